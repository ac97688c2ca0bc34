"""Incremental loads as finite streams over a landing folder.

Each call processes the files that arrived since the last one and stops. The
checkpoint remembers the files, so each is processed exactly once; it and the
targets belong in a folder all executors reach.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from strata.functions.exprs import ratio
from strata.operators.quality import Check, Watch
from strata.operators.refresh import Buckets, incremental_upsert
from strata.sources.sinks import replace_partitions


def landing(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def stream_append(rows: DataFrame, target: str, checkpoint: str) -> None:
    """Append new files' rows; the sink's own log makes a retried batch harmless."""
    writer = rows.writeStream.format("parquet").outputMode("append")
    _drain(writer.option("path", target).option("checkpointLocation", checkpoint))


def stream_upsert(
    rows: DataFrame, table: Buckets, newest_first: Sequence[str], checkpoint: str
) -> None:
    """Upsert each batch by key, rewriting the buckets it touches; the newest row per key stays, whatever the order of
    the files, and repeating a batch leaves the table as it is."""

    def load(batch: DataFrame, _: int) -> None:
        incremental_upsert(batch, table, newest_first)

    _drain(rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint))


def stream_checked(rows: DataFrame, target: str, report: str, table: str, checks: Sequence[Check], checkpoint: str) -> None:
    """Append each batch and, from the same pass, its quality report to the table ``report`` (with ``batch_id``)."""

    def load(batch: DataFrame, number: int) -> None:
        watch = Watch(table, checks)
        # A batch that is tried again replaces what the first try left.
        replace_partitions(batch.withColumn("batch_id", F.lit(number).cast("bigint")), target, ["batch_id"], watch=watch)
        found = watch.report(batch.sparkSession).withColumn("batch_id", F.lit(number).cast("bigint"))
        replace_partitions(found, report, ["batch_id"])

    _drain(rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint))


def stream_dedupe(
    rows: DataFrame, keys: Sequence[str], ts_col: str, delay: str, target: str, checkpoint: str, partitions: int | None = None
) -> int:
    """Append rows whose key was not delivered before within ``delay``, by whatever file; returns the rows dropped as late.

    Keys are kept as state until the watermark, ``delay`` behind the newest row, has passed them; older rows are late and not taken,
    since nobody knows any more whether they were.
    """
    timed = rows.withColumn("_ts", F.col(ts_col).cast("timestamp")).withWatermark("_ts", delay)
    fresh = timed.dropDuplicatesWithinWatermark(list(keys)).drop("_ts")
    writer = fresh.writeStream.format("parquet").outputMode("append")
    return _drain(writer.option("path", target).option("checkpointLocation", checkpoint), rows.sparkSession, partitions)


def daily_state(readings: DataFrame, delay: str) -> DataFrame:
    """Running sums per day; rows later than ``delay`` behind the newest are dropped."""
    timed = readings.withColumn("_ts", F.col("reading_ts").cast("timestamp")).withWatermark("_ts", delay)
    return timed.groupBy(F.window("_ts", "1 day").alias("_day")).agg(
        F.sum("temperature_2m").alias("temperature_sum"),
        F.min("temperature_2m").alias("min_temperature"),
        F.max("temperature_2m").alias("max_temperature"),
        F.sum("precipitation").cast("decimal(22,2)").alias("total_precipitation"),
        F.count("temperature_2m").alias("temperature_count"),
        F.count("*").alias("measurement_count"),
    )


def stream_daily_weather(
    readings: DataFrame, target: str, checkpoint: str, delay: str = "1 day", partitions: int | None = None
) -> int:
    """Daily aggregates kept up to date, one partition per day; returns how many rows came too late.

    Update mode delivers every changed day with its full totals; writing it
    replaces that day's partition. (Append mode would hold back the days still
    open when the stream ends.) ``partitions`` of the state, by default the session's shuffle partitions, are fixed by the first run
    with this checkpoint; the state holds a row per day, so few are enough. Late rows are counted after each task has
    summed them by day.
    """

    def store(batch: DataFrame, _: int) -> None:
        days = batch.select(
            F.to_date("_day.start").alias("measurement_date"),
            ratio("temperature_sum", "temperature_count").alias("avg_temperature"),
            "min_temperature",
            "max_temperature",
            "total_precipitation",
            "measurement_count",
        )
        replace_partitions(days, target, ["measurement_date"])

    return _drain(
        daily_state(readings, delay)
        .writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint),
        readings.sparkSession,
        partitions,
    )


def _drain(writer, spark: SparkSession | None = None, partitions: int | None = None) -> int:
    """Run to the end of what has arrived; the rows that stateful operators dropped as late."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key) if partitions else None
    if partitions:
        spark.conf.set(key, str(partitions))
    try:
        query = writer.trigger(availableNow=True).start()
    finally:
        if partitions:
            spark.conf.set(key, before)
    query.awaitTermination()
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
