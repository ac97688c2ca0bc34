"""Stage layer: projections, casts, run metadata, cleaning, last versions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.functions import retail, weather
from strata.session import intermediate_dir
from strata.sources.sinks import ONE_PART, Parts, Watched, as_is, full_refresh, write_parts
from strata.sources.star import ORDER_LINE_COLUMNS
from strata.sources.tables import read_table

READING_COLUMNS = ("temperature_2m", "relative_humidity_2m", "wind_speed_10m", "precipitation")


def at(ts: dt.datetime):
    """A job's time parameter as a zoneless timestamp."""
    return F.lit(ts).cast("timestamp_ntz")


def stage_orders(lines: DataFrame, load_ts: dt.datetime, columns: Sequence[str] = ORDER_LINE_COLUMNS) -> DataFrame:
    return lines.select(*columns).withColumn("load_ts", at(load_ts))


def with_run_metadata(df: DataFrame, load_ts: dt.datetime, run_started: dt.datetime, run_id: str) -> DataFrame:
    return df.withColumns({"loaded_at": at(load_ts), "run_started_at": at(run_started), "run_id": F.lit(run_id)})


RUN_METADATA = ("loaded_at", "run_started_at", "run_id")


def run_marks(df: DataFrame) -> list:
    """The greatest load time, run start and run id of a group, of those the rows carry."""
    return [F.max(c).alias(c) for c in RUN_METADATA if c in df.columns]


def run_times(df: DataFrame) -> dict:
    """The load time and run start among a fold's measures, of those the rows carry."""
    return {c: ("max", F.col(c)) for c in RUN_METADATA[:2] if c in df.columns}


def run_names(df: DataFrame) -> list[str]:
    """The run id, a text, is a group of a fold's rows rather than a measure."""
    return [c for c in RUN_METADATA[2:] if c in df.columns]


def with_net_sales(lines: DataFrame) -> DataFrame:
    return lines.withColumn("net_sales", retail.net_sales())


def with_margin_pct(lines: DataFrame) -> DataFrame:
    return lines.withColumn("profit_margin_pct", retail.margin_pct())


def clean_orders(lines: DataFrame) -> DataFrame:
    dates = {c: F.col(c).cast("date") for c in ("order_date", "ship_date")}
    return lines.withColumns(dates).withColumn("sales_amount", F.col("sales").cast("decimal(9,2)")).drop("sales")


def stage_readings(readings: DataFrame, load_ts: dt.datetime, keep: Sequence[str] = ()) -> DataFrame:
    return readings.select(*keep, *READING_COLUMNS).withColumn("load_ts", at(load_ts))


def stage_weather(readings: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Measures under their units, with Fahrenheit and km/h; empty readings are left out.

    The reading's own time is the measurement time.
    """
    t, h, w, p = READING_COLUMNS
    return drop_all_null(readings, READING_COLUMNS).select(
        *keep,
        F.col("reading_ts").alias("measured_at"),
        F.to_date("reading_ts").alias("measurement_date"),
        F.col(t).alias("temperature_celsius"),
        weather.fahrenheit(t).alias("temperature_fahrenheit"),
        F.col(h).alias("humidity_percent"),
        F.col(w).alias("wind_speed_ms"),
        weather.kmh(w).alias("wind_speed_kmh"),
        F.col(p).alias("precipitation_mm"),
    )


def drop_all_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop("all", subset=list(cols))


def dedupe(df: DataFrame, keys: Sequence[str], newest_first: Sequence[str]) -> DataFrame:
    """The newest row per key; rows equal in ``newest_first`` are told apart by their other columns.

    An aggregate, not a window: each task keeps one row per key before anything
    is shuffled, also when a join above was split, so the copies of a hot key
    never meet in one task. Columns must be comparable (no maps).
    """
    order = [c for c in newest_first if c not in keys]
    others = [c for c in df.columns if c not in keys and c not in order]
    newest = df.groupBy(*keys).agg(F.max(F.struct(*order, *others)).alias("_newest"))
    return newest.select(*[c if c in keys else F.col("_newest").getField(c).alias(c) for c in df.columns])


def as_view(df: DataFrame, name: str) -> DataFrame:
    """A named view, recomputed whenever it is read."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def settled(df: DataFrame, name: str, parts: Parts = ONE_PART, watch: Watched = as_is) -> DataFrame:
    """The frame stored in the shared folder, part by part, and read back. ``watch`` sees the rows as they are written.

    What follows starts from its files: it is computed once, and joins choose
    between broadcast and shuffle by its real size, not by an estimate. Inside
    :func:`strata.session.scratch` the files go when the run ends.
    """
    spark: SparkSession = df.sparkSession
    path = intermediate_dir(spark, name)
    write_parts(df, path, parts, watch)
    return spark.read.schema(df.schema).parquet(path)


def as_table(df: DataFrame, target: str) -> DataFrame:
    """A table rebuilt in full; the old one stays until the new one is written."""
    full_refresh(df, target)
    return read_table(df.sparkSession, target)
