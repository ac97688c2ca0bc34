"""Top-k, ranks and running totals that do not pass through one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strata.operators.staging import settled


def top_k(df: DataFrame, by: str, k: int, tie: Sequence[str]) -> DataFrame:
    """The ``k`` largest rows: every task keeps its own k, then those are merged."""
    return df.orderBy(F.col(by).desc(), *tie).limit(k)


def top_k_by_metric(df: DataFrame, metrics: Mapping[str, str], k: int, tie: str, keep: Sequence[str]) -> DataFrame:
    """Several rankings of one frame, stacked: (analysis_type, metric_value, rank).

    The frame is read once and unpivoted; the rank filter is applied in every
    task before the shuffle, so only ``k`` rows per task and metric move.
    """
    pairs = ", ".join(f"'{label}', `{column}`" for label, column in metrics.items())
    stacked = df.select(tie, *keep, F.expr(f"stack({len(metrics)}, {pairs}) AS (analysis_type, metric_value)"))
    best = W.partitionBy("analysis_type").orderBy(F.col("metric_value").desc(), tie)
    return stacked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def running_total(df: DataFrame, value: str, tie: str, partitions: int | None = None) -> DataFrame:
    """Rank and running sum over the whole frame in falling order of ``value``.

    Adds ``rank``, ``running`` and ``total``. A window without partitions would
    send every row to one task. Instead rows are range-partitioned on (value,
    tie), so equal values may spread over ranges and no range is much larger
    than another. The ranges are stored with their number, which fixes them for
    every later use. Each range then needs only the totals of the ranges before
    it, of which there is one row per range.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, F.col(value).desc(), F.col(tie)).withColumn("_range", F.spark_partition_id())
    stored = settled(ranged, "ranges")

    sums = stored.groupBy("_range").agg(F.sum(value).alias("_sum"), F.count("*").alias("_rows"))
    # One row per range, at most `n`: small by construction, for this window as for the broadcast.
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    offsets = sums.select(
        "_range",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum_before"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        F.sum("_sum").over(everything).alias("total"),
    )
    inside = W.partitionBy("_range").orderBy(F.col(value).desc(), tie)
    local = stored.select(
        "*",
        F.row_number().over(inside).alias("_rn"),
        F.sum(value).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("_run"),
    )
    joined = local.join(F.broadcast(offsets), "_range")
    return joined.withColumns(
        {"rank": F.col("_rn") + F.col("_rows_before"), "running": F.col("_run") + F.col("_sum_before")}
    ).drop("_range", "_rn", "_run", "_sum_before", "_rows_before")


def previous(c: Column | str, *order: str) -> Column:
    """Value of the row before, over a frame that holds one row per period."""
    return F.lag(c).over(W.orderBy(*order))
