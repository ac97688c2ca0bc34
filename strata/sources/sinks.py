"""Writing tables: new, full refresh, append, by day, by partition; removing days and expired partitions.

Tables are Parquet folders. A write by partition first rebalances on the
partition columns: small partitions are merged into few files and a hot one is
split over many tasks at run time.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DatetimeType, NumericType

from strata.sources.scans import in_days
from strata.sources.tables import drop_partitions, partition_values, read_table, refuse_empty, save_schema, swap_in


Watched = Callable[[DataFrame], DataFrame]


def as_is(df: DataFrame) -> DataFrame:
    return df


def write_new(df: DataFrame, target: str) -> None:
    """Fails when the target exists."""
    df.write.mode("errorifexists").parquet(target)


def jdbc_options(url: str, table: str, **options: str) -> dict[str, str]:
    return {"url": url, "dbtable": table, **options}


def write_new_jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    df.write.format("jdbc").options(**jdbc_options(url, table, **options)).mode("errorifexists").save()


class Parts(NamedTuple):
    """A frame's rows in ``n`` parts by a hash of ``by``, each computed and written by a job of its own: a part's shuffles are
    gone before the next one's, so disk is needed for one part at a time. Each part reads the frame's sources again; where
    ``by`` are columns of theirs, or keys of its joins and aggregates, only the part's rows leave the scans."""

    by: Sequence[str] = ()
    n: int = 1

    def of(self, df: DataFrame) -> list[DataFrame]:
        if self.n == 1:
            return [df]
        place = F.pmod(F.xxhash64(*self.by), F.lit(self.n))
        return [df.where(place == i) for i in range(self.n)]


ONE_PART = Parts()


def write_parts(df: DataFrame, path: str, parts: Parts = ONE_PART, watch: Watched = as_is) -> None:
    """A new folder of the rows, part by part."""
    for part in parts.of(df):
        watch(part).write.mode("append" if parts.n > 1 else "errorifexists").parquet(path)


def full_refresh(df: DataFrame, target: str, parts: Parts = ONE_PART, watch: Watched = as_is) -> None:
    """Rebuild a table; until the new one is written, and if that fails, the old one stays."""
    swap_in(df.sparkSession, target, lambda path: write_parts(df, path, parts, watch))


def append(df: DataFrame, target: str) -> None:
    """Creates the target on the first load."""
    df.write.mode("append").parquet(target)


def rebalanced(df: DataFrame, partition_cols: Sequence[str]) -> DataFrame:
    return df.hint("rebalance", *partition_cols)


def laid_out(df: DataFrame, partition_cols: Sequence[str], sort_cols: Sequence[str]) -> DataFrame:
    checked = refuse_empty(df, partition_cols)
    return rebalanced(checked, partition_cols).sortWithinPartitions(*partition_cols, *sort_cols)


def stored_order(df: DataFrame, partition_cols: Sequence[str]):
    """The frame's schema as its files give it back: partition columns last."""
    return df.select(*[c for c in df.columns if c not in partition_cols], *partition_cols).schema


def write_partitioned(
    df: DataFrame, target: str, partition_cols: Sequence[str], sort_cols: Sequence[str] = (), watch: Watched = as_is,
    parts: Parts = ONE_PART, derive: Watched = as_is,
) -> None:
    """Rebuild a table in partition folders, each file sorted by ``sort_cols`` for min/max skipping. ``derive`` adds columns to the
    rows in their place, so that no shuffle carries these; ``watch`` sees the rows as they are written. Each of several ``parts``
    has files of its own in the folders."""

    def write(path: str) -> None:
        for part in parts.of(df):
            laid = watch(derive(laid_out(part, partition_cols, sort_cols)))
            laid.write.mode("append" if parts.n > 1 else "errorifexists").partitionBy(*partition_cols).parquet(path)
        save_schema(df.sparkSession, path, stored_order(derive(df), partition_cols))

    swap_in(df.sparkSession, target, write)


def interleaved_rank(df: DataFrame, columns: Sequence[str], bits: int = 6) -> Column:
    """Place of a row on a curve through all ``columns`` at once: the bits of its rank in each of them in turn.

    A rank is the number of limits below the value, at most ``2 ** bits - 1``. The limits are approximate quantiles, found in one pass;
    only they come to the driver. Columns are numbers, dates or timestamps; a missing value has rank 0.
    """
    for c in columns:
        if not isinstance(df.schema[c].dataType, (NumericType, DatetimeType)):
            raise TypeError(f"{c} has no quantiles")
    shares = [k / 2**bits for k in range(1, 2**bits)]
    limits = df.agg(*[F.percentile_approx(c, shares, 10 * 2**bits).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    place = F.lit(0).cast("bigint")
    for i, c in enumerate(columns):
        kind = df.schema[c].dataType
        below = F.array(*[F.lit(x).cast(kind) for x in sorted(set(limits[i] or []))])
        rank = F.coalesce(F.size(F.filter(below, _under(F.col(c)))), F.lit(0)).cast("bigint")
        for b in range(bits):
            bit = F.call_function("shiftright", rank, F.lit(b)).bitwiseAND(1)
            place = place + bit * F.lit(1 << (b * len(columns) + i)).cast("bigint")
    return place


def _under(c: Column):
    return lambda limit: limit < c


def write_interleaved(df: DataFrame, target: str, columns: Sequence[str], bits: int = 6) -> None:
    """Rebuild a table so that a filter on any of ``columns`` skips most files and row groups, not only one on the first.

    Rows are range-partitioned and sorted by :func:`interleaved_rank`, so a file covers a small range of every column.
    """
    ranked = df.withColumn("_place", interleaved_rank(df, columns, bits))
    laid = ranked.repartitionByRange("_place").sortWithinPartitions("_place").drop("_place")
    swap_in(df.sparkSession, target, laid.write.parquet)


def replace_partitions(
    df: DataFrame, target: str, partition_cols: Sequence[str], sort_cols: Sequence[str] = (), watch: Watched = as_is
) -> None:
    """Rewrite only the partitions that occur in ``df``; running it twice changes nothing. ``watch`` sees the rows as they are
    written."""
    writer = watch(laid_out(df, partition_cols, sort_cols)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_cols).parquet(target)
    save_schema(df.sparkSession, target, stored_order(df, partition_cols))


def load_days(df: DataFrame, target: str, ts_col: str, day_col: str = "load_day") -> None:
    """Store all rows by day; days that occur in ``df`` are replaced, others stay."""
    replace_partitions(df.withColumn(day_col, F.to_date(ts_col)), target, [day_col], [ts_col])


def backfill(df: DataFrame, target: str, ts_col: str, first: dt.date, last: dt.date, day_col="load_day") -> None:
    """Replace every day from ``first`` to ``last`` by what ``df`` has of it, in one job; a day without rows is emptied."""
    spark = df.sparkSession
    days = [first + dt.timedelta(days=i) for i in range((last - first).days + 1)]
    rows = df.where(in_days(ts_col, first, len(days)))
    load_days(rows, target, ts_col, day_col)
    # At most one row per day of the range.
    there = {r[0] for r in rows.select(F.to_date(ts_col)).distinct().collect()}
    drop_partitions(spark, target, day_col, [d.isoformat() for d in days if d not in there])


def replace_day(df: DataFrame, target: str, ts_col: str, day: dt.date, day_col: str = "load_day") -> None:
    """Replace one day by what ``df`` has of it; without rows the day is emptied."""
    backfill(df, target, ts_col, day, day, day_col)


def expire_partitions(spark: SparkSession, target: str, day_col: str, days: int, as_of: dt.date) -> list[str]:
    """Remove a stored table's partitions older than ``days`` days; returns their values.

    Values are days (2024-01-31) or months (202401, old once their last day is). Others stay, as does the
    partition of rows without a date.
    """
    limit = as_of - dt.timedelta(days=days)
    gone = [v for v in partition_values(spark, target, day_col) if (last := last_day(v)) is not None and last <= limit]
    drop_partitions(spark, target, day_col, gone)
    return sorted(gone)


def expire_rows(
    spark: SparkSession, target: str, day_col: str, ts_col: str, days: int, as_of: dt.date, sort_cols: Sequence[str] = ()
) -> list[str]:
    """:func:`expire_partitions`, and the expired rows of the partitions that reach over the limit: those are rewritten
    without them. Returns the values of the partitions removed or rewritten."""
    gone = expire_partitions(spark, target, day_col, days, as_of)
    limit = as_of - dt.timedelta(days=days)
    # A month that holds the day of the limit; a day's partition does not reach over it.
    value = limit.strftime("%Y%m")
    if value not in partition_values(spark, target, day_col):
        return gone
    table = read_table(spark, target)
    own = table.where(F.col(day_col).cast("string") == value)
    kept = own.where(F.col(ts_col).isNull() | (F.to_date(ts_col) > F.lit(limit)))
    if kept.isEmpty():
        drop_partitions(spark, target, day_col, [value])
    else:
        replace_partitions(kept, target, [day_col], sort_cols)
    return sorted([*gone, value])


def last_day(value: str) -> dt.date | None:
    """Last day of a partition named by a day or a month."""
    try:
        if len(value) == 6:
            first = dt.datetime.strptime(value, "%Y%m").date()
            return (first + dt.timedelta(days=31)).replace(day=1) - dt.timedelta(days=1)
        return dt.date.fromisoformat(value)
    except ValueError:
        return None


def load_all(
    spark: SparkSession,
    sources: Mapping[str, Callable[[], DataFrame]],
    folder: str,
    parallel: int = 4,
) -> dict[str, DataFrame]:
    """Load every declared source. The loads are independent Spark jobs, a few at a time."""

    def load(item):
        name, read = item
        full_refresh(read(), f"{folder}/{name}")
        return name, read_table(spark, f"{folder}/{name}")

    with ThreadPoolExecutor(parallel) as pool:
        return dict(pool.map(load, sources.items()))
