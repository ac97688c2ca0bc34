"""Incremental refresh: marks, appends, upserts, regrouped aggregates.

The mark of a load is best a column that every row carries from the load that brought it (``loaded_at`` of
:func:`strata.operators.staging.with_run_metadata`): it rises from load to load whatever the rows' business dates are.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, DateType, NumericType, StructType, TimestampNTZType, TimestampType

from strata.operators.staging import dedupe, settled
from strata.session import scratch
from strata.sources.schema import check_schema_unchanged
from strata.operators.deltas import ADDED, ANEW, CLEARED, WHOLE, Deltas
from strata.sources.marks import append_marked, observed, save_mark, stored_mark
from strata.sources.sinks import ONE_PART, Parts, Watched, append, as_is, replace_partitions, write_partitioned
from strata.sources.tables import Folder, read_table, stored, stored_schema


class MovedKey(ValueError):
    """A batch row belongs to another partition than the stored row with its key."""


def _before_everything(t: DataType) -> Column:
    if isinstance(t, (DateType, TimestampType, TimestampNTZType)):
        return F.lit("0001-01-01").cast(t)
    if isinstance(t, NumericType):
        return F.lit(float("-inf")) if t.typeName() in ("float", "double") else F.lit(-(2**63) + 1).cast("decimal(20,0)")
    return F.lit("")


def high_water_mark(target: DataFrame, mark: str) -> Column:
    """The target's greatest mark as a scalar subquery; an empty target lies before every row."""
    first = _before_everything(target.schema[mark].dataType)
    return target.agg(F.coalesce(F.max(mark), first)).scalar()


def newer_rows(source: DataFrame, target: DataFrame | Column | None, mark: str, inclusive: bool = False) -> DataFrame:
    """Source rows above the target's mark (``inclusive``: from the mark on), all marked ones if there is no target.

    The target is its stored mark (:func:`strata.sources.marks.stored_mark`), so that nothing but the source is read, or a frame
    whose mark is searched. A row without a mark is in no load, not even the first; :func:`unmarked` has them. Where the mark is
    a column of the source's files, the comparison reaches the scan and skips older row groups.
    """
    if target is None:
        return source.where(F.col(mark).isNotNull())
    limit = target if isinstance(target, Column) else high_water_mark(target, mark)
    return source.where(F.col(mark) >= limit if inclusive else F.col(mark) > limit)


def unmarked(source: DataFrame, mark: str) -> DataFrame:
    """The rows no load by this mark takes."""
    return source.where(F.col(mark).isNull())


def new_keys_only(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the target does not have."""
    return source.join(target.select(*keys).distinct(), list(keys), "left_anti")


def incremental_append(
    source: DataFrame, target: str, mark: str, keys: Sequence[str] | None = None, fixed_schema: bool = False
) -> int:
    """Append the rows above the target's stored mark, the first time all; returns how many rows have no mark and stay out.

    Without ``keys`` late rows that equal the mark are lost. With ``keys`` the
    comparison includes the mark, and rows already stored at it are left out.
    """
    spark = source.sparkSession
    current = stored(spark, target)
    if current is not None and fixed_schema:
        check_schema_unchanged(source, current.schema)
    limit = stored_mark(spark, target, mark)
    new = newer_rows(source, limit, mark, inclusive=keys is not None)
    if current is not None and limit is not None and keys is not None:
        # The limit is a constant, so of the target only row groups that reach the mark are read.
        new = new_keys_only(new, current.where(F.col(mark) >= limit), keys)
    append_marked(new, target, mark)
    return unmarked(source, mark).count()


def merged(
    current: DataFrame, batch: DataFrame, keys: Sequence[str], newest_first: Sequence[str] | None = None
) -> DataFrame:
    """The batch and the current rows whose key it does not have; with ``newest_first`` the newest of both per key.

    A batch row that is as new as the stored one replaces it.
    """
    batch = batch.select(*current.columns)
    if newest_first:
        both = current.withColumn("_late", F.lit(0)).unionByName(batch.withColumn("_late", F.lit(1)))
        return dedupe(both, keys, [*newest_first, "_late"]).drop("_late")
    return null_safe(current, batch.select(*keys), keys, "left_anti").unionByName(batch)


class Versions:
    """A table replaced as a whole: each version is a new folder, readers take the newest complete one.

    A version that was not finished has no success marker and is never read. Publishing removes versions older than
    the one before, which readers may still hold.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._folder = Folder(spark, root)

    def _numbers(self) -> list[int]:
        return sorted(int(n[1:]) for n in self._folder.names() if n.startswith("v") and n[1:].isdigit())

    def _complete(self) -> list[int]:
        return [n for n in self._numbers() if self._version(n).child("_SUCCESS").exists()]

    def _version(self, n: int) -> Folder:
        return self._folder.child(f"v{n:06d}")

    def current(self) -> DataFrame | None:
        complete = self._complete()
        return read_table(self.spark, self._version(complete[-1]).path) if complete else None

    def mark(self, name: str) -> Column | None:
        """The current version's greatest mark, from the file beside it."""
        complete = self._complete()
        return stored_mark(self.spark, self._version(complete[-1]).path, name) if complete else None

    def publish(self, df: DataFrame, mark: str | None = None) -> DataFrame:
        """``mark``: the column whose greatest value is kept beside the version."""
        before = self._complete()
        folder = self._version(max(self._numbers(), default=0) + 1)
        if mark is None:
            df.write.mode("errorifexists").parquet(folder.path)
        else:
            noted, note = observed(df, mark)
            noted.write.mode("errorifexists").parquet(folder.path)
            save_mark(self.spark, folder.path, df.schema[mark].dataType.simpleString(), note.get.get("mark"))
        for n in self._numbers():
            if before and n < before[-1]:
                self._version(n).delete()
        return read_table(self.spark, folder.path)


BUCKET = "_bucket"


class RepeatedKey(ValueError):
    """A batch has a key more than once, and no order says which row is the newest."""


class OtherBuckets(ValueError):
    """A stored table has another number of buckets, or other keys, than it is opened with."""


BUCKETS_FILE = "_strata_buckets"


class Buckets:
    """A keyed table in ``n`` buckets by a hash of the key; an upsert rewrites the buckets it touches only.

    ``n`` is fixed when the table is made (64 unless given; choose it so that a bucket is a few files) and stored with it.
    An existing table is opened with its own number; asking for another, or for other keys, raises :class:`OtherBuckets`.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], n: int | None = None):
        self.spark, self.root, self.keys = spark, root, list(keys)
        self._file = Folder(spark, f"{root}/{BUCKETS_FILE}")
        self.n = n or 64
        if self._file.exists():
            kept = json.loads(self._file.read_text())
            if n not in (None, kept["n"]) or kept["keys"] != self.keys:
                raise OtherBuckets(f"{root} has {kept['n']} buckets by {kept['keys']}, not {n} by {self.keys}")
            self.n = kept["n"]
        elif (there := stored(spark, root)) is not None:
            # Made before the number was stored: it is taken as asked for, once every row lies where that number puts it.
            wrong = self.bucketed(there.withColumnRenamed(BUCKET, "_there")).where(F.col(BUCKET) != F.col("_there"))
            if not wrong.isEmpty():
                raise OtherBuckets(f"{root} does not have {self.n} buckets by {self.keys}")
            self.keep()

    def keep(self) -> None:
        """Store the number beside the table."""
        self._file.write_text(json.dumps({"n": self.n, "keys": self.keys}))

    def bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.n)).cast("int"))

    def current(self) -> DataFrame | None:
        df = stored(self.spark, self.root)
        return None if df is None else df.drop(BUCKET)


def fitted(batch: DataFrame, schema: StructType, evolve: bool) -> DataFrame:
    """``batch`` with the stored columns. Any drift raises :class:`~strata.sources.schema.SchemaChanged`; with
    ``evolve`` new columns stay and missing ones are null, only retyped columns raise."""
    if not evolve:
        return check_schema_unchanged(batch, schema)
    have = {f.name for f in batch.schema}
    batch = batch.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in have})
    kept = StructType([f for f in batch.schema if f.name in set(schema.names)])
    return check_schema_unchanged(batch.select(*kept.names), schema) and batch


def incremental_upsert(
    batch: DataFrame, table: Buckets, newest_first: Sequence[str] | None = None, evolve: bool = False, parts: int = 1
) -> DataFrame:
    """Replace the rows with the batch's keys, add the others; only the buckets of these keys are rewritten.

    With ``newest_first`` the newest row per key wins, within the batch and against the stored row, so batches may come
    in any order and repeat. Without it a key that the batch repeats raises :class:`RepeatedKey`. ``parts``: see
    :func:`upsert_partitions`.
    """
    upsert_partitions(
        table.bucketed(batch), table.root, table.keys, [BUCKET], newest_first=newest_first, check_moved=False, evolve=evolve, parts=parts
    )
    table.keep()
    return table.current()


def upsert_partitions(
    batch: DataFrame,
    target: str,
    keys: Sequence[str],
    partition_cols: Sequence[str],
    sort_cols: Sequence[str] = (),
    newest_first: Sequence[str] | None = None,
    check_moved: bool = True,
    evolve: bool = False,
    parts: int = 1,
) -> None:
    """Upsert that rewrites only the partitions the batch touches; drift raises unless ``evolve`` (:func:`fitted`).

    The partition of a key must not change between loads. Unless the partition
    columns are part of the key, this is checked (a scan of the stored keys,
    ``check_moved=False`` leaves it out) and :class:`MovedKey` raised. The batch is computed once and stored. Without
    ``newest_first`` a key that it repeats raises :class:`RepeatedKey`, before anything is written.

    With ``parts`` the batch is reduced and stored in so many parts by its keys, then the touched partitions are rewritten in so many
    sets, one after the other: disk is needed for the shuffles of one. An upsert that ends half way has done whole partitions, and
    is run again.
    """
    spark = batch.sparkSession
    latest = dedupe(batch, keys, newest_first) if newest_first else batch
    current = stored(spark, target)
    with scratch(spark):
        if not newest_first:
            latest = settled(latest, "unordered", Parts(keys, parts))
            refuse_repeats(latest, keys)
        if current is None:
            write_partitioned(latest, target, partition_cols, sort_cols, parts=Parts(keys, parts))
            return
        latest = settled(fitted(latest, current.schema, evolve), "batch", Parts(keys, parts))
        if check_moved and not set(partition_cols) <= set(keys):
            _check_partitions_stay(current, latest, keys, partition_cols)
        if evolve:
            have = set(current.columns)
            new = {f.name: F.lit(None).cast(f.dataType) for f in latest.schema if f.name not in have}
            current = current.withColumns(new)
        sets = Parts(partition_cols, parts)
        for ours, theirs in zip(sets.of(current), sets.of(latest)):
            # One row per partition that the batch touches: the stored rows need not be shuffled to find theirs.
            touched = null_safe(ours, F.broadcast(theirs.select(*partition_cols).distinct()), partition_cols, "left_semi")
            replace_partitions(merged(touched, theirs, keys, newest_first), target, partition_cols, sort_cols)


def refuse_repeats(batch: DataFrame, keys: Sequence[str]) -> None:
    """Raise if a key, missing values included, occurs twice."""
    twice = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if not twice.isEmpty():
        raise RepeatedKey(f"the batch has rows with the same {list(keys)}; give newest_first, or keep one of each")


def _check_partitions_stay(current, latest, keys, partition_cols) -> None:
    here = latest.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*partition_cols).alias("_new"))
    there = current.select(*keys, F.struct(*partition_cols).alias("_old"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    moved = here.join(there, same).where(~F.col("_old").eqNullSafe(F.col("_new")))
    if not moved.isEmpty():
        raise MovedKey(f"a key of the batch is stored under other values of {list(partition_cols)}")


def incremental_aggregate(
    source: DataFrame,
    table: Versions,
    keys: Sequence[str],
    mark: str,
    aggregate: Callable[[DataFrame], DataFrame],
    parts: Parts = ONE_PART,
) -> DataFrame:
    """Bring an aggregate table up to date: groups with new rows are aggregated anew from all their rows.

    ``mark`` is a load mark on the source's rows, and ``aggregate`` carries its greatest value per group. Groups with
    rows at the table's mark or above it, or without a mark, are built again: whole groups, so a second load at the same mark
    is taken and repeating one changes nothing. Late business dates do no harm; a late *mark* (below one already
    loaded) is not seen, so business dates are no marks. With ``parts`` (by ``keys``) the groups are built part by part, and
    published together.
    """
    current = table.current()
    limit = table.mark(mark)
    with scratch(source.sparkSession):
        rows = source
        if limit is not None:
            touched = source.where((F.col(mark) >= limit) | F.col(mark).isNull()).select(*keys).distinct()
            if parts.n > 1:
                touched = settled(touched, "touched")
            rows = null_safe(source, touched, keys, "left_semi")
        groups = aggregate(rows)
        if mark not in groups.columns:
            raise ValueError(f"the aggregate does not carry its mark {mark!r}")
        if current is not None or parts.n > 1:
            groups = settled(groups, "groups", parts)
        if current is None:
            return table.publish(groups, mark)
        kept = null_safe(current, groups.select(*keys), keys, "left_anti")
        return table.publish(kept.unionByName(groups.select(*current.columns)), mark)


def incremental_states(
    source: DataFrame,
    table: Deltas,
    keys: Sequence[str],
    mark: str,
    fold: Callable[[DataFrame], DataFrame],
    changed: DataFrame | None = None,
) -> int:
    """Bring a table of mergeable states (:func:`strata.operators.deltas.adding_states`) up to date; returns the rows written.

    ``fold`` makes states of rows, by ``keys`` and finer columns, and carries the greatest ``mark``. A load folds the rows above the stored
    mark and appends their states: nothing stored is read or written again, so a load costs what it brings. States
    cannot take rows back: the groups of ``changed`` (``keys``), whose loaded rows were replaced or removed in the source, are made anew
    from all their rows. Rows that come late at a mark already stored are not seen.
    """
    limit = table.mark()
    new = newer_rows(source, limit, mark)
    if changed is None or limit is None:
        return table.add(fold(new).withColumn(WHOLE, F.lit(ADDED)), mark)
    with scratch(source.sparkSession):
        groups = settled(changed.select(*keys).distinct(), "changed")
        added = fold(null_safe(new, groups, keys, "left_anti")).withColumn(WHOLE, F.lit(ADDED))
        marked = source.where(F.col(mark).isNotNull())
        anew = fold(null_safe(marked, groups, keys, "left_semi")).withColumn(WHOLE, F.lit(ANEW))
        # A group that lost all its rows is cleared by this row alone.
        others = [F.lit(None).cast(f.dataType).alias(f.name) for f in added.schema if f.name not in (*keys, WHOLE)]
        cleared = groups.select(*keys, *others, F.lit(CLEARED).alias(WHOLE))
        return table.add(added.unionByName(anew).unionByName(cleared), mark)


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """A semi or anti join in which a missing key value is a value as any other."""
    other = right.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = [left[k].eqNullSafe(other[f"_{k}"]) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return left.join(other, condition, how)


def partition_refresh(
    df: DataFrame, target: str, partition_cols: Sequence[str], sort_cols: Sequence[str] = (), watch: Watched = as_is
) -> None:
    """Rewrite the partitions present in ``df``, leave the others. A drifting frame raises."""
    schema = stored_schema(df.sparkSession, target)
    if schema is not None:
        check_schema_unchanged(df, schema)
    replace_partitions(df, target, partition_cols, sort_cols, watch)


def guarded_append(df: DataFrame, target: str) -> None:
    """Append that fails on any column drift."""
    current = stored(df.sparkSession, target)
    append(df if current is None else check_schema_unchanged(df, current.schema), target)
