"""Stored tables: exact schemas, swaps that leave the old table until the new one is whole, removal of partitions.

Partition columns live in folder names, from which Spark guesses their types ('01' becomes 1). A table written here
keeps its schema beside its data, in a folder that readers of the data skip, and is read back with it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

SCHEMA_FILE = "_strata_schema"


class EmptyPartitionValue(ValueError):
    """Folder names cannot tell an empty text from a missing value."""


class Folder:
    """A folder of any file system Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def child(self, name: str) -> Folder:
        return Folder(self.spark, f"{self.path}/{name}")

    def exists(self) -> bool:
        return self._fs.exists(self._path)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path)] if self.exists() else []

    def delete(self) -> None:
        self._fs.delete(self._path, True)

    def move(self, target: Folder) -> None:
        if not self._fs.rename(self._path, target._path):
            raise OSError(f"cannot move {self.path} to {target.path}")

    def write_text(self, text: str) -> None:
        out = self._fs.create(self._path, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read_text(self) -> str:
        stream = self._fs.open(self._path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


def save_schema(spark: SparkSession, path: str, schema: StructType) -> None:
    Folder(spark, f"{path}/{SCHEMA_FILE}").write_text(schema.json())


def stored_schema(spark: SparkSession, path: str) -> StructType | None:
    file = Folder(spark, f"{path}/{SCHEMA_FILE}")
    return StructType.fromJson(json.loads(file.read_text())) if file.exists() else None


def place_of(spark: SparkSession, path: str) -> str:
    """Where the table's rows are: at ``path``, or, while :func:`swap_in` or a crash has left nothing there, in the old
    table it moved aside."""
    if Folder(spark, path).exists():
        return path
    above, _, name = path.rstrip("/").rpartition("/")
    aside = [n for n in Folder(spark, above or "/").names() if n.startswith(f"{name}.old-")] if above else []
    return f"{above}/{max(aside)}" if aside else path


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The table at ``path`` with the schema it was written with; ``schema`` is for tables that keep none."""
    path = place_of(spark, path)
    known = stored_schema(spark, path) or schema
    return spark.read.parquet(path) if known is None else spark.read.schema(known).parquet(path)


def stored(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    """:func:`read_table`, or None before the first load."""
    try:
        df = read_table(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return df


def refuse_empty(df: DataFrame, partition_cols: Sequence[str]) -> DataFrame:
    """Fail on rows whose text partition value is empty; it would be read back as missing."""
    texts = [c for c in partition_cols if isinstance(df.schema[c].dataType, StringType)]
    message = lambda c: F.raise_error(F.lit(f"{EmptyPartitionValue.__name__}: {c} is empty"))
    return df.withColumns({c: F.when(F.col(c) == "", message(c).cast("string")).otherwise(F.col(c)) for c in texts})


def swap_in(spark: SparkSession, path: str, write) -> None:
    """Let ``write(folder)`` fill a folder beside ``path`` and put it in its place.

    A job that fails leaves the old table as it was. Between the two moves, also if the driver ends there,
    :func:`read_table` finds the old table where it was moved to; the next swap removes it. :class:`~strata.operators.refresh.Versions`
    also keep the files of readers that began before.
    """
    path = path.rstrip("/")
    left = place_of(spark, path)
    if left != path:
        Folder(spark, left).move(Folder(spark, path))
    number = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    new, here, old = (Folder(spark, p) for p in (f"{path}.new-{number}", path, f"{path}.old-{number}"))
    try:
        write(new.path)
    except Exception:
        new.delete()
        raise
    if here.exists():
        here.move(old)
    new.move(here)
    old.delete()


def drop_partitions(spark: SparkSession, path: str, column: str, values: Iterable[str]) -> None:
    """Remove the partitions ``column=value`` at the top of a table's folder."""
    for value in values:
        Folder(spark, f"{path}/{column}={value}").delete()


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of the top partition column, as texts, from the folder names."""
    return [n.split("=", 1)[1] for n in Folder(spark, path).names() if n.startswith(f"{column}=")]
