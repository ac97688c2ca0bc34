"""Declared schemas: type names to Spark types, and fitting a frame to them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

# Type names accepted in a source declaration.
TYPE_NAMES = {
    "integer": "bigint",
    "int": "bigint",
    "int64": "bigint",
    "int32": "int",
    "string": "string",
    "text": "string",
    "date": "date",
    "datetime": "timestamp_ntz",
    "timestamp": "timestamp_ntz",
    "numeric": "decimal(12,2)",
    "decimal": "decimal(12,2)",
    "decimal32(2)": "decimal(9,2)",
    "float": "float",
    "float32": "float",
    "float64": "double",
    "double": "double",
}

# Fixed value: tables of a source's latest load end with it.
TABLE_SUFFIX = "_last_data"


class SchemaChanged(ValueError):
    """A batch does not have the columns of its target."""


def spark_type(name: str) -> str:
    try:
        return TYPE_NAMES[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown type name: {name!r}") from None


def declare_schema(columns: Mapping[str, str]) -> StructType:
    return StructType([StructField(c, _parse_datatype_string(spark_type(t))) for c, t in columns.items()])


def physical_name(source: str, suffix: str = TABLE_SUFFIX) -> str:
    """Table holding a source's latest load."""
    return f"{source}{suffix}"


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the declared columns: others dropped, missing ones null, all cast."""
    have = set(df.columns)
    return df.select(
        *[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    )


def schema_changes(df: DataFrame, target: StructType) -> list[tuple[str, str | None, str | None]]:
    """(column, type in target, type in batch) of every difference."""
    batch = {f.name: f.dataType.simpleString() for f in df.schema}
    fixed = {f.name: f.dataType.simpleString() for f in target}
    names = list(fixed) + [n for n in batch if n not in fixed]
    return [(n, fixed.get(n), batch.get(n)) for n in names if fixed.get(n) != batch.get(n)]


def check_schema_unchanged(df: DataFrame, target: StructType) -> DataFrame:
    """``df``, or :class:`SchemaChanged` when columns were added, lost or retyped."""
    changes = schema_changes(df, target)
    if changes:
        raise SchemaChanged("; ".join(f"{n}: {was or 'absent'} -> {now or 'absent'}" for n, was, now in changes))
    return df
