"""Reading declared sources and cutting out the rows of one load."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from strata.functions.exprs import col


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None, encoding="ISO-8859-1") -> DataFrame:
    """CSV with a header; empty fields are null. Without a schema the file is read once more to infer it."""
    reader = spark.read.option("header", True).option("encoding", encoding).option("nullValue", "")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def jdbc_scan_options(
    url: str, table: str, partition: tuple[str, object, object, int] | None = None, **options: str
) -> dict[str, str]:
    """Reader options of a database table; ``partition`` (column, lower, upper, splits) makes the scan parallel."""
    found = {"url": url, "dbtable": table, **options}
    if partition:
        column, lower, upper, splits = partition
        found |= {"partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(splits)}
    return found


def read_jdbc(spark: SparkSession, url: str, table: str, partition=None, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_scan_options(url, table, partition, **options)).load()


def extract_since(df: DataFrame, date_col: str, start, columns: dict[str, str] | None = None) -> DataFrame:
    """Listed columns, cast, of the rows from ``start`` on. The comparison is on the raw column, so it is pushed down."""
    rows = df.where(F.col(date_col) >= F.lit(start))
    return rows if columns is None else rows.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()])


def in_days(ts: Column | str, first: dt.date, days: int = 1) -> Column:
    """Half-open range on the raw timestamp; a cast to date would defeat pushdown."""
    start = dt.datetime.combine(first, dt.time())
    lower, upper = (F.lit(x).cast("timestamp_ntz") for x in (start, start + dt.timedelta(days=days)))
    return (col(ts) >= lower) & (col(ts) < upper)


def extract_day(df: DataFrame, ts_col: str, day: dt.date) -> DataFrame:
    return df.where(in_days(ts_col, day))


def retain(df: DataFrame, ts_col: str, days: int, as_of) -> DataFrame:
    """Rows still within their time to live: ``ts + days > as_of``, written as a limit on the raw column."""
    return df.where(F.col(ts_col) > F.lit(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))


def parse_iso_minute(c: Column | str) -> Column:
    return F.to_timestamp_ntz(col(c), F.lit("yyyy-MM-dd'T'HH:mm"))


def explode_parallel_arrays(df: DataFrame, struct_col: str, fields: list[str], keep: list[str] = ()) -> DataFrame:
    """One row per index of equally long arrays in ``struct_col``; short arrays give nulls."""
    zipped = F.arrays_zip(*[F.col(f"{struct_col}.{f}").alias(f) for f in fields])
    rows = df.select(*keep, F.explode(zipped).alias("_row"))
    return rows.select(*keep, *[F.col("_row").getField(f).alias(f) for f in fields])


HOURLY_MEASURES = ("temperature_2m", "relative_humidity_2m", "wind_speed_10m", "precipitation")
HOURLY_PAYLOAD = (
    "struct<hourly: struct<time: array<string>, "
    + ", ".join(f"{m}: array<double>" for m in HOURLY_MEASURES)
    + ">>"
)


def hourly_readings(documents: DataFrame, json_col: str) -> DataFrame:
    """Weather documents (JSON text) to typed hourly rows."""
    parsed = documents.select(F.from_json(json_col, HOURLY_PAYLOAD).alias("doc"))
    rows = explode_parallel_arrays(parsed, "doc.hourly", ["time", *HOURLY_MEASURES])
    return rows.select(
        parse_iso_minute("time").alias("reading_ts"), *[F.col(m).cast("float").alias(m) for m in HOURLY_MEASURES]
    )


def malformed(documents: DataFrame, json_col: str) -> DataFrame:
    """The documents that are no JSON; a missing one is not counted among them."""
    return documents.where(F.col(json_col).isNotNull() & F.try_parse_json(json_col).isNull())


def open_readings(documents: DataFrame, json_col: str, group: str = "hourly", time: str = "time") -> DataFrame:
    """Documents whose measures are not declared: a row ``reading_ts``, ``measure``, ``value`` for every number of every
    array in ``group``, whatever the arrays are called.

    Arrays need not be equally long: numbers beyond the times have no ``reading_ts``, missing ones give no row. What is no
    number is null; what is no array, and documents that are no JSON (:func:`malformed`) or have no such group, give no rows.
    """
    parsed = documents.select(F.try_parse_json(json_col).alias("doc"))
    named = parsed.select(
        F.try_variant_get("doc", f"$.{group}.{time}", "array<string>").alias("times"),
        F.explode(F.try_variant_get("doc", f"$.{group}", "map<string, variant>")).alias("measure", "numbers"),
    )
    named = named.where(F.col("measure") != time)
    values = named.select(
        "times", "measure", F.posexplode(F.try_variant_get("numbers", "$", "array<variant>")).alias("at", "number")
    )
    return values.select(
        parse_iso_minute(F.get("times", F.col("at"))).alias("reading_ts"),
        "measure",
        F.try_variant_get("number", "$", "double").alias("value"),
    )
