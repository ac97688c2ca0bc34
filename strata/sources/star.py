"""The two analytic inputs, built from a star schema of Parquet tables.

A retail system delivers order lines as one wide table; here they are joined
from a normalised schema. Dimensions are joined only when one of their columns
is wanted, and by left joins: the rows are the lines, whichever columns are
asked for. A line whose order, customer or part is missing has nulls in their
columns; :func:`orphans` counts such lines.

No side is forced to broadcast. Spark broadcasts what it measures to be below
its threshold and merges sorted shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from strata.functions.exprs import MONEY, mean, ratio
from strata.sources.scans import HOURLY_MEASURES

ORDER_LINE_COLUMNS = (
    "order_id", "line_no", "product_id", "supplier_id", "customer_id", "customer_name", "segment",
    "region", "state", "category", "sub_category", "product_name", "order_date", "ship_date",
    "sales", "quantity", "discount", "profit", "return_flag",
)

FROM_CUSTOMER = {"customer_name": "c_name", "segment": "c_mktsegment"}
FROM_GEOGRAPHY = ("state", "region")
FROM_PART = {"category": "p_type", "sub_category": "p_brand", "product_name": "p_name"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")



def order_lines(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Order lines with the given columns (all of them by default)."""
    wanted = columns or ORDER_LINE_COLUMNS
    unknown = set(wanted) - set(ORDER_LINE_COLUMNS)
    if unknown:
        raise ValueError(f"no such order line columns: {sorted(unknown)}")
    need = set(wanted)

    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_extendedprice").cast(MONEY).alias("sales"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_discount").cast("decimal(4,2)").alias("_rate"),
        F.col("l_returnflag").alias("return_flag"),
        F.col("l_shipdate").alias("_shipped_at"),
    )
    if need & {"customer_id", "order_date", "ship_date", *FROM_CUSTOMER, *FROM_GEOGRAPHY}:
        # Customers meet orders first: that join moves orders, not the longer line table.
        lines = lines.join(_order_heads(spark, folder, need), "order_id", "left")
    if need & {"profit", *FROM_PART}:
        lines = lines.join(_products(spark, folder), "product_id", "left")
    if need & set(FROM_GEOGRAPHY):
        lines = _with_places(spark, folder, lines)

    derived = {
        "discount": (F.col("sales") * F.col("_rate")).cast(MONEY),
        "order_date": F.to_date("_ordered_at"),
        "ship_date": F.when(F.col("_shipped_at") >= F.col("_ordered_at"), F.to_date("_shipped_at")),
        "profit": (
            F.col("sales") * (1 - F.col("_rate")) - F.col("quantity") * F.col("_price")
        ).cast(MONEY),
    }
    return lines.select(*[derived[c].alias(c) if c in derived else F.col(c) for c in wanted])


def _order_heads(spark: SparkSession, folder: str, need: set[str]) -> DataFrame:
    heads = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("_ordered_at"),
    )
    if need & {*FROM_CUSTOMER, *FROM_GEOGRAPHY}:
        return heads.join(_people(spark, folder), "customer_id", "left")
    return heads


def _people(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_nationkey").alias("_nation"),
        *[F.col(src).alias(name) for name, src in FROM_CUSTOMER.items()],
    )


def _with_places(spark: SparkSession, folder: str, df: DataFrame) -> DataFrame:
    """State and region by nation key: two tables of fixed size, broadcast by their measured size."""
    nation = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("_nation"), F.col("n_name").alias("state"), F.col("n_regionkey").alias("_region")
    )
    region = table(spark, folder, "region").select(
        F.col("r_regionkey").alias("_region"), F.col("r_name").alias("region")
    )
    return df.join(nation, "_nation", "left").join(region, "_region", "left").drop("_nation", "_region")


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return _with_places(spark, folder, _people(spark, folder))


def _products(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_retailprice").cast(MONEY).alias("_price"),
        *[F.col(src).alias(name) for name, src in FROM_PART.items()],
    )


def product_costs(spark: SparkSession, folder: str) -> DataFrame:
    return _products(spark, folder).select("product_id", F.col("_price").alias("unit_cost"))


def readings(spark: SparkSession, folder: str, faulty: bool = False) -> DataFrame:
    """Weather readings, derived from the events table.

    With ``faulty`` every kind of event loses some measures, a signup all of them.
    """
    value, kind = F.col("value").cast("decimal(10,2)"), F.col("event_type")
    measures = {
        "temperature_2m": (value % 40 - 10, ["signup", "view"]),
        "relative_humidity_2m": (value * 13 % 100, ["signup", "click"]),
        "wind_speed_10m": (value * 7 % 15, ["signup", "purchase"]),
        "precipitation": (F.when(kind == "error", value % 8).otherwise(0), ["signup", "click", "view"]),
    }
    cols = []
    for name, (measure, lost) in measures.items():
        measure = measure.cast("decimal(5,2)")
        cols.append((F.when(~kind.isin(lost), measure) if faulty else measure).alias(name))
    return table(spark, folder, "events").select(
        "event_id", F.col("user_id").alias("station_id"), F.col("ts").alias("reading_ts"), *cols
    )


def weekday_norms(readings: DataFrame) -> DataFrame:
    """A norms table by date: the mean temperature of all readings on the same weekday.

    The window runs over days, not over readings.
    """
    by_day = readings.groupBy(F.to_date("reading_ts").alias("date")).agg(
        F.sum("temperature_2m").alias("_total"), F.count("temperature_2m").alias("_n")
    )
    same = W.partitionBy(F.weekday("date"))
    return by_day.select("date", ratio(F.sum("_total").over(same), F.sum("_n").over(same)).alias("climate_norm"))


def hourly_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON document per day with parallel arrays of hourly means, as a weather API returns it.

    A document holds at most 24 hours, whatever the number of readings.
    """
    hour = F.date_format(F.date_trunc("HOUR", F.col("reading_ts")), "yyyy-MM-dd'T'HH:mm")
    hourly = (
        readings(spark, folder)
        .groupBy(F.to_date("reading_ts").alias("day"), hour.alias("time"))
        .agg(*[mean(m).alias(m) for m in HOURLY_MEASURES])
    )
    entries = F.sort_array(F.collect_list(F.struct("time", *HOURLY_MEASURES)))
    arrays = F.struct(*[F.col("entries").getField(f).alias(f) for f in ("time", *HOURLY_MEASURES)])
    daily = hourly.groupBy("day").agg(entries.alias("entries"))
    return daily.select("day", F.to_json(F.struct(arrays.alias("hourly"))).alias("payload"))


def orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Quality rows (table_name, column_name, rule, failed_rows, total_rows): lines without their order or part, orders
    without their customer."""

    def missing(child: str, key: str, parent: str, parent_key: str) -> DataFrame:
        there = table(spark, folder, parent).select(F.col(parent_key).alias("_there")).distinct()
        keys = table(spark, folder, child).groupBy(key).agg(F.count("*").alias("_n"))
        joined = keys.join(there, F.col(key) == F.col("_there"), "left")
        lost = F.sum(F.when(F.col("_there").isNull(), F.col("_n")).otherwise(0))
        return joined.agg(
            F.lit(child).alias("table_name"),
            F.lit(key).alias("column_name"),
            F.lit(f"in {parent}").alias("rule"),
            F.coalesce(lost, F.lit(0)).alias("failed_rows"),
            F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
        )

    found = missing("lineitem", "l_orderkey", "orders", "o_orderkey")
    found = found.unionByName(missing("lineitem", "l_partkey", "part", "p_partkey"))
    return found.unionByName(missing("orders", "o_custkey", "customer", "c_custkey"))
