"""Every registered query: ``name -> (spark, folder) -> DataFrame``.

Each reads the whole tables. ``checks/oracles.py`` states the same results in SQL.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import fixture as fx
from strata.functions import retail
from strata.functions import weather as wx
from strata.functions.exprs import mean, money_sum, month_start, ratio, whole
from strata.functions import named
from strata.operators import customers, deltas, distinct, enrich, metrics, products, quality, refresh, sales, staging, weather
from strata.plans.layers import quality_of, run_layers
from strata.plans.retail import retail_models
from strata.plans.weather import weather_models
from strata.session import building, prepare, run_dir
from strata.sources import marks, scans, schema, sinks, star
from strata.sources.tables import read_table
from strata.streaming import loads

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
LINE_KEY = ["order_id", "line_no", "product_id", "supplier_id"]


def query(fn: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(prepare(spark), folder)

    run.__name__ = fn.__name__
    REGISTRY[fn.__name__] = run
    return run


def lines(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return star.order_lines(spark, folder, *columns)


def ntz(ts: dt.datetime):
    return F.lit(ts).cast("timestamp_ntz")


def loaded(df: DataFrame, late=None) -> DataFrame:
    """Lines with the metadata of the run that loaded them: the second one for ``late`` rows, by default late orders."""
    late = F.coalesce(F.col("order_date") >= F.lit(fx.FIRST_LOAD_UNTIL) if late is None else late, F.lit(False))
    return df.withColumns(
        {
            "loaded_at": F.when(late, ntz(fx.NEXT_LOAD_TS)).otherwise(ntz(fx.LOAD_TS)),
            "run_started_at": F.when(late, ntz(fx.NEXT_RUN_STARTED)).otherwise(ntz(fx.RUN_STARTED)),
            "run_id": F.when(late, fx.NEXT_RUN_ID).otherwise(fx.RUN_ID),
        }
    )


# --- sources and sinks ------------------------------------------------------------------


@query
def csv_scan(spark, folder):
    columns = [*LINE_KEY, "customer_name", "order_date", "ship_date", "sales"]
    source = lines(spark, folder, *columns)
    path = run_dir(spark, "csv")
    source.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return scans.read_csv(spark, path, source.schema)


@query
def write_new_table(spark, folder):
    path = run_dir(spark, "new")
    sinks.write_new(lines(spark, folder, *LINE_KEY, "sales"), path)
    return spark.read.parquet(path)


@query
def extract_since(spark, folder):
    columns = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderdate": "date", "o_totalprice": "decimal(12,2)"}
    return scans.extract_since(star.table(spark, folder, "orders"), "o_orderdate", fx.EXTRACT_FROM, columns)


@query
def extract_day(spark, folder):
    return scans.extract_day(star.table(spark, folder, "events"), "ts", fx.ONE_DAY).select(
        "event_id", "ts", "user_id", "event_type", "value"
    )


@query
def api_hourly_rows(spark, folder):
    return scans.hourly_readings(star.hourly_documents(spark, folder), "payload")


@query
def api_variant_rows(spark, folder):
    """Documents with a measure nobody declared and shorter than the times, some of them broken off, which are counted."""
    days = star.hourly_documents(spark, folder)
    more = F.replace("payload", F.lit('{"hourly":{'), F.lit('{"hourly":{"pressure_msl":[1000.5,"calm",null],'))
    broken = F.dayofmonth("day") % 5 == 0
    documents = days.select(F.when(broken, F.expr("left(payload, length(payload) - 3)")).otherwise(more).alias("payload"))
    lost = scans.malformed(documents, "payload").agg(
        F.lit(None).cast("timestamp_ntz").alias("reading_ts"), F.lit("malformed documents").alias("measure"),
        F.count(F.lit(1)).cast("double").alias("value"),
    )
    return scans.open_readings(documents, "payload").unionByName(lost)


@query
def conform_schema(spark, folder):
    declared = schema.declare_schema(
        {
            "o_orderkey": "Int64",
            "o_orderdate": "date",
            "o_totalprice": "numeric",
            "o_orderpriority": "Text",
            "o_comment": "string",
        }
    )
    return schema.conform(star.table(spark, folder, "orders"), declared)


STAR_SOURCES = {
    "region": {"r_regionkey": "Int32", "r_name": "Text"},
    "nation": {"n_nationkey": "Int32", "n_name": "Text", "n_regionkey": "Int32"},
    "customer": {"c_custkey": "Int64", "c_name": "Text", "c_mktsegment": "Text"},
    "supplier": {"s_suppkey": "Int64", "s_name": "Text"},
    "part": {"p_partkey": "Int64", "p_name": "Text", "p_type": "Text", "p_retailprice": "numeric"},
    "orders": {"o_orderkey": "Int64", "o_custkey": "Int64", "o_orderdate": "datetime"},
    "lineitem": {"l_orderkey": "Int64", "l_partkey": "Int64", "l_extendedprice": "numeric"},
    "events": {"event_id": "Int64", "ts": "datetime", "event_type": "Text", "value": "Float64"},
}


@query
def load_all_counts(spark, folder):
    def reader(name):
        return lambda: schema.conform(star.table(spark, folder, name), schema.declare_schema(STAR_SOURCES[name]))

    loaded = sinks.load_all(spark, {n: reader(n) for n in STAR_SOURCES}, run_dir(spark, "load"))
    counted = [
        df.agg(F.lit(schema.physical_name(n)).alias("table_name"), F.count("*").alias("row_count"))
        for n, df in loaded.items()
    ]
    return metrics.stacked(counted)


@query
def full_refresh(spark, folder):
    path = run_dir(spark, "refresh")
    orders = star.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    sinks.full_refresh(orders.where(F.col("o_orderdate") < F.lit(fx.BATCH_FROM)), path)
    return staging.as_table(orders, path)


@query
def replace_day_idempotent(spark, folder):
    path = run_dir(spark, "days")
    readings = star.readings(spark, folder)
    sinks.load_days(readings, path, "reading_ts")
    for _ in range(2):
        sinks.replace_day(readings, path, "reading_ts", fx.ONE_DAY)
    return read_table(spark, path)


@query
def replace_day_emptied(spark, folder):
    path = run_dir(spark, "emptied")
    readings = star.readings(spark, folder).select("event_id", "reading_ts", "temperature_2m")
    sinks.load_days(readings, path, "reading_ts")
    source = readings.where(~scans.in_days("reading_ts", fx.ONE_DAY))
    sinks.replace_day(source, path, "reading_ts", fx.ONE_DAY)
    return read_table(spark, path)


@query
def backfill_gap(spark, folder):
    path = run_dir(spark, "gap")
    readings = star.readings(spark, folder).select("event_id", "reading_ts", "temperature_2m")
    sinks.load_days(readings, path, "reading_ts")
    source = readings.where(~scans.in_days("reading_ts", fx.BACKFILL_FROM, 3))
    sinks.backfill(source, path, "reading_ts", fx.BACKFILL_FROM, fx.LAST_DAY)
    return read_table(spark, path)


@query
def expire_partitions(spark, folder):
    path = run_dir(spark, "expiry")
    sinks.load_days(star.readings(spark, folder).select("event_id", "reading_ts"), path, "reading_ts")
    sinks.expire_partitions(spark, path, "load_day", fx.EXPIRE_DAYS, fx.EXPIRE_AS_OF)
    return read_table(spark, path)


@query
def expire_rows(spark, folder):
    """Partitions by month; the one the limit falls into keeps its younger rows."""
    path = run_dir(spark, "expiry-rows")
    dated = star.readings(spark, folder).select("event_id", "reading_ts")
    sinks.write_partitioned(dated.withColumn("month", F.date_format("reading_ts", "yyyyMM")), path, ["month"], ["reading_ts"])
    sinks.expire_rows(spark, path, "month", "reading_ts", fx.EXPIRE_DAYS, fx.EXPIRE_AS_OF)
    return read_table(spark, path)


@query
def append_load(spark, folder):
    path = run_dir(spark, "append")
    readings = star.readings(spark, folder)
    half = ntz(fx.HALF_TIME)
    sinks.append(readings.where(F.col("reading_ts") < half), path)
    sinks.append(readings.where(F.col("reading_ts") >= half), path)
    return spark.read.parquet(path)


@query
def retention_filter(spark, folder):
    return scans.retain(
        lines(spark, folder, *LINE_KEY, "order_date", "sales"), "order_date", fx.RETAIN_DAYS, fx.RETAIN_AS_OF
    )


@query
def backfill_range(spark, folder):
    path = run_dir(spark, "backfill")
    readings = star.readings(spark, folder).select("event_id", "reading_ts", "temperature_2m")
    sinks.load_days(readings.where(F.col("reading_ts") < ntz(fx.HALF_TIME)), path, "reading_ts")
    sinks.backfill(readings, path, "reading_ts", fx.BACKFILL_FROM, fx.LAST_DAY)
    return read_table(spark, path)


@query
def partitioned_write(spark, folder):
    path = run_dir(spark, "layout")
    source = lines(spark, folder, "region", "order_date", "customer_id", "sales")
    source = source.withColumn("month", F.date_format("order_date", "yyyyMM"))
    sinks.write_partitioned(source, path, ["month", "region"], ["order_date", "customer_id"])
    back = read_table(spark, path)
    return back.groupBy(whole("month").alias("month"), "region").agg(
        F.count("*").alias("line_count"), money_sum("sales").alias("total_sales")
    )


@query
def interleaved_write(spark, folder):
    path = run_dir(spark, "interleaved")
    source = lines(spark, folder, *LINE_KEY, "customer_id", "order_date")
    sinks.write_interleaved(source, path, ["order_date", "customer_id"])
    return read_table(spark, path)


# --- staging ------------------------------------------------------------------------------


@query
def stg_orders_basic(spark, folder):
    return staging.as_view(staging.stage_orders(lines(spark, folder), fx.LOAD_TS), "stg_orders_basic")


@query
def stg_orders_metadata(spark, folder):
    source = lines(spark, folder, *LINE_KEY, "customer_id", "order_date", "sales")
    return staging.with_run_metadata(source, fx.LOAD_TS, fx.RUN_STARTED, fx.RUN_ID)


@query
def stg_orders_enriched(spark, folder):
    source = lines(spark, folder, *LINE_KEY, "sales", "discount", "profit")
    return staging.with_margin_pct(staging.with_net_sales(source))


@query
def orders_cleaned(spark, folder):
    return staging.clean_orders(lines(spark, folder))


@query
def stg_weather(spark, folder):
    return _stage_weather(star.readings(spark, folder))


@query
def stg_weather_nonnull(spark, folder):
    return _stage_weather(star.readings(spark, folder, faulty=True))


def _stage_weather(readings):
    staged = staging.stage_weather(readings, ["event_id"])
    converted = ("temperature_fahrenheit", "wind_speed_kmh")
    return staged.withColumns({c: F.col(c).cast("decimal(8,2)") for c in converted})


@query
def stg_readings_basic(spark, folder):
    return staging.stage_readings(star.readings(spark, folder), fx.LOAD_TS, ["event_id", "reading_ts"])


@query
def dedupe_latest(spark, folder):
    source = lines(spark, folder, *LINE_KEY, "order_date", "ship_date", "sales")
    return staging.dedupe(source, ["order_id", "product_id"], ["ship_date", "line_no", "supplier_id", "sales"])


# --- filters --------------------------------------------------------------------------------


@query
def hwm_exclusive(spark, folder):
    events = star.table(spark, folder, "events").select("event_id", "ts", "event_type", "value")
    path = run_dir(spark, "hwm")
    refresh.incremental_append(events.where(F.col("ts") <= ntz(fx.HALF_TIME)), path, "ts")
    return refresh.newer_rows(events, marks.stored_mark(spark, path, "ts"), "ts")


@query
def hwm_inclusive(spark, folder):
    orders = star.table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    path = run_dir(spark, "hwm-inclusive")
    refresh.incremental_append(orders.where(F.col("o_orderdate") <= F.lit(fx.FIRST_LOAD_UNTIL)), path, "o_orderdate")
    return refresh.newer_rows(orders, marks.stored_mark(spark, path, "o_orderdate"), "o_orderdate", inclusive=True)


@query
def new_keys_only(spark, folder):
    source = lines(spark, folder, "order_id", "customer_id", "order_date", "sales")
    segments = customers.customer_segments(source, **fx.CUSTOMER_SEGMENT)
    known = source.where(F.col("order_date") < F.lit(fx.KNOWN_BEFORE))
    return refresh.new_keys_only(segments, known, ["customer_id"])


@query
def product_priority(spark, folder):
    tagged = enrich.with_priority(lines(spark, folder, "category", "sales"), "category", fx.HIGH_PRIORITY)
    return tagged.groupBy("priority", "category").agg(
        F.count("*").alias("line_count"), money_sum("sales").alias("total_sales")
    )


# --- row-level enrichment ------------------------------------------------------------------


@query
def orders_enriched(spark, folder):
    source = lines(spark, folder, *LINE_KEY, "customer_id", "order_date", "ship_date", "sales", "discount", "profit")
    return enrich.enrich_orders(source, size_steps=fx.SIZE_STEPS)


@query
def geo_customers(spark, folder):
    source = lines(spark, folder, "customer_id", "customer_name", "region", "state", "order_date")
    latest = customers.latest_by(source, "customer_id", ["customer_name", "region", "state"], "order_date")
    return enrich.geo_enrich(latest, fx.COORDINATES)


@query
def category_map(spark, folder):
    grouped = enrich.category_map(lines(spark, folder, "category", "sales"), "category", fx.CATEGORY_GROUPS)
    return grouped.groupBy("category_group").agg(
        F.count("*").alias("line_count"), money_sum("sales").alias("total_sales")
    )


@query
def customer_tenure_years(spark, folder):
    first = lines(spark, folder, "customer_id", "order_date").groupBy("customer_id")
    first = first.agg(F.min("order_date").alias("first_order_date"))
    return enrich.with_tenure(first, "first_order_date", fx.AS_OF)


@query
def fixture_profit(spark, folder):
    source = lines(spark, folder, "product_id", "category", "sales", "discount", "quantity")
    costed = source.join(star.product_costs(spark, folder), "product_id")
    cost = (F.col("quantity") * F.col("unit_cost")).cast("decimal(16,2)")
    profit = retail.gross_margin(retail.net_sales(), cost)
    return costed.groupBy("category").agg(money_sum(profit).alias("gross_margin"), money_sum(cost).alias("total_cost"))


@query
def wind_category_counts(spark, folder):
    return sales.counts(star.readings(spark, folder), {"wind_category": wx.wind_category("wind_speed_10m")})


@query
def icing_risk_by_day(spark, folder):
    return weather.icing_risk_by_day(star.readings(spark, folder))


@query
def comfort_index(spark, folder):
    return weather.comfort(star.readings(spark, folder))


@query
def sql_comfort(spark, folder):
    """:func:`comfort_index` in SQL text, with the formulas as functions of the session."""
    named.register(spark, "strata_")
    star.readings(spark, folder).createOrReplaceTempView("strata_readings")
    return spark.sql(
        """
        SELECT event_id, reading_ts, temperature_2m, relative_humidity_2m, wind_speed_10m,
               CAST(strata_heat_index(temperature_2m, relative_humidity_2m) AS DOUBLE) AS heat_index,
               ROUND(strata_wind_chill(temperature_2m, wind_speed_10m), 6) AS wind_chill,
               CAST(strata_comfort_index(temperature_2m, relative_humidity_2m, wind_speed_10m) AS DECIMAL(8,3)) AS comfort_index,
               strata_comfort_category(
                 strata_comfort_index(temperature_2m, relative_humidity_2m, wind_speed_10m)) AS comfort_category
        FROM strata_readings
        """
    )


@query
def comfort_category_counts(spark, folder):
    return sales.counts(weather.comfort(star.readings(spark, folder)), ["comfort_category"])


# --- retail aggregates ----------------------------------------------------------------------

CUSTOMER_COLUMNS = (
    "order_id", "customer_id", "customer_name", "segment", "order_date", "sales", "discount", "profit", "quantity",
)


def _customer_metrics(spark, folder):
    return customers.customer_metrics(lines(spark, folder, *CUSTOMER_COLUMNS), fx.CUSTOMER_TIER)


@query
def customer_metrics(spark, folder):
    return customers.customer_metrics(loaded(lines(spark, folder, *CUSTOMER_COLUMNS)), fx.CUSTOMER_TIER)


@query
def customer_table(spark, folder):
    source = lines(spark, folder, *CUSTOMER_COLUMNS, "region", "state", "category", "sub_category")
    return customers.customer_table(staging.settled(loaded(source), "lines"), fx.CUSTOMER_TIER)


@query
def customer_latest_attrs(spark, folder):
    return customers.customer_latest_attrs(
        lines(spark, folder, "customer_id", "region", "state", "order_date", "category", "sub_category", "sales", "discount")
    )


@query
def customer_tier_counts(spark, folder):
    return sales.counts(_customer_metrics(spark, folder), ["customer_tier"], "customer_count")


@query
def customer_segments(spark, folder):
    source = lines(spark, folder, "order_id", "customer_id", "customer_name", "segment", "region", "sales")
    return customers.customer_segments(
        source, **fx.CUSTOMER_SEGMENT, attributes=["customer_name", "segment", "region"]
    )


@query
def customer_segments_by_lines(spark, folder):
    source = lines(spark, folder, "order_id", "customer_id", "sales")
    return customers.customer_segments(source, **fx.LINE_SEGMENT, count_lines=True)


PERFORMANCE_COLUMNS = (
    "order_id", "customer_id", "product_id", "product_name", "category", "sub_category", "region", "state",
    "order_date", "sales", "discount", "profit", "quantity",
)


@query
def product_performance(spark, folder):
    source = loaded(lines(spark, folder, *PERFORMANCE_COLUMNS))
    return products.product_performance(source, fx.PRODUCT_TIER, fx.VOLUME_STEPS)


@query
def product_tier_counts(spark, folder):
    source = lines(spark, folder, "order_id", "product_id", "quantity", "sales", "discount", "profit")
    totals = products.product_totals(source, fx.PRODUCT_TIER, fx.VOLUME_STEPS)
    return sales.counts(totals, ["product_tier", "volume_category"], "product_count")


@query
def regional_sales(spark, folder):
    source = lines(
        spark, folder, "order_id", "customer_id", "product_id", "region", "state", "category", "segment",
        "order_date", "ship_date", "sales", "discount", "profit", "quantity",
    )
    return sales.regional_sales(loaded(source), fx.SEGMENTS)


@query
def avg_delivery_days(spark, folder):
    return sales.avg_delivery_days(lines(spark, folder, "region", "order_date", "ship_date"))


@query
def category_region_month(spark, folder):
    return sales.category_region_month(_category_lines(spark, folder))


@query
def category_region_month_of_year(spark, folder):
    return sales.category_region_month(_category_lines(spark, folder), month_of_year=True)


def _category_lines(spark, folder):
    return lines(
        spark, folder, "order_id", "customer_id", "category", "region", "order_date", "sales", "quantity", "profit",
        "discount",
    )


@query
def sales_overview(spark, folder):
    return sales.sales_overview(
        lines(spark, folder, "order_id", "customer_id", "order_date", "sales", "discount", "profit")
    )


@query
def shipments_overview(spark, folder):
    """The overview by shipping month and supplier: an order has several of both."""
    source = lines(spark, folder, "order_id", "supplier_id", "ship_date", "sales", "discount", "profit")
    shipped = source.withColumnsRenamed({"ship_date": "order_date", "supplier_id": "customer_id"})
    return sales.sales_overview(shipped.where(F.col("order_date").isNotNull()))


@query
def unique_customers_sketch(spark, folder):
    """Estimates from stored daily sketches, beside the exact counts and whether they are as near as they should be."""
    path = run_dir(spark, "sketches")
    source = lines(spark, folder, "order_id", "customer_id", "order_date")
    sinks.write_new(sales.customer_sketches(source), path)
    estimates = sales.unique_customers_estimated(read_table(spark, path))
    exact = source.groupBy(month_start("order_date").alias("period_start")).agg(
        F.count_distinct("customer_id").alias("unique_customers"), F.count_distinct("order_id").alias("total_orders")
    )
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.lit(distinct.error_bound()) * F.col(b)
    return exact.join(estimates, "period_start").select(
        "period_start", "unique_customers", "total_orders",
        near("customers", "unique_customers").alias("customers_near"), near("orders", "total_orders").alias("orders_near"),
    )


@query
def sales_by_time(spark, folder):
    return sales.sales_by_time(lines(spark, folder, "order_id", "order_date", "sales"))


@query
def period_totals(spark, folder):
    return sales.period_totals(lines(spark, folder, "order_date", "sales"))


@query
def profit_by_category_region(spark, folder):
    return sales.profit_by_category_region(lines(spark, folder, "category", "region", "sales", "profit"))


@query
def assumed_margin(spark, folder):
    return sales.assumed_margin(lines(spark, folder, "category", "region", "sales"))


@query
def average_check(spark, folder):
    return sales.average_check_by_total(lines(spark, folder, "order_id", "customer_id", "sales"), **fx.CUSTOMER_SEGMENT)


@query
def average_check_joined(spark, folder):
    source = lines(spark, folder, "order_id", "customer_id", "sales")
    return sales.average_check(source, customers.customer_segments(source, **fx.CUSTOMER_SEGMENT))


@query
def delivery_performance(spark, folder):
    return sales.delivery_performance(lines(spark, folder, "order_date", "ship_date"))


@query
def customer_clv_days(spark, folder):
    return customers.clv_by_days(_customer_metrics(spark, folder))


@query
def customer_clv_months(spark, folder):
    return customers.clv_by_months(lines(spark, folder, "order_id", "customer_id", "order_date", "sales"))


@query
def customer_segment_share(spark, folder):
    metrics_table = staging.settled(_customer_metrics(spark, folder), "customer-metrics")
    return customers.segment_share(customers.clv_by_days(metrics_table))


@query
def retention_monthly(spark, folder):
    return customers.retention_monthly(lines(spark, folder, "customer_id", "order_date"))


@query
def retention_crr(spark, folder):
    return customers.retention_crr(lines(spark, folder, "customer_id", "order_date"))


@query
def order_dynamics(spark, folder):
    return sales.order_dynamics(lines(spark, folder, "order_id", "order_date", "sales"))


@query
def sales_drop_alert(spark, folder):
    return sales.sales_drop_alert(lines(spark, folder, "order_id", "order_date", "sales"))


@query
def return_rate(spark, folder):
    return sales.return_rate(lines(spark, folder, "order_id", "segment", "return_flag"), by=["segment"])


@query
def conversion_rate(spark, folder):
    return sales.conversion_rate(star.table(spark, folder, "events"))


@query
def sales_per_day(spark, folder):
    return sales.sales_per_period(lines(spark, folder, "order_date", "sales"), "day")


@query
def sales_per_week(spark, folder):
    return sales.sales_per_period(lines(spark, folder, "order_date", "sales"), "week")


@query
def region_sales_customers(spark, folder):
    return sales.region_sales_customers(lines(spark, folder, "region", "customer_id", "sales"))


@query
def orders_summary(spark, folder):
    source = lines(
        spark, folder, *LINE_KEY, "customer_id", "category", "region", "order_date", "sales", "quantity", "discount",
        "profit",
    )
    source = staging.settled(source, "lines")
    segments = customers.customer_segments(source, **fx.LINE_SEGMENT, count_lines=True)
    return sales.orders_summary(source, segments, staging.settled(sales.group_totals(source), "totals"))


@query
def orders_with_customers(spark, folder):
    source = lines(spark, folder, *LINE_KEY, "customer_id", "order_date", "sales")
    return enrich.with_customers(source, star.customers(spark, folder))


@query
def abc_analysis(spark, folder):
    return products.abc_analysis(lines(spark, folder, "order_id", "product_id", "sales", "discount", "profit"))


@query
def top_products_two_metrics(spark, folder):
    return products.top_products_two_metrics(
        lines(spark, folder, "order_id", "product_id", "sales", "discount", "profit")
    )


@query
def top10_sales(spark, folder):
    return products.top_products(lines(spark, folder, "product_id", "sales"), "sales")


@query
def top10_quantity(spark, folder):
    return products.top_products(lines(spark, folder, "product_name", "quantity"), "quantity", by=("product_name",))


@query
def top10_profit(spark, folder):
    return products.top_products(lines(spark, folder, "product_id", "profit"), "profit")


@query
def top10_by_category_product(spark, folder):
    return products.top_category_products(lines(spark, folder, "category", "product_name", "sales", "profit"))


# --- weather aggregates ------------------------------------------------------------------


@query
def daily_weather(spark, folder):
    return weather.daily_weather(star.readings(spark, folder))


@query
def daily_weather_by_station(spark, folder):
    return weather.daily_weather(star.readings(spark, folder), ["station_id"])


@query
def daily_weather_alerts(spark, folder):
    return weather.daily_alerts(weather.daily_weather(star.readings(spark, folder)), fx.DAILY_LIMITS)


@query
def hourly_comfort(spark, folder):
    return weather.hourly_comfort(weather.comfort(star.readings(spark, folder)))


@query
def linear_comfort_daily(spark, folder):
    return weather.linear_comfort(weather.daily_weather(star.readings(spark, folder)))


@query
def seasonal_anomaly(spark, folder):
    return weather.seasonal_anomaly(_daily_sales(spark, folder), "total_sales", "period_start")


def _daily_sales(spark, folder):
    daily = sales.sales_per_period(lines(spark, folder, "order_date", "sales"), "day")
    return daily.select("period_start", "total_sales")


@query
def seasonal_anomaly_lookback(spark, folder):
    return weather.seasonal_anomaly(
        _daily_sales(spark, folder), "total_sales", "period_start", fx.LOOKBACK_DAYS, fx.RETAIN_AS_OF
    )


@query
def seasonal_anomaly_other_years(spark, folder):
    return weather.seasonal_anomaly(_daily_sales(spark, folder), "total_sales", "period_start", leave_out_today=True)


@query
def anomaly_alerts(spark, folder):
    return weather.anomaly_mart(seasonal_anomaly(spark, folder), fx.ANOMALY_LIMIT)


@query
def daily_weather_reaveraged(spark, folder):
    by_station = weather.daily_weather(star.readings(spark, folder), ["station_id"])
    means = ["avg_temperature", "avg_humidity", "avg_wind_speed"]
    return weather.reaverage(by_station, means, ["total_precipitation"])


@query
def trailing_baseline(spark, folder):
    return weather.trailing_baseline(
        weather.daily_means(star.readings(spark, folder)), "avg_temperature", threshold=fx.TRAILING_THRESHOLD
    )


@query
def trailing_sales(spark, folder):
    """The trailing baseline over years of daily sales: days leave the frame again."""
    daily = _daily_sales(spark, folder).withColumnRenamed("period_start", weather.DAY)
    return weather.trailing_baseline(daily, "total_sales", threshold=fx.SALES_THRESHOLD)


@query
def sales_day_summary(spark, folder):
    """The joined day summary over years of daily sales in the place of temperatures: anomalies differ from zero."""
    amounts = _daily_sales(spark, folder)
    daily = amounts.select(
        F.col("period_start").alias(weather.DAY),
        F.col("total_sales").alias("avg_temperature"),
        *[F.lit(0).cast("decimal(22,2)").alias(c) for c in ("avg_humidity", "avg_wind_speed", "total_precipitation")],
    )
    daily = staging.settled(daily, "daily-sales")
    odd = weather.anomaly_mart(
        weather.seasonal_anomaly(daily.select(weather.DAY, "avg_temperature"), "avg_temperature"), fx.ANOMALY_LIMIT
    )
    hours = weather.hourly_comfort(weather.comfort(star.readings(spark, folder)))
    summary = weather.weather_summary(weather.daily_alerts(daily, fx.DAILY_LIMITS), odd, hours)
    return summary.select(
        weather.DAY, F.col("avg_temperature").alias("total_sales"), "temperature_anomaly", "severity",
        "significant_anomaly_alert", "daily_low_comfort_alert",
    )


@query
def hot_day_count(spark, folder):
    return weather.hot_day_count(trailing_baseline(spark, folder))


@query
def norm_deviation(spark, folder):
    readings = star.readings(spark, folder)
    return weather.norm_deviation(weather.daily_means(readings), star.weekday_norms(readings))


@query
def precip_intensity(spark, folder):
    return weather.precip_intensity(star.readings(spark, folder))


@query
def daily_stddev(spark, folder):
    return weather.daily_stddev(star.readings(spark, folder))


@query
def daily_extremes(spark, folder):
    return weather.daily_extremes(star.readings(spark, folder), hot=29.9, cold=-9.5)


@query
def daily_weather_fact(spark, folder):
    readings = star.readings(spark, folder)
    daily = staging.settled(weather.daily_weather(readings), "daily-weather")
    means = daily.select(weather.DAY, "avg_temperature")
    deviations = weather.norm_deviation(means, star.weekday_norms(readings))
    return weather.daily_weather_fact(daily, deviations, weather.linear_comfort(daily))


@query
def weather_summary(spark, folder):
    readings = star.readings(spark, folder)
    daily = staging.settled(weather.daily_weather(readings), "daily-weather")
    odd = weather.anomaly_mart(weather.seasonal_anomaly(daily.select(weather.DAY, "avg_temperature"), "avg_temperature"))
    hours = weather.hourly_comfort(weather.comfort(readings))
    return weather.weather_summary(weather.daily_alerts(daily, fx.DAILY_LIMITS), odd, hours)


# --- incremental refresh -------------------------------------------------------------------


@query
def incremental_append(spark, folder):
    path = run_dir(spark, "incremental")
    readings = star.readings(spark, folder)
    refresh.incremental_append(readings.where(F.col("reading_ts") <= ntz(fx.HALF_TIME)), path, "reading_ts")
    refresh.incremental_append(readings, path, "reading_ts", fixed_schema=True)
    return spark.read.parquet(path)


@query
def incremental_append_inclusive(spark, folder):
    path = run_dir(spark, "inclusive")
    orders = star.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    first = orders.where(F.col("o_orderdate") <= F.lit(fx.FIRST_LOAD_UNTIL))
    refresh.incremental_append(first, path, "o_orderdate", keys=["o_orderkey"])
    refresh.incremental_append(orders, path, "o_orderdate", keys=["o_orderkey"])
    return spark.read.parquet(path)


def _line_loads(spark, folder):
    """A first load, and a batch with changed and new lines."""
    source = lines(spark, folder, *LINE_KEY, "order_date", "quantity")
    first = source.where(F.col("order_date") < F.lit(fx.FIRST_LOAD_UNTIL))
    batch = source.where(F.col("order_date") >= F.lit(fx.BATCH_FROM))
    return first, batch.withColumn("quantity", F.col("quantity") + 100)


@query
def incremental_upsert(spark, folder):
    table = refresh.Buckets(spark, run_dir(spark, "upsert"), LINE_KEY, 8)
    for rows in _line_loads(spark, folder):
        stored = refresh.incremental_upsert(rows, table, ["order_date", "quantity"])
    return stored


@query
def upsert_out_of_order(spark, folder):
    table = refresh.Buckets(spark, run_dir(spark, "upsert-order"), LINE_KEY, 8)
    first, batch = _line_loads(spark, folder)
    for rows in (batch, first, batch):
        stored = refresh.incremental_upsert(rows, table, ["order_date", "quantity"])
    return stored


@query
def partitioned_upsert(spark, folder):
    path = run_dir(spark, "upsert-months")
    for rows in _line_loads(spark, folder):
        dated = rows.withColumn("order_month", F.date_format("order_date", "yyyyMM"))
        refresh.upsert_partitions(
            dated, path, LINE_KEY, ["order_month"], ["order_date"], newest_first=["order_date", "quantity"]
        )
    return read_table(spark, path).drop("order_month")


def _merge_on_read(spark, folder):
    table = deltas.newest_rows(spark, run_dir(spark, "merge-on-read"), LINE_KEY, ["order_date", "quantity"])
    first, batch = _line_loads(spark, folder)
    for rows in (batch, first, batch):
        table.add(rows)
    return table


@query
def merge_on_read(spark, folder):
    return _merge_on_read(spark, folder).current()


@query
def merge_on_read_compacted(spark, folder):
    table = _merge_on_read(spark, folder)
    table.compact()
    table.add(_line_loads(spark, folder)[0])  # older versions once more
    return table.current()


STATE_KEYS = ["region", "order_year"]
STATE_MEASURES = {"quantity": "sum", "sales": "sum", "first_date": "min", "last_date": "max", "loaded_at": "max"}


def _region_states(rows):
    measures = {n: (STATE_MEASURES[n], F.col(c)) for n, c in (
        ("quantity", "quantity"), ("sales", "sales"), ("first_date", "order_date"), ("last_date", "order_date"), ("loaded_at", "loaded_at"),
    )}
    return distinct.folded(rows, STATE_KEYS, ["order_id", "customer_id"], measures)


@query
def incremental_states(spark, folder):
    """Sums, bounds and distinct counts by region and year over three loads; the third corrects the lines of one year,
    whose groups are made anew."""
    source = lines(spark, folder, "order_id", "customer_id", "region", "order_date", "quantity", "sales")
    source = loaded(source).withColumn("order_year", whole(F.year("order_date")))
    wrong = F.coalesce((F.col("order_year") == fx.REFRESH_YEAR) & (F.col("order_id") % 7 == 0), F.lit(False))
    corrected = source.withColumns(
        {
            "quantity": F.when(wrong, F.col("quantity") + 100).otherwise(F.col("quantity")),
            "loaded_at": F.when(wrong, ntz(fx.CORRECTED_TS)).otherwise(F.col("loaded_at")),
        }
    )
    combine = STATE_MEASURES | {distinct.BITS: "or"}
    table = deltas.adding_states(spark, run_dir(spark, "states"), STATE_KEYS, combine, distinct.WORDS)
    first = source.where(F.col("loaded_at") == ntz(fx.LOAD_TS))
    for rows, changed in ((first, None), (source, None), (source, None), (corrected, corrected.where(wrong))):
        refresh.incremental_states(rows, table, STATE_KEYS, "loaded_at", _region_states, changed)
    counted = distinct.counted(table.current(), STATE_KEYS, {"total_orders": 0, "unique_customers": 1}, STATE_MEASURES)
    return counted.withColumn("sales", F.col("sales").cast("decimal(22,2)"))


def _segment_loads(spark, folder, late):
    """Customer segments kept up to date over two loads, the second with the ``late`` lines; a third brings nothing."""
    source = loaded(lines(spark, folder, "order_id", "customer_id", "order_date", "sales"), late)
    table = refresh.Versions(spark, run_dir(spark, "aggregate"))

    def totals(rows):
        return customers.customer_segments(rows, **fx.CUSTOMER_SEGMENT, attributes=["loaded_at"])

    first = source.where(F.col("loaded_at") == ntz(fx.LOAD_TS))
    for rows in (first, source, source):
        stored = refresh.incremental_aggregate(rows, table, ["customer_id"], "loaded_at", totals)
    return stored


@query
def incremental_aggregate(spark, folder):
    return _segment_loads(spark, folder, F.col("order_date") >= F.lit(fx.FIRST_LOAD_UNTIL))


@query
def incremental_same_day(spark, folder):
    """Every date is in both loads."""
    return _segment_loads(spark, folder, F.col("order_id") % 3 == 0)


@query
def incremental_late_rows(spark, folder):
    """The second load brings the older dates, and customers that are new."""
    older = F.col("order_date") < F.lit(fx.KNOWN_BEFORE)
    return _segment_loads(spark, folder, older | (F.col("customer_id") % 5 == 0))


@query
def partition_refresh(spark, folder):
    path = run_dir(spark, "partitions")
    source = lines(spark, folder, "region", "order_date", "sales")
    yearly = (
        source.groupBy("region", whole(F.year("order_date")).alias("order_year"))
        .agg(money_sum("sales").alias("total_sales"), F.count("*").alias("line_count"))
        .withColumn("load_no", F.lit(1))
    )
    refresh.partition_refresh(yearly, path, ["order_year"])
    again = yearly.where(F.col("order_year") == fx.REFRESH_YEAR).withColumn("load_no", F.lit(2))
    refresh.partition_refresh(again, path, ["order_year"])
    return read_table(spark, path)


@query
def schema_guard(spark, folder):
    path = run_dir(spark, "guard")
    readings = star.readings(spark, folder).drop("station_id")
    half = ntz(fx.HALF_TIME)
    refresh.guarded_append(readings.where(F.col("reading_ts") < half), path)
    try:
        refresh.guarded_append(readings.withColumn("extra", F.lit(1)), path)
    except schema.SchemaChanged:
        refresh.guarded_append(readings.where(F.col("reading_ts") >= half), path)
    return spark.read.parquet(path)


def _table_totals(tables, measures):
    return metrics.stacked(
        [
            tables[name].agg(
                F.lit(name).alias("model"),
                F.count("*").alias("row_count"),
                F.sum(F.col(measure).cast("decimal(22,2)")).cast("decimal(22,2)").alias("total"),
            )
            for name, measure in measures.items()
        ]
    )


@query
def layers_retail(spark, folder):
    models = retail_models(fx.LOAD_TS, fx.AS_OF, fx.SEGMENTS, RETAIL_CLASSES)
    built = run_layers(spark, {"orders": lines(spark, folder)}, models, run_dir(spark, "retail"))
    return _table_totals(built, RETAIL_TOTALS)


def retail_loads(source):
    """Two loads of lines: the second has late dates, dates of the first one, and customers that are new."""
    late = (F.col("order_id") % 3 == 0) | (F.col("customer_id") % 7 == 0)
    return source.where(~late), source.where(late)


def layered_retail(spark, folder):
    """(incremental build over two loads, the second run twice; full build)"""
    source = lines(spark, folder)
    path = run_dir(spark, "retail-incremental")
    first, second = retail_loads(source)
    runs = [
        (first, fx.LOAD_TS, (fx.RUN_STARTED, fx.RUN_ID)),
        (second, fx.NEXT_LOAD_TS, (fx.NEXT_RUN_STARTED, fx.NEXT_RUN_ID)),
        (second, fx.NEXT_LOAD_TS, (fx.NEXT_RUN_STARTED, fx.NEXT_RUN_ID)),
    ]
    for rows, load_ts, run in runs:
        models = retail_models(load_ts, fx.AS_OF, fx.SEGMENTS, RETAIL_CLASSES, run, [*LINE_KEY, "sales"])
        built = run_layers(spark, {"orders": rows}, models, path)
    models = retail_models(fx.LOAD_TS, fx.AS_OF, fx.SEGMENTS, RETAIL_CLASSES)
    return built, run_layers(spark, {"orders": source}, models, run_dir(spark, "retail-full"))


#: Ids of order lines; what has a row per line is compared in parts by them.
LINE_IDS = ("order_id", "line_no", "product_id")


def differing(built, full, name):
    """Rows of a model that only one of two builds has, as often as it has them more; load metadata aside.

    One shuffle of both builds' rows; the counts are stored, so the shuffles of a model, or of a part of its lines, are gone before
    the next one's.
    """
    columns = [c for c in full[name].columns if c not in (*staging.RUN_METADATA, "load_ts")]
    a, b = (df[name].select(*columns) for df in (built, full))
    both = a.withColumn("_more", F.lit(1)).unionByName(b.withColumn("_more", F.lit(-1)))
    parts = sinks.Parts(LINE_IDS, 4) if set(LINE_IDS) <= set(columns) else sinks.ONE_PART
    counts = []
    for part in parts.of(both):
        unequal = part.groupBy(*columns).agg(F.sum("_more").alias("_more")).where("_more <> 0")
        counts.append(staging.settled(unequal.agg(F.sum(F.abs("_more")).alias("_n")), "differing"))
    return metrics.stacked(counts).agg(F.lit(name).alias("model"), F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("differing_rows"))


def _compared(built, full, totals):
    spark = next(iter(built.values())).sparkSession
    with building(spark):
        found = metrics.stacked([differing(built, full, name) for name in totals])
        found = staging.settled(found, "differing")
    return _table_totals(built, totals).join(found, "model")


@query
def layers_retail_incremental(spark, folder):
    built, full = layered_retail(spark, folder)
    totals = {name: measure for name, measure in RETAIL_TOTALS.items() if name != "stg_orders"}
    return _compared(built, full, totals)


@query
def layers_quality(spark, folder):
    """Checks of both domains' tables, counted while a build stores them."""
    reports = []
    retail_tables = ("stg_orders", "int_orders_enriched", "int_customer_metrics")
    chosen = [m for m in retail_models(fx.LOAD_TS, fx.AS_OF, fx.SEGMENTS, RETAIL_CLASSES) if m.name in retail_tables]
    days = [m for m in weather_models(fx.DAILY_LIMITS) if m.name in ("stg_readings", "int_daily_weather")]
    sources = ({"orders": lines(spark, folder)}, {"readings": star.readings(spark, folder, faulty=True)})
    for models, source in zip((chosen, days), sources):
        path = run_dir(spark, "layers-quality")
        run_layers(spark, source, models, path)
        reports.append(quality_of(spark, models, path))
    return metrics.stacked(reports)


RETAIL_CLASSES = {
    "customer_tier": fx.CUSTOMER_TIER,
    "customer_segment": fx.CUSTOMER_SEGMENT,
    "product_tier": fx.PRODUCT_TIER,
    "enrich": {"size_steps": fx.SIZE_STEPS},
    "coordinates": fx.COORDINATES,
}
RETAIL_TOTALS = {
    "stg_orders": "net_sales",
    "int_orders_enriched": "net_sales",
    "int_customer_metrics": "total_spent",
    "int_customer_segments": "total_spent",
    "int_product_performance": "total_revenue",
    "int_regional_sales": "total_sales",
    "int_geo_customers": "latitude",
    "int_group_totals": "total_sales",
    "mart_orders_summary": "total_sales",
    "int_category_region_month": "total_sales",
    "mart_sales_overview": "total_sales",
    "mart_customer_segments": "total_spent",
    "mart_delivery_performance": "orders_count",
    "mart_product_abc_analysis": "total_sales",
    "mart_top_products": "metric_value",
    "mart_average_check": "total_sales",
    "mart_retention": "retained_customers",
    "mart_clv": "customer_lifespan",
    "mart_profit": "total_profit",
}


@query
def layers_weather(spark, folder):
    readings = star.readings(spark, folder)
    models = weather_models(fx.DAILY_LIMITS, fx.TRAILING_THRESHOLD, trailing_limit=fx.TRAILING_THRESHOLD)
    sources = {"readings": readings, "norms": star.weekday_norms(readings)}
    return _table_totals(run_layers(spark, sources, models, run_dir(spark, "weather")), WEATHER_TOTALS)


@query
def layers_weather_incremental(spark, folder):
    """Two loads that share the day the second one starts on."""
    readings = star.readings(spark, folder)
    norms = star.weekday_norms(readings)
    path = run_dir(spark, "weather-incremental")
    second = F.col("reading_ts") >= ntz(fx.HALF_TIME)
    marked = readings.withColumn("loaded_at", F.when(second, ntz(fx.NEXT_LOAD_TS)).otherwise(ntz(fx.LOAD_TS)))
    limits = {"limits": fx.DAILY_LIMITS, "anomaly_limit": fx.TRAILING_THRESHOLD, "trailing_limit": fx.TRAILING_THRESHOLD}
    for rows in (marked.where(~second), marked, marked):
        models = weather_models(**limits, incremental=True)
        built = run_layers(spark, {"readings": rows, "norms": norms}, models, path)
    full = run_layers(spark, {"readings": readings, "norms": norms}, weather_models(**limits), run_dir(spark, "weather-full"))
    built["int_comfort_index"] = built["int_comfort_index"].withColumn("yyyymm", F.date_format("reading_ts", "yyyyMM"))
    return _compared(built, full, WEATHER_TOTALS)


WEATHER_TOTALS = {
    "stg_readings": "precipitation",
    "stg_weather_metrics": "precipitation_mm",
    "int_daily_weather": "total_precipitation",
    "int_comfort_index": "temperature_2m",
    "int_weather_anomalies": "anomaly",
    "int_norm_deviation": "temperature_anomaly",
    "int_linear_comfort": "comfort_index",
    "mart_daily_metrics": "total_precipitation",
    "mart_anomalies": "significant_anomaly_alert",
    "mart_comfort": "low_comfort_alert",
    "mart_trailing": "is_anomaly",
    "mart_daily_fact": "total_precipitation",
    "mart_summary": "total_precipitation",
}


@query
def top_products_snapshot(spark, folder):
    path = run_dir(spark, "snapshots")
    ranking = top_products_two_metrics(spark, folder)
    for day in (fx.AS_OF, fx.AS_OF + dt.timedelta(days=1), fx.AS_OF):
        refresh.partition_refresh(products.snapshot(ranking, day), path, ["analysis_date"])
    return read_table(spark, path)


# --- quality ---------------------------------------------------------------------------------


@query
def dq_report(spark, folder):
    return metrics.stacked([quality.quality_report(*x) for x in _checked(spark, folder)])


@query
def dq_observed(spark, folder):
    """The same counts, taken while the tables are written."""
    found = []
    for rows, name, checks in _checked(spark, folder):
        watch = quality.Watch(name, checks)
        sinks.write_new(watch(rows), run_dir(spark, "observed"))
        found.append(watch.report(spark))
    return metrics.stacked(found)


def _checked(spark, folder):
    source = lines(
        spark, folder, *LINE_KEY, "customer_id", "segment", "order_date", "ship_date", "sales", "quantity", "discount",
        "profit",
    )
    enriched = enrich.enrich_orders(source, size_steps=fx.SIZE_STEPS)
    q = quality
    order_checks = [
        *q.not_null("order_id", "customer_id", "order_date", "ship_date", "sales"),
        q.accepted_values("segment", fx.SEGMENTS[:4]),
        q.accepted_values("delivery_status", ["Not Shipped", "Fast", "Standard", "Slow"]),
        q.accepted_range("sales", low=0),
        q.accepted_range("quantity", low=1, high=40),
        q.accepted_range("discount", high=9000),
        q.accepted_range("delivery_days", low=0, high=365),
        q.positive("profit"),
        q.in_past("order_date", fx.BATCH_FROM),
    ]
    readings = star.readings(spark, folder, faulty=True)
    reading_checks = [
        *q.not_null(*staging.READING_COLUMNS),
        q.accepted_range("temperature_2m", low=-5, high=25),
        q.accepted_range("relative_humidity_2m", low=0, high=100),
        q.positive("wind_speed_10m"),
    ]
    return [(enriched, "int_orders_enriched", order_checks), (readings, "stg_readings", reading_checks)]


@query
def dq_marts(spark, folder):
    q = quality
    customer_checks = [
        *q.not_null("customer_id", "total_orders", "total_spent"),
        q.accepted_range("total_orders", low=1),
        q.accepted_range("total_spent", low=0),
        q.accepted_values("customer_tier", retail.CUSTOMER_TIERS[:3]),
        q.accepted_range("customer_lifetime_days", low=0, high=2200),
        q.positive("total_profit"),
    ]
    day_checks = [
        *q.not_null("measurement_date", "avg_temperature", "total_precipitation"),
        q.accepted_range("avg_humidity", low=0, high=100),
        q.accepted_range("max_temperature", high=29.95),
        q.positive("measurement_count"),
    ]
    return q.quality_report(_customer_metrics(spark, folder), "int_customer_metrics", customer_checks).unionByName(
        q.quality_report(weather.daily_weather(star.readings(spark, folder)), "int_daily_weather", day_checks)
    )


@query
def dq_unique(spark, folder):
    orders = star.table(spark, folder, "orders")
    return metrics.stacked(
        [
            quality.uniqueness_report(orders, "orders", ["o_orderkey"]),
            quality.uniqueness_report(star.table(spark, folder, "lineitem"), "lineitem", ["l_orderkey"]),
            quality.uniqueness_report(_customer_metrics(spark, folder), "int_customer_metrics", ["customer_id"]),
        ]
    )


@query
def dq_unique_hashed(spark, folder):
    orders, line_items = star.table(spark, folder, "orders"), star.table(spark, folder, "lineitem")
    report = quality.hashed_uniqueness_report
    return metrics.stacked(
        [
            report(orders, "orders", ["o_orderkey"]),
            report(line_items, "lineitem", ["l_orderkey"]),
            report(_customer_metrics(spark, folder), "int_customer_metrics", ["customer_id"]),
        ]
    )


@query
def dq_unique_combo(spark, folder):
    source = lines(spark, folder, *LINE_KEY)
    combos = (["order_id", "product_id"], ["order_id", "line_no"], LINE_KEY)
    return metrics.stacked(
        [quality.uniqueness_report(source, "order_lines", keys, "unique_combination") for keys in combos]
    )


@query
def dq_orphans(spark, folder):
    return star.orphans(spark, folder)


@query
def dq_numeric(spark, folder):
    events = star.table(spark, folder, "events").select("value", F.get_json_object("props", "$.k").alias("k"))
    orders = star.table(spark, folder, "orders")
    return quality.quality_report(
        events, "events", [quality.numeric(events, "value"), quality.numeric(events, "k")]
    ).unionByName(
        quality.quality_report(
            orders, "orders", [quality.numeric(orders, c) for c in ("o_totalprice", "o_orderpriority")]
        )
    )


# --- metrics, alerts, cards ------------------------------------------------------------------


def _metric_values(spark, folder):
    """All values of lines come from one stored row per order."""
    per_order = (
        lines(spark, folder, "order_id", "customer_id", "order_date", "ship_date", "return_flag", "sales")
        .withColumn("_days", retail.delivery_days())
        .groupBy("order_id", "customer_id", "order_date")
        .agg(
            F.sum("_days").alias("days"),
            F.count("_days").alias("shipped"),
            F.max((F.col("return_flag") == "R").cast("int")).alias("returned"),
            F.sum("sales").alias("sales"),
        )
    )
    per_order = staging.settled(per_order, "per-order")
    overall = per_order.agg(
        ratio(F.sum("days"), F.sum("shipped")).alias("avg_delivery_days"),
        ratio(F.sum("returned"), F.count("*")).alias("return_rate"),
    )
    clv = customers.clv_by_months(per_order).agg(F.round(F.avg("clv"), 4).alias("avg_clv"))
    conversion = star.table(spark, folder, "events").agg(
        ratio(F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "view")).alias("rate")
    )
    crr = customers.retention_crr(per_order).withColumn("share", F.col("crr") / 100)
    return metrics.stacked(
        [
            metrics.metric_rows(overall, {m: m for m in ("avg_delivery_days", "return_rate")}),
            metrics.metric_rows(clv, {"avg_clv": "avg_clv"}),
            metrics.metric_rows(conversion, {"conversion_rate": "rate"}),
            metrics.metric_rows(crr, {"retention_crr": "share"}, "order_month"),
        ]
    )


@query
def metric_targets(spark, folder):
    return metrics.evaluate_metrics(_metric_values(spark, folder))


@query
def metric_alerts(spark, folder):
    daily = weather.daily_weather(star.readings(spark, folder))
    daily_values = metrics.metric_rows(
        daily,
        {"daily_temperature": "avg_temperature", "daily_humidity": "avg_humidity", "daily_wind": "avg_wind_speed"},
        weather.DAY,
    )
    rules = [
        *metrics.RULES,
        metrics.Rule("daily_temperature", ">", fx.DAILY_LIMITS["temperature"], "weather desk"),
        metrics.Rule("daily_temperature", "<=", 6, "weather desk"),
        metrics.Rule("daily_humidity", ">", fx.DAILY_LIMITS["humidity"], "weather desk"),
        metrics.Rule("daily_wind", ">=", fx.DAILY_LIMITS["wind"], "weather desk"),
    ]
    return metrics.evaluate_alerts(_metric_values(spark, folder).unionByName(daily_values), rules)


@query
def card_scalar(spark, folder):
    return metrics.card_scalar(lines(spark, folder, "sales"), money_sum("sales"), "total_sales")


@query
def card_line(spark, folder):
    return metrics.card_series(
        lines(spark, folder, "order_date", "sales"), month_start("order_date"), money_sum("sales"), "month", "total_sales"
    )


@query
def card_bar(spark, folder):
    return metrics.card_series(
        lines(spark, folder, "region", "sales"), F.col("region"), mean("sales"), "region", "avg_sales"
    )


@query
def card_pie(spark, folder):
    return metrics.card_pie(
        lines(spark, folder, "segment", "sales"), F.col("segment"), money_sum("sales"), "segment", "total_sales"
    )


@query
def card_table(spark, folder):
    totals = lines(spark, folder, "customer_id", "sales").groupBy("customer_id")
    return metrics.card_table(totals.agg(money_sum("sales").alias("total_sales")), "total_sales", 20, ["customer_id"])


# --- streams ---------------------------------------------------------------------------------


def _arrivals(spark, folder, name, newest_first=False):
    """Readings landing in two deliveries; yields after each one."""
    base = run_dir(spark, name)
    readings = star.readings(spark, folder)
    half = ntz(fx.HALF_TIME)
    parts = [F.col("reading_ts") < half, F.col("reading_ts") >= half]
    for part in reversed(parts) if newest_first else parts:
        sinks.append(readings.where(part), f"{base}/landing")
        yield base, loads.landing(spark, f"{base}/landing", readings.schema)


@query
def stream_append(spark, folder):
    for base, arriving in _arrivals(spark, folder, "stream"):
        loads.stream_append(arriving, f"{base}/table", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/table")


@query
def stream_upsert(spark, folder):
    for base, arriving in _arrivals(spark, folder, "stream-upsert"):
        latest = arriving.select("station_id", "reading_ts", "event_id", "temperature_2m")
        table = refresh.Buckets(spark, f"{base}/table", ["station_id"], 8)
        loads.stream_upsert(latest, table, ["reading_ts", "event_id"], f"{base}/checkpoint")
    return table.current()


@query
def stream_upsert_out_of_order(spark, folder):
    for base, arriving in _arrivals(spark, folder, "stream-order", newest_first=True):
        latest = arriving.select("station_id", "reading_ts", "event_id", "temperature_2m")
        table = refresh.Buckets(spark, f"{base}/table", ["station_id"], 8)
        loads.stream_upsert(latest, table, ["reading_ts", "event_id"], f"{base}/checkpoint")
    return table.current()


@query
def stream_daily_weather(spark, folder):
    for base, arriving in _arrivals(spark, folder, "stream-days"):
        loads.stream_daily_weather(arriving, f"{base}/table", f"{base}/checkpoint", partitions=4)
    return read_table(spark, f"{base}/table")


@query
def stream_dedupe(spark, folder):
    """The second delivery brings the first one's rows again, in another file."""
    base = run_dir(spark, "stream-dedupe")
    readings = star.readings(spark, folder)
    early = F.col("reading_ts") < ntz(fx.HALF_TIME)
    for rows in (readings.where(early), readings.where(early).unionByName(readings.where(~early))):
        sinks.append(rows, f"{base}/landing")
        arriving = loads.landing(spark, f"{base}/landing", readings.schema)
        loads.stream_dedupe(arriving, ["event_id"], "reading_ts", "40 days", f"{base}/table", f"{base}/checkpoint", partitions=4)
    return spark.read.parquet(f"{base}/table")


@query
def stream_checked(spark, folder):
    """Quality of each delivery, counted while it is appended."""
    checks = [
        *quality.not_null("event_id", *staging.READING_COLUMNS),
        quality.accepted_range("temperature_2m", low=-5, high=25),
        quality.positive("wind_speed_10m"),
    ]
    for base, arriving in _arrivals(spark, folder, "stream-checked"):
        loads.stream_checked(arriving, f"{base}/table", f"{base}/report", "readings", checks, f"{base}/checkpoint")
    written = read_table(spark, f"{base}/table").groupBy("batch_id").agg(F.count("*").alias("written_rows"))
    return read_table(spark, f"{base}/report").join(written, "batch_id")
