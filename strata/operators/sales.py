"""Sales aggregates by period, region, category and segment; delivery; rates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strata.functions import retail
from strata.functions.bands import exact
from strata.functions.exprs import mean, money_sum, month_start, number, ratio, whole
from strata.operators import distinct
from strata.operators.folding import folded_sums, line_measures, ones
from strata.operators.ranking import previous
from strata.operators.staging import run_marks, run_names, run_times, with_margin_pct, with_net_sales


def calendar(c: str | Column = "order_date") -> dict[str, Column]:
    return {"year": whole(F.year(c)), "quarter": whole(F.quarter(c)), "month": whole(F.month(c))}


def sales_overview(lines: DataFrame) -> DataFrame:
    """Month rows carrying the totals of their quarter and year.

    Lines are folded to months once: sums, and bitmap words of orders and customers. Months merge to quarters and years by OR,
    so an order with lines in several months counts once in each of them and once in their quarter and year, whatever its customers.
    """
    dated = with_net_sales(lines).withColumn("month_start", month_start("order_date"))
    measures = {"_net": ("sum", F.col("net_sales")), "_profit": ("sum", F.col("profit"))}
    sums = {n: f for n, (f, _) in measures.items()}
    months = distinct.folded(dated, ["month_start"], ["order_id", "customer_id"], measures)
    m = F.col("month_start")
    periods = F.array(*[F.struct(F.lit(k).alias("_span"), F.trunc(m, unit).alias("_start")) for k, unit in enumerate(("month", "quarter", "year"))])
    spans = distinct.merged(months.select("*", F.inline(periods)), ["_span", "_start"], sums)
    names = {"total_orders": 0, "unique_customers": 1}
    rows = distinct.counted(spans, ["_span", "_start"], names, sums).withColumns(
        {"total_sales": F.col("_net").cast("decimal(22,2)"), "total_profit": F.col("_profit").cast("decimal(22,2)")}
        | calendar("_start")
    )
    # From here on a row per month, quarter and year.
    year = W.partitionBy("year")
    totals = {}
    for span, name, group in ((1, "quarterly", W.partitionBy("year", "quarter")), (2, "yearly", year)):
        for measure in ("sales", "profit", "orders"):
            totals[f"{name}_{measure}"] = F.max(F.when(F.col("_span") == span, F.col(f"total_{measure}"))).over(group)
    with_totals = rows.withColumns(totals).where("_span = 0").withColumns(
        {
            "profit_margin": ratio("total_profit", "total_sales"),
            "avg_order_value": ratio("total_sales", "total_orders"),
        }
    )
    return with_totals.withColumnRenamed("_start", "month_start").drop("_span", "_net", "_profit")


def sales_by_time(lines: DataFrame, amount: str = "sales") -> DataFrame:
    months = lines.groupBy(month_start("order_date").alias("order_month")).agg(
        money_sum(amount).alias("total_sales"), F.count_distinct("order_id").alias("total_orders")
    )
    return months.withColumns(calendar("order_month"))


def period_totals(lines: DataFrame, amount: str = "sales") -> DataFrame:
    """Totals by month, quarter, year and overall; ``level`` says which (0 month … 7 all)."""
    months = lines.groupBy(month_start("order_date").alias("_m")).agg(money_sum(amount).alias("_sales"))
    return (
        months.withColumns(calendar("_m"))
        .rollup("year", "quarter", "month")
        .agg(money_sum("_sales").alias("total_sales"), F.grouping_id().cast("bigint").alias("level"))
    )


def sales_per_period(lines: DataFrame, unit: str, amount: str = "sales") -> DataFrame:
    """Total per day, or per week from its Monday."""
    period = F.to_date("order_date") if unit == "day" else F.trunc("order_date", unit)
    return lines.groupBy(period.alias("period_start")).agg(
        money_sum(amount).alias("total_sales"), F.count("*").alias("line_count")
    )


def regional_sales(lines: DataFrame, segments: Sequence[str]) -> DataFrame:
    """Region × month: reach, totals, averages, lines per segment, best category, delivery.

    One pass, as for the product table: sums folded to (region, month, category), identifiers to bitmap words. Carries the
    rows' load metadata.
    """
    keys = ("region", "order_year", "order_month")
    dated = with_margin_pct(with_net_sales(lines)).withColumns(
        {
            "order_year": whole(F.year("order_date")),
            "order_month": whole(F.month("order_date")),
            "_days": retail.delivery_days(),
        }
    )
    per_segment = {f"{s.lower().replace(' ', '_')}_orders": ("sum", ones(F.col("segment") == s)) for s in segments}
    measures = line_measures() | per_segment | run_times(dated) | {
        "_days": ("sum", F.col("_days")),
        "_shipped": ("sum", ones(F.col("_days").isNotNull())),
        "_unshipped": ("sum", ones(F.col("_days").isNull())),
    }
    ids = ["order_id", "customer_id", "product_id", "state"]
    names = {"total_orders": 0, "unique_customers": 1, "unique_products": 2, "unique_states": 3}
    finer = ["category", *run_names(dated)]
    states = distinct.folded(dated, keys, ids, measures, finer)
    groups = distinct.counted(states, keys, names, {n: f for n, (f, _) in measures.items()}, finer)
    return groups.groupBy(*keys).agg(
        *run_marks(dated),
        *folded_sums("total_quantity", "total_sales"),
        *[F.sum(n).alias(n) for n in (*per_segment, *names)],
        ratio(F.sum("_days"), F.sum("_shipped")).alias("avg_delivery_days"),
        F.sum("_unshipped").alias("unshipped_orders"),
        F.max(F.struct("_best", "category"))["category"].alias("top_category_by_sales"),
    )


def category_region_month(lines: DataFrame, month_of_year: bool = False) -> DataFrame:
    """Category × region × month totals; ``month_of_year`` merges the years. Orders and customers are counted by bitmap words."""
    month = whole(F.month("order_date")) if month_of_year else month_start("order_date")
    keys = ["category", "region", "order_month"]
    measures = {f"_{c}": ("sum", F.col(c)) for c in ("sales", "quantity", "profit", "discount")}
    measures["_discounts"] = ("sum", ones(F.col("discount").isNotNull()))
    states = distinct.folded(lines.withColumn("order_month", month), keys, ["order_id", "customer_id"], measures)
    groups = distinct.counted(states, keys, {"order_count": 0, "customer_count": 1}, {n: "sum" for n in measures})
    return groups.select(
        *keys,
        F.col("_sales").cast("decimal(22,2)").alias("total_sales"),
        F.col("_quantity").alias("total_quantity"),
        F.col("_profit").cast("decimal(22,2)").alias("total_profit"),
        ratio("_discount", "_discounts").alias("avg_discount"),
        "order_count",
        "customer_count",
    )


def customer_sketches(lines: DataFrame) -> DataFrame:
    """Sketches of orders and customers by day, to be stored; they merge to any period (:func:`unique_customers_estimated`)."""
    return distinct.sketches(lines, ["order_date"], {"orders": "order_id", "customers": "customer_id"})


def unique_customers_estimated(sketches: DataFrame, unit: str = "month") -> DataFrame:
    """Estimated orders and customers per period from stored daily sketches, without the lines: the opt-in alternative to
    exact counts."""
    return distinct.estimated(sketches, [F.trunc("order_date", unit).alias("period_start")], ["orders", "customers"])


SUMMARY_KEYS = ("category", "region", "order_month")


def group_totals(lines: DataFrame) -> DataFrame:
    """Totals per category, region and month of year."""
    dated = lines.withColumn("order_month", whole(F.month("order_date")))
    return dated.groupBy(*SUMMARY_KEYS).agg(
        money_sum("sales").alias("total_sales"),
        F.sum("quantity").alias("total_quantity"),
        mean("discount").alias("avg_discount"),
        money_sum("profit").alias("total_profit"),
    )


def orders_summary(lines: DataFrame, segments: DataFrame, totals: DataFrame) -> DataFrame:
    """Every line with its customer's segment and the totals (:func:`group_totals`) of its category, region and month.

    Give stored tables: Spark then sees how few the totals are and broadcasts them.
    """
    dated = lines.withColumn("order_month", whole(F.month("order_date")))
    with_segment = dated.join(segments.select("customer_id", "customer_segment"), "customer_id", "left")
    return with_segment.join(totals, list(SUMMARY_KEYS), "left")


def profit_by_category_region(lines: DataFrame) -> DataFrame:
    return lines.groupBy("category", "region").agg(
        money_sum("profit").alias("total_profit"), ratio(F.sum("profit"), F.sum("sales")).alias("profitability")
    )


def assumed_margin(lines: DataFrame, cost_rate: float = 0.2) -> DataFrame:
    """Profit and margin if cost were a fixed part of sales."""
    profit = F.sum("sales") - F.sum("sales") * exact(cost_rate)
    return lines.groupBy("category", "region").agg(
        profit.cast("decimal(22,2)").alias("profit"), ratio(profit, F.sum("sales")).alias("margin")
    )


def average_check(lines: DataFrame, segments: DataFrame) -> DataFrame:
    """Sales per order (and per line) by customer segment.

    Lines are summed per customer before they meet the segments, so a hot
    customer is one row in the join. An order belongs to one customer.
    """
    joined = _per_customer(lines).join(segments.select("customer_id", "customer_segment"), "customer_id")
    return _check_by_segment(joined)


def average_check_by_total(lines: DataFrame, total_over=10000, count_over=10) -> DataFrame:
    """:func:`average_check` for segments by total and orders, in one pass over the lines."""
    segment = retail.customer_segment("_sales", "_orders", total_over, count_over)
    return _check_by_segment(_per_customer(lines).withColumn("customer_segment", segment))


def _per_customer(lines: DataFrame) -> DataFrame:
    return lines.groupBy("customer_id").agg(
        F.sum("sales").alias("_sales"), F.count("*").alias("_lines"), F.count_distinct("order_id").alias("_orders")
    )


def _check_by_segment(per_customer: DataFrame) -> DataFrame:
    return per_customer.groupBy("customer_segment").agg(
        money_sum("_sales").alias("total_sales"),
        F.sum("_orders").alias("total_orders"),
        ratio(F.sum("_sales"), F.sum("_orders")).alias("average_check"),
        ratio(F.sum("_sales"), F.sum("_lines")).alias("average_sale"),
    )


def delivery_performance(lines: DataFrame, steps=retail.DELIVERY_STEPS) -> DataFrame:
    """Count, mean, extremes, median and 95th percentile of delivery days per status and overall.

    Lines are first counted per number of days: a histogram of whole days is
    small whatever the volume, and exact percentiles come from its counts.
    """
    days = lines.select(whole(retail.delivery_days()).alias("days")).where("days IS NOT NULL")
    histogram = days.groupBy("days").agg(F.count("*").alias("n"))
    labelled = histogram.withColumn("delivery_status", retail.delivery_status("days", steps))
    order = {"Overall": 1, **{label: i + 2 for i, (_, label) in enumerate(steps)}}
    rows = labelled.rollup("delivery_status").agg(
        F.sum("n").alias("orders_count"),
        ratio(F.sum(F.col("days") * F.col("n")), F.sum("n")).alias("avg_delivery_days"),
        F.min("days").alias("min_delivery_days"),
        F.max("days").alias("max_delivery_days"),
        number(F.percentile("days", 0.5, F.col("n"))).alias("median_delivery_days"),
        number(F.percentile("days", 0.95, F.col("n"))).alias("p95_delivery_days"),
    )
    rows = rows.withColumn("delivery_status", F.coalesce("delivery_status", F.lit("Overall")))
    key = None
    for label, position in order.items():
        test = F.col("delivery_status") == label
        key = F.when(test, position) if key is None else key.when(test, position)
    return rows.withColumn("sort_key", key.otherwise(len(order) + 1)).orderBy("sort_key")


def avg_delivery_days(lines: DataFrame, by: Sequence[str] = ("region",)) -> DataFrame:
    return lines.groupBy(*by).agg(
        mean(retail.delivery_days()).alias("avg_delivery_days"),
        F.count_if(retail.shipped()).alias("shipped_lines"),
    )


def order_dynamics(lines: DataFrame) -> DataFrame:
    """Orders and sales per month with the change from the month before."""
    months = lines.groupBy(month_start("order_date").alias("order_month")).agg(
        F.count_distinct("order_id").alias("order_count"), money_sum("sales").alias("total_sales")
    )
    before = {
        "previous_orders": previous("order_count", "order_month"),
        "previous_sales": previous("total_sales", "order_month"),
    }
    return months.withColumns(before).withColumns(
        {
            "order_change": F.col("order_count") - F.col("previous_orders"),
            "sales_change_pct": ratio(F.col("total_sales") - F.col("previous_sales"), "previous_sales"),
        }
    )


def sales_drop_alert(lines: DataFrame, drop: float = 0.15) -> DataFrame:
    """Months whose sales fell by at least ``drop`` against the month before."""
    months = order_dynamics(lines).select("order_month", "total_sales", "previous_sales", "sales_change_pct")
    fallen = F.col("total_sales") <= F.col("previous_sales") * exact(1 - drop)
    return months.withColumn("drop_alert", F.when(fallen, 1).otherwise(0))


def return_rate(lines: DataFrame, flag: str = "R", by: Sequence[str] = ()) -> DataFrame:
    """Orders with a returned line as part of all orders.

    Lines are first folded to orders, in the partitioning their join left.
    """
    orders = lines.groupBy("order_id", *by).agg(F.max((F.col("return_flag") == flag).cast("int")).alias("_back"))
    return orders.groupBy(*by).agg(
        F.sum("_back").alias("returned_orders"),
        F.count("*").alias("total_orders"),
        ratio(F.sum("_back"), F.count("*")).alias("return_rate"),
    )


def conversion_rate(events: DataFrame, visit="view", purchase="purchase") -> DataFrame:
    """Purchases per visit and day."""
    kind = F.col("event_type")
    per_day = events.groupBy(F.to_date("ts").alias("event_date")).agg(
        F.count_if(kind == visit).alias("visits"), F.count_if(kind == purchase).alias("purchases")
    )
    return per_day.withColumn("conversion_rate", ratio("purchases", "visits"))


def region_sales_customers(lines: DataFrame) -> DataFrame:
    return lines.groupBy("region").agg(
        money_sum("sales").alias("total_sales"), F.count_distinct("customer_id").alias("unique_customers")
    )


def counts(df: DataFrame, columns: Mapping[str, Column] | Sequence[str], name: str = "n") -> DataFrame:
    named = columns.items() if isinstance(columns, Mapping) else [(c, F.col(c)) for c in columns]
    return df.groupBy(*[c.alias(n) for n, c in named]).agg(F.count("*").alias(name))
