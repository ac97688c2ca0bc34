"""Customer aggregates: metrics, tiers, segments, lifetime value, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from strata.functions import retail
from strata.functions.exprs import mean, money_sum, month_index, month_start, number, ratio, whole
from strata.operators.ranking import previous
from strata.operators.staging import run_marks, with_margin_pct, with_net_sales

DAYS_PER_YEAR = 365.0


def latest_by(df: DataFrame, key: str, values: Sequence[str], order: str) -> DataFrame:
    """``values`` of the row with the greatest ``order`` per key; ties go to the greatest values."""
    return picked_rows(df, key, [(values, order)])


def picked_rows(df: DataFrame, key: str, picks: Sequence[tuple[Sequence[str], str]]) -> DataFrame:
    """:func:`latest_by` for several (values, order) pairs in one pass.

    First one row per key and values with the greatest orders, an aggregate that
    hashes on the map side and takes the weight out of a hot key; only what is
    left is compared as structs.
    """
    values = [v for names, _ in picks for v in names]
    versions = df.groupBy(key, *values).agg(*[F.max(o).alias(f"_order{i}") for i, (_, o) in enumerate(picks)])
    best = versions.groupBy(key).agg(
        *[F.max(F.struct(f"_order{i}", *names)).alias(f"_best{i}") for i, (names, _) in enumerate(picks)]
    )
    return best.select(
        key, *[F.col(f"_best{i}").getField(v).alias(v) for i, (names, _) in enumerate(picks) for v in names]
    )


def customer_metrics(lines: DataFrame, tier: dict | None = None) -> DataFrame:
    """One row per customer: orders, spending, profit, first and last order, margin, tier, the rows' load metadata."""
    priced = with_margin_pct(with_net_sales(lines))
    grouped = priced.groupBy("customer_id", "customer_name", "segment").agg(
        F.count_distinct("order_id").alias("total_orders"),
        money_sum("net_sales").alias("total_spent"),
        mean("net_sales").alias("avg_order_value"),
        money_sum("profit").alias("total_profit"),
        F.sum("quantity").alias("total_quantity"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
        number(F.avg("profit_margin_pct")).alias("avg_profit_margin"),
        *run_marks(priced),
    )
    return grouped.withColumns(
        {
            "customer_lifetime_days": whole(F.date_diff("last_order_date", "first_order_date")),
            "customer_tier": retail.customer_tier("total_spent", "total_orders", **(tier or {})),
        }
    )


def customer_latest_attrs(lines: DataFrame) -> DataFrame:
    """Last known place of a customer, and category and sub-category of the biggest line."""
    picks = [(("region", "state"), "order_date"), (("category", "sub_category"), "net_sales")]
    return picked_rows(with_net_sales(lines), "customer_id", picks).select(
        "customer_id",
        *[F.col(c).alias(f"latest_{c}") for c in ("region", "state")],
        *[F.col(c).alias(f"preferred_{c}") for c in ("category", "sub_category")],
    )


def customer_table(lines: DataFrame, tier: dict | None = None) -> DataFrame:
    """:func:`customer_metrics` with the latest place and the preferred category of each customer; give stored lines."""
    return customer_metrics(lines, tier).join(customer_latest_attrs(lines), "customer_id", "left")


def customer_segments(
    lines: DataFrame, amount="sales", total_over=10000, count_over=10, count_lines=False, attributes: Sequence[str] = ()
) -> DataFrame:
    """VIP by total, Frequent by number of orders (or of lines), else Regular."""
    counted = F.count("order_id") if count_lines else F.count_distinct("order_id")
    totals = lines.groupBy("customer_id").agg(
        *[F.max(a).alias(a) for a in attributes],
        money_sum(amount).alias("total_spent"),
        counted.alias("order_count"),
    )
    segment = retail.customer_segment("total_spent", "order_count", total_over, count_over)
    return totals.withColumn("customer_segment", segment)


def clv_by_days(metrics: DataFrame) -> DataFrame:
    """Order value, orders per year and lifetime value from the days between first and last order.

    Value × frequency × years cancels to the total spent; the general product is
    kept in ``customer_lifetime_value`` with full precision and rounded last.
    """
    spent, orders, days = (F.col(c).cast("double") for c in ("total_spent", "total_orders", "customer_lifetime_days"))
    years = days / DAYS_PER_YEAR
    value = F.try_divide(spent, orders)
    lasting = F.col("customer_lifetime_days") > 0
    per_year = F.when(lasting, F.try_divide(orders, years)).otherwise(F.lit(0.0))
    lifetime = F.when(lasting, value * F.try_divide(orders, years) * years).otherwise(spent)
    return metrics.select(
        "customer_id",
        "customer_tier",
        "total_orders",
        "total_spent",
        "customer_lifetime_days",
        value.alias("avg_order_value"),
        per_year.alias("purchase_frequency"),
        F.round(lifetime, 2).alias("customer_lifetime_value"),
    )


def clv_by_months(lines: DataFrame, amount="sales") -> DataFrame:
    """Order value × orders per month × months, months counted by calendar boundaries."""
    totals = lines.groupBy("customer_id").agg(
        F.count_distinct("order_id").alias("orders"),
        F.sum(amount).cast("double").alias("spent"),
        F.min("order_date").alias("first"),
        F.max("order_date").alias("last"),
    )
    months = month_index("last") - month_index("first")
    value = F.try_divide(F.col("spent"), F.col("orders").cast("double"))
    frequency = F.col("orders").cast("double") / F.greatest(months, F.lit(1))
    return totals.select(
        "customer_id",
        value.alias("avg_order_value"),
        frequency.alias("purchase_frequency"),
        whole(months).alias("customer_lifespan"),
        F.round(value * frequency * months, 2).alias("clv"),
    )


def segment_share(clv: DataFrame) -> DataFrame:
    """Every customer with the totals of its tier and its share of the tier's revenue."""
    tiers = clv.groupBy("customer_tier").agg(
        F.count("*").alias("customers_count"),
        mean("total_spent").alias("avg_total_spent"),
        mean("total_orders").alias("avg_total_orders"),
        F.round(F.avg("avg_order_value"), 4).alias("avg_order_value_segment"),
        F.round(F.avg("customer_lifetime_value"), 4).alias("avg_clv"),
        money_sum("total_spent").alias("segment_revenue"),
        F.sum("total_orders").alias("segment_orders"),
    )
    # The tier is one of four labels: at most four rows, whatever the data.
    joined = clv.join(F.broadcast(tiers), "customer_tier", "left")
    return joined.withColumn("revenue_contribution_pct", ratio("total_spent", "segment_revenue"))


def customer_months(lines: DataFrame) -> DataFrame:
    return lines.select("customer_id", month_start("order_date").alias("order_month")).distinct()


def _activity(lines: DataFrame) -> DataFrame:
    """(customer, month) with the month before and the first month; at most one row per month and customer."""
    own = W.partitionBy("customer_id")
    return customer_months(lines).withColumns(
        {
            "_before": F.lag("order_month").over(own.orderBy("order_month")),
            "_first": F.min("order_month").over(own),
        }
    )


def retention_monthly(lines: DataFrame) -> DataFrame:
    """Active customers per month, those active in the month before, and their share of that month."""
    kept = F.col("_before") == F.add_months("order_month", -1)
    months = (
        _activity(lines)
        .groupBy("order_month")
        .agg(F.count("*").alias("current_customers"), F.count_if(kept).alias("retained_customers"))
    )
    # One row per month from here on.
    months = months.withColumn("previous_customers", previous("current_customers", "order_month"))
    rate = ratio("retained_customers", "previous_customers")
    return months.withColumn("retention_rate", F.coalesce(rate, F.lit(0.0)))


def retention_crr(lines: DataFrame) -> DataFrame:
    """((customers at end − new) / customers at start) × 100 per month."""
    new = F.col("_first") == F.col("order_month")
    months = (
        _activity(lines)
        .groupBy("order_month")
        .agg(F.count("*").alias("customers_at_end"), F.count_if(new).alias("new_customers"))
    )
    months = months.withColumn("customers_at_start", previous("customers_at_end", "order_month"))
    stayed = (F.col("customers_at_end") - F.col("new_customers")) * 100
    return months.withColumn("crr", ratio(stayed, "customers_at_start"))


