"""The retail build: staged lines, core tables, marts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import functions as F

from strata.functions import retail
from strata.operators import customers, enrich, products, quality, sales, staging
from strata.plans.layers import Model

LINE_KEY = ("order_id", "line_no", "product_id", "supplier_id")
MARK = "loaded_at"


def order_checks() -> list[quality.Check]:
    """Of the enriched lines."""
    return [
        *quality.not_null("order_id", "product_id", "customer_id"),
        quality.accepted_range("delivery_days", low=0, high=365),
        quality.accepted_values("delivery_status", [retail.NOT_SHIPPED, *labels(retail.DELIVERY_STEPS), retail.DELIVERY_SLOW]),
        quality.accepted_values("order_size_category", [*labels(retail.ORDER_SIZE_STEPS), retail.ORDER_SIZE_REST]),
        quality.accepted_values("profitability_category", [*labels(retail.MARGIN_STEPS), retail.MARGIN_REST]),
    ]


def customer_checks() -> list[quality.Check]:
    """Of the customer table."""
    return [
        *quality.not_null("customer_id", "total_orders", "total_spent"),
        quality.accepted_range("total_orders", low=1),
        quality.accepted_range("total_spent", low=0),
        quality.accepted_values("customer_tier", retail.CUSTOMER_TIERS),
        quality.accepted_range("customer_lifetime_days", low=0),
    ]


def labels(steps) -> list[str]:
    return [label for _, label in steps]


def retail_models(
    load_ts: dt.datetime,
    as_of: dt.date,
    segments: Sequence[str],
    tiers: Mapping[str, dict] | None = None,
    run: tuple[dt.datetime, str] | None = None,
    line_key: Sequence[str] = LINE_KEY,
) -> list[Model]:
    """Models over the source ``orders`` (order lines). ``tiers`` overrides class limits by name.

    With ``run`` (start and id) the build is incremental: ``orders`` holds the lines of one load, new or changed;
    they are stamped with the run, upserted into the enriched table, and the core aggregates build the groups anew that
    the load touched. ``line_key`` tells lines apart; a changed line keeps its customer, product and month. Without
    ``run``, ``orders`` holds all lines.
    """
    limits = dict(tiers or {})
    segment_limits = limits.get("customer_segment", {})
    coordinates = limits.get("coordinates", enrich.REGION_COORDINATES)

    def staged(t):
        lines = staging.with_margin_pct(staging.with_net_sales(staging.stage_orders(t["orders"], load_ts)))
        return staging.with_run_metadata(lines, load_ts, *run) if run else lines

    def dated(t):
        return t["stg_orders"].withColumn("order_yyyymm", F.date_format("order_date", "yyyyMM"))

    def enriched(rows):
        wide = enrich.enrich_orders(rows, **limits.get("enrich", {}))
        return wide.select(*[c for c in wide.columns if c != "order_yyyymm"], "order_yyyymm")

    def lines(t):
        return t["int_orders_enriched"]

    def core(name, aggregate, keys, partition_by=(), sort_by=(), checks=(), parts=1):
        """A core aggregate of the enriched lines. Built in full, its groups are checked."""
        if run:
            return Model(name, "core", lines, materialized="aggregate", keys=keys, mark=MARK, aggregate=aggregate, parts=parts)
        return Model(
            name, "core", lambda t: aggregate(lines(t)), partition_by, sort_by, checks=checks, parts=parts, parts_by=keys
        )

    def customer_table(rows):
        return customers.customer_table(rows, limits.get("customer_tier"))

    def segmented(rows):
        marked = [MARK] if run else []
        return customers.customer_segments(rows, **segment_limits, attributes=marked)

    def geo(t):
        latest = customers.latest_by(lines(t), "customer_id", ["customer_name", "region", "state"], "order_date")
        return enrich.geo_enrich(latest, coordinates)

    stored = (
        {"materialized": "upsert", "keys": line_key, "newest_first": (MARK,)} if run else {}
    )
    # Models that shuffle more than a small part of the lines' size are built in parts.
    return [
        Model("stg_orders", "stage", staged, materialized="view"),
        Model(
            "int_orders_enriched", "core", dated, ("order_yyyymm",), ("order_date", "customer_id"), checks=order_checks(),
            parts=4, parts_by=("order_id",), derive=enriched, **stored,
        ),
        core("int_customer_metrics", customer_table, ("customer_id",), checks=customer_checks(), parts=3),
        core("int_customer_segments", segmented, ("customer_id",)),
        core(
            "int_product_performance",
            lambda rows: products.product_performance(rows, limits.get("product_tier")),
            ("product_id",),
            ("category",),
            ("sub_category", "product_id"),
            parts=4,
        ),
        core(
            "int_regional_sales",
            lambda rows: sales.regional_sales(rows, segments),
            ("region", "order_year", "order_month"),
            ("order_year",),
            ("region", "order_month"),
        ),
        Model("int_category_region_month", "core", lambda t: sales.category_region_month(lines(t))),
        Model("int_geo_customers", "core", geo),
        Model("int_group_totals", "core", lambda t: sales.group_totals(lines(t))),
        Model("mart_sales_overview", "marts", lambda t: sales.sales_overview(lines(t))),
        Model(
            "mart_customer_segments",
            "marts",
            lambda t: customers.segment_share(customers.clv_by_days(t["int_customer_metrics"])),
            ("customer_tier",),
        ),
        Model("mart_delivery_performance", "marts", lambda t: sales.delivery_performance(lines(t)), materialized="view"),
        Model(
            "mart_product_abc_analysis",
            "marts",
            lambda t: products.abc_analysis(lines(t)),
            ("abc_category",),
            ("sales_rank",),
        ),
        Model(
            "mart_top_products",
            "marts",
            lambda t: products.snapshot(products.top_products_two_metrics(lines(t)), as_of),
            ("analysis_date",),
            materialized="partition",
        ),
        Model(
            "mart_average_check", "marts", lambda t: sales.average_check(lines(t), t["int_customer_segments"])
        ),
        Model(
            "mart_orders_summary",
            "marts",
            lambda t: sales.orders_summary(
                lines(t).drop("order_month"), t["int_customer_segments"], t["int_group_totals"]
            ),
            materialized="view",
        ),
        Model("mart_retention", "marts", lambda t: customers.retention_monthly(lines(t))),
        Model("mart_clv", "marts", lambda t: customers.clv_by_months(lines(t))),
        Model("mart_profit", "marts", lambda t: sales.profit_by_category_region(lines(t))),
    ]
