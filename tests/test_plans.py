"""The physical plans that matter on large data, and invariants of the results."""

import re

import pytest
from pyspark.sql import functions as F

from checks.queries import REGISTRY
from strata.sources import star

SMALL = "/root/testdata/sf0.001"
STORED = (
    "layers_ stream_ incremental_ csv_scan write_new load_all full_refresh replace_day append_load backfill partition "
    "schema_guard top_products_snapshot expire_ upsert_out_of_order merge_on_read interleaved_write dq_observed hwm_"
).split()
READ_ONLY = [n for n in REGISTRY if not n.startswith(tuple(STORED))]


@pytest.fixture()
def large(spark):
    """Plan as if no table were small."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield spark
    spark.conf.set(key, before)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_last_versions_are_cut_down_before_the_shuffle(large):
    from strata.operators.staging import dedupe

    text = plan(dedupe(star.table(large, SMALL, "events"), ["user_id"], ["ts"]))
    assert text.index("Exchange hashpartitioning(user_id") < text.index("partial_max(struct(")
    assert "Window" not in text


@pytest.mark.parametrize("name", ["sales_overview", "category_region_month", "category_region_month_of_year", "sales_by_time"])
def test_lines_are_scanned_once_and_never_multiplied(large, name):
    text = plan(REGISTRY[name](large, SMALL))
    assert text.count("l_orderkey:bigint") == 1 and "Expand" not in text


def test_aggregates_of_two_passes_read_stored_lines(large):
    assert "l_orderkey:bigint" not in plan(REGISTRY["customer_table"](large, SMALL))


def test_declared_tables_are_joined_by_their_known_size(spark):
    text = plan(REGISTRY["category_map"](spark, SMALL))
    assert "LocalTableScan" in text and "BroadcastHashJoin" in text


def test_a_pie_has_no_window(large):
    assert "Window" not in plan(REGISTRY["card_pie"](large, SMALL))


def test_a_hot_order_is_split_at_run_time(spark, tmp_path):
    """One order holds nearly all lines."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    for name in ("orders", "customer", "nation", "region", "part"):
        star.table(spark, SMALL, name).write.parquet(f"{tmp_path}/{name}.parquet")
    lines = star.table(spark, SMALL, "lineitem")
    hot = lines.withColumn("l_orderkey", F.when(F.col("l_linenumber") < 7, F.lit(1)).otherwise(F.col("l_orderkey")).cast("bigint"))
    hot.repartition(16).write.parquet(f"{tmp_path}/lineitem.parquet")
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        df = star.order_lines(spark, str(tmp_path), "order_id", "order_date", "sales", "product_id")
        df.write.format("noop").mode("overwrite").save()
        df.collect()
        assert "skew=true" in plan(df)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_the_rows_of_order_lines_do_not_depend_on_the_columns(spark, tmp_path):
    for name in ("orders", "customer", "nation", "region", "part"):
        star.table(spark, SMALL, name).where("false" if name == "part" else "true").write.parquet(f"{tmp_path}/{name}.parquet")
    lines = star.table(spark, SMALL, "lineitem")
    lost = lines.limit(5).withColumn("l_orderkey", F.lit(-1).cast("bigint"))
    lines.unionByName(lost).write.parquet(f"{tmp_path}/lineitem.parquet")
    n = lines.count() + 5
    for columns in (["sales"], ["order_date"], ["customer_name", "region"], ["category"], []):
        assert star.order_lines(spark, str(tmp_path), *columns).count() == n
    found = {(r.table_name, r.column_name): r.failed_rows for r in star.orphans(spark, str(tmp_path)).collect()}
    assert found == {("lineitem", "l_orderkey"): 5, ("lineitem", "l_partkey"): n, ("orders", "o_custkey"): 0}


def test_rankings_are_cut_down_before_the_shuffle(large):
    assert "row_number(), 10, Partial" in plan(REGISTRY["top_products_two_metrics"](large, SMALL))
    assert "TakeOrderedAndProject" in plan(REGISTRY["top10_profit"](large, SMALL))


def test_unused_dimensions_are_not_joined_and_columns_are_pruned(large):
    text = plan(star.order_lines(large, SMALL, "order_id", "sales"))
    assert text.count("FileScan") == 1
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>", text)
    assert plan(star.order_lines(large, SMALL, "order_date", "sales")).count("FileScan") == 2


@pytest.mark.parametrize("name", READ_ONLY)
def test_no_query_needs_a_product_of_rows(large, name):
    text = plan(REGISTRY[name](large, SMALL))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_hot_groups_are_folded_to_few_rows_before_any_struct_is_compared(large):
    text = plan(REGISTRY["customer_latest_attrs"](large, SMALL))
    assert text.rindex("SortAggregate") < text.index("HashAggregate")


def test_results_stay_within_their_bounds(spark):
    retention = REGISTRY["retention_monthly"](spark, SMALL).collect()
    assert all(0 <= r["retention_rate"] <= 1 for r in retention)
    abc = REGISTRY["abc_analysis"](spark, SMALL).collect()
    shares = [r["cumulative_sales_pct"] for r in sorted(abc, key=lambda r: r["sales_rank"])]
    assert shares == sorted(shares) and shares[-1] == 1.0
    share = REGISTRY["customer_segment_share"](spark, SMALL).groupBy("customer_tier").sum("revenue_contribution_pct")
    assert all(abs(r[1] - 1) < 1e-9 for r in share.collect())
