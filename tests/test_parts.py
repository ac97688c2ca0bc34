"""Tables built part by part, and the room their shuffles take."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from checks.queries import REGISTRY, differing
from strata.operators import products, quality, refresh
from strata.plans.layers import Model, quality_of, run_layers
from strata.session import BUILDING, building, scratch
from strata.sources import sinks, star
from strata.sources.tables import read_table

SMALL = "/root/testdata/sf0.001"
DAY = dt.date(2024, 1, 1)


def content(df):
    return sorted(map(repr, df.collect()))


def shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def gone(spark, before: set[str]) -> bool:
    """Whether all shuffle files but those of before are removed; that happens beside the jobs."""
    for _ in range(50):
        if not shuffle_files(spark) - before:
            return True
        time.sleep(0.1)
    return False


def numbered(spark, n=200):
    """Rows with a missing and an empty-handed key among them, some of them twice."""
    rows = spark.range(n).select(
        F.when(F.col("id") % 7 != 0, F.col("id") % 50).alias("k"), (F.col("id") % 3).cast("string").alias("g"), F.col("id").alias("v")
    )
    return rows.unionByName(rows.limit(20))


def test_every_row_is_in_one_part(spark):
    df = numbered(spark)
    parts = sinks.Parts(("k",), 5).of(df)
    assert len(parts) == 5
    assert sorted(r for p in parts for r in content(p)) == content(df)
    keys = [{r.k for r in p.collect()} for p in parts]
    assert sum(map(len, keys)) == len(set.union(*keys))


@pytest.mark.parametrize("partition_by", [(), ("g",)])
def test_a_table_built_in_parts_has_the_same_rows_and_counts(spark, folder, partition_by, monkeypatch):
    monkeypatch.setattr("strata.plans.layers.PART_BYTES", 1)
    checks = [*quality.not_null("k"), quality.accepted_range("twice", high=300)]

    def model(name, parts):
        return Model(
            name, "core", lambda t: t["rows"], partition_by, checks=checks, parts=parts, parts_by=("k",),
            derive=lambda rows: rows.withColumn("twice", F.col("v") * 2),
        )

    models = [model("whole", 1), model("parts", 4)]
    built = run_layers(spark, {"rows": numbered(spark)}, models, folder)
    assert built["parts"].columns == built["whole"].columns
    assert content(built["parts"]) == content(built["whole"])
    counts = {}
    for r in quality_of(spark, models, folder).collect():
        counts.setdefault(r.table_name, []).append((r.column_name, r.failed_rows, r.total_rows))
    assert counts["parts"] == counts["whole"] and counts["whole"][0][1:] == (32, 220)


def test_a_table_without_rows_is_built_in_parts(spark, folder, monkeypatch):
    monkeypatch.setattr("strata.plans.layers.PART_BYTES", 1)
    none = numbered(spark).where("v < 0")
    for name, by in (("flat", ()), ("folders", ("g",))):
        model = Model(name, "core", lambda t: t["rows"], by, parts=3, parts_by=("k",), checks=quality.not_null("k"))
        built = run_layers(spark, {"rows": none}, [model], folder)[name]
        assert built.count() == 0 and set(built.columns) == set(none.columns)
        assert [r.total_rows for r in quality_of(spark, [model], folder).collect()] == [0]


def test_a_failed_part_leaves_the_old_table(spark, folder):
    path = f"{folder}/t"
    sinks.full_refresh(numbered(spark), path)
    before = content(read_table(spark, path))
    broken = numbered(spark).withColumn("v", F.when(F.col("k") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("v")).cast("bigint"))
    with pytest.raises(Exception, match="no"):
        sinks.full_refresh(broken, path, sinks.Parts(("k",), 4))
    assert content(read_table(spark, path)) == before


def test_a_build_leaves_no_shuffles_behind(spark, folder):
    """Between models as well: the second model looks for those of the first."""
    before = shuffle_files(spark)
    seen = []

    def totals(t):
        return t["rows"].groupBy("k").agg(F.sum("v").alias("v"))

    def looking(t):
        t["totals"]
        seen.append(gone(spark, before))
        return t["rows"]

    run_layers(spark, {"rows": numbered(spark)}, [Model("totals", "core", totals), Model("looking", "marts", looking)], folder)
    assert seen == [True] and gone(spark, before)


def test_the_settings_of_a_build_end_with_it_and_yield_to_the_users(spark):
    codec = "spark.sql.parquet.compression.codec"
    with building(spark):
        assert spark.conf.get(codec) == "zstd"
    assert all(spark.conf.get(k, None) is None for k in BUILDING)
    spark.conf.set(codec, "gzip")
    try:
        with building(spark):
            assert spark.conf.get(codec) == "gzip"
        assert spark.conf.get(codec) == "gzip"
    finally:
        spark.conf.unset(codec)


def test_a_models_parts_need_columns(spark):
    with pytest.raises(ValueError, match="no columns"):
        Model("m", "core", lambda t: t["rows"], parts=2).check()
    with pytest.raises(ValueError, match="not built in parts"):
        Model("m", "core", lambda t: t["rows"], materialized="append", mark="v", parts=2, parts_by=("k",)).check()


def test_a_product_folds_each_line_to_three_rows_and_counts_its_places(spark):
    line = {
        "order_id": 1, "product_id": 5, "product_name": "p", "category": "c", "sub_category": "s", "customer_id": 9, "quantity": 1,
        "sales": 10, "discount": 0, "profit": 1, "order_date": DAY,
    }
    places = [("east", "a"), ("east", "b"), ("west", None), (None, "c"), (None, None), ("east", "a")]
    schema = (
        "order_id bigint, product_id bigint, product_name string, category string, sub_category string, customer_id bigint, quantity int, "
        "sales decimal(12,2), discount decimal(12,2), profit decimal(12,2), order_date date, region string, state string"
    )
    from decimal import Decimal

    rows = [
        tuple(Decimal(v) if k in ("sales", "discount", "profit") else v for k, v in (line | {"order_id": i, "region": r, "state": s}).items())
        for i, (r, s) in enumerate(places)
    ]
    df = products.product_performance(spark.createDataFrame(rows, schema))
    found = df.first()
    assert (found.total_orders, found.unique_customers, found.states_sold, found.regions_sold) == (6, 1, 3, 2)
    assert found.total_quantity_sold == 6 and found.top_region_by_sales == "west"
    text = df._jdf.queryExecution().analyzed().toString()
    assert "_kind" in text and ", 2 AS _kind" not in text  # measures and two kinds of ids


def test_the_lines_are_laid_out_before_they_are_widened(spark, folder, monkeypatch):
    plans = []
    written = sinks.write_partitioned

    def spy(df, *args, **kwargs):
        plans.append(set(df.columns))
        return written(df, *args, **kwargs)

    monkeypatch.setattr("strata.plans.layers.write_partitioned", spy)
    REGISTRY["layers_quality"](spark, SMALL)
    assert not any("profitability_category" in columns for columns in plans) and any("order_yyyymm" in columns for columns in plans)


def load(spark, rows):
    return spark.createDataFrame(rows, "k bigint, g string, at int, v string")


FIRST = [(i if i % 9 else None, f"g{i % 5}", 1, f"a{i}") for i in range(1, 60)] + [(1, "g1", 0, "old")]
SECOND = [(1, "g1", 2, "b"), (2, "g2", 0, "older"), (100, "g0", 2, "new"), (100, "g0", 3, "newer")]


def test_an_upsert_in_parts_gives_the_same_table(spark, folder):
    tables = {}
    for n in (1, 4):
        bucketed = refresh.Buckets(spark, f"{folder}/buckets{n}", ["k", "g"], 8)
        for rows in (FIRST, SECOND):
            refresh.incremental_upsert(load(spark, rows), bucketed, ["at"], parts=n)
            refresh.upsert_partitions(load(spark, rows), f"{folder}/folders{n}", ["k"], ["g"], newest_first=["at"], check_moved=False, parts=n)
        again = refresh.Buckets(spark, bucketed.root, ["k", "g"])
        tables[n] = [content(again.current()), content(read_table(spark, f"{folder}/folders{n}"))]
    assert tables[4] == tables[1]
    assert repr(again.current().where("k = 100").first().v) == "'newer'"


def test_what_an_upsert_in_parts_refuses_is_refused_before_anything_is_written(spark, folder):
    path = f"{folder}/t"
    refresh.upsert_partitions(load(spark, FIRST), path, ["k"], ["g"], newest_first=["at"], parts=4)
    before = content(read_table(spark, path))
    moved = [*SECOND, (3, "g0", 9, "elsewhere")]
    with pytest.raises(refresh.MovedKey):
        refresh.upsert_partitions(load(spark, moved), path, ["k"], ["g"], newest_first=["at"], parts=4)
    with pytest.raises(refresh.RepeatedKey):
        refresh.upsert_partitions(load(spark, SECOND), path, ["k"], ["g"], parts=4)
    assert content(read_table(spark, path)) == before


def test_stored_rows_are_not_shuffled_to_find_the_touched_partitions(spark, folder, monkeypatch):
    plans = []
    written = refresh.replace_partitions

    def spy(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, *args, **kwargs)

    monkeypatch.setattr(refresh, "replace_partitions", spy)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        for rows in (FIRST, SECOND):
            refresh.upsert_partitions(load(spark, rows), f"{folder}/t", ["k"], ["g"], newest_first=["at"], check_moved=False, parts=2)
    finally:
        spark.conf.set(key, before)
    assert len(plans) == 2 and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in plans)


def test_an_aggregate_in_parts_gives_the_same_table(spark, folder):
    def totals(rows):
        return rows.groupBy("k").agg(F.max("at").alias("at"), F.count("*").alias("n"))

    loads = [load(spark, FIRST), load(spark, FIRST + SECOND), load(spark, FIRST + SECOND)]
    found = {}
    for n in (1, 4):
        table = refresh.Versions(spark, f"{folder}/{n}")
        for rows in loads:
            refresh.incremental_aggregate(rows, table, ["k"], "at", totals, sinks.Parts(("k",), n))
        found[n] = content(refresh.Versions(spark, f"{folder}/{n}").current())
    assert found[4] == found[1] == content(totals(loads[-1]))


def test_builds_differ_by_the_rows_one_has_more_often(spark, folder):
    schema = "order_id bigint, line_no int, product_id bigint, load_ts int, v string"
    a = [(1, 1, 1, 0, "x"), (1, 1, 1, 1, "x"), (2, 1, None, 0, None), (3, 1, 1, 0, "y")]
    b = [(1, 1, 1, 0, "x"), (2, 1, None, 7, None), (3, 1, 1, 0, "z"), (3, 1, 1, 0, "z")]
    before = shuffle_files(spark)
    with building(spark), scratch(spark):
        for drop in ([], ["product_id"]):
            one, two = (spark.createDataFrame(rows, schema).drop(*drop) for rows in (a, b))
            assert [tuple(r) for r in differing({"t": one}, {"t": two}, "t").collect()] == [("t", 4)]
            assert [tuple(r) for r in differing({"t": one}, {"t": one}, "t").collect()] == [("t", 0)]
        assert gone(spark, before)


def test_only_models_with_large_sources_are_built_in_parts(spark, monkeypatch):
    model = Model("m", "core", lambda t: t["rows"], parts=4, parts_by=("order_id",))
    lines = star.order_lines(spark, SMALL)
    assert model.in_parts(lines).n == 1
    monkeypatch.setattr("strata.plans.layers.PART_BYTES", 1000)
    assert model.in_parts(lines) == sinks.Parts(("order_id",), 4)
    assert model._replace(parts=1).in_parts(lines).n == 1


def test_a_part_of_the_lines_leaves_the_scans_of_lines_and_orders_alone(spark):
    """The other rows are not shuffled."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        part = sinks.Parts(("order_id",), 4).of(star.order_lines(spark, SMALL))[1]
        text = part._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(key, before)
    for name in ("l_orderkey", "o_orderkey"):
        assert any("pmod(xxhash64(" in line and f"{name}#" in line for line in text.splitlines() if "Filter" in line)
