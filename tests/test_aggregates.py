"""Operators on small frames against brute force."""

import datetime as dt
import random
from collections import Counter, defaultdict
from decimal import Decimal as D

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import customers, metrics, quality, ranking, sales, staging, weather
from strata.operators.folding import join_groups
from tests.conftest import rows


def skewed_totals(n=900):
    """A third of all rows share one value."""
    rnd = random.Random(7)
    return [(i, D("100.00") if i % 3 == 0 else D(rnd.randint(0, 20_000)).scaleb(-2)) for i in range(n)]


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_running_total_with_a_hot_value(spark, partitions):
    data = skewed_totals()
    df = spark.createDataFrame(data, "id bigint, v decimal(12,2)").repartition(5)
    got = rows(ranking.running_total(df, "v", "id", partitions).select("id", "rank", "running", "total"), "rank")
    want, run = [], D(0)
    for rank, (i, v) in enumerate(sorted(data, key=lambda r: (-r[1], r[0])), 1):
        run += v
        want.append((i, rank, run))
    assert [r[:3] for r in got] == want
    assert {r[3] for r in got} == {run}


def test_hot_value_is_spread_over_ranges(spark):
    df = spark.createDataFrame([(i, D(5)) for i in range(4000)], "id bigint, v decimal(12,2)")
    ranged = df.repartitionByRange(8, F.col("v").desc(), F.col("id")).groupBy(F.spark_partition_id().alias("p")).count()
    sizes = [r["count"] for r in ranged.collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 4000 / 8


def test_abc_classes_cover_all_products(spark):
    from strata.operators.products import abc_analysis

    data = [(i, i % 50, D(10 + i % 50), D(0), D(1)) for i in range(500)]
    lines = spark.createDataFrame(
        data, "order_id bigint, product_id bigint, sales decimal(12,2), discount decimal(12,2), profit decimal(12,2)"
    )
    got = rows(abc_analysis(lines).select("abc_category", "sales_rank", "cumulative_sales_pct"))
    assert sorted(r[1] for r in got) == list(range(1, 51))
    assert max(r[2] for r in got) == 1.0
    assert all((c == "A") == (s <= 0.8) for c, _, s in got)


def test_top_k_ties_are_broken_by_key(spark):
    df = spark.createDataFrame([(i, 5) for i in range(30)], "id bigint, v bigint")
    assert rows(ranking.top_k(df, "v", 3, ["id"]).select("id"), "id") == [(0,), (1,), (2,)]


def lines_of(spark, data):
    schema = "order_id bigint, customer_id bigint, order_date date, sales decimal(12,2)"
    return spark.createDataFrame(data, schema)


def test_retention_with_gaps(spark):
    d = dt.date
    data = [
        (1, 1, d(2024, 1, 31), D(10)),
        (2, 1, d(2024, 2, 1), D(10)),
        (3, 2, d(2024, 1, 5), D(10)),
        (4, 2, d(2024, 3, 5), D(10)),  # skips a month
        (5, 3, d(2024, 5, 5), D(10)),  # nobody in April
    ]
    lines = lines_of(spark, data)
    got = rows(
        customers.retention_monthly(lines).select(
            "order_month", "current_customers", "retained_customers", "previous_customers", "retention_rate"
        ),
        "order_month",
    )
    assert got == [
        (d(2024, 1, 1), 2, 0, None, 0.0),
        (d(2024, 2, 1), 1, 1, 2, 0.5),
        (d(2024, 3, 1), 1, 0, 1, 0.0),
        (d(2024, 5, 1), 1, 0, 1, 0.0),
    ]
    crr = rows(customers.retention_crr(lines).select("order_month", "new_customers", "crr"), "order_month")
    assert crr == [(d(2024, 1, 1), 2, None), (d(2024, 2, 1), 0, 50.0), (d(2024, 3, 1), 0, 100.0), (d(2024, 5, 1), 1, 0.0)]


def test_clv_of_one_order_counts_no_months(spark):
    one = lines_of(spark, [(1, 1, dt.date(2024, 1, 31), D(10)), (1, 1, dt.date(2024, 1, 31), D(5))])
    assert rows(customers.clv_by_months(one)) == [(1, 15.0, 1.0, 0, 0.0)]
    two = lines_of(spark, [(1, 1, dt.date(2024, 1, 31), D(10)), (2, 1, dt.date(2024, 2, 1), D(20))])
    assert rows(customers.clv_by_months(two)) == [(1, 15.0, 2.0, 1, 30.0)]


def test_latest_by_breaks_ties_by_value(spark):
    d = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(1, "a", d), (1, "c", d), (1, "b", d), (2, "x", None)], "k int, v string, d date")
    assert rows(customers.latest_by(df, "k", ["v"], "d"), "k") == [(1, "c"), (2, "x")]


def test_dedupe_keeps_one_row_of_a_hot_key(spark):
    df = spark.createDataFrame([(i % 3 and i, i) for i in range(300)], "k bigint, v bigint")
    out = staging.dedupe(df, ["k"], ["v"])
    got = dict(rows(out))
    assert got[0] == 297 and len(got) == 201


def test_delivery_percentiles_come_from_the_histogram(spark):
    rnd = random.Random(3)
    day = dt.date(2024, 1, 1)
    spans = [rnd.choice([0, 2, 3, 5, 7, 9, 30]) for _ in range(200)]
    data = [(day, day + dt.timedelta(days=s)) for s in spans] + [(day, None)] * 50
    got = {
        r["delivery_status"]: r
        for r in sales.delivery_performance(spark.createDataFrame(data, "order_date date, ship_date date")).collect()
    }
    overall = got["Overall"]
    assert overall["orders_count"] == 200
    assert overall["p95_delivery_days"] == pytest.approx(np.percentile(spans, 95))
    fast = [s for s in spans if s <= 3]
    assert got["Fast"]["median_delivery_days"] == pytest.approx(np.median(fast))
    assert [r["sort_key"] for r in sorted(got.values(), key=lambda r: r["sort_key"])] == [1, 2, 3, 4]


def test_period_totals_levels(spark):
    d = dt.date
    lines = lines_of(spark, [(1, 1, d(2024, 1, 1), D(1)), (2, 1, d(2024, 2, 1), D(2)), (3, 1, d(2024, 4, 1), D(4))])
    by_level = defaultdict(list)
    for r in sales.period_totals(lines).collect():
        by_level[r["level"]].append(r["total_sales"])
    assert {k: sorted(v) for k, v in by_level.items()} == {0: [1, 2, 4], 1: [3, 4], 3: [7], 7: [7]}


def seasons(spark, years, value):
    data = [(dt.date(y, 3, 1), value(y)) for y in years] + [(dt.date(2023, 7, 1), 4.0)]
    return spark.createDataFrame(data, "measurement_date date, x double")


def test_seasonal_baseline_with_and_without_the_day_itself(spark):
    years = range(2017, 2024)  # the same day of the year in leap and other years differs by one
    years = [y for y in years if y % 4]
    value = {y: float(i * i) for i, y in enumerate(years)}
    df = seasons(spark, years, value.get)
    got = {r["measurement_date"].year: r for r in weather.seasonal_anomaly(df, "x").where("month(measurement_date) = 3").collect()}
    xs = list(value.values())
    assert got[years[0]]["baseline"] == pytest.approx(np.mean(xs), abs=1e-4)
    assert got[years[0]]["z_score"] == pytest.approx((xs[0] - np.mean(xs)) / np.std(xs), abs=1e-4)
    apart = weather.seasonal_anomaly(df, "x", leave_out_today=True).where("month(measurement_date) = 3").collect()
    for r in apart:
        others = [v for y, v in value.items() if y != r["measurement_date"].year]
        assert r["baseline"] == pytest.approx(np.mean(others), abs=1e-4)
        assert r["baseline_stddev"] == pytest.approx(np.std(others), abs=1e-4)


def test_a_single_value_is_never_an_anomaly(spark):
    lone = weather.seasonal_anomaly(seasons(spark, [2023], lambda y: 1.0), "x").collect()
    assert {(r["z_score"], r["severity"]) for r in lone} == {(None, "Normal")}


def test_trailing_baseline_leaves_out_the_day(spark):
    start = dt.date(2024, 1, 1)
    data = [(start + dt.timedelta(days=i), float(i)) for i in range(40) if i != 5]
    df = spark.createDataFrame(data, "measurement_date date, t double")
    got = {r["measurement_date"]: r for r in weather.trailing_baseline(df, "t", days=30, threshold=16.2).collect()}
    values = dict(data)
    for day, r in got.items():
        window = [v for d, v in values.items() if 1 <= (day - d).days <= 30]
        assert r["historical_avg"] == (pytest.approx(np.mean(window), abs=1e-6) if window else None)
        assert r["is_anomaly"] == int(bool(window) and r["t"] - np.mean(window) > 16.2)


def test_groups_with_a_missing_key_are_joined(spark):
    a = spark.createDataFrame([(1, None, 5), (1, "x", 6)], "k int, n string, p int")
    b = spark.createDataFrame([(1, None, 7), (1, "x", 8)], "k int, n string, q int")
    assert sorted(rows(join_groups(a, b, ["k", "n"])), key=repr) == [(1, "x", 6, 8), (1, None, 5, 7)]


def test_quality_checks_ignore_missing_values(spark):
    df = spark.createDataFrame([(1, "a", "7"), (None, "b", "x"), (-1, None, None)], "n int, s string, t string")
    q = quality
    checks = [
        *q.not_null("n", "s"),
        q.accepted_values("s", ["a"]),
        q.accepted_range("n", low=0),
        q.accepted_range("n", high=0),
        q.positive("n"),
        q.numeric(df, "t"),
        q.numeric(df, "n"),
    ]
    report = q.quality_report(df, "t", checks)
    assert [r["failed_rows"] for r in report.collect()] == [1, 1, 1, 1, 1, 1, 1, 0]
    assert {r["total_rows"] for r in report.collect()} == {3}
    with pytest.raises(ValueError):
        q.accepted_range("n")


def test_uniqueness_counts_repeated_keys(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,), (3,), (3,)], "k int")
    assert rows(quality.uniqueness_report(df, "t", ["k"])) == [("t", "k", "unique", 2, 6)]


def test_a_missing_key_is_no_repeated_value(spark):
    df = spark.createDataFrame([(1, 1), (None, 1), (None, 1), (2, None), (2, None)], "k int, j int")
    assert rows(quality.uniqueness_report(df, "t", ["k"])) == [("t", "k", "unique", 1, 5)]
    assert rows(quality.uniqueness_report(df, "t", ["k", "j"])) == [("t", "k, j", "unique", 0, 5)]


def test_targets_and_rules(spark):
    values = spark.createDataFrame(
        [("return_rate", "all", 0.04), ("return_rate", "may", 0.2), ("avg_clv", "all", None), ("other", "all", 1.0)],
        "metric string, period string, value double",
    )
    status = Counter(r["status"] for r in metrics.evaluate_metrics(values).collect())
    assert status == {"met": 1, "missed": 1, None: 2}
    rules = [*metrics.RULES, metrics.Rule("return_rate", ">=", 0.2, "again"), metrics.Rule("other", "!=", 1, "no")]
    fired = rows(metrics.evaluate_alerts(values, rules).select("metric", "period", "op"), "op")
    assert fired == [("return_rate", "may", ">"), ("return_rate", "may", ">=")]


def test_average_check_counts_lines_and_orders(spark):
    lines = lines_of(
        spark, [(1, 1, dt.date(2024, 1, 1), D(10)), (1, 1, dt.date(2024, 1, 1), D(20)), (2, 2, dt.date(2024, 1, 1), D(6))]
    )
    segments = customers.customer_segments(lines, total_over=20, count_over=5)
    got = {r["customer_segment"]: (r["average_check"], r["average_sale"]) for r in sales.average_check(lines, segments).collect()}
    assert got == {"VIP": (30.0, 15.0), "Regular": (6.0, 6.0)}
