"""Sources, sinks, incremental refresh and streams on small frames."""

import datetime as dt
import os
from decimal import Decimal as D

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from strata.operators import refresh, staging, weather
from strata.sources import scans, schema, sinks, star
from strata.sources.tables import read_table
from strata.streaming import loads
from tests.conftest import rows

SMALL = "/root/testdata/sf0.001"


def frame(spark, data, types="k int, v int, d date"):
    return spark.createDataFrame(data, types)


def day(n):
    return dt.date(2024, 1, n)


def test_csv_without_schema_and_with_latin_letters(spark, folder):
    with open(f"{folder}/in.csv", "w", encoding="latin-1") as f:
        f.write("id,name,amount\n1,Café,2.5\n2,,\n")
    inferred = scans.read_csv(spark, f"{folder}/in.csv")
    assert rows(inferred, "id") == [(1, "Café", 2.5), (2, None, None)]
    declared = schema.declare_schema({"id": "Int64", "name": "Text", "amount": "numeric"})
    assert rows(scans.read_csv(spark, f"{folder}/in.csv", declared), "id") == [(1, "Café", D("2.50")), (2, None, None)]


def test_unknown_type_name():
    with pytest.raises(ValueError):
        schema.declare_schema({"a": "blob"})


def test_write_new_refuses_an_existing_table(spark, folder):
    df = frame(spark, [(1, 1, day(1))])
    sinks.write_new(df, f"{folder}/t")
    with pytest.raises(AnalysisException):
        sinks.write_new(df, f"{folder}/t")


def test_parallel_arrays_of_unequal_length(spark):
    doc = '{"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [1.5], '
    doc += '"relative_humidity_2m": [2, 3], "wind_speed_10m": [], "precipitation": [0, 1]}}'
    got = rows(scans.hourly_readings(frame(spark, [(doc,)], "payload string"), "payload"), "reading_ts")
    assert got == [
        (dt.datetime(2024, 1, 1, 0), 1.5, 2.0, None, 0.0),
        (dt.datetime(2024, 1, 1, 1), None, 3.0, None, 1.0),
    ]


def test_a_reading_without_measures_is_dropped(spark):
    df = spark.createDataFrame(
        [(1, None, None, None, None), (2, None, 5.0, None, None)],
        "event_id int, temperature_2m double, relative_humidity_2m double, wind_speed_10m double, precipitation double",
    )
    assert staging.drop_all_null(df, staging.READING_COLUMNS).count() == 1


def test_filters_reach_the_scan(spark):
    orders = star.table(spark, SMALL, "orders")
    jdbc = scans.jdbc_scan_options("jdbc:x", "t", ("id", 1, 100, 8), user="u")
    assert jdbc == {
        "url": "jdbc:x", "dbtable": "t", "user": "u", "partitionColumn": "id", "lowerBound": "1", "upperBound": "100",
        "numPartitions": "8",
    }
    assert sinks.jdbc_options("jdbc:x", "t", batchsize="9") == {"url": "jdbc:x", "dbtable": "t", "batchsize": "9"}
    for df in (
        scans.extract_since(orders, "o_orderdate", dt.date(2000, 1, 1)),
        scans.extract_day(orders, "o_orderdate", dt.date(2000, 1, 1)),
        scans.retain(orders, "o_orderdate", 365, dt.datetime(2000, 1, 1)),
        refresh.newer_rows(orders, orders.where("o_orderkey < 5"), "o_orderdate"),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        pushed = [part.split("]")[0] for part in plan.split("PushedFilters: [")[1:]]
        assert any("GreaterThan" in filters and "o_orderdate" in filters for filters in pushed)


def test_replaced_days_leave_other_days_alone(spark, folder):
    path = f"{folder}/t"
    stamps = "event_id int, reading_ts timestamp_ntz"
    at = [dt.datetime(2024, 1, 1, 5), dt.datetime(2024, 1, 2, 5), dt.datetime(2024, 1, 2, 6)]
    first = spark.createDataFrame(list(enumerate(at)), stamps)
    sinks.load_days(first, path, "reading_ts")
    for _ in range(2):
        sinks.replace_day(spark.createDataFrame([(9, at[1])], stamps), path, "reading_ts", day(2))
    assert rows(read_table(spark, path).select("event_id"), "event_id") == [(0,), (9,)]
    sinks.replace_day(first.where("false"), path, "reading_ts", day(2))
    assert rows(read_table(spark, path).select("event_id", "load_day")) == [(0, day(1))]


def test_a_backfill_empties_days_its_source_lacks(spark, folder):
    path = f"{folder}/t"
    df = spark.createDataFrame([(n, dt.datetime(2024, 1, n, 5)) for n in range(1, 6)], "n int, ts timestamp_ntz")
    sinks.load_days(df, path, "ts")
    sinks.backfill(df.where("n <> 3"), path, "ts", day(2), day(4))
    assert rows(read_table(spark, path).select("n"), "n") == [(1,), (2,), (4,), (5,)]


def test_expired_partitions_are_removed(spark, folder):
    df = frame(spark, [(n, 0, dt.date(2024, n, 28)) for n in (1, 2, 3)] + [(9, 0, None)])
    sinks.write_partitioned(df, f"{folder}/days", ["d"])
    assert sinks.expire_partitions(spark, f"{folder}/days", "d", 30, dt.date(2024, 3, 29)) == ["2024-01-28", "2024-02-28"]
    assert rows(read_table(spark, f"{folder}/days").select("k"), "k") == [(3,), (9,)]
    sinks.write_partitioned(df.withColumn("m", F.date_format("d", "yyyyMM")), f"{folder}/months", ["m"])
    assert sinks.expire_partitions(spark, f"{folder}/months", "m", 28, dt.date(2024, 3, 28)) == ["202401", "202402"]
    assert sinks.expire_partitions(spark, f"{folder}/none", "m", 28, dt.date(2024, 3, 28)) == []


def test_partition_values_come_back_as_written(spark, folder):
    df = frame(spark, [(1, 1, "01"), (2, 1, None)], "k int, v int, m string")
    sinks.write_partitioned(df, f"{folder}/t", ["m"])
    assert rows(read_table(spark, f"{folder}/t"), "k") == [(1, 1, "01"), (2, 1, None)]
    with pytest.raises(Exception, match="EmptyPartitionValue"):
        sinks.write_partitioned(frame(spark, [(1, 1, "")], "k int, v int, m string"), f"{folder}/t", ["m"])
    assert rows(read_table(spark, f"{folder}/t"), "k") == [(1, 1, "01"), (2, 1, None)]  # the old table stays


def test_a_failed_refresh_leaves_the_old_table(spark, folder):
    sinks.full_refresh(frame(spark, [(1, 1, day(1))]), f"{folder}/t")
    broken = frame(spark, [(2, 2, day(2))]).withColumn("v", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        sinks.full_refresh(broken, f"{folder}/t")
    assert rows(read_table(spark, f"{folder}/t")) == [(1, 1, day(1))] and os.listdir(folder) == ["t"]
    again = read_table(spark, f"{folder}/t")
    sinks.full_refresh(again.unionByName(again), f"{folder}/t")  # a table may be rebuilt from itself
    assert read_table(spark, f"{folder}/t").count() == 2


def test_backfill_loads_only_its_days(spark, folder):
    path = f"{folder}/t"
    df = spark.createDataFrame([(n, dt.datetime(2024, 1, n, 23, 59)) for n in range(1, 6)], "n int, ts timestamp_ntz")
    sinks.backfill(df, path, "ts", day(2), day(4))
    assert rows(read_table(spark, path).select("n"), "n") == [(2,), (3,), (4,)]


def test_append_above_the_mark_loses_equal_rows_and_the_inclusive_mark_does_not(spark, folder):
    first = frame(spark, [(1, 1, day(1)), (2, 1, day(2))])
    late = frame(spark, [(1, 1, day(1)), (2, 1, day(2)), (3, 1, day(2)), (4, 1, day(3))])
    for name, keys, want in (("open", None, [1, 2, 4]), ("closed", ["k"], [1, 2, 3, 4])):
        path = f"{folder}/{name}"
        for batch in (first, late, late):
            refresh.incremental_append(batch, path, "d", keys)
        assert [r[0] for r in rows(spark.read.parquet(path).select("k"), "k")] == want


def test_an_empty_target_takes_everything(spark):
    source = frame(spark, [(1, 1, day(1)), (-5, 1, day(2))])
    for mark in ("d", "k"):
        assert refresh.newer_rows(source, source.where("false"), mark).count() == 2


def test_upsert_twice_is_upsert_once(spark, folder):
    table = refresh.Buckets(spark, f"{folder}/t", ["k"])
    assert table.current() is None
    refresh.incremental_upsert(frame(spark, [(1, 1, day(1)), (2, 1, day(1))]), table)
    batch = frame(spark, [(2, 7, day(2)), (2, 8, day(3)), (3, 9, day(3))])
    for _ in range(2):
        out = refresh.incremental_upsert(batch, table, newest_first=["d"])
        assert rows(out.select("k", "v"), "k") == [(1, 1), (2, 8), (3, 9)]


def test_an_older_row_does_not_replace_a_newer_one(spark, folder):
    table = refresh.Buckets(spark, f"{folder}/t", ["k"], 4)
    for batch in ([(1, 10, day(10)), (None, 1, day(1))], [(1, 5, day(5)), (2, 2, day(2))], [(None, 2, day(2))]):
        out = refresh.incremental_upsert(frame(spark, batch), table, newest_first=["d"])
    assert rows(out.select("k", "v"), "k") == [(None, 2), (1, 10), (2, 2)]


def test_an_upsert_leaves_untouched_buckets_alone(spark, folder):
    table = refresh.Buckets(spark, f"{folder}/t", ["k"], 8)
    refresh.incremental_upsert(frame(spark, [(k, 1, day(1)) for k in range(100)]), table)

    def files():
        return {d: sorted(os.listdir(f"{folder}/t/{d}")) for d in os.listdir(f"{folder}/t") if d.startswith("_bucket=")}

    before = files()
    out = refresh.incremental_upsert(frame(spark, [(7, 2, day(2))]), table)
    assert out.count() == 100 and rows(out.where("k = 7").select("v")) == [(2,)]
    after = files()
    assert len(before) == 8 and [d for d in before if before[d] != after[d]] != [] and sum(before[d] != after[d] for d in before) == 1


@pytest.mark.parametrize("partitioned", [False, True])
def test_a_drifting_batch_stops_the_upsert_or_evolves_the_table(spark, folder, partitioned):
    first = frame(spark, [(1, 1, "a", "01"), (2, 2, "b", "01")], "k int, v int, b string, m string")
    table = refresh.Buckets(spark, f"{folder}/t", ["k"], 1)

    def load(batch, **options):
        if partitioned:
            refresh.upsert_partitions(batch, f"{folder}/p", ["k"], ["m"], **options)
            return read_table(spark, f"{folder}/p")
        return refresh.incremental_upsert(batch, table, **options)

    load(first)
    fewer = frame(spark, [(2, 5, "01")], "k int, v int, m string")
    more = first.where("k = 1").withColumn("x", F.lit(9))
    for bad in (fewer, more, first.withColumn("v", F.col("v").cast("string"))):
        with pytest.raises(schema.SchemaChanged):
            load(bad)
    with pytest.raises(schema.SchemaChanged):
        load(first.withColumn("v", F.col("v").cast("string")), evolve=True)
    assert rows(load(fewer, evolve=True).select("k", "v", "b", "m"), "k") == [(1, 1, "a", "01"), (2, 5, None, "01")]
    assert rows(load(more, evolve=True).select("k", "v", "b", "x"), "k") == [(1, 1, "a", 9), (2, 5, None, None)]


def test_an_unfinished_version_is_not_read(spark, folder):
    table = refresh.Versions(spark, f"{folder}/t")
    table.publish(frame(spark, [(1, 1, day(1))]))
    os.makedirs(f"{folder}/t/v000002")
    assert table.current().count() == 1
    table.publish(frame(spark, [(1, 1, day(1)), (2, 2, day(1))]))
    assert table.current().count() == 2
    assert os.path.exists(f"{folder}/t/v000003/_SUCCESS")
    table.publish(frame(spark, [(3, 3, day(1))]))
    assert sorted(os.listdir(f"{folder}/t")) == ["v000003", "v000004"]  # the one before stays for its readers


def test_partition_upsert_keeps_untouched_partitions_and_refuses_moved_keys(spark, folder):
    path = f"{folder}/t"
    first = frame(spark, [(1, 1, "01"), (2, 1, "01"), (3, 1, "02")], "k int, v int, m string")
    refresh.upsert_partitions(first, path, ["k"], ["m"])
    untouched = sorted(os.listdir(f"{path}/m=02"))
    refresh.upsert_partitions(frame(spark, [(2, 5, "01"), (4, 5, "01")], "k int, v int, m string"), path, ["k"], ["m"])
    got = rows(refresh.stored(spark, path, first.schema), "k")
    assert got == [(1, 1, "01"), (2, 5, "01"), (3, 1, "02"), (4, 5, "01")]
    assert sorted(os.listdir(f"{path}/m=02")) == untouched
    with pytest.raises(refresh.MovedKey):
        refresh.upsert_partitions(frame(spark, [(3, 5, "01")], "k int, v int, m string"), path, ["k"], ["m"])


def test_incremental_aggregate_equals_the_full_one(spark, folder):
    data = [(i % 4, i, day(1 + i // 10)) for i in range(40)]
    table = refresh.Versions(spark, f"{folder}/t")

    def totals(df):
        return df.groupBy("k").agg(F.avg("v").alias("v"), F.max("d").alias("d"))

    for last in (1, 2, 4):
        out = refresh.incremental_aggregate(
            frame(spark, [r for r in data if r[2] <= day(last)]), table, ["k"], "d", totals
        )
    assert rows(out, "k") == rows(totals(frame(spark, data)), "k")


def test_an_aggregate_sees_rows_of_the_last_mark_late_dates_and_missing_keys(spark, folder):
    types = "k int, v int, d date, at int"
    table = refresh.Versions(spark, f"{folder}/t")

    def totals(df):
        return df.groupBy("k").agg(F.sum("v").alias("v"), F.count("*").alias("n"), F.max("at").alias("at"))

    first = [(1, 10, day(5), 1), (None, 1, day(5), 1)]
    same = first + [(1, 5, day(5), 1), (3, 7, day(5), 1)]
    late = same + [(1, 2, day(1), 2), (None, 3, day(1), 2), (4, 4, day(1), None)]
    for data in (first, same, late, late):
        out = refresh.incremental_aggregate(spark.createDataFrame(data, types), table, ["k"], "at", totals)
        assert rows(out, "k") == rows(totals(spark.createDataFrame(data, types)), "k")


def test_rows_without_a_mark_stay_out_of_every_load_and_are_counted(spark, folder):
    path = f"{folder}/t"
    first = frame(spark, [(1, 1, day(1)), (2, 1, None)])
    later = frame(spark, [(1, 1, day(1)), (2, 1, None), (3, 1, None), (4, 1, day(2))])
    assert refresh.incremental_append(first, path, "d") == 1
    assert refresh.incremental_append(later, path, "d") == 2
    assert rows(spark.read.parquet(path).select("k"), "k") == [(1,), (4,)]
    assert rows(refresh.unmarked(later, "d").select("k"), "k") == [(2,), (3,)]


def test_schema_drift_stops_the_load(spark, folder):
    path = f"{folder}/t"
    good = frame(spark, [(1, 1, day(1))])
    refresh.guarded_append(good, path)
    drifted = (good.withColumn("x", F.lit(1)), good.drop("v"), good.withColumn("v", F.col("v").cast("string")))
    for bad in drifted:
        with pytest.raises(schema.SchemaChanged):
            refresh.guarded_append(bad, path)
    refresh.guarded_append(good, path)
    assert spark.read.parquet(path).count() == 2


READING = "event_id int, station_id int, reading_ts timestamp_ntz, temperature_2m decimal(5,2), precipitation decimal(5,2)"


def reading(i, d, h):
    return (i, 1, dt.datetime(2024, 1, d, h), D(i), D(1))


def test_streamed_days_equal_a_batch_and_late_rows_are_dropped(spark, folder):
    arrivals = [
        [reading(1, 1, 5), reading(2, 1, 20), reading(3, 2, 1)],
        [reading(4, 2, 9), reading(5, 9, 9)],
        [reading(6, 1, 6)],  # a week late: behind the mark
        [reading(7, 9, 10)],
    ]
    for batch in arrivals:
        sinks.append(spark.createDataFrame(batch, READING), f"{folder}/in")
        stream = loads.landing(spark, f"{folder}/in", spark.createDataFrame([], READING).schema)
        loads.stream_daily_weather(stream, f"{folder}/out", f"{folder}/ck")
    kept = spark.createDataFrame([r for b in arrivals for r in b if r[0] != 6], READING)
    want = kept.groupBy(F.to_date("reading_ts").alias("d")).agg(F.count("*"), F.max("temperature_2m"))
    got = read_table(spark, f"{folder}/out").select("measurement_date", "measurement_count", "max_temperature")
    assert rows(got, "measurement_date") == rows(want, "d")


def test_streamed_append_reads_every_file_once(spark, folder):
    batches = [[reading(1, 1, 1)], [reading(2, 2, 1)]]
    for batch in batches:
        sinks.append(spark.createDataFrame(batch, READING), f"{folder}/in")
        for _ in range(2):  # the second call finds nothing new
            stream = loads.landing(spark, f"{folder}/in", spark.createDataFrame([], READING).schema, files_per_batch=1)
            loads.stream_append(stream, f"{folder}/out", f"{folder}/ck")
    assert rows(spark.read.parquet(f"{folder}/out").select("event_id"), "event_id") == [(1,), (2,)]


def test_weather_days_of_faulty_stations_do_not_fail(spark):
    daily = weather.daily_weather(star.readings(spark, SMALL, faulty=True))
    assert daily.where("avg_temperature IS NULL AND max_temperature IS NOT NULL").count() == 0


def test_layers_can_be_rebuilt_apart(spark, folder):
    from strata.plans.layers import run_layers
    from strata.plans.weather import weather_models

    readings = star.readings(spark, SMALL)
    sources = {"readings": readings, "norms": star.weekday_norms(readings)}
    keys = ("measurement_date", "hour")
    full = rows(run_layers(spark, sources, weather_models(), folder)["mart_comfort"], *keys)
    again = run_layers(spark, sources, weather_models(), folder, layers=["marts"])
    assert rows(again["mart_comfort"], *keys) == full


def test_models_may_come_from_a_generator_and_are_checked(spark, folder):
    from strata.plans.layers import Model, run_layers

    df = frame(spark, [(1, 1, "01"), (2, 2, "02")], "k int, v int, m string")
    models = (Model(f"m_{layer}", layer, lambda t: t["src"], ("m",)) for layer in ("stage", "core", "marts"))
    built = run_layers(spark, {"src": df}, models, folder)
    assert set(built) == {"src", "m_stage", "m_core", "m_marts"}
    assert rows(built["m_marts"], "k") == [(1, 1, "01"), (2, 2, "02")]
    for bad in (
        [Model("x", "silver", lambda t: df)],
        [Model("x", "core", lambda t: df, materialized="cube")],
        [Model("x", "core", lambda t: df, materialized="append")],
        [Model("x", "core", lambda t: df), Model("x", "marts", lambda t: df)],
        [Model("src", "core", lambda t: df)],
    ):
        with pytest.raises(ValueError):
            run_layers(spark, {"src": df}, bad, folder)
    with pytest.raises(ValueError):
        run_layers(spark, {"src": df}, [], folder, layers=["gold"])


def test_incremental_models(spark, folder):
    from strata.plans.layers import Model, run_layers

    def models():
        total = lambda df: df.groupBy("v").agg(F.count("*").alias("n"), F.max("d").alias("d"))
        return [
            Model("added", "core", lambda t: t["src"], materialized="append", keys=("k",), mark="d"),
            Model("latest", "core", lambda t: t["src"], materialized="upsert", keys=("k",), newest_first=("d",)),
            Model("counts", "core", lambda t: t["added"], materialized="aggregate", keys=("v",), mark="d", aggregate=total),
            Model("days", "marts", lambda t: t["src"], ("d",), materialized="partition"),
        ]

    first = frame(spark, [(1, 1, day(1)), (2, 1, day(2))])
    second = frame(spark, [(2, 1, day(2)), (3, 2, day(2)), (1, 9, day(3)), (2, 7, day(1))])
    run_layers(spark, {"src": first}, models(), folder)
    for _ in range(2):
        built = run_layers(spark, {"src": second}, models(), folder)
    assert rows(built["added"], "k", "d") == [(1, 1, day(1)), (1, 9, day(3)), (2, 1, day(2)), (3, 2, day(2))]
    assert rows(built["latest"].select("k", "v"), "k") == [(1, 9), (2, 1), (3, 2)]
    assert rows(built["counts"], "v") == [(1, 2, day(2)), (2, 1, day(2)), (9, 1, day(3))]
    assert rows(built["days"].select("k", "d"), "d", "k") == [(2, day(1)), (2, day(2)), (3, day(2)), (1, day(3))]


def test_a_run_leaves_only_its_tables(spark, folder):
    from strata.plans.layers import run_layers
    from strata.plans.retail import retail_models
    from strata.session import shared_dir

    base = f"{shared_dir(spark)}/strata"
    os.makedirs(base, exist_ok=True)
    before = set(os.listdir(base))
    lines = star.order_lines(spark, SMALL)
    for n, part in enumerate((lines.where("order_id % 2 = 0"), lines.where("order_id % 2 = 1"))):
        at = dt.datetime(2024, 2, 1 + n)
        models = retail_models(at, at.date(), ("BUILDING",), run=(at, f"r{n}"), line_key=("order_id", "line_no", "product_id", "sales"))
        built = run_layers(spark, {"orders": part}, models, folder)
    assert set(os.listdir(base)) == before
    assert built["int_orders_enriched"].count() == lines.count()
    assert {n for layer in ("core", "marts") for n in os.listdir(f"{folder}/{layer}")} <= set(built)


def test_models_of_a_layer_wait_for_those_before_them(spark, folder):
    from strata.plans.layers import Model, run_layers

    src = frame(spark, [(1, 1, day(1))])
    add = lambda name: lambda t: t[name].withColumn("v", F.col("v") + 1)
    names = ["src", "a", "b", "c", "d", "e"]
    chain = [Model(n, "core", add(before)) for before, n in zip(names, names[1:])]
    for parallel in (1, 4):
        built = run_layers(spark, {"src": src}, chain, f"{folder}/{parallel}", parallel=parallel)
        assert rows(built["e"].select("v")) == [(6,)]
    with pytest.raises(KeyError):
        run_layers(spark, {"src": src}, [Model("x", "core", add("y")), Model("y", "core", add("src"))], folder)
