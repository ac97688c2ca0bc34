"""Mergeable counts and states, stored marks, tables merged on read, checks during the write, open payloads, layout."""

import datetime as dt
import os
import random
from decimal import Decimal as D

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strata.functions import named
from strata.operators import deltas, distinct, products, quality, refresh, sales, weather
from strata.plans.layers import Model, quality_of, run_layers
from strata.sources import marks, scans, sinks, star, tables
from strata.sources.tables import Folder, read_table
from strata.streaming import loads
from tests.conftest import rows
from tests.test_plans import SMALL, large, plan  # noqa: F401


def frame(spark, data, types="k int, v int, d date"):
    return spark.createDataFrame(data, types)


def day(n):
    return dt.date(2024, 1, n)


def bytes_in(folder):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(folder) for f in fs)


# --- distinct counts --------------------------------------------------------------------


def test_bitmap_words_count_what_sets_count(spark):
    rng = random.Random(1)
    ids = [None, 0, 63, 64, -1, -64, -65, 2**62, -(2**62)]
    data = [(rng.choice([None, "a", "b"]), rng.choice(ids + list(range(-70, 200, 7))), rng.choice(["x", "", None, "y"]), rng.randrange(9)) for _ in range(400)]
    df = spark.createDataFrame(data, "g string, id long, name string, v int")
    states = distinct.folded(df, ["g"], ["id", "name"], {"total": ("sum", F.col("v")), "least": ("min", F.col("v"))})
    got = distinct.counted(states, ["g"], {"ids": 0, "names": 1}, {"total": "sum", "least": "min"})
    wanted = df.groupBy("g").agg(
        F.sum("v").alias("total"), F.min("v").alias("least"), F.count_distinct("id").alias("ids"), F.count_distinct("name").alias("names")
    )
    assert sorted(rows(got), key=repr) == sorted(rows(wanted), key=repr)
    # states of parts merge to the state of all
    parts = distinct.id_words(df.where("v < 4"), ["g"], ["id"]).unionByName(distinct.id_words(df.where("v >= 3"), ["g"], ["id"]))
    whole = distinct.counted(distinct.merged(parts, [], {}), [], {"ids": 0}, {})
    assert rows(whole) == rows(df.agg(F.count_distinct("id")))
    assert rows(distinct.counted(distinct.id_words(df.where("false"), ["g"], ["id"]), ["g"], {"ids": 0}, {})) == []
    with pytest.raises(TypeError):
        distinct.id_words(df.withColumn("x", F.lit(1.5)), ["g"], ["x"])


def test_dense_ids_take_few_rows(spark):
    df = spark.range(0, 6400, 1, 1).withColumn("g", F.lit(1))
    assert distinct.id_words(df, ["g"], ["id"]).count() == 100


def line(order, customer, day_, product=1, region="R", state="S", category="C", sales_=10):
    return (order, customer, product, f"p{product}", category, "sub", region, state, day_, 1, D(sales_), D(1), D(2))


LINES = (
    "order_id long, customer_id long, product_id long, product_name string, category string, sub_category string, region string, "
    "state string, order_date date, quantity int, sales decimal(12,2), discount decimal(12,2), profit decimal(12,2)"
)


def test_orders_over_two_months_and_of_two_customers_count_once(spark):
    data = [
        line(1, 7, dt.date(2024, 1, 31)), line(1, 7, dt.date(2024, 2, 1)),  # over two months
        line(2, 7, dt.date(2024, 2, 2)), line(2, 8, dt.date(2024, 2, 2)),  # of two customers
        line(3, 8, dt.date(2024, 3, 31)), line(3, 8, dt.date(2024, 4, 1)),  # over two quarters
    ]
    df = spark.createDataFrame(data, LINES)
    got = sales.sales_overview(df).select("month", "total_orders", "unique_customers", "quarterly_orders", "yearly_orders")
    assert rows(got, "month") == [(1, 1, 1, 3, 3), (2, 2, 2, 3, 3), (3, 1, 1, 3, 3), (4, 1, 1, 1, 3)]
    by_region = sales.category_region_month(df).select("order_month", "order_count", "customer_count")
    assert [r[1:] for r in rows(by_region, "order_month")] == [(1, 1), (2, 2), (1, 1), (1, 1)]
    of_product = products.product_performance(df).select("total_orders", "unique_customers", "states_sold", "regions_sold")
    assert rows(of_product) == [(3, 2, 1, 1)]


@pytest.mark.parametrize("name", ["regional_sales", "product_performance", "sales_overview", "category_region_month"])
def test_distinct_counts_take_one_pass_and_aggregate_by_hash(large, name):  # noqa: F811
    from checks.queries import REGISTRY

    text = plan(REGISTRY[name](large, SMALL))
    assert text.count("l_orderkey:bigint") == 1 and "Expand" not in text
    lowest = text[: text.rindex("Generate inline")]  # the aggregate of the lines
    assert lowest.rstrip().splitlines()[-1].count("HashAggregate") + lowest.rstrip().splitlines()[-2].count("HashAggregate")


def test_sketches_merge_within_their_bound(spark):
    df = spark.range(200_000).select((F.col("id") % 50_000).alias("c"), F.date_add(F.lit(day(1)), (F.col("id") % 60).cast("int")).alias("order_date"))
    daily = distinct.sketches(df, ["order_date"], {"customers": "c"})
    monthly = distinct.estimated(daily, [F.trunc("order_date", "MM").alias("m")], ["customers"])
    exact = dict(rows(df.groupBy(F.trunc("order_date", "MM")).agg(F.count_distinct("c"))))
    for month, estimate in rows(monthly):
        assert abs(estimate - exact[month]) <= distinct.error_bound() * exact[month]
    assert distinct.error_bound(10) > distinct.error_bound(14)


# --- marks ------------------------------------------------------------------------------


@pytest.mark.parametrize("kind,values", [
    ("date", ["2024-01-01", "2024-02-01"]), ("timestamp", ["2024-01-01 00:00:00.000001", "2024-01-01 00:00:00.000002"]),
    ("timestamp_ntz", ["2024-01-01 00:00:00", "2024-03-01 00:00:00.5"]), ("bigint", ["-5", "9007199254740993"]),
    ("decimal(20,4)", ["1.0001", "1.0002"]), ("double", ["0.1", "0.30000000000000004"]), ("string", ["a'b", "b"]),
])
def test_marks_of_all_types_come_back(spark, folder, kind, values):
    source = spark.createDataFrame([(v,) for v in values] + [(None,)], "m string").select(F.col("m").cast(kind).alias("m"))
    for n, part in enumerate((source.where(F.col("m") <= F.lit(values[0]).cast(kind)), source, source)):
        assert refresh.incremental_append(part, f"{folder}/t", "m") == (n > 0)
        assert spark.read.parquet(f"{folder}/t").count() == min(n + 1, 2)
    assert marks.saved_mark(spark, f"{folder}/t")[0] == kind


def test_a_load_with_a_stored_mark_does_not_read_its_target(spark, folder):
    source = star.table(spark, SMALL, "orders").select("o_orderkey", "o_orderdate")
    refresh.incremental_append(source.where("o_orderkey < 500"), f"{folder}/t", "o_orderkey")
    text = plan(refresh.newer_rows(source, marks.stored_mark(spark, f"{folder}/t", "o_orderkey"), "o_orderkey"))
    assert text.count("FileScan") == 1 and "Subquery" not in text and "GreaterThan(o_orderkey," in text


def test_a_load_cut_short_is_seen_by_the_next(spark, folder):
    path = f"{folder}/t"
    refresh.incremental_append(frame(spark, [(1, 1, day(1))]), path, "d")
    # rows written, mark not
    Folder(spark, f"{path}/{marks.OPEN_FILE}").write_text("")
    sinks.append(frame(spark, [(2, 2, day(5))]), path)
    refresh.incremental_append(frame(spark, [(2, 2, day(5)), (3, 3, day(6))]), path, "d")
    assert rows(read_table(spark, path).select("k"), "k") == [(1,), (2,), (3,)]
    assert not Folder(spark, f"{path}/{marks.OPEN_FILE}").exists()


def test_a_table_without_a_mark_file_gets_one(spark, folder):
    sinks.append(frame(spark, [(1, 1, day(3))]), f"{folder}/t")
    refresh.incremental_append(frame(spark, [(1, 1, day(3)), (2, 1, day(4))]), f"{folder}/t", "d")
    assert marks.saved_mark(spark, f"{folder}/t") == ("date", "2024-01-04")
    refresh.incremental_append(frame(spark, []), f"{folder}/t", "d")  # an empty load leaves the mark
    assert marks.saved_mark(spark, f"{folder}/t") == ("date", "2024-01-04")


# --- merged on read ---------------------------------------------------------------------


def test_merge_on_read_is_the_upsert_before_and_after_compactions(spark, folder):
    rng = random.Random(2)
    table = deltas.newest_rows(spark, f"{folder}/t", ["k"], ["d"], most=3)
    other = refresh.Buckets(spark, f"{folder}/u", ["k"], 2)
    assert table.current() is None and table.mark() is None
    for n in range(7):
        batch = [(rng.choice([None, *range(8)]), rng.randrange(100), day(rng.randrange(1, 9))) for _ in range(6)]
        table.add(frame(spark, batch), "d")
        wanted = refresh.incremental_upsert(frame(spark, batch), other, ["d"])
        assert sorted(rows(table.current()), key=repr) == sorted(rows(wanted.select("k", "v", "d")), key=repr), n
        base, later = table.pieces()
        assert len(later) < 3
    names = os.listdir(f"{folder}/t")
    assert len([n for n in names if n.startswith("base-")]) <= 2 and len(names) <= 8
    table.compact()
    table.compact()
    assert table.pieces()[1] == []


def test_a_failed_load_is_not_read_and_its_number_not_used_again(spark, folder):
    table = deltas.newest_rows(spark, f"{folder}/t", ["k"], ["d"])
    table.add(frame(spark, [(1, 1, day(1))]), "d")
    broken = frame(spark, [(2, 2, day(2))]).withColumn("v", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        table.add(broken, "d")
    # whole, but its mark was not written
    frame(spark, [(9, 9, day(9))]).withColumn(deltas.LOAD, F.lit(7)).write.parquet(f"{folder}/t/delta-00000007")
    assert rows(table.current()) == [(1, 1, day(1))]
    table.add(frame(spark, [(1, 5, day(1))]), "d")
    assert table.pieces()[1] == [1, 8] and rows(table.current()) == [(1, 5, day(1))]
    with pytest.raises(Exception):
        table.add(frame(spark, [(1, "x", day(1))], "k int, v string, d date"))


def fold(df):
    return df.groupBy("g").agg(F.sum("v").alias("total"), F.max("v").alias("most"), F.max("m").alias("m"))


def test_states_add_up_to_a_full_build(spark, folder):
    rng = random.Random(3)
    table = deltas.adding_states(spark, f"{folder}/t", ["g"], {"total": "sum", "most": "max", "m": "max"}, most=3)
    source = []
    for load in range(1, 8):
        source += [(rng.choice([None, "a", "b", f"g{load}"]), rng.randrange(50), load) for _ in range(10)]
        changed = None
        if load % 2 == 0:  # some stored rows are corrected, and all of one group removed
            gone = f"g{load - 1}"
            touched = {gone, "a"}
            source = [(g, v + 1000 * (g == "a" and m < load), load if g == "a" else m) for g, v, m in source if g != gone]
            changed = spark.createDataFrame([(g,) for g in touched], "g string")
        df = spark.createDataFrame(source, "g string, v int, m int")
        refresh.incremental_states(df, table, ["g"], "m", fold, changed)
        refresh.incremental_states(df, table, ["g"], "m", fold)  # nothing new
        got = table.current().select("g", "total", "most", "m")
        assert sorted(rows(got), key=repr) == sorted(rows(fold(df)), key=repr), load


def test_bytes_of_a_load_follow_the_groups_it_touches(spark, folder):
    table = deltas.adding_states(spark, f"{folder}/t", ["g"], {"total": "sum", "most": "max", "m": "max"})
    source = spark.range(200_000).select(F.col("id").cast("string").alias("g"), F.col("id").alias("v"), F.lit(1).alias("m"))
    refresh.incremental_states(source, table, ["g"], "m", fold)
    more = source.unionByName(source.limit(10).withColumn("m", F.lit(2)))
    assert refresh.incremental_states(more, table, ["g"], "m", fold) == 10
    assert bytes_in(f"{folder}/t/delta-00000002") < bytes_in(f"{folder}/t/delta-00000001") / 50
    assert table.current().agg(F.sum("total")).first()[0] == sum(range(200_000)) + sum(range(10))


# --- upserts ----------------------------------------------------------------------------


def test_upsert_bucket_mismatch(spark, folder):
    keys = frame(spark, [(k, 1, day(1)) for k in range(20)])
    refresh.incremental_upsert(keys, refresh.Buckets(spark, f"{folder}/t", ["k"], 8))
    for n, by in ((64, ["k"]), (8, ["v"])):
        with pytest.raises(refresh.OtherBuckets):
            refresh.Buckets(spark, f"{folder}/t", by, n)
    again = refresh.Buckets(spark, f"{folder}/t", ["k"])  # the stored number
    assert again.n == 8 and refresh.incremental_upsert(keys, again).count() == 20
    # a table from before the number was stored
    os.remove(f"{folder}/t/{refresh.BUCKETS_FILE}")
    with pytest.raises(refresh.OtherBuckets):
        refresh.Buckets(spark, f"{folder}/t", ["k"], 64)
    assert refresh.Buckets(spark, f"{folder}/t", ["k"], 8).n == 8 and os.path.exists(f"{folder}/t/{refresh.BUCKETS_FILE}")


def test_upsert_repeated_keys(spark, folder):
    table = refresh.Buckets(spark, f"{folder}/t", ["k"], 4)
    for twice in ([(1, 1, day(1)), (1, 2, day(1))], [(None, 1, day(1)), (None, 1, day(1))]):
        with pytest.raises(refresh.RepeatedKey):
            refresh.incremental_upsert(frame(spark, twice), table)
    assert table.current() is None
    refresh.incremental_upsert(frame(spark, [(1, 1, day(1))]), table)
    with pytest.raises(refresh.RepeatedKey):
        refresh.incremental_upsert(frame(spark, [(1, 3, day(1)), (1, 3, day(1))]), table)
    assert rows(table.current()) == [(1, 1, day(1))]
    with pytest.raises(refresh.RepeatedKey):
        refresh.upsert_partitions(frame(spark, [(1, 1, day(1)), (1, 2, day(2))]), f"{folder}/p", ["k"], ["d"])


def test_a_missing_key_that_moved_partition_is_noticed(spark, folder):
    refresh.upsert_partitions(frame(spark, [(None, 1, day(1))]), f"{folder}/t", ["k"], ["d"])
    with pytest.raises(refresh.MovedKey):
        refresh.upsert_partitions(frame(spark, [(None, 2, day(2))]), f"{folder}/t", ["k"], ["d"])


# --- publishing -------------------------------------------------------------------------


@pytest.mark.parametrize("moves", [0, 1])
def test_a_swap_ended_between_its_steps_leaves_the_old_table(spark, folder, monkeypatch, moves):
    path = f"{folder}/t"
    sinks.full_refresh(frame(spark, [(1, 1, day(1))]), path)
    done, move = [], tables.Folder.move

    def stop(self, target):
        if len(done) == moves:
            raise KeyboardInterrupt
        done.append(target)
        move(self, target)

    monkeypatch.setattr(tables.Folder, "move", stop)
    with pytest.raises(KeyboardInterrupt):
        sinks.full_refresh(frame(spark, [(2, 2, day(2))]), path)
    monkeypatch.undo()
    assert rows(read_table(spark, path)) == [(1, 1, day(1))]
    sinks.full_refresh(frame(spark, [(3, 3, day(3))]), path)
    assert rows(read_table(spark, path)) == [(3, 3, day(3))]
    assert not [n for n in os.listdir(folder) if ".old-" in n]


# --- quality ----------------------------------------------------------------------------


def test_checks_counted_during_the_write(spark, folder):
    df = frame(spark, [(1, -1, None), (None, 5, day(1)), (3, None, day(9))])
    checks = [*quality.not_null("k", "d"), quality.positive("v"), quality.in_past("d", day(5))]
    for name, part in (("some", df), ("none", df.where("k > 100")), ("empty", df.limit(0))):
        watch = quality.Watch("t", checks)
        sinks.write_new(watch(part), f"{folder}/{name}")
        assert rows(watch.report(spark)) == rows(quality.quality_report(part, "t", checks))
        watch = quality.Watch("t", checks)
        sinks.write_partitioned(part, f"{folder}/{name}-days", ["d"], ["k"], watch)
        assert rows(watch.report(spark)) == rows(quality.quality_report(part, "t", checks))
        # counted in the stage that writes, above the shuffle that deals out the partitions
        text = plan(quality.Watch("t", checks)(sinks.laid_out(part, ["d"], [])))
        assert name != "some" or text.index("CollectMetrics") < text.index("Exchange")


def test_uniqueness_by_hashes(spark, monkeypatch):
    data = [(k % 50 if k < 60 else k, None if k % 7 == 0 else f"key number {k % 90}") for k in range(100)]
    df = spark.createDataFrame(data, "a long, b string")
    for keys in (["a"], ["b"], ["a", "b"]):
        assert rows(quality.hashed_uniqueness_report(df, "t", keys)) == rows(quality.uniqueness_report(df, "t", keys))
    assert rows(quality.hashed_uniqueness_report(df.limit(0), "t", ["a"])) == [("t", "a", "unique", 0, 0)]
    # equal hashes of different keys
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: F.length(F.concat_ws(",", *c)).cast("long"))
    for keys in (["a"], ["b"], ["a", "b"]):
        assert rows(quality.hashed_uniqueness_report(df, "t", keys)) == rows(quality.uniqueness_report(df, "t", keys))


def test_unique_keys_are_not_shuffled(spark):
    df = spark.range(100_000).select(F.concat(F.lit("a long key, the same for all but its end " * 3), "id").alias("key"))
    text = []
    seen = quality.settled

    def look(stored, name):
        text.append(plan(stored))
        return seen(stored, name)

    quality.settled = look
    try:
        report = quality.hashed_uniqueness_report(df, "t", ["key"])
        assert rows(report) == [("t", "key", "unique", 0, 100_000)]
    finally:
        quality.settled = seen
    # what moves is the hash and its count: two numbers of 8 bytes a key
    exchange = next(x for x in text[0].splitlines() if "Exchange hashpartitioning" in x)
    assert "_hash" in exchange and "key#" not in exchange
    final = plan(report)
    assert "BroadcastHashJoin" in final


# --- payloads ---------------------------------------------------------------------------


def test_open_payloads(spark):
    docs = [
        '{"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "uv": [1, 2.5], "soil": ["wet"], "long": [1, 2, 3], "flat": 5}}',
        '{"hourly": {"uv": [7]}}', '{"daily": {"uv": [1]}}', '{"hourly": [1, 2]}', '{"hourly": {', "", None, "[]", "null",
        '{"hourly": {"time": ["bad"], "a.b": [true]}}',
    ]
    df = spark.createDataFrame([(d,) for d in docs], "payload string")
    at = [dt.datetime(2024, 1, 1, h) for h in (0, 1)]
    got = sorted(rows(scans.open_readings(df.where("payload not like '%bad%' or payload is null"), "payload")), key=repr)
    assert got == sorted(
        [(at[0], "uv", 1.0), (at[1], "uv", 2.5), (at[0], "soil", None), (at[0], "long", 1.0), (at[1], "long", 2.0), (None, "long", 3.0), (None, "uv", 7.0)],
        key=repr,
    )
    assert {r[0] for r in rows(scans.malformed(df, "payload"))} == {'{"hourly": {', ""}


# --- layout -----------------------------------------------------------------------------


def files_reaching(folder, column, low, high):
    n = 0
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            meta = pq.ParquetFile(f"{folder}/{name}").metadata
            place = meta.schema.names.index(column)
            groups = [meta.row_group(i).column(place).statistics for i in range(meta.num_row_groups)]
            n += any(s.max >= low and s.min <= high for s in groups)
    return n


def test_interleaved_files_skip_on_every_column(spark, folder):
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.randrange(10_000), rng.randrange(10_000), i) for i in range(20_000)], "a int, b int, i int")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_interleaved(df, f"{folder}/z", ["a", "b"])
        df.repartitionByRange("a", "b").sortWithinPartitions("a", "b").write.parquet(f"{folder}/linear")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(rows(read_table(spark, f"{folder}/z"))) == sorted(rows(df))
    reached = {t: [files_reaching(f"{folder}/{t}", c, 3000, 3050) for c in ("a", "b")] for t in ("z", "linear")}
    assert reached["linear"][1] >= 60 and reached["z"][1] <= 20 and reached["z"][0] <= 20, reached


def test_interleaving_takes_missing_values_dates_and_constants(spark, folder):
    data = [(None if i % 5 == 0 else day(i % 28 + 1), 7, 1.5 * i) for i in range(100)]
    df = spark.createDataFrame(data, "d date, k int, x double")
    sinks.write_interleaved(df, f"{folder}/t", ["d", "k", "x"], bits=3)
    assert sorted(rows(read_table(spark, f"{folder}/t")), key=repr) == sorted(data, key=repr)
    sinks.write_interleaved(df.limit(0), f"{folder}/t", ["d", "x"])
    assert read_table(spark, f"{folder}/t").count() == 0
    with pytest.raises(TypeError):
        sinks.interleaved_rank(df.withColumn("s", F.lit("a")), ["s"])


def test_expired_rows_leave_the_partition_the_limit_falls_into(spark, folder):
    stamps = [dt.datetime(2024, m, d, 5) for m in (1, 2, 3) for d in (1, 10, 20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(stamps)], "i int, ts timestamp_ntz").withColumn("m", F.date_format("ts", "yyyyMM"))
    sinks.write_partitioned(df, f"{folder}/t", ["m"])
    for _ in range(2):
        sinks.expire_rows(spark, f"{folder}/t", "m", "ts", 30, dt.date(2024, 3, 11))
        assert rows(read_table(spark, f"{folder}/t").select("i"), "i") == [(i,) for i in range(5, 9)]
    sinks.expire_rows(spark, f"{folder}/t", "m", "ts", 0, dt.date(2024, 3, 25))
    assert not [n for n in os.listdir(f"{folder}/t") if n.startswith("m=")]


# --- streams ----------------------------------------------------------------------------


def landing(spark, folder, data):
    types = "event_id int, reading_ts timestamp_ntz, temperature_2m decimal(5,2), precipitation decimal(5,2)"
    df = spark.createDataFrame([(i, t, None, None) for i, t in data], types).coalesce(1)
    sinks.append(df, f"{folder}/landing")
    return loads.landing(spark, f"{folder}/landing", df.schema)


def hour(d, h=0):
    return dt.datetime(2024, 1, d, h)


def test_a_file_delivered_twice_adds_nothing(spark, folder):
    def load(data):
        rows_ = landing(spark, folder, data)
        return loads.stream_dedupe(rows_, ["event_id"], "reading_ts", "2 days", f"{folder}/t", f"{folder}/c", partitions=2)

    first = [(1, hour(1)), (2, hour(2)), (3, hour(3))]
    assert load(first) == 0
    load(first + [(4, hour(4))])
    load([(4, hour(4)), (5, hour(9)), (5, hour(9))])
    assert rows(spark.read.parquet(f"{folder}/t").select("event_id"), "event_id") == [(1,), (2,), (3,), (4,), (5,)]
    assert load([(6, hour(1))]) > 0  # nobody knows any more whether it was there


def test_late_rows_are_counted(spark, folder):
    def load(data):
        return loads.stream_daily_weather(landing(spark, folder, data), f"{folder}/t", f"{folder}/c", partitions=2)

    assert load([(1, hour(5)), (2, hour(6))]) == 0
    assert load([(3, hour(6, 3)), (4, hour(9))]) == 0
    assert load([(5, hour(1)), (6, hour(9, 1))]) == 1
    got = rows(read_table(spark, f"{folder}/t").select("measurement_date", "measurement_count"), "measurement_date")
    assert got == [(day(5), 1), (day(6), 2), (day(9), 2)]
    assert len([n for n in os.listdir(f"{folder}/c/state/0") if n.isdigit()]) == 2
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


# --- named functions --------------------------------------------------------------------


def test_named_formulas_are_the_expressions(spark):
    names = named.register(spark, "my_")
    assert set(names) == {f"my_{n}" for n in named.formulas()}
    rng = random.Random(8)
    data = [tuple(None if rng.random() < 0.05 else rng.randrange(-2000, 10_000) / 100 for _ in range(3)) for _ in range(300)]
    df = spark.createDataFrame(data, "t double, h double, w double").select(*[F.col(c).cast("decimal(5,2)") for c in "thw"])
    from strata.functions import weather as wx

    number = lambda c: F.round(c.cast("double"), 6)
    own = df.select(
        number(wx.heat_index("t", "h")), number(wx.wind_chill("t", "w")), number(wx.comfort_index("t", "h", "w")),
        wx.comfort_category(wx.comfort_index("t", "h", "w")), number(wx.linear_comfort("t", "h", "w")),
    )
    df.createOrReplaceTempView("measured")
    sql = spark.sql("""
        SELECT round(CAST(my_heat_index(t, h) AS DOUBLE), 6), round(my_wind_chill(t, w), 6),
               round(CAST(my_comfort_index(t, h, w) AS DOUBLE), 6), my_comfort_category(my_comfort_index(t, h, w)),
               round(my_linear_comfort(t, h, w), 6) FROM measured""")
    assert rows(sql) == rows(own)
    assert "PythonUDF" not in plan(sql)


# --- layered builds ---------------------------------------------------------------------


def test_models_merged_on_read_and_of_states(spark, folder):
    types = "k string, v int, m int"

    def models(**extra):
        return [
            Model("newest", "core", lambda t: t["rows"], materialized="merge", keys=("k",), newest_first=("v",), mark="m"),
            Model(
                "totals", "core", lambda t: t["rows"], materialized="states", keys=("k",), mark="m",
                aggregate=lambda df: df.groupBy("k").agg(F.sum("v").alias("total"), F.count("*").alias("n"), F.max("m").alias("m")),
                combine={"total": "sum", "n": "sum", "m": "max"},
                finish=lambda s: s.select("k", (F.col("total") / F.col("n")).alias("mean")),
                checks=[*quality.not_null("k"), quality.positive("v")],
            ),
            Model("plain", "marts", lambda t: t["totals"].where("mean > 0"), checks=quality.not_null("k")),
        ]

    first = [("a", 1, 1), ("b", 5, 1), (None, -2, 1)]
    second = [("a", 3, 2), ("b", 3, 2)]
    for data in (first, second, second):
        built = run_layers(spark, {"rows": spark.createDataFrame(data, types)}, models(), folder)
    assert sorted(rows(built["newest"]), key=repr) == sorted([("a", 3, 2), ("b", 5, 1), (None, -2, 1)], key=repr)
    assert sorted(rows(built["totals"]), key=repr) == sorted([("a", 2.0), ("b", 4.0), (None, -2.0)], key=repr)
    report = rows(quality_of(spark, models(), folder), "table_name", "column_name")
    assert report == [("plain", "k", "not_null", 0, 2), ("totals", "k", "not_null", 0, 2), ("totals", "v", "positive", 0, 2)]
    with pytest.raises(ValueError, match="no model has checks"):
        quality_of(spark, models()[:1], folder)
    for bad in (
        Model("x", "core", lambda t: t["rows"], materialized="merge", keys=("k",)),
        Model("x", "core", lambda t: t["rows"], materialized="states", keys=("k",), mark="m"),
        Model("x", "core", lambda t: t["rows"], materialized="view", checks=quality.not_null("k")),
    ):
        with pytest.raises(ValueError):
            bad.check()


def test_days_from_states_are_days_from_readings(spark):
    readings = star.readings(spark, SMALL, faulty=True).withColumn("loaded_at", F.lit(1))
    parts = [readings.where(F.col("event_id") % 3 == n) for n in range(3)]
    states = weather.daily_states(parts[0], ["station_id"])
    for part in parts[1:]:
        states = states.unionByName(weather.daily_states(part, ["station_id"]))
    combine = weather.DAY_STATES | {"loaded_at": "max"}
    merged = states.groupBy("measurement_date", "station_id").agg(*[deltas.COMBINE[f](c).alias(c) for c, f in combine.items()])
    own = weather.daily_from_states(merged, ["station_id"])
    wanted = weather.daily_weather(readings, ["station_id"]).select(*own.columns)
    assert own.exceptAll(wanted).count() == wanted.exceptAll(own).count() == 0 and own.count() == wanted.count() > 0
