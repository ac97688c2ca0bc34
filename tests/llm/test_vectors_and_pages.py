"""Top-k search and URL rules against SQL and plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks.compare import connect, differences
from strata.llm import queries, topk, url_rules
from strata.llm.sql import Q
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(Q))
def test_query_agrees_with_sql(spark, con, name):
    assert differences(queries.REGISTRY[name](spark, SMALL), con, Q[name]) == []


@pytest.fixture()
def as_query(monkeypatch):
    def run(name, spark, df):
        monkeypatch.setattr(queries, "table", lambda *_: df)
        return queries.REGISTRY[name](spark, "")

    return run


# --- top-k ------------------------------------------------------------------------------


def vectors(n, seed, width=6):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.25, 0.003, 1.0]) for _ in range(width)]) for i in range(n)]
    rows[7] = (7, None)
    rows[50] = (50, [math.nan] * width)
    rows[8] = (8, [1.0, None] + [0.0] * (width - 2))
    rows[9] = (9, [math.inf] + [0.0] * (width - 1))
    rows[10] = (10, [])
    rows[11] = (11, [1.0])
    rows[12] = (None, [1.0] * width)
    return rows + [rows[13], rows[13]]


def nearest(rows, k):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(256 * float(np.float32(x))) for x in v]

    usable = [(i, whole(v)) for i, v in rows if i is not None and whole(v) is not None]
    out = []
    for q, a in usable:
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q)
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return out


SCHEMA = "vec_id long, embedding array<float>, label int, block long, ids string, vector string, q int, score string"


@pytest.mark.parametrize("n, partitions, sizes", [(400, 3, (4096, 512)), (300, 4, (16, 2)), (60, 1, (1, 1)), (2, 1, (8, 8))])
def test_top_k(spark, as_query, monkeypatch, n, partitions, sizes):
    monkeypatch.setattr(topk, "CANDIDATES", sizes[0])
    monkeypatch.setattr(topk, "QUERIES", sizes[1])
    rows = vectors(n, n) if n > 20 else [(0, [1.0, 2.0]), (50, [3.0, 1.0])]
    df = spark.createDataFrame([(*r, None, 1, "i", "v", 2, "s") for r in rows], SCHEMA).repartition(partitions)
    out = as_query("op9_top_k", spark, df)
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert Counter(map(tuple, out.collect())) == Counter(nearest(rows, 5))


def test_top_k_of_an_empty_table(spark, as_query):
    assert as_query("op9_top_k", spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_top_k_with_more_slices_than_components(spark):
    rows = [(i, [i % 5, -i, 3]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = topk.top_k(df.where("vec_id % 10 = 0"), df, k=3, slices=8).collect()
    wanted = []
    for q, a in rows[::10]:
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q)
        wanted += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:3], 1)]
    assert Counter(map(tuple, got)) == Counter(wanted)


@pytest.mark.parametrize("slices", [2, 4])
def test_few_entries_leave_their_lists(spark, monkeypatch, tmp_path, slices):
    """Phase 1 sends k entries a list, phase 2 those at or above the share, phase 3 resolves the rest exactly."""
    monkeypatch.setattr(topk, "run_dir", lambda *_: str(tmp_path))
    monkeypatch.setattr(topk, "CANDIDATES", 256)
    rng = np.random.default_rng(slices)
    q, c = rng.integers(-200, 200, (20, 64)), rng.integers(-200, 200, (3000, 64))
    frame = lambda m, first: spark.createDataFrame([(first + i, v) for i, v in enumerate(m.tolist())], "vec_id long, vector array<long>")
    got = topk.top_k(frame(q, 10_000), frame(c, 0), k=5, slices=slices).collect()
    scores = q @ c.T
    for i in range(20):
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 10_000 + i)
        best = sorted(range(3000), key=lambda j: (-scores[i, j], j))[:5]
        assert own == [(r, j, scores[i, j]) for r, j in enumerate(best, 1)]
    sent = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in ("leaders", "sent", "known", "cutoffs")}
    assert sent["leaders"].count() <= 20 * 5 * slices
    assert sent["sent"].count() < 0.2 * scores.size * slices and sent["known"].count() < scores.size / 2
    kth = np.sort(scores, axis=1)[:, -5]
    assert all(r["cutoff"] <= kth[n] for n, r in enumerate(sent["cutoffs"].orderBy("q").collect()))
    # nothing below the share was sent, and nothing at or above it was kept back
    cutoff = {r["q"]: r["cutoff"] for r in sent["cutoffs"].collect()}
    entries = sent["sent"].collect()
    assert all(r["part"] * slices >= cutoff[r["q"]] for r in entries)
    place = {r["q"]: r["query_id"] - 10_000 for r in entries}
    cuts = np.array_split(np.arange(64), slices)
    wanted = sum(int((q[place[n]][cut] @ c[:, cut].T * slices >= limit).sum()) for n, limit in cutoff.items() for cut in cuts)
    assert len(entries) == wanted


def test_a_share_is_reached_by_whole_numbers_only_if_they_reach_it():
    for cutoff in range(-20, 21):
        for slices in (1, 2, 3, 8):
            least = topk.shares([cutoff], slices)[0]
            assert [p >= least for p in range(-30, 31)] == [p * slices >= cutoff for p in range(-30, 31)]
    assert topk.shares([None, 2**60 + 1], 2)[0] == -np.inf and topk.shares([2**60 + 1], 2)[0] <= 2**59


# --- URL rules --------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, host string, path string, rule string, _part string, _key int, _id string"


def urls():
    rng = random.Random(4)
    hosts = ["com", "example.com", "EXAMPLE.com", "www.example.com", "a.www.example.com", "net", "x.net", "xnet", "examplexcom", "badexample.com", "", "..", "com.", "example.com:80", "é.com"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/es/1", "/fr/", "/EN/", "?q=/en/", "#/en/", "/es/?a#b", "//en/"]
    made = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(500)]
    return made + [None, "", "example.com/en/", "a://b://example.com/en/", "http://www.example.com/en/" + "x" * 50_000, "x\n://net/es/\n?"]


def as_pages(spark, made):
    return spark.createDataFrame([(i // 2, u, None, "h", "p", "r", "a", 1, "z") for i, u in enumerate(made)], PAGES)


def test_url_rules(spark, as_query):
    made = urls()
    out = as_query("op10_url_rules", spark, as_pages(spark, made).repartition(5))
    wanted = [(i // 2, *brute.judge(u, queries.URL_RULES)) for i, u in enumerate(made)]
    assert Counter(map(tuple, out.collect())) == Counter(wanted)


def test_many_nested_rules(spark):
    rng = random.Random(8)
    label = lambda: rng.choice("abc")
    rules = [(".".join(label() for _ in range(rng.randrange(1, 5))), rng.choice(["", "/", "/a", "/a/b", "/b"]), rng.choice(["allow", "block"])) for _ in range(60)]
    rules += [rules[0], (None, "/", "block"), ("a", None, "block"), ("B", "/", None)]
    made = ["http://" + ".".join(label() for _ in range(rng.randrange(1, 7))) + rng.choice(["", "/", "/a/b/c", "/b?x", "/c"]) for _ in range(2000)]
    rules_df = spark.createDataFrame(rules, "host string, path string, verdict string")
    df = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    own = [(h, p or "", v) for h, p, v in rules if h and v]
    got = url_rules.judge_urls(df, rules_df, default="block").collect()
    assert Counter(map(tuple, got)) == Counter((i, *brute.judge(u, own, "block")) for i, u in enumerate(made))


def test_empty_pages_and_rules(spark, as_query):
    assert as_query("op10_url_rules", spark, as_pages(spark, ["x"]).limit(0)).collect() == []
    none = spark.createDataFrame([], "host string, path string, verdict string")
    got = url_rules.judge_urls(as_pages(spark, ["http://a.b/c"]), none).collect()
    assert [tuple(r) for r in got] == [(0, "a.b", "/c", None, "allow")]
