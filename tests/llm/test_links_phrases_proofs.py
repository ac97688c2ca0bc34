"""SimHash links, collocations and Merkle proofs against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import collocations, components, merkle, queries, simhash
from tests.llm import brute
from tests.llm.test_documents import as_query, odd_rows, same, table, tables  # noqa: F401

WORDS = "doc_id long, text string"


def low(key):
    return (key is not None, key)


def full(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# --- SimHash ----------------------------------------------------------------------------


def expected_links(rows):
    """Rows of (id, text); a component's id is its least that is not missing, if there is one."""
    prints = [brute.simhash(t) for _, t in rows]
    least = brute.linked_components([(k is None, k) for k, _ in rows], prints)
    return [(k, f"{p:016x}", c[1]) for (k, _), p, c in zip(rows, prints, least)]


def test_simhash(spark, table, as_query):  # noqa: F811
    df, rows = table
    wanted = expected_links([(k, t) for k, _, t in rows])
    same(as_query("op11_simhash", spark, df), ["doc_id", "fingerprint", "component_id"], wanted)


def spread(rng, n, flips):
    """Fingerprints in chains of a few bits each, around few centres."""
    out = []
    for _ in range(n):
        p = rng.choice(out) if out and rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randrange(flips + 1)):
            p ^= 1 << rng.randrange(64)
        out.append(p)
    return out


@pytest.mark.parametrize("most", [4, 30, 1 << 14])
def test_no_link_is_lost_however_small_the_shards(spark, folder, most):
    rng = random.Random(most)
    prints = sorted({*spread(rng, 400, 3), *[rng.getrandbits(40) | 5 << 60 for _ in range(100)]})
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    members = simhash.shards(df, 2, folder, most)
    sizes = members.groupBy("shard").count().agg(F.min("count"), F.max("count")).first()
    assert 2 <= sizes[0] and sizes[1] <= most
    edges = simhash.linked(simhash.trees(members), 2)
    edges.write.parquet(f"{folder}/edges")
    found = dict(full(components.components(spark.read.parquet(f"{folder}/edges"), f"{folder}/c"), "node", "label"))
    label = [found.get(simhash.signed(p), simhash.signed(p)) for p in prints]
    wanted = brute.linked_components(prints, prints)
    assert len(set(zip(label, wanted))) == len(set(wanted)) == len(set(label))


def test_bk_tree_edges_are_distances_and_searches_are_whole():
    rng = random.Random(5)
    members = np.array(sorted(set(spread(rng, 3000, 4))), np.uint64)
    roots = np.where(np.arange(len(members)) < 1000, 0, 1000)  # two trees
    up, edge = simhash.grow(members, roots)
    below = up != np.arange(len(members))
    assert below.sum() == len(members) - 2 and (np.bitwise_count(members ^ members[up]) == edge)[below].all()
    pairs = list(zip(up[below].tolist(), edge[below].tolist()))
    assert len(set(pairs)) == len(pairs)  # one child per distance
    places = np.arange(len(members))
    who, what = simhash.search(members, up, edge, places, roots, 2)
    near = np.bitwise_count(members[:, None] ^ members[None, :]) <= 2
    near &= roots[:, None] == roots[None, :]
    assert len(who) == near.sum() and near[who, what].all()


def test_a_search_leaves_most_of_the_tree_out(monkeypatch):
    members = np.array(random.Random(6).sample(range(1 << 62), 4000), np.uint64)
    up, edge = simhash.grow(members, np.zeros(len(members), np.int64))
    visited, count = [], np.bitwise_count
    monkeypatch.setattr(simhash.np, "bitwise_count", lambda x: visited.append(len(x)) or count(x))
    simhash.search(members, up, edge, np.arange(100), np.zeros(100, np.int64), 2)
    assert sum(visited) < 0.35 * 100 * len(members)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, folder, seed):
    rng = random.Random(seed)
    n = 400
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(300)]
    pairs += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(60)]  # a chain, a star
    pairs = [(a, b) for a, b in pairs if a != b]
    spark.createDataFrame(pairs, "a long, b long").write.parquet(f"{folder}/e")
    got = dict(full(components.components(spark.read.parquet(f"{folder}/e"), f"{folder}/c"), "node", "label"))
    group = {x: x for p in pairs for x in p}
    for _ in group:
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    assert set(got) == set(group)
    assert len(set(zip(got.values(), map(group.get, got)))) == len(set(group.values())) == len(set(got.values()))


# --- collocations -----------------------------------------------------------------------

PHRASE = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocations(spark, tables, as_query):  # noqa: F811
    for name in ("small", "odd", "empty"):
        df, _ = tables[name]
        wanted = brute.collocations(full(df, "lang", "text"))
        same(as_query("op12_collocations", spark, df), PHRASE, wanted)
        assert wanted or name != "small"


def phrase_rows(rng, n):
    """Few words, so phrases repeat, overlap and tie; all kinds of separators; three languages and a missing one."""
    words = ["a", "B", "b", "ä", "Ä", "c-d", "ſ", "x\x85y", "\x1c", "文"]
    gaps = [" ", "  ", "\t", " \t ", ". ", ",", "\n", "\x0b", "!?"]
    rows = [(None, None), ("en", ""), ("en", " . ,\n"), (None, "a"), ("en", "a a a a a a")]
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice(gaps if rng.random() < 0.3 else gaps[:4]) for _ in range(rng.randrange(60)))
        rows.append((rng.choice(["en", "en", "de", None]), text))
    return rows


@pytest.mark.parametrize("percent,top", [(100, 2000), (60, 7), (0, 5)])
def test_collocations_of_random_texts(spark, percent, top):
    rows = phrase_rows(random.Random(top), 300)
    df = spark.createDataFrame(rows, "lang string, text string")
    got = collocations.phrases(df, least=9, absorbed_percent=percent, top=top)
    same(got, PHRASE, brute.collocations(rows, 9, percent=percent, top=top))
    two = collocations.phrases(df, longest=2, least=20)
    same(two, PHRASE, brute.collocations(rows, 20, longest=2))


def test_collocations_do_not_depend_on_chunks_and_shards(spark, monkeypatch):
    """Chunks of a few texts, many shards; the counting itself is called here, so that the small sizes reach it."""
    rows = phrase_rows(random.Random(1), 120)
    whole = collocations._chunk(1, "en", [t or "" for _, t in rows])
    parts = [collocations._chunk(i, "en", [t or "" for _, t in rows[i::7]]) for i in range(7)]
    for width in range(1, 6):
        for shards in (1, 50):
            def total(chunks):
                out = {}
                for c in chunks:
                    chunk = collocations.Chunk(c["lang"], c["words"], c["ids"])
                    for shard, _, fps, counts in collocations._counted(c["chunk"], chunk.fingerprints(chunk.runs(width), width), shards):
                        for f, n in zip(np.frombuffer(fps, np.uint64).tolist(), np.frombuffer(counts, np.uint32).tolist()):
                            assert f * shards >> 64 == shard or shards == 1 or ((f >> 32) * shards) >> 32 == shard
                            out[f] = out.get(f, 0) + n
                return out

            assert total([whole]) == total(parts)


def test_phrases_of_one_fingerprint_are_told_apart():
    ids = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3], np.uint16)
    at, fps = np.array([0, 3, 6, 1, 4, 7]), np.array([7, 7, 7, 9, 9, 9], np.uint64)
    got = sorted(collocations.distinct_runs(ids, at, fps, 2))
    assert got == [(7, (1, 2), 3), (9, (2, 3), 2), (9, (2, 4), 1)]
    fps[:] = 1  # all collide
    assert sorted(collocations.distinct_runs(ids, at, fps, 2)) == [(1, *g[1:]) for g in got]
    assert list(collocations.distinct_runs(ids, at[:0], fps[:0], 2)) == []


def test_window_fingerprints_are_those_of_their_words():
    texts = ["a b c a b c", "x a b c y"]
    own = [collocations._chunk(i, "en", [t]) for i, t in enumerate(texts)]
    found = []
    for c in own:
        chunk = collocations.Chunk(c["lang"], c["words"], c["ids"])
        found.append(dict(zip([tuple(chunk.words[w] for w in chunk.ids[i : i + 3]) for i in chunk.runs(3)], chunk.fingerprints(chunk.runs(3), 3))))
    assert found[0][b"a", b"b", b"c"] == found[1][b"a", b"b", b"c"]
    assert len({*found[0].values(), *found[1].values()}) == len({*found[0], *found[1]}) == 5
    other = collocations.Chunk("de", own[0]["words"], own[0]["ids"])
    assert other.fingerprints(other.runs(3), 3)[0] not in found[0].values()  # languages are apart


# --- Merkle trees -----------------------------------------------------------------------

PROOF = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_merkle_manifest(spark, tables, as_query):  # noqa: F811
    for name in ("small", "odd", "empty"):
        df, _ = tables[name]
        wanted = brute.manifest(full(df, *queries.LEAF_COLUMNS))
        same(as_query("op13_merkle", spark, df), PROOF, wanted)
    assert not all(r[6] for r in brute.manifest([(i, "s", None, 1, f"{i}\n") for i in range(9)]))


@pytest.mark.parametrize("sizes", [(1,), (3,), (244,), (2200, 1, 729, 730, 243 * 9 + 1), (5,) * 30])
def test_merkle_trees_of_many_sizes(spark, sizes):
    """Groups of one partition and of several rounds, full and not."""
    rng = random.Random(len(sizes))
    rows = [(rng.randrange(10**6), f"s{g}", "en", i, f"t\n{i}") for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string").repartition(5)
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(changed, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))
    out = merkle.manifest(df, queries.LEAF_COLUMNS, claimed=["doc_id", "source", "lang", "n_chars", text])
    got = out.select(
        "doc_id", *[merkle.hex_text(c) for c in ("leaf", "subroot", "root")], merkle.proof_digest("proof"),
        merkle.hex_text("folded"), F.col("folded") == F.col("root"),
    )
    same(got.toDF(*PROOF), PROOF, brute.manifest(rows))


def test_other_fanouts(spark):
    rows = [(i, "s") for i in range(1100)]
    out = merkle.manifest(spark.createDataFrame(rows, "doc_id long, source string"), ["doc_id", "source"], fanout=2).collect()
    root, ways = brute.tree_ways([brute.row_hash(r) for r in rows], 2)
    assert {r["root"].hex() for r in out} == {root} and all(r["folded"] == r["root"] for r in out)
    for r in out[:50]:
        assert [(p["place"], [o.hex() for o in p["others"]]) for p in r["proof"]] == ways[r["doc_id"]]
