"""The pipeline's stages against plain versions, and the queries' registration."""

import zlib
from array import array
from collections import Counter

import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from strata.llm import queries, secrets
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


def test_stages_agree_with_plain_versions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["source"], r["text"]) for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()]
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append(Counter((r["doc_id"], r["source"], r["text"]) for r in docs.collect()))
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())

    rows = [r for r, q in zip(rows, brute.quality(rows)) if q[7]]
    assert kept[0] == Counter(rows)  # no line is in more than 100 of these documents
    stays = {c for _, c, _, _ in brute.near_duplicates([(k, t) for k, _, t in rows])}
    rows = [r for r in rows if r[0] in stays]
    assert kept[1] == Counter(rows)
    scanner = secrets.Scanner()
    rows = [(k, s, secrets.redacted(t, scanner.spans(t)[1], "[SECRET]")) for k, s, t in rows]
    assert kept[2] == Counter(rows)
    assert not any(brute.spans(t, {k: p for k, p in brute.SECRETS.items()}) for _, _, t in rows)

    out = corpus_pipeline.run(spark, SMALL).collect()
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = {}
    for r in sorted(out, key=lambda r: (r["doc_id"], r["piece"])):
        whole.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    assert set(whole) == {k for k, _, _ in rows}
    for key, _, text in rows:
        ids = [*own.encode(text, add_special_tokens=False).ids, queries.END_ID]
        assert [c for _, _, c in whole[key]] == [zlib.crc32(array("I", ids[a : a + n]).tobytes()) for a, n, _ in whole[key]]
        assert sum(n for _, n, _ in whole[key]) == len(ids)
    filled = Counter()
    for r in out:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= queries.SEQUENCE


def test_last_stage_carries_the_sequences(spark):
    docs = spark.createDataFrame([(1, "one two three " * 900), (2, "four"), (3, None)], "doc_id long, text string")
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in sorted(corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect(), key=lambda r: (r["doc_id"], r["piece"])):
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], b"") + r["ids"]
    for key, text in ((1, "one two three " * 900), (2, "four"), (3, "")):
        assert array("I", pieces[key]).tolist() == [*own.encode(text, add_special_tokens=False).ids, queries.END_ID]


def test_all_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 14)} == {x.split("_")[0] + "_" for x in names if x[:2] == "op" and x[2].isdigit()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "secret scans", "best-fit packing"]
