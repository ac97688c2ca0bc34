"""Registered queries of the subpackage: ``opN_<name>`` over whole tables, with production parameters.

The operators have interfaces of their own; the digest columns are derived here.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.llm import bpe, collocations, kneser_ney, line_quality, merkle, ngram_join, packing, pii, secrets, simhash, topk, url_rules, viterbi
from strata.llm.text import count_kind, spans_digest, spans_text

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def importable(spark: SparkSession) -> None:
    """Let the Python workers of this machine import the package from where the driver has it, whatever folder the
    driver was started in. A cluster has it in its image or by ``--py-files``."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [*paths, root]))


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        importable(spark)
        return fn(spark, folder)

    REGISTRY[fn.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_sanitise(spark, folder):
    found = pii.sanitise(table(spark, folder, "documents"), everywhere=True)
    return found.select(
        "doc_id",
        *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in pii.PATTERNS],
        spans_digest(F.col("base")).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


@query
def op2_ngram_join(spark, folder):
    joined = ngram_join.near_duplicates(table(spark, folder, "documents"))
    return joined.select("doc_id", "class_id", "copy_id", "n_links")


@query
def op3_language_model(spark, folder):
    docs = table(spark, folder, "documents")
    model = kneser_ney.train(docs.where(~kneser_ney.held_out(F.col("doc_id"))))
    return kneser_ney.score(docs, model).select(
        "doc_id",
        kneser_ney.held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.words.total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


@query
def op4_quality_rules(spark, folder):
    judged = line_quality.judge(table(spark, folder, "documents"))
    return judged.select("doc_id", *line_quality.COUNTS, "base_failed", "kept", "lost_words")


@query
def op5_byte_bpe(spark, folder):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode_decode(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.octet_length("tokens") / 4).cast("long").alias("n_tokens"),
        F.sha2("tokens", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: The id that ends a document, and the length of a packed sequence.
END_ID, SEQUENCE = 2, 1024


@query
def op6_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID, SEQUENCE)


@query
def op7_secret_scan(spark, folder):
    found = secrets.find_secrets(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in secrets.BASE],
        spans_digest(F.col("base")).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


@query
def op8_token_counts(spark, folder):
    return viterbi.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op9_top_k(spark, folder):
    vectors = table(spark, folder, "embeddings").where(topk.usable(F.col("embedding")))
    vectors = vectors.select("vec_id", topk.scaled(F.col("embedding"), 256).alias("vector"))
    return topk.top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors, k=5)


#: host, path, verdict
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


@query
def op10_url_rules(spark, folder):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, folder, "pages"), rules)


@query
def op11_simhash(spark, folder):
    linked = simhash.near_duplicates(table(spark, folder, "documents"), shingle=3, radius=2)
    return linked.select("doc_id", "fingerprint", "component_id")


@query
def op12_collocations(spark, folder):
    return collocations.phrases(table(spark, folder, "documents"), longest=5, least=100, absorbed_percent=100, top=2000)


LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


@query
def op13_merkle(spark, folder):
    docs = table(spark, folder, "documents")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(changed, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    claimed = [text if c == "text" else F.col(c) for c in LEAF_COLUMNS]
    listed = merkle.manifest(docs, LEAF_COLUMNS, fanout=3, claimed=claimed)
    return listed.select(
        "doc_id",
        *[merkle.hex_text(c).alias(c) for c in ("leaf", "subroot", "root")],
        merkle.proof_digest("proof").alias("proof_sha256"),
        merkle.hex_text("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )
