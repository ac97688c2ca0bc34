"""Quality rules over a text's words, and lines that many documents of one host share.

Lines are normalised (lower case, single spaces) and hashed. Per host and line the distinct documents are counted; a
line above the limit is removed from every document of that host but the first one that has it, and a document
that loses too large a share of its words is rejected.

What counts as a document: texts with the same set of lines count once, so that exact copies of one document do
not make its own lines frequent. The first document is that of the least id, so whatever is removed as frequent stays in
the corpus once.

A null text has no words and fails the base rules; a null host is the host ''. Rows equal in id, host and text are one
document and get the same result each. Other columns are not read.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from strata.llm.text import map_columns, map_text, row_hash
from strata.session import run_dir

#: Fixed values of the base rules: ASCII white space parts words; the symbols counted.
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 50, 50, 3
#: Bytes of text whose lines are held as Python objects at a time.
SLICE = 1 << 20


def repeated_words(words: list) -> int:
    """Words within windows of three that occur twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, again = set(), set()
    for w in windows:
        (again if w in seen else seen).add(w)
    total, upto = 0, 0
    for at, w in enumerate(windows):
        if w in again:
            total += at + WINDOW - max(at, upto)
            upto = at + WINDOW
    return total


def _hash(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(text.encode())
    return h - (1 << 64) if h >> 63 else h


def measures(text: str) -> dict:
    """The base rules' numbers, a hash of the set of normalised lines, and of each of them its hash and the words in the
    text's lines like it."""
    words = text.encode().split()  # bytes part at ASCII white space only
    seen: set[str] = set()
    duplicates = 0
    own: dict[int, int] = {}
    for line in text.split("\n"):
        n = len(line.encode().split())
        if not n:
            continue
        duplicates += line in seen
        seen.add(line)
        h = _hash(" ".join(line.lower().split()))
        own[h] = own.get(h, 0) + n
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, SPACES)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": duplicates,
        "n_repeat_words": repeated_words(words),
        "content": _hash(",".join(map(str, sorted(own)))),
        "lines": [{"line": h, "words": n} for h, n in own.items()],
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def measure(df: DataFrame, id_col: str, host_col: str, text_col: str) -> DataFrame:
    def run(keys, ids, hosts, texts):
        found = [measures(t or "") for t in texts]
        out = {"_key": keys, "_id": ids, "_host": [h or "" for h in hosts]}
        return out | {c: [f[c] for f in found] for c in (*COUNTS, "content", "lines")}

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"_key bigint, _id {kind}, _host string, {', '.join(f'{c} bigint' for c in COUNTS)}, "
    schema += "content bigint, lines array<struct<line: bigint, words: bigint>>"
    columns = [row_hash(id_col, host_col, text_col), F.col(id_col), F.col(host_col).cast("string"), F.col(text_col)]
    return map_columns(df.select(*columns), run, schema, SLICE)


def frequent_lines(lines: DataFrame, limit: int) -> DataFrame:
    """``_host``, ``line``, ``_first`` (the document that keeps it) of lines in more than ``limit`` documents."""
    documents = lines.groupBy("_host", "line", "content").agg(F.min(F.struct("_id", "_key")).alias("_first"))
    counted = documents.groupBy("_host", "line").agg(F.count(F.lit(1)).alias("_n"), F.min("_first").alias("_first"))
    return counted.where(F.col("_n") > limit).select("_host", "line", F.col("_first._key").alias("_first"))


def judge(
    df: DataFrame, limit: int = 100, keep_percent: int = 30, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """Per row of ``df``: ``_key`` (of id, host and text), the id, the base rules' numbers, ``base_failed``, ``kept``,
    ``lost_words`` and ``removed`` (hashes of the lines to remove).

    ``limit`` is the number of documents per host a line may be in; a document is kept if it passes the base rules
    and ``keep_percent`` of its words remain.
    """
    spark = df.sparkSession
    folder = run_dir(spark, "line-quality")
    measure(df, id_col, host_col, text_col).write.parquet(f"{folder}/measured")
    measured = spark.read.parquet(f"{folder}/measured")
    lines = measured.select("_key", "_id", "_host", "content", F.inline("lines"))
    # Stored, so that the join below meets plain exchanges: a line shared by a third of all rows is split there.
    frequent_lines(lines, limit).write.parquet(f"{folder}/frequent")
    frequent = spark.read.parquet(f"{folder}/frequent")
    hits = lines.select("_key", "_host", "line", "words").join(frequent, ["_host", "line"])
    hits = hits.where(F.col("_key") != F.col("_first"))
    lost = hits.groupBy("_key").agg(F.collect_set(F.struct("line", "words")).alias("_lost"))
    words = F.aggregate("_lost", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    lost = lost.select("_key", words.alias("lost_words"), F.col("_lost.line").alias("removed"))
    out = measured.drop("lines", "content", "_host").join(lost, "_key", "left")
    lost_words = F.coalesce("lost_words", F.lit(0).cast("long"))
    enough = 100 * (F.col("n_words") - lost_words) >= keep_percent * F.col("n_words")
    return out.select(
        "_key",
        F.col("_id").alias(id_col),
        *COUNTS,
        base_failed().alias("base_failed"),
        (~base_failed() & enough).alias("kept"),
        lost_words.alias("lost_words"),
        F.coalesce("removed", F.array().cast("array<bigint>")).alias("removed"),
    )


def without_lines(text: str, removed: set[int]) -> str:
    """The text without the lines whose normalised hash is in ``removed``."""
    return "\n".join(line for line in text.split("\n") if _hash(" ".join(line.lower().split())) not in removed)


def cleaned(
    df: DataFrame, limit: int = 100, keep_percent: int = 30, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """The rows of ``df`` that are kept, all columns, their frequent lines removed from the text."""
    verdicts = judge(df, limit, keep_percent, id_col, host_col, text_col).where("kept")
    verdicts = verdicts.groupBy("_key").agg(F.first("removed").alias("_removed"))
    rows = df.select(F.struct("*").alias("_row"), row_hash(id_col, host_col, text_col).alias("_key"))
    rows = rows.join(verdicts, "_key").select("_row", "_removed")

    def without(text, removed):
        return text if text is None or not removed else without_lines(text, set(removed))

    return map_text(rows, df.schema, text_col, without, "_removed")
