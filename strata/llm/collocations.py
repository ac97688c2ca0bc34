"""Phrase collocations: phrases whose words stand together more often than their parts would by chance.

1. Texts are cut into pieces and words, gathered by language into chunks of bounded size, each with its own dictionary
   (exact words, numbered) and its word numbers.
2. Rabin-Karp: prefix polynomials over the words' hashes give the fingerprint of any run of words by one subtraction. A
   chunk counts its fingerprints of one and two words, and sends the counts, cut by fingerprint into shards, with its number:
   the pointer to where they occur.
3. A shard adds up all chunks' counts, and sends the fingerprints that are frequent in total back to the chunks they point to.
   Equal phrases have equal fingerprints, so a phrase's count is never more than its fingerprint's: no frequent phrase is lost.
4. With those a chunk does the same for longer runs, of which only those count whose pairs of words are all frequent.
5. Each chunk compares all occurrences of a frequent fingerprint with its text, word by word, and writes out the phrases
   and their own counts, again by shard of fingerprint. Adding up these texts tells apart phrases that share a fingerprint. Only
   phrases frequent in total remain; their parts are among them.

A missing or empty text has no words; a missing language is ``und``. Repeated rows count as often as they occur.
Other columns are not read. Without phrases the result is empty.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strata.session import run_dir

#: Bytes of text in a chunk, and in all chunks a task has open.
CHUNK, OPEN = 2 << 20, 12 << 20
#: Counts in a shard, about.
SHARD = 1 << 20
#: Ranking is prepared in so many parts of a language.
PARTS = 64
BREAK = b"."  # no word, since it ends a piece
ENDS = b".,;:!?\n\x0b\x0c\r"
NORMAL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + ENDS, b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(ENDS))

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


# --- chunks -----------------------------------------------------------------------------


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def tokens(text: str) -> list[bytes]:
    """The words, and :data:`BREAK` between pieces."""
    return text.encode().translate(NORMAL).replace(b"\n", b" . ").split()


CHUNKS = "chunk bigint, lang string, n bigint, words binary, ids binary"


def _chunk(number: int, lang: str, texts: list[str]) -> dict:
    flat: list[bytes] = []
    for text in texts:
        flat += tokens(text)
        flat.append(BREAK)
    numbers = Numbers({BREAK: 0})
    ids = np.fromiter(map(numbers.__getitem__, flat), np.uint32, len(flat))
    ids = ids[(ids != 0) | np.r_[True, ids[:-1] != 0][: len(ids)]]  # one break between pieces is enough
    narrow = ids.astype(np.uint16) if len(numbers) <= 1 << 16 else ids
    words = list(numbers)[1:]
    return {"chunk": number, "lang": lang, "n": int((ids != 0).sum()), "words": b" ".join(words), "ids": narrow.tobytes()}


def chunks(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    arrow = to_arrow_schema(StructType.fromDDL(CHUNKS))

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        open_: dict[str, list[str]] = {}
        sizes: dict[str, int] = {}

        def close(lang: str) -> pa.RecordBatch:
            nonlocal number
            number += 1
            del sizes[lang]
            return pa.RecordBatch.from_pylist([_chunk(number, lang, open_.pop(lang))], schema=arrow)

        for batch in batches:
            for lang, text in zip(*(batch.column(i) for i in range(2))):
                lang, text = lang.as_py(), text.as_py()
                open_.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text) + 64
                if sizes[lang] >= CHUNK:
                    yield close(lang)
                elif len(sizes) > 1 and sum(sizes.values()) >= OPEN:
                    yield close(max(sizes, key=sizes.__getitem__))
        for lang in list(open_):
            yield close(lang)

    rows = df.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return rows.where("octet_length(text) > 0").mapInArrow(run, CHUNKS)


class Chunk:
    """A chunk's words and prefix polynomials."""

    def __init__(self, lang: str, words: bytes, ids: bytes):
        self.words = [BREAK, *words.split()]
        self.ids = np.frombuffer(ids, np.uint16 if len(self.words) <= 1 << 16 else np.uint32)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.words), np.uint64, len(self.words))
        n = len(self.ids)
        # prefix[i]: the sum of hash[k] * BASE ** k over k < i, so a run from i is (prefix[i + n] - prefix[i]) * BASE ** -i.
        self.prefix = np.r_[np.uint64(0), np.cumsum(hashes[self.ids] * powers(BASE, n))]
        self.breaks = np.r_[0, np.cumsum(self.ids == 0)]
        self.inverse = powers(INVERSE, n)
        self.seed = xxhash.xxh3_64_intdigest(lang.encode())

    def runs(self, width: int) -> np.ndarray:
        """Where the runs of ``width`` words within a piece begin."""
        n = max(0, len(self.ids) - width + 1)
        return np.flatnonzero(self.breaks[width : width + n] == self.breaks[:n])

    def fingerprints(self, at: np.ndarray, width: int) -> np.ndarray:
        own = (self.prefix[at + width] - self.prefix[at]) * self.inverse[at]
        return mixed(own + np.uint64(self.seed * (2 * width + 1) % (1 << 64)))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        _POWERS[int(base)] = known = np.cumprod(known)
    return known[:n]


def among(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    place = np.searchsorted(sorted_, values)
    place[place == len(sorted_)] = 0
    return sorted_[place] == values


# --- fingerprints in shards -------------------------------------------------------------

COUNTS = "shard bigint, chunk bigint, fps binary, counts binary"


def _counted(number: int, fps: np.ndarray, shards: int) -> Iterator[tuple]:
    """A row for each shard that has some of the fingerprints."""
    fps, counts = np.unique(fps, return_counts=True)
    counts = counts.astype(np.uint32)
    shard = ((fps >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)  # ascends with the fingerprint
    bounds = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(fps) else []
    for a, b in zip(bounds, bounds[1:]):
        yield int(shard[a]), number, fps[a:b].tobytes(), counts[a:b].tobytes()


def pairs_frequent(chunk: Chunk, frequent: np.ndarray) -> np.ndarray:
    """Prefix counts of the places at which a frequent pair of words begins."""
    at = chunk.runs(2)
    hit = np.zeros(len(chunk.ids), np.int64)
    hit[at[among(chunk.fingerprints(at, 2), frequent)]] = 1
    return np.r_[0, np.cumsum(hit)]


def counted(rows: DataFrame, widths: list[int], shards: int) -> DataFrame:
    """Counts of the chunks' fingerprints by shard; with the column ``frequent`` only of runs whose pairs are all in it."""
    arrow = to_arrow_schema(StructType.fromDDL(COUNTS))
    known = "frequent" in rows.columns

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                chunk = Chunk(row["lang"], row["words"], row["ids"])
                good = pairs_frequent(chunk, merged(row["frequent"])) if known else None
                fps = []
                for width in widths:
                    at = chunk.runs(width)
                    if known:
                        at = at[good[at + width - 1] - good[at] == width - 1]
                    fps.append(chunk.fingerprints(at, width))
                out = list(_counted(row["chunk"], np.concatenate(fps), shards))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)

    return rows.mapInArrow(run, COUNTS)


def merged(parts: list[bytes] | None) -> np.ndarray:
    return np.sort(np.frombuffer(b"".join(parts or []), np.uint64))


def in_shards(rows: DataFrame, shards: int) -> DataFrame:
    """A partition for each shard, so that what a task reads does not grow with the corpus."""
    return rows.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard")


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def sent_back(counts: DataFrame, shards: int, least: int) -> DataFrame:
    """``chunk``, ``fps``: the fingerprints with ``least`` occurrences or more in all, for each chunk that has them."""
    schema = "chunk bigint, fps binary"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for _, rows_ in groupby(_rows(batches), itemgetter(0)):
            blocks = [(chunk, np.frombuffer(f, np.uint64), np.frombuffer(c, np.uint32)) for _, chunk, f, c in rows_]
            fps = np.concatenate([f for _, f, _ in blocks])
            order = np.argsort(fps, kind="stable")
            fps = fps[order]
            first = np.flatnonzero(np.r_[True, fps[1:] != fps[:-1]])
            totals = np.add.reduceat(np.concatenate([c for _, _, c in blocks]).astype(np.int64)[order], first)
            frequent = fps[first][totals >= least]
            del fps, order, first, totals
            hits = [(chunk, f[among(f, frequent)].tobytes()) for chunk, f, _ in blocks]
            hits = [h for h in hits if h[1]]
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hits), arrow.types)], schema=arrow)

    return in_shards(counts, shards).mapInArrow(run, schema)


def with_frequent(rows: DataFrame, back: DataFrame) -> DataFrame:
    """The chunks with their frequent fingerprints, as many at most as the chunk has runs of words."""
    own = back.groupBy("chunk").agg(F.collect_list("fps").alias("frequent"))
    return rows.join(own, "chunk")


# --- phrases ----------------------------------------------------------------------------


TEXTS = "shard bigint, lang string, texts binary, counts binary"


def written_out(rows: DataFrame, longest: int, shards: int) -> DataFrame:
    """The phrases behind each chunk's frequent fingerprints, compared with the text, and the chunk's counts of them: a row for
    each shard of fingerprints, its phrases a line each."""
    arrow = to_arrow_schema(StructType.fromDDL(TEXTS))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                chunk, frequent = Chunk(row["lang"], row["words"], row["ids"]), merged(row["frequent"])
                by_shard: dict[int, tuple[list, list]] = {}
                good = None
                for width in range(1, longest + 1):
                    at = chunk.runs(width)
                    if width > 2:
                        at = at[good[at + width - 1] - good[at] == width - 1]
                    fps = chunk.fingerprints(at, width)
                    hit = among(fps, frequent)
                    if width == 2:
                        good = pairs_frequent(chunk, frequent)
                    for fp, words, n in distinct_runs(chunk.ids, at[hit], fps[hit], width):
                        texts, counts = by_shard.setdefault((fp >> 32) * shards >> 32, ([], []))
                        texts.append(b" ".join([chunk.words[w] for w in words]))
                        counts.append(n)
                if by_shard:
                    out = [(s, row["lang"], b"\n".join(t), np.array(n, np.uint32).tobytes()) for s, (t, n) in by_shard.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)

    return rows.mapInArrow(run, TEXTS)


def added_up(texts: DataFrame, shards: int, least: int) -> DataFrame:
    """``lang``, ``phrase``, ``width``, ``a``: the phrases that occur ``least`` times or more in all, by their texts."""
    schema = "lang string, phrase string, width int, a bigint"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for _, rows_ in groupby(_rows(batches), itemgetter(0)):
            totals: dict[str, dict[bytes, int]] = {}
            for _, lang, lines, counts in rows_:
                own = totals.setdefault(lang, defaultdict(int))
                for text, n in zip(lines.split(b"\n"), np.frombuffer(counts, np.uint32).tolist()):
                    own[text] += n
            found = [(lang, t.decode(), t.count(b" ") + 1, n) for lang, own in totals.items() for t, n in own.items() if n >= least]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), arrow.types)], schema=arrow)

    return in_shards(texts, shards).mapInArrow(run, schema)


def distinct_runs(ids: np.ndarray, at: np.ndarray, fps: np.ndarray, width: int) -> Iterator[tuple[int, tuple, int]]:
    """Fingerprint, words and count of the different runs that begin at ``at``; equal fingerprints do not make them equal."""
    order = np.argsort(fps, kind="stable")
    at, fps = at[order], fps[order]
    first = np.flatnonzero(np.r_[True, fps[1:] != fps[:-1]][: len(fps)])
    counts = np.diff(np.r_[first, len(fps)])
    runs = np.stack([ids[at + k] for k in range(width)], axis=1)
    clash = np.zeros(len(first), bool)
    if len(first):
        differs = (runs != np.repeat(runs[first], counts, axis=0)).any(axis=1)
        clash = np.add.reduceat(differs, first, dtype=np.int64) > 0
    yield from zip(fps[first[~clash]].tolist(), map(tuple, runs[first[~clash]].tolist()), counts[~clash].tolist())
    for i in np.flatnonzero(clash).tolist():
        own, many = np.unique(runs[first[i] : first[i] + counts[i]], axis=0, return_counts=True)
        yield from zip([int(fps[first[i]])] * len(own), map(tuple, own.tolist()), many.tolist())


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(17,0)")


def scored(found: DataFrame, totals: DataFrame) -> DataFrame:
    """Every phrase of two words or more with its lowest-scoring cut: ``l``, ``r``, ``score``."""
    words = F.split("phrase", " ")
    cuts = found.where("width > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("width") - 1)))
    cuts = cuts.withColumns(
        {
            "head": F.array_join(F.slice(words, 1, F.col("k")), " "),
            "tail": F.array_join(F.slice(words, F.col("k") + 1, F.col("width") - F.col("k")), " "),
        }
    )
    # A part occurs at least as often as the phrase, so it is among the found.
    part = lambda name, n: found.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).join(totals, "lang")
    # Whole numbers of up to 38 digits; a is at most l and r, so the quotient has no more digits than 1000 * n.
    cuts = cuts.withColumns({"over": F.lit(1000) * big("a") * big("n"), "under": big("l") * big("r")})
    cuts = cuts.withColumn("score", F.expr("over div under"))
    lowest = cuts.groupBy("lang", "phrase", "width", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "width", "a", "n", "cut.l", "cut.r", "cut.score")


def unabsorbed(candidates: DataFrame, percent: int) -> DataFrame:
    """Without those inside a longer one that has at least ``percent`` per cent of their occurrences."""
    words = F.split("phrase", " ")
    inner = candidates.where("width > 2").select(
        "lang", F.col("a").alias("outer"), words.alias("ws"), F.explode(F.sequence(F.lit(2), F.col("width") - 1)).alias("w"), "width"
    )
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("width") - F.col("w") + 1)))
    inner = inner.select("lang", F.array_join(F.slice("ws", F.col("at"), F.col("w")), " ").alias("phrase"), "outer")
    most = inner.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    kept = candidates.join(most, ["lang", "phrase"], "left")
    return kept.where(F.col("outer").isNull() | (100 * big("outer") < percent * big("a"))).drop("outer")


def phrases(
    df: DataFrame, longest: int = 5, least: int = 100, absorbed_percent: int = 100, top: int = 2000,
    text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """Each language's first ``top`` phrases of 2 to ``longest`` words that occur ``least`` times or more.

    A phrase cut after its first k words, which occur l times and the rest r times, scores floor(1000 * a * n / (l * r)), n being
    all words of the language; the lowest cut counts. Phrases inside a longer one of ``absorbed_percent`` of their occurrences are left out.
    Order: score, then a, descending, then the phrase's bytes.
    """
    spark = df.sparkSession
    folder = run_dir(spark, "collocations")

    def stored(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    texts = stored(chunks(df, text_col, lang_col), "chunks")
    totals = stored(texts.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    shards = int(totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) * 2 // SHARD + 1
    short = stored(sent_back(counted(texts, [1, 2], shards), shards, least), "short")
    back = short
    if longest > 2:
        long = sent_back(counted(with_frequent(texts, short), list(range(3, longest + 1)), shards), shards, least)
        back = short.unionByName(stored(long, "long"))
    # Frequent phrases are far fewer than runs of words: a few shards' worth of them fit one.
    few = -(-shards // 8)
    found = stored(added_up(written_out(with_frequent(texts, back), longest, few), few, least), "found")
    candidates = stored(scored(found, totals), "candidates")
    kept = unabsorbed(candidates, absorbed_percent)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of a language are among the first of its parts, so no task sorts a whole language.
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = kept.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order)))
    first = first.where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
