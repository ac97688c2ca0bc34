"""Near-duplicate texts: a Jaccard self-join on sets of word n-grams.

1. Each text gives its set of n-gram hashes, a hash of the whole set (equal sets are copies: one class) and a MinHash
   signature cut into bands. Bands and rows follow from the threshold and the wanted recall (:func:`choose_bands`).
2. Classes that share a band hash are candidates. They meet on the hash as a star around the bucket's least class, so
   rows grow with the classes, not with their pairs.
3. Candidates connected by stars are verified together on full n-gram sets: every pair of a connected group is
   compared as bitmaps within one task; a group too large for that is cut into blocks, and pairs of blocks are tasks.
   Tasks return, per class, the number of links and one link that connects it, never the pairs.
4. Linked classes form groups.

A text with fewer words than n, but at least one, has one n-gram of all its words. A text without words (or null) has
an empty set; such texts are copies of each other and link to nothing. Rows that repeat id and text are copies.
Words are runs of characters other than ASCII white space, compared as they are. n-grams are told apart by 64-bit
hashes. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strata.llm.components import components
from strata.llm.text import map_columns, row_hash
from strata.session import run_dir

#: Words a worker remembers, and bytes of text hashed at a time. Only speed and memory depend on these.
CACHED, SLICE = 300_000, 1 << 20
#: Classes and n-grams in a block of a group under verification.
BLOCK_CLASSES, BLOCK_GRAMS = 1024, 1 << 19
MIX = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float, recall: float = 0.9999, low: float = 0.3, most: float = 0.01) -> tuple[int, int]:
    """(bands, rows): the fewest hashes with which pairs at the threshold meet with probability ``recall`` or more, and
    pairs at ``low`` with ``most`` or less."""
    best = None
    for rows in range(1, 33):
        bands = math.ceil(math.log1p(-recall) / math.log1p(-(threshold**rows)))
        if 1 - (1 - low**rows) ** bands <= most and (best is None or bands * rows < best[0] * best[1]):
            best = bands, rows
    if best is None:
        raise ValueError("no band layout within 32 rows meets these rates")
    return best


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


WORDS = WordHashes()


def gram_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted n-gram hashes of every text one after another, and where each text's begin (and the end)."""
    flat: list[bytes] = []
    sizes = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = (text or "").encode().split()
        sizes[i] = len(words)
        flat += words
    hashes = np.fromiter(map(WORDS.__getitem__, flat), np.uint64, len(flat))
    first = np.cumsum(np.r_[0, sizes])
    text = np.repeat(np.arange(len(texts)), sizes)
    grams, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
    for width in range(1, n + 1):  # narrower ones only for texts of so many words
        at = np.arange(max(0, len(flat) - width + 1))
        whole = sizes[text[at]] == width if width < n else sizes[text[at]] >= n
        at = at[whole & (at + width <= first[text[at] + 1])]
        h = np.full(len(at), width, np.uint64)
        for k in range(width):
            h = h * MIX + hashes[at + k]
        grams, owner = np.r_[grams, mixed(h)], np.r_[owner, text[at]]
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.r_[True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])][: len(grams)]
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(len(texts) + 1))


def signatures(grams: np.ndarray, first: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every set (0 of the empty one), and the band hashes, of those that are not empty."""
    full = np.flatnonzero(np.diff(first))
    whole = np.zeros(len(first) - 1, np.uint64)
    out = np.empty((len(full), bands), np.uint64)
    if len(full):
        starts = first[full]
        whole[full] = mixed(np.add.reduceat(mixed(grams), starts) + MIX * np.diff(first)[full].astype(np.uint64))
        seeds = mixed(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * MIX)
        for band in range(bands):
            h = np.full(len(full), band, np.uint64)
            for row in range(rows):
                k = 2 * (band * rows + row)
                least = np.minimum.reduceat((grams ^ seeds[k]) * (seeds[k + 1] | np.uint64(1)), starts)
                h = mixed(h * MIX + least)
            out[:, band] = h
    return whole, out


def sign(df: DataFrame, n: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """``_key``, ``_id``, ``class``, ``grams`` (size of the set), ``bands`` per row."""

    def run(keys, ids, texts):
        grams, first = gram_sets(texts, n)
        whole, hashes = signatures(grams, first, bands, rows)
        sizes = np.diff(first)
        own = iter(hashes.view(np.int64).tolist())
        return {
            "_key": keys, "_id": ids, "class": whole.view(np.int64), "grams": sizes,
            "bands": [next(own) if size else [] for size in sizes],
        }

    kind = df.schema[id_col].dataType.simpleString()
    columns = df.select(row_hash(id_col, text_col), id_col, text_col)
    return map_columns(columns, run, f"_key bigint, _id {kind}, class bigint, grams bigint, bands array<bigint>", SLICE)


def candidate_stars(classes: DataFrame) -> DataFrame:
    """Edges ``a``, ``b``: every class with the least class of each band bucket it is in."""
    banded = classes.select("class", F.explode("bands").alias("hash"))
    buckets = banded.groupBy("hash").agg(F.min("class").alias("least"), F.count(F.lit(1)).alias("_n"))
    buckets = buckets.where(F.col("_n") > 1).drop("_n")
    stars = banded.join(buckets, "hash").where(F.col("class") != F.col("least"))
    return stars.select(F.col("class").alias("a"), F.col("least").alias("b")).distinct()


# --- verification -----------------------------------------------------------------------


def linked(sets: list[np.ndarray], side: np.ndarray | None, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Links per set, and for each set the place of the least set connected to it, among the pairs to compare: those of
    different sides, none if a side is empty; all without sides."""
    if side is not None and (side.all() or not side.any()):
        return np.zeros(len(sets), np.int64), np.arange(len(sets))
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    grams = np.concatenate(sets)
    _, place, count = np.unique(grams, return_inverse=True, return_counts=True)
    shared = count > 1  # other n-grams are in no intersection
    column = (np.cumsum(shared) - 1)[place]
    owner = np.repeat(np.arange(n), sizes)
    keep = shared[place]
    bits = np.zeros((n, max(1, -(-int(shared.sum()) // 64))), np.uint64)
    np.bitwise_or.at(bits, (owner[keep], column[keep] // 64), np.uint64(1) << (column[keep] % 64).astype(np.uint64))

    order = np.argsort(sizes, kind="stable")
    by_size = sizes[order]
    bits = bits[order]
    own_side = None if side is None else side[order]
    up, down = threshold.denominator, threshold.numerator
    links, root = np.zeros(n, np.int64), np.arange(n)
    # A pair at the threshold has sizes at most 1 / threshold apart.
    until = np.searchsorted(by_size * down, by_size * up, "right")
    step = max(1, (1 << 21) // bits.shape[1])
    for i in range(n):
        for a in range(i + 1, int(until[i]), step):
            b = min(a + step, int(until[i]))
            both = np.bitwise_count(bits[a:b] & bits[i]).sum(axis=1, dtype=np.int64)
            hit = up * both >= down * (by_size[a:b] + by_size[i] - both)
            if own_side is not None:
                hit &= own_side[a:b] != own_side[i]
            if not hit.any():
                continue
            j = a + np.flatnonzero(hit)
            links[i] += len(j)
            links[j] += 1
            joined = np.unique(np.r_[root[i], root[j]])
            if len(joined) > 1:
                root[np.isin(root, joined)] = joined[0]
    out_links, out_root = np.empty_like(links), np.empty_like(root)
    out_links[order] = links
    out_root[order] = order[root]
    return out_links, out_root


def _groups(batches, columns: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Neighbouring rows with equal first ``columns`` values."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:columns] != key:
                if rows:
                    yield key, rows
                key, rows = row[:columns], []
            rows.append(row[columns:])
    if rows:
        yield key, rows


def verify(members: DataFrame, texts: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """``class``, ``links``, ``to`` (a class it is connected with, itself if none), a row per pair of blocks the class is in.

    ``members``: group, class, ``_key`` of the row with its text, grams; ``texts``: ``_key``, ``_text``.
    """
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("_n"), F.sum("grams").alias("_grams"))
    blocks = F.greatest(F.ceil(F.col("_n") / BLOCK_CLASSES), F.ceil(F.col("_grams") / BLOCK_GRAMS))
    members = members.join(sizes.select("group", blocks.cast("int").alias("blocks")), "group")

    def extract(groups, classes, blocks, texts_):
        grams, first = gram_sets(texts_, n)
        sets = [grams[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
        return {"group": groups, "class": classes, "blocks": blocks, "set": sets}

    # Members grow with the corpus: merged whatever their size, so that small inputs run the plan of large ones.
    rows = members.hint("merge").join(texts, "_key").select("group", "class", "blocks", "_text")
    rows = map_columns(rows, extract, "group bigint, class bigint, blocks int, set binary", SLICE)
    own = F.pmod(F.xxhash64("class"), "blocks").cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "class", "own", "set"
    )
    rows = rows.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "class")
    schema = "class bigint, links bigint, to bigint"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for (_, i, j), members_ in _groups(batches, 3):
            distinct = {c: (own != i, raw) for c, own, raw in members_}  # a row may repeat
            classes = np.array(list(distinct), np.int64)
            side = np.array([s for s, _ in distinct.values()]) if i != j else None
            links, root = linked([np.frombuffer(raw, np.uint64) for _, raw in distinct.values()], side, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(classes), pa.array(links), pa.array(classes[root])], schema=arrow)

    return rows.mapInArrow(run, schema)


def near_duplicates(
    df: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: ``_key`` (of id and text), the id, ``copy_id`` (the least id among equal sets), ``class_id`` (the least
    id among all texts connected by links), ``n_links`` (different n-gram sets at the threshold or above) and
    ``first`` (the row, of least id and key, that stands for the class)."""
    spark = df.sparkSession
    folder = run_dir(spark, "ngram-join")
    bands, rows = choose_bands(threshold, recall)

    def stored(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    signed = stored(sign(df, n, bands, rows, id_col, text_col), "signed")
    least = F.min(F.struct("_id", "_key")).alias("least")
    classes = stored(signed.groupBy("class").agg(least, F.first("grams").alias("grams"), F.first("bands").alias("bands")), "classes")
    candidates = components(stored(candidate_stars(classes), "stars"), f"{folder}/candidates")
    members = candidates.select(F.col("node").alias("class"), F.col("label").alias("group")).join(classes, "class")
    members = stored(members.select("group", "class", F.col("least._key").alias("_key"), "grams"), "members")
    texts = df.select(row_hash(id_col, text_col).alias("_key"), F.col(text_col).alias("_text"))
    verified = stored(verify(members, texts, n, Fraction(str(threshold))), "verified")

    links = verified.groupBy("class").agg(F.sum("links").alias("n_links"))
    bonds = verified.where(F.col("class") != F.col("to")).select(F.col("class").alias("a"), F.col("to").alias("b")).distinct()
    groups = components(stored(bonds, "bonds"), f"{folder}/groups")
    groups = groups.select(F.col("node").alias("class"), F.col("label").alias("group"))
    own = classes.select("class", "least").join(groups, "class", "left").join(links, "class", "left")
    own = own.withColumn("group", F.coalesce("group", "class"))
    firsts = own.groupBy("group").agg(F.min("least").alias("first"))
    own = stored(own.join(firsts, "group").select("class", "least", "first", "n_links"), "own")
    return signed.select("_key", "_id", "class").join(own, "class").select(
        "_key",
        F.col("_id").alias(id_col),
        F.col("least._id").alias("copy_id"),
        F.col("first._id").alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        (F.col("first._key") == F.col("_key")).alias("first"),
    )


def one_of_each(
    df: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``df``, all columns, with one row of every class."""
    kept = near_duplicates(df, threshold, n, recall, id_col, text_col).where("first").select("_key").distinct()
    rows = df.select(F.struct("*").alias("_row"), row_hash(id_col, text_col).alias("_key"))
    return rows.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select("_row.*")
