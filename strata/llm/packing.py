"""Packing tokenized documents into sequences of a fixed length by patterns of few documents.

1. Texts are encoded; documents longer than a sequence are cut into whole sequences, the first piece takes the rest.
2. Every pattern of at most three lengths that fills a sequence exactly is enumerated. Repeat counts are fitted to
   the histogram of lengths by non-negative least squares (projected gradient with momentum) and rounded so that
   no length is used more often than it occurs.
3. The lengths that remain are packed best-fit decreasing, on the histogram.
4. Every piece gets a rank among the pieces of its length: a running total over input partitions plus its place in
   its own. The plan says which ranks of a length go where, so that no task sees more than its own pieces.

The driver holds the histogram (at most ``size`` numbers) and the plan (bounded by the number of patterns,
about size² / 12). Rows are packed as they are: repeated rows and null ids each get a place of their own; a null text is
empty, that is a lone end token. Other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from codecs import charmap_decode
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strata.llm.text import FINE_CHUNK, slices
from strata.session import run_dir

#: Chunks in each of the cache's two generations; longer chunks are never kept. Only speed and memory depend on these.
CACHED, CACHED_CHARS = 350_000, 48
#: The same where a task also holds the ids it writes.
CACHED_WITH_IDS = 150_000
#: Fixed rule of byte-level vocabularies: printable bytes are their own character, the others follow from U+0100.
PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
OTHERS = [b for b in range(256) if b not in PRINTABLE]
BYTE_CHARS = "".join(chr(b if b in PRINTABLE else 0x100 + OTHERS.index(b)) for b in range(256))
#: Latin words and ASCII numbers are one pre-token whatever the Unicode version; the model alone does for them.
ONE_PRE_TOKEN = re.compile(" ?(?:[A-Za-zªµºÀ-ÖØ-öø-ɏ]+|[0-9]+)")
#: Bytes of text encoded at a time.
SLICE = 3 << 19


class Encoder(dict):
    """Ids of chunks seen, as little-endian 32-bit integers; a new chunk is encoded when it is looked up.

    When the dict is full it becomes the older generation, from which chunks come back as they are met again.
    """

    def __init__(self, path: str, cached: int = CACHED):
        super().__init__()
        self.cached = cached
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        return [b"".join(map(self.__getitem__, FINE_CHUNK.findall(text))) for text in texts]

    def __missing__(self, chunk: str) -> bytes:
        if (ids := self.older.get(chunk)) is None:
            if ONE_PRE_TOKEN.fullmatch(chunk):
                own = [t.id for t in self.tokenize(charmap_decode(chunk.encode(), "strict", BYTE_CHARS)[0])]
            else:
                own = self.tokenizer.encode_batch_fast([chunk], add_special_tokens=False)[0].ids
            ids = array("I", own).tobytes()
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= self.cached:  # at every new chunk: one long text may have more of them than are kept
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


@lru_cache(maxsize=1)
def encoder(path: str, cached: int = CACHED) -> Encoder:
    return Encoder(path, cached)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens."""
    first = n if n <= size else n % size or size
    return [(0, first), *((at, size) for at in range(first, n, size))]


def token_pieces(
    df: DataFrame, tokenizer: str, end_id: int, size: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, the task's number ``part``, the piece's
    place ``nth`` among those of its length in that task, and with ``keep_ids`` its token ids.

    To be stored before use, since a task's number is only that of one run.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, nth bigint"
    schema += ", ids binary" if keep_ids else ""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        own = encoder(tokenizer, CACHED_WITH_IDS if keep_ids else CACHED)
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            for rows in slices(batch, SLICE):
                out = []
                texts = [t or "" for t in rows.column(1).to_pylist()]
                for key, ids in zip(rows.column(0).to_pylist(), own.encode(texts)):
                    ids += end
                    for piece, (start, length) in enumerate(cut(len(ids) // 4, size)):
                        own_ids = ids[4 * start : 4 * (start + length)]
                        row = (key, piece, start, length, zlib.crc32(own_ids), part, seen[length])
                        out.append((*row, own_ids) if keep_ids else row)
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def patterns(size: int, most: int = 3) -> np.ndarray:
    """Lengths, longest first, that fill ``size`` exactly: one, two or three of them; 0 stands for none."""
    found = [(size, 0, 0)]
    if most >= 2:
        found += [(size - b, b, 0) for b in range(1, size // 2 + 1)]
    if most >= 3:
        found += [
            (size - b - c, b, c) for c in range(1, size // 3 + 1) for b in range(c, (size - c) // 2 + 1)
        ]
    return np.array(found)


def fit(own: np.ndarray, counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that make the patterns' lengths come nearest to ``counts`` by least squares.

    Accelerated projected gradient; the step is 1 over a bound of the largest eigenvalue, found by power steps.
    """
    n = len(counts)
    used = own > 0

    def lengths(x):
        return sum(np.bincount(own[:, j][used[:, j]], x[used[:, j]], n) for j in range(own.shape[1]))

    def back(r):
        r = r.copy()
        r[0] = 0
        return r[own].sum(axis=1)

    v = np.ones(len(own))
    for _ in range(20):
        w = back(lengths(v))
        v = w / (np.linalg.norm(w) or 1.0)
    step = 1.0 / (1.05 * (np.linalg.norm(back(lengths(v))) or 1.0))
    x = y = np.zeros(len(own))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - step * back(lengths(y) - counts))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def best_fit(left: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing over a histogram: (lengths of a sequence, number of such sequences)."""
    groups: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    free: list[int] = []

    def put(lengths: list[int], n: int) -> None:
        room = size - sum(lengths)
        if room not in groups or not groups[room]:
            insort(free, room)
        groups[room].append((lengths, n))

    for length in sorted(left, reverse=True):
        n = left[length]
        while n > 0:
            at = bisect_left(free, length)
            if at == len(free):  # new sequences; equal lengths go together, as one by one they would
                each = size // length
                if n >= each:
                    put([length] * each, n // each)
                if n % each:
                    put([length] * (n % each), 1)
                break
            room = free[at]
            lengths, there = groups[room].pop()
            if not groups[room]:
                del free[at]
            taken = min(n, there)
            if taken < there:
                put(lengths, there - taken)
            put([*lengths, length], taken)
            n -= taken
    return [g for room in groups.values() for g in room]


#: Fractions of a repeat count that are rounded up, if the lengths are there; the one that gives the fewest sequences is
#: taken. Above 1: none is.
ROUND_UP = (0.05, 0.3, 0.6, 1.1)


def rounded(own: np.ndarray, x: np.ndarray, histogram: dict[int, int], size: int, least: float) -> list[tuple[list[int], int]]:
    """Whole repeat counts, and what they leave packed best-fit: (lengths of a sequence, number of such sequences)."""
    left = {length: n for length, n in histogram.items() if n}
    groups: list[tuple[list[int], int]] = []

    def use(i: int, wanted: int) -> None:
        lengths = [int(v) for v in own[i] if v]
        n = min([wanted, *(left.get(v, 0) // lengths.count(v) for v in lengths)])
        if n > 0:
            groups.append((lengths, n))
            for v in lengths:
                left[v] -= n

    whole = np.flatnonzero(x >= 1)
    for i in whole[np.argsort(-x[whole], kind="stable")]:
        use(i, int(x[i]))
    part = x - np.floor(x)
    more = np.flatnonzero(part >= least)
    for i in more[np.argsort(-part[more], kind="stable")]:
        use(i, 1)
    return groups + best_fit({length: n for length, n in left.items() if n}, size)


def packing_plan(histogram: dict[int, int], size: int, most: int = 3) -> dict[int, np.ndarray]:
    """For every length the ranges of its ranks: columns first rank, first sequence, offset; by first rank.

    The pieces of one range go to successive sequences at the same offset.
    """
    counts = np.zeros(size + 1)
    for length, n in histogram.items():
        counts[length] = n
    own = patterns(size, most)
    own = own[(np.where(own > 0, counts[own], 1) > 0).all(axis=1)]
    x = fit(own, counts) if len(own) else np.zeros(0)
    tries = [rounded(own, x, histogram, size, least) for least in ROUND_UP]
    groups = min(tries, key=lambda g: sum(n for _, n in g))

    ranges: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    sequence = 0
    for lengths, n in groups:
        offset = 0
        for v in lengths:
            ranges[v].append((rank[v], sequence, offset))
            rank[v] += n
            offset += v
        sequence += n
    return {length: np.array(r, dtype=np.int64) for length, r in ranges.items()}


def pack(
    df: DataFrame, tokenizer: str, end_id: int, size: int = 1024, id_col: str = "doc_id", text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset``; see the module's text."""
    spark = df.sparkSession
    folder = run_dir(spark, "packing")
    token_pieces(df, tokenizer, end_id, size, id_col, text_col, keep_ids).write.parquet(folder)
    pieces = spark.read.parquet(folder)

    by_part = pieces.groupBy("part", "length").count()
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = by_part.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    plan = packing_plan(histogram, size)

    ranked = pieces.join(first, ["part", "length"]).withColumn("_rank", F.col("_first") + F.col("nth"))
    out = [f for f in pieces.schema if f.name not in ("part", "nth")]
    schema = StructType([*out, *StructType.fromDDL("sequence_id bigint, offset bigint").fields])
    arrow = to_arrow_schema(schema)

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for own in np.unique(length):
                here = length == own
                rows = plan[int(own)]
                at = np.searchsorted(rows[:, 0], rank[here], "right") - 1
                sequence[here] = rows[at, 1] + rank[here] - rows[at, 0]
                offset[here] = rows[at, 2]
            columns = [batch.column(f.name) for f in out] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays([pc.cast(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return ranked.mapInArrow(place, schema)
