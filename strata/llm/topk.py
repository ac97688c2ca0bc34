"""Exact top-k search by inner product with a uniform threshold in three phases.

Vectors are cut into m slices of components, and a pair's score is the sum of its m partial scores. A task holds one slice of
some candidates and meets the queries' same slice, so what it computes is a list of partial scores, local to the slice.

1. Of every list only the best k entries of each query are gathered. These few candidates are scored in full; the k-th best of
   them is a score that k candidates reach: the safe cutoff, sent back to the tasks with the queries.
2. A candidate that reaches the cutoff has, in one slice at least, cutoff / m or more. Each task sends the entries at or
   above that. An entry known in all slices has its score by adding up; one whose known scores and the bound for the unknown ones
   stay below the cutoff falls away.
3. The missing scores of those left are resolved exactly, and the best k of all stay.

Candidates are dealt to as many groups as the session has shuffle partitions, and each query goes once to each group, however many
candidates it holds. Only pairs at or above the cutoff / m leave a task; no list is sent whole.

Scores are integers and exact as long as they fit 64 bits. Vectors that are null or hold null, NaN or infinite components take no part;
shorter vectors count as padded with zeros. Ids that are null take no part. A query's own row is known by its id, so rows that repeat an
id are no candidates for it; repeated queries are answered each; repeated candidates count each. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strata.session import run_dir

CANDIDATES, QUERIES = 4096, 512
BLOCK = "slice int, first bigint, ids binary, vectors binary, width int, bound double"
ENTRY = "q bigint, query_id bigint, c bigint, vec_id bigint, slice int, part bigint"


def scaled(vector: Column, scale: int) -> Column:
    """Components as whole numbers: floor(scale * x), x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def blocks(df: DataFrame, rows: int, width: int, slices: int) -> DataFrame:
    """A row for each slice of at most ``rows`` of (id, vector): ids, and the slice's matrix as 64-bit integers.

    ``first`` numbers the block's rows: the task, then the place.
    """
    arrow = to_arrow_schema(StructType.fromDDL(BLOCK))
    cuts = np.array_split(np.arange(width), slices)

    def run(batches):
        first = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        vectors: list[list[int]] = []

        def packed():
            nonlocal first
            matrix = np.zeros((len(vectors), width), "<i8")
            for row, v in zip(matrix, vectors):
                row[: len(v)] = v
            raw = np.array(ids, "<i8").tobytes()
            for at, cut in enumerate(cuts):
                part = matrix[:, cut]
                values = at, first, raw, part.tobytes(), len(cut), float(np.abs(part.astype(float)).max(initial=0))
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow)], schema=arrow)
            first += len(ids)
            ids.clear()
            vectors.clear()

        for batch in batches:
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(key)
                vectors.append(vector)
                if len(ids) == rows:
                    yield from packed()
        if ids:
            yield from packed()

    return df.mapInArrow(run, BLOCK)


def matrix(raw: bytes, width: int, exact_as_double: bool) -> np.ndarray:
    m = np.frombuffer(raw, "<i8").reshape(-1, width) if width else np.zeros((0, 0), "<i8")
    return m.astype(float) if exact_as_double else m


class Meeting:
    """The partial scores of a block of queries and a block of candidates in one slice."""

    def __init__(self, row: dict):
        self.q_ids, self.c_ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
        self.q_first, self.c_first, self.slice = row["q_first"], row["first"], row["slice"]
        # Whole numbers that doubles hold exactly are multiplied as doubles.
        small = row["q_bound"] * row["bound"] * max(row["width"], 1) < 2**53
        if row["width"]:
            q, c = matrix(row["q_vectors"], row["width"], small), matrix(row["vectors"], row["width"], small)
            self.part = q @ c.T
        else:
            self.part = np.zeros((len(self.q_ids), len(self.c_ids)))
        self.other = self.q_ids[:, None] != self.c_ids[None, :]

    def best(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of each query's ``k`` best entries in this slice."""
        part = np.where(self.other, self.part, -np.inf if self.part.dtype == float else np.iinfo(np.int64).min)
        n = min(k, part.shape[1])
        top = np.argpartition(-part if part.dtype == float else ~part, n - 1, axis=1)[:, :n]
        q = np.repeat(np.arange(len(part)), n)
        keep = self.other[q, top.ravel()]
        return q[keep], top.ravel()[keep]

    def reaching(self, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries at or above each query's share."""
        return np.nonzero((self.part >= share[:, None]) & self.other)

    def entries(self, q: np.ndarray, c: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
        part = self.part[q, c].astype(np.int64)
        columns = q + self.q_first, self.q_ids[q], c + self.c_first, self.c_ids[c], np.full(len(q), self.slice, np.int32), part
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, schema.types)], schema=schema)


def meetings(pairs: DataFrame, work) -> DataFrame:
    """The entries that ``work(meeting, row)`` chooses, of every pair of blocks."""
    schema = to_arrow_schema(StructType.fromDDL(ENTRY))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                meeting = Meeting(row)
                yield meeting.entries(*work(meeting, row), schema)

    return pairs.mapInArrow(run, ENTRY)


def resolved(pairs: DataFrame, q: DataFrame, c: DataFrame) -> DataFrame:
    """``q``, ``query_id``, ``c``, ``vec_id``, ``score``: the whole scores of chosen pairs; ``q`` and ``c`` have the vectors by row."""
    own = pairs.join(c.withColumnRenamed("row", "c").withColumnRenamed("vector", "_c"), "c")
    own = own.join(q.withColumnRenamed("row", "q").withColumnRenamed("vector", "_q"), "q")
    products = F.zip_with("_q", "_c", lambda a, b: F.coalesce(a, F.lit(0)) * F.coalesce(b, F.lit(0)))
    score = F.aggregate(products, F.lit(0).cast("bigint"), lambda total, x: total + x)
    return own.select("q", "query_id", "c", "vec_id", score.alias("score"))


def vectors_by_row(parts: DataFrame) -> DataFrame:
    """``row`` and ``vector`` of all rows of the stored blocks, put together from their slices."""
    arrow = to_arrow_schema(StructType.fromDDL("row bigint, slice int, part array<bigint>"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["ids"]) // 8
                own = matrix(row["vectors"], row["width"], False) if row["width"] else np.zeros((n, 0), "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(n) + row["first"]), pa.array([row["slice"]] * n, pa.int32()), pa.array(own.tolist(), arrow.types[2])],
                    schema=arrow,
                )

    rows = parts.select("first", "slice", "ids", "vectors", "width").mapInArrow(run, "row bigint, slice int, part array<bigint>")
    slices = F.sort_array(F.collect_list(F.struct("slice", "part")))
    return rows.groupBy("row").agg(F.flatten(F.transform(slices, lambda s: s["part"])).alias("vector"))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, slices: int = 2) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the ``k`` best candidates of every query.

    Both frames have an id and a vector (array of whole numbers) in this order.
    """
    spark = queries.sparkSession
    folder = run_dir(spark, "top-k")

    def stored(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    ready = [df.where(F.col(df.columns[0]).isNotNull() & F.col(df.columns[1]).isNotNull()) for df in (queries, candidates)]
    longest = [df.agg(F.coalesce(F.max(F.size(df.columns[1])), F.lit(0))).first()[0] for df in ready]
    width = max(1, *longest)
    slices = min(slices, width)
    q_parts = stored(blocks(ready[0], QUERIES, width, slices), "q")
    c_parts = stored(blocks(ready[1], CANDIDATES, width, slices), "c")
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    c = c_parts.withColumn("group", F.pmod(F.xxhash64("first"), F.lit(groups)).cast("int"))
    q = q_parts.select("slice", *[F.col(x).alias(f"q_{x}") for x in ("first", "ids", "vectors", "width", "bound")])

    def pairs(q: DataFrame) -> DataFrame:
        spread = q.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        # Merged, never broadcast: the blocks are far larger than what Spark takes them for.
        return spread.hint("merge").join(c, ["slice", "group"])

    def ranked(df: DataFrame, by: list[str], score: str) -> DataFrame:
        order = W.partitionBy(*by).orderBy(F.desc(score), "vec_id", "c")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    # Phase 1: the lists' best entries, and the cutoff their whole scores give.
    heads = ranked(meetings(pairs(q), lambda meeting, _: meeting.best(k)), ["q", "slice"], "part")
    leaders = stored(heads.select("q", "query_id", "c", "vec_id").distinct(), "leaders")
    q_rows, c_rows = (stored(vectors_by_row(p), n) for p, n in ((q_parts, "q-rows"), (c_parts, "c-rows")))
    lead = stored(resolved(leaders, q_rows, c_rows), "lead")
    cutoffs = ranked(lead, ["q"], "score").where(F.col("rank") == k).select("q", F.col("score").alias("cutoff"))
    cutoffs = stored(cutoffs, "cutoffs")

    # Phase 2: every block of queries takes its cutoffs along; without one, fewer than k candidates are known and all entries are sent.
    rows = q_parts.where("slice = 0").select(
        F.col("first").alias("q_first"), F.explode(F.sequence(F.lit(0), F.expr("octet_length(ids) div 8 - 1"))).alias("at")
    )
    rows = rows.withColumn("q", F.col("q_first") + F.col("at")).join(cutoffs, "q", "left")
    limits = rows.groupBy("q_first").agg(F.sort_array(F.collect_list(F.struct("at", "cutoff"))).alias("limits"))
    armed = q.join(stored(limits.select("q_first", "limits.cutoff"), "limits"), "q_first")
    sent = stored(meetings(pairs(armed), lambda meeting, row: meeting.reaching(shares(row["cutoff"], slices))), "sent")
    known = sent.groupBy("q", "query_id", "c", "vec_id").agg(F.sum("part").alias("part"), F.count(F.lit(1)).alias("known"))
    known = known.join(cutoffs, "q", "left")
    # Each unknown slice is below its share, cutoff / m.
    hopeless = F.col("part") * slices + (slices - F.col("known")) * F.col("cutoff") < F.col("cutoff") * slices
    known = stored(known.where(~F.coalesce(hopeless, F.lit(False))), "known")

    # Phase 3: what is missing.
    whole = known.where(F.col("known") == slices).select("q", "query_id", "c", "vec_id", F.col("part").alias("score"))
    missing = known.where(F.col("known") < slices).select("q", "query_id", "c", "vec_id")
    final = ranked(whole.unionByName(resolved(missing, q_rows, c_rows)), ["q"], "score")
    return final.select("query_id", "rank", "vec_id", "score")


def shares(cutoffs: list[int | None], slices: int) -> np.ndarray:
    """The least partial score that counts, per query: the cutoff's share rounded up, so that a whole number reaches it if and only if it
    reaches the share."""
    return np.array([-np.inf if c is None else float(-(-c // slices)) if abs(c) < 2**52 else np.floor(c / slices) - 2.0**12 for c in cutoffs])
