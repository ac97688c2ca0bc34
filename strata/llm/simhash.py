"""SimHash near-duplicates: fingerprints within a Hamming radius, found in BK-trees, and their connected components.

1. A text's fingerprint has a bit set where over half of its shingles' hashes have it. Equal fingerprints are one from here on.
2. Shards: fingerprints within ``radius`` bits are equal in at least one of ``radius + 1`` parts, so each is put in one
   shard per part. A shard with more than ``TREE`` members is cut again by the bits not used yet, until it fits;
   with 14 bits left it has to, since its members differ. No pair within the radius is lost.
3. A shard's members form a BK-tree: a child hangs under its parent by their integer Hamming distance. The tree, whose
   size is thereby bounded, is sent whole to every task that holds a block of its shard's queries, and a search at
   distance d from a node follows only the edges from d - radius to d + radius.
4. A task returns a forest that connects what its queries found, not the pairs; the forests' components are the result.

Words are runs of characters other than ASCII white space, A-Z lower-cased. A text with fewer words than a shingle is one shingle;
texts without words (or null) have fingerprint zero and are linked like any other. Repeated rows stay; a missing id
never names a component unless all its ids are missing. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strata.llm.components import components
from strata.llm.text import map_columns
from strata.session import run_dir

#: Members of a tree, and of a block of its queries.
TREE, QUERIES = 1 << 14, 1 << 12
#: Pairs of query and node that a search holds at a time.
FRONTIER = 1 << 20
SEED = 42
SLICE = 1 << 20
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


# --- fingerprints -----------------------------------------------------------------------


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    words = (text or "").encode().translate(LOWER).split()
    if len(words) <= shingle:
        whole = [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
        return np.array(whole, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, len(words) - shingle + 1)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << bit for bit in np.flatnonzero(2 * counts > len(hashes)).tolist())


def fingerprints(df: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """``_id`` and ``fp``, the fingerprint as a signed integer."""

    def run(ids, texts):
        found = [majority(shingle_hashes(t, shingle)) for t in texts]
        return {"_id": ids, "fp": np.array(found, np.uint64).view(np.int64)}

    kind = df.schema[id_col].dataType.simpleString()
    return map_columns(df.select(id_col, text_col), run, f"_id {kind}, fp bigint", SLICE)


# --- shards -----------------------------------------------------------------------------


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def cut(free: int, parts: int) -> list[int]:
    """``parts`` masks that share out the bits of ``free`` evenly."""
    bits = [b for b in range(64) if free >> b & 1]
    bounds = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << b for b in bits[i:j]) for i, j in zip(bounds, bounds[1:])]


def shards(distinct: DataFrame, radius: int, folder: str, most: int) -> DataFrame:
    """``shard`` and ``fp``: the members of all shards of 2 to ``most`` fingerprints; shards above are cut by further bits.

    With ``radius`` bits left all members are near each other and no cut is possible; there are ``2 ** radius`` of them at most.
    """
    if most < 2**radius:
        raise ValueError(f"shards of {most} cannot be told apart within {radius} bits")
    spark = distinct.sparkSession
    rows, free, turn, out = distinct.select("fp", F.lit(0).cast("long").alias("shard"), F.lit(-1).cast("long").alias("free")), {(1 << 64) - 1}, 0, []
    while True:
        # Masks by what is left of the bits: at most 3 ** turn for radius 2, and few turns.
        masks = {f: cut(f, radius + 1) for f in free}
        entries = [x for f, own in masks.items() for x in (F.lit(signed(f)), F.array(*[F.lit(signed(m)) for m in own]))]
        dealt = rows.withColumn("part", F.explode(F.create_map(*entries)[F.col("free")]))
        dealt = dealt.select(
            "fp",
            F.xxhash64("shard", "part", F.col("fp").bitwiseAND(F.col("part"))).alias("shard"),
            F.col("free").bitwiseAND(F.bitwise_not("part")).alias("free"),
        )
        dealt.write.parquet(f"{folder}/{turn}")
        dealt = spark.read.parquet(f"{folder}/{turn}")
        sizes = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = dealt.join(sizes, "shard")
        out.append(sized.where(F.col("n") <= most).select("shard", "fp"))
        rows = sized.where(F.col("n") > most).select("fp", "shard", "free")
        if rows.isEmpty():
            break
        free, turn = {f & ~m for f, own in masks.items() for m in own}, turn + 1
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


# --- BK-trees ---------------------------------------------------------------------------


def grow(members: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent and edge (Hamming distance to the parent) of every member of a forest; a root is its own parent.

    ``roots``: per member the place of its tree's root. All trees grow a level at a time: of the members still waiting
    below a node at the same distance, the first becomes the child, the others wait below it.
    """
    n = len(members)
    up, edge = np.arange(n), np.zeros(n, np.int64)
    waiting = np.flatnonzero(roots != np.arange(n))
    below = roots[waiting]
    while len(waiting):
        apart = np.bitwise_count(members[waiting] ^ members[below]).astype(np.int64)
        order = np.lexsort((waiting, apart, below))
        waiting, below, apart = waiting[order], below[order], apart[order]
        first = np.r_[True, (below[1:] != below[:-1]) | (apart[1:] != apart[:-1])]
        child = waiting[first]
        up[child], edge[child] = below[first], apart[first]
        head = child[np.cumsum(first) - 1]
        rest = ~first
        waiting, below = waiting[rest], head[rest]
    return up, edge


def search(members: np.ndarray, up: np.ndarray, edge: np.ndarray, queries: np.ndarray, starts: np.ndarray, radius: int):
    """(query, member) places of all pairs within the radius; ``starts`` has the root each query begins at."""
    n = len(members)
    child = np.flatnonzero(up != np.arange(n))
    key = up[child] * 65 + edge[child]
    order = np.argsort(key)
    child, key = child[order], key[order]
    found = []
    for at in range(0, len(queries), max(1, FRONTIER // 64)):
        stack = [(queries[at : at + FRONTIER // 64], starts[at : at + FRONTIER // 64])]
        while stack:
            who, node = stack.pop()
            apart = np.bitwise_count(members[who] ^ members[node]).astype(np.int64)
            hit = apart <= radius
            found.append((who[hit], node[hit]))
            low = np.searchsorted(key, node * 65 + np.maximum(apart - radius, 0), "left")
            high = np.searchsorted(key, node * 65 + np.minimum(apart + radius, 64), "right")
            many = high - low
            next_ = np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            who, node = np.repeat(who, many), child[next_]
            stack += [(who[i : i + FRONTIER], node[i : i + FRONTIER]) for i in range(0, len(who), FRONTIER)]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([w for w, _ in found]), np.concatenate([m for _, m in found])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per place the least place it is connected with by the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _tree(shards_: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Members, roots, parents and edges of several shards' trees in one forest."""
    members = np.concatenate(shards_)
    sizes = np.array([len(s) for s in shards_])
    roots = np.repeat(np.cumsum(sizes) - sizes, sizes)
    return members, roots, *grow(members, roots)


def trees(members: DataFrame) -> DataFrame:
    """A row per shard: its members, and each one's parent (a place in the row) and edge, as bytes."""
    rows = members.groupBy("shard").agg(F.sort_array(F.collect_list("fp")).alias("fps"))

    def build(fps):
        if not fps:
            return {"fps": [], "up": [], "edge": []}
        own = [np.array(f, np.int64).view(np.uint64) for f in fps]
        flat, roots, up, edge = _tree(own)
        ends = np.cumsum([len(s) for s in own])[:-1]
        cut_ = lambda x: [p.tobytes() for p in np.split(x, ends)]
        return {
            "fps": cut_(flat), "up": cut_((up - roots).astype(np.int32)), "edge": cut_(edge.astype(np.int8)),
        }

    return map_columns(rows.select("fps"), build, "fps binary, up binary, edge binary", SLICE)


def linked(tree_rows: DataFrame, radius: int) -> DataFrame:
    """Edges ``a``, ``b`` that connect the fingerprints within the radius of each other in some shard."""
    schema = "a bigint, b bigint"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    # Every block of a shard's queries gets the shard's tree.
    blocks = F.sequence(F.lit(0), F.expr(f"(octet_length(fps) div 8 - 1) div {QUERIES}"))
    dealt = tree_rows.withColumn("block", F.explode(blocks)).repartition(F.xxhash64("fps", "block"))

    def run(batches):
        for batch in batches:
            # Small trees are searched together, at most some thousand members beyond the largest.
            rows = batch.to_pylist()
            at = 0
            while at < len(rows):
                own, size = [], 0
                while at < len(rows) and size < TREE:
                    own.append(rows[at])
                    size += len(rows[at]["fps"]) // 8
                    at += 1
                sizes = np.array([len(r["fps"]) // 8 for r in own])
                base = np.cumsum(sizes) - sizes
                members = np.frombuffer(b"".join(r["fps"] for r in own), np.uint64)
                up = np.frombuffer(b"".join(r["up"] for r in own), np.int32).astype(np.int64) + np.repeat(base, sizes)
                edge = np.frombuffer(b"".join(r["edge"] for r in own), np.int8).astype(np.int64)
                spans = [(int(b), r["block"] * QUERIES, min(int(s), (r["block"] + 1) * QUERIES)) for b, s, r in zip(base, sizes, own)]
                queries = np.concatenate([np.arange(b + i, b + j) for b, i, j in spans])
                starts = np.repeat(base, [j - i for _, i, j in spans])
                who, what = search(members, up, edge, queries, starts, radius)
                label = forest(len(members), who, what)
                joined = np.flatnonzero(label != np.arange(len(members)))
                as_ids = members.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(as_ids[joined]), pa.array(as_ids[label[joined]])], schema=arrow)

    return dealt.mapInArrow(run, schema).distinct()


def near_duplicates(
    df: DataFrame, shingle: int = 5, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", most: int = TREE
) -> DataFrame:
    """Per row: the id, ``fingerprint`` (16 hex digits) and ``component_id``, the least id among all rows whose
    fingerprints are connected by steps of at most ``radius`` bits."""
    spark = df.sparkSession
    folder = run_dir(spark, "simhash")

    def stored(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    printed = stored(fingerprints(df, shingle, id_col, text_col), "fingerprints")
    distinct = stored(printed.groupBy("fp").agg(F.min("_id").alias("least")), "distinct")
    members = shards(distinct.select("fp"), radius, f"{folder}/shards", most)
    edges = stored(linked(stored(trees(members), "trees"), radius), "edges")
    groups = components(edges, f"{folder}/components").select(F.col("node").alias("fp"), F.col("label").alias("group"))
    own = distinct.join(groups, "fp", "left").withColumn("group", F.coalesce("group", "fp"))
    firsts = own.groupBy("group").agg(F.min("least").alias("component"))
    named = stored(own.join(firsts, "group").select("fp", "component"), "named")
    return printed.join(named, "fp").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )
