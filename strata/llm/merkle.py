"""Merkle manifest of a table: a digest tree per group, a tree over the groups, and every row's proof.

1. A row's leaf is hashed where it is read; only ids and digests move on. Rows are numbered within their group by range
   partitions and running counts, so a group of any size is spread over tasks.
2. Aligned runs of ``fanout ** LEVELS`` leaves are the partitions of the exchange; each hashes its own subtree.
3. Butterfly: in round r a partition swaps its current ancestor's digest with the partitions that differ from it in the
   r-th digit of their number only (in a group that is not full, with one that holds the same digest), and all of
   them hash the parent. After the last round every partition has the root and the siblings on its way up; nothing is passed down
   the tree again. A round is one shuffle of one row per partition, stored below the shared folder.
4. The groups' roots are leaves of one more tree, built in the same way.
5. Each partition joins its own levels with the siblings above and gives its rows' proofs.

A missing value is ``-``, others are their UTF-8 length, ``:`` and the value. Groups ascend bytewise, a missing group
first; leaves ascend by id, a missing id first, and by digest where ids repeat, so repeated rows are leaves of their own
next to each other. A table without rows gives none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strata.llm.text import slices
from strata.session import run_dir

#: Levels of the tree that one partition of the exchange hashes by itself: 243 leaves with fanout 3.
LEVELS = 5
PATH = "array<struct<place: int, others: array<binary>>>"
#: Bytes of blocks handled at a time.
SLICE = 4 << 20


def leaf(*columns: Column | str) -> Column:
    """The digest, as bytes, of the columns' values."""
    values = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def combined(digests: Column) -> Column:
    """The parent of an array of digests, in order."""
    text = F.concat_ws("", F.transform(digests, lambda d: F.lower(F.hex(d))))
    return F.unhex(F.sha2(text.cast("binary"), 256))


def parent(digests: Sequence[bytes]) -> bytes:
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def depth(size: int, fanout: int) -> int:
    """Levels above ``size`` leaves."""
    levels, reach = 0, 1
    while reach < size:
        levels, reach = levels + 1, reach * fanout
    return levels


def depth_of(size: Column, fanout: int) -> Column:
    reach = F.array(*[F.lit(fanout**k) for k in range(63) if fanout**k < 2**63])
    return F.size(F.filter(reach, lambda r: r < size))


def levels_of(leaves: Sequence[bytes], levels: int, fanout: int) -> list[list[bytes]]:
    """The nodes of each level, leaves first; runs at the end may be short."""
    out = [list(leaves)]
    for _ in range(levels):
        row = out[-1]
        out.append([parent(row[i : i + fanout]) for i in range(0, len(row), fanout)])
    return out


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], folder: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``pos``, its rows' place in their group by ``order``, and the groups with their ``size``.

    Rows are sorted by range partitions, whatever the groups' sizes; a row's place is its place in its partition and what
    the partitions before hold of its group.
    """
    spark = df.sparkSession
    by = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    ordered = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    ordered.write.parquet(f"{folder}/ordered")
    ordered = spark.read.parquet(f"{folder}/ordered").withColumn("_part", F.shiftright("_at", 33))
    # One row for each group and range.
    runs = ordered.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = W.partitionBy(*group)
    before = F.sum("_rows").over(whole.orderBy("_part")) - F.col("_rows")
    runs = runs.withColumns({"_before": before, "size": F.sum("_rows").over(whole)})
    runs.write.parquet(f"{folder}/runs")
    runs = spark.read.parquet(f"{folder}/runs")
    own = runs.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("_part").alias("_of"), "_first", "_before", "size")
    same = F.col("_part") == F.col("_of")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    placed = ordered.join(own, same).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before"))
    groups = runs.groupBy(*group).agg(F.max("size").alias("size"))
    return placed.select(*df.columns, "pos", "size"), groups


def subtrees(nodes: DataFrame, fanout: int, folder: str) -> DataFrame:
    """Partitions of the exchange, a row each, with the digest of their subtree.

    ``nodes``: tree, size (its leaves), pos, digest and more; ``items`` has them by place, at most ``fanout ** LEVELS``.
    """
    width = fanout**LEVELS
    block = F.expr(f"pos div {width}").alias("block")
    items = F.sort_array(F.collect_list(F.struct("pos", *[c for c in nodes.columns if c not in ("tree", "size", "pos")])))
    blocks = nodes.groupBy("tree", "size", block).agg(items.alias("items"))
    blocks.write.parquet(f"{folder}/blocks")
    blocks = nodes.sparkSession.read.parquet(f"{folder}/blocks")

    schema = "tree bigint, block bigint, blocks bigint, digest binary"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for part in slices(batch, SLICE):
                trees, numbers, sizes, digests = (c.to_pylist() for c in part.columns)
                tops = [
                    levels_of(own, min(LEVELS, depth(size, fanout)), fanout)[-1][0] for own, size in zip(digests, sizes)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip((trees, numbers, [-(-s // width) for s in sizes], tops), arrow.types)],
                    schema=arrow,
                )

    return blocks, blocks.select("tree", "block", "size", "items.digest").mapInArrow(run, schema)


def exchange(state: DataFrame, turn: int, fanout: int) -> DataFrame:
    """One round: partitions swap the digests of their ancestors of level ``turn`` and hash the next."""
    step = fanout**turn
    at = state.withColumns({"_low": F.col("block") % step, "_node": F.expr(f"block div {step}")})
    at = at.withColumns({"_group": F.expr(f"_node div {fanout}"), "_place": (F.col("_node") % fanout).cast("int")})
    # A tree's last node may have fewer partitions than its siblings; each then serves several of theirs.
    last = F.col("_node") == F.expr(f"(blocks - 1) div {step}")
    have = F.col("blocks") - F.col("_node") * step
    served = F.when(last & (F.col("_place") > 0), F.sequence("_low", F.lit(step - 1), have)).otherwise(F.array("_low"))
    sent = at.withColumn("_to", F.explode(served)).select(
        "tree", "_group", F.col("_to").alias("_low"), "blocks",
        F.struct("_place", "digest", F.when(F.col("_to") == F.col("_low"), F.col("block")).alias("block"), "path").alias("m"),
    )
    met = sent.groupBy("tree", "_group", "_low", "blocks").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    met = met.withColumn("up", combined(F.col("ms.digest"))).withColumn("m", F.explode("ms")).where("m.block is not null")
    others = F.transform(F.filter("ms", lambda o: o["_place"] != F.col("m._place")), lambda o: o["digest"])
    level = F.struct(F.col("m._place").alias("place"), others.alias("others"))
    return met.select(
        "tree", F.col("m.block").alias("block"), "blocks", F.col("up").alias("digest"),
        F.concat("m.path", F.array(level)).alias("path"),
    )


def butterfly(tops: DataFrame, fanout: int, folder: str) -> DataFrame:
    """Per partition: ``tree``, ``block``, ``top`` (the tree's root) and ``path`` from the partition's subtree to it."""
    spark = tops.sparkSession
    state = tops.withColumn("path", F.from_json(F.lit("[]"), PATH)).withColumn("path", F.coalesce("path", F.array().cast(PATH)))
    turn, done = 0, []
    while True:
        state.write.parquet(f"{folder}/{turn}")
        state = spark.read.parquet(f"{folder}/{turn}").withColumn("_depth", depth_of(F.col("blocks"), fanout))
        done.append(state.where(F.col("_depth") <= turn).drop("_depth"))
        state = state.where(F.col("_depth") > turn).drop("_depth")
        if state.isEmpty():
            break
        state = exchange(state, turn, fanout)
        turn += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("tree", "block", F.col("digest").alias("top"), "path")


def climbed(pos: int, levels: list[list[bytes]], fanout: int) -> list[tuple[int, list[bytes]]]:
    """Place and siblings of a leaf on the levels of its own subtree."""
    way = []
    for row in levels[:-1]:
        first = pos - pos % fanout
        way.append((pos - first, [row[i] for i in range(first, min(first + fanout, len(row))) if i != pos]))
        pos //= fanout
    return way


def folded(digest: bytes, way: Sequence[tuple[int, list[bytes]]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for place, others in way:
        digest = parent([*others[:place], digest, *others[place:]])
    return digest


def proofs(blocks: DataFrame, above: DataFrame, fanout: int, columns: str, item: str, give) -> DataFrame:
    """Rows of ``give(item, way)`` for every item of every partition; ``above`` has the siblings above its subtree."""
    arrow = to_arrow_schema(StructType.fromDDL(columns))
    width = fanout**LEVELS

    def run(batches):
        for batch in batches:
            for part in slices(batch, SLICE):
                out = []
                for row in part.to_pylist():
                    items = row["items"]
                    levels = levels_of([i["digest"] for i in items], min(LEVELS, depth(row["size"], fanout)), fanout)
                    up = [(p["place"], p["others"]) for p in row["path"]]
                    out += [give(row, i, climbed(i["pos"] % width, levels, fanout) + up) for i in items]
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    joined = blocks.select("tree", "size", "block", F.expr(item).alias("items")).join(above, ["tree", "block"])
    return joined.mapInArrow(run, columns)


def manifest(
    df: DataFrame, columns: Sequence[str], group_col: str = "source", id_col: str = "doc_id", fanout: int = 3,
    claimed: Sequence[Column | str] | None = None,
) -> DataFrame:
    """Per row: the id, ``leaf``, ``subroot`` (of its group), ``root``, ``proof`` (place and siblings of every level,
    leaf first) and ``folded``, the root its claimed values (``claimed``, by default its own) give with the siblings.

    Digests are bytes. A row whose ``folded`` is not ``root`` claims values the manifest does not have.
    """
    spark = df.sparkSession
    folder = run_dir(spark, "merkle")
    rows = df.select(
        F.col(group_col).alias("_group"), F.col(id_col).alias("_id"),
        leaf(*columns).alias("digest"), leaf(*(claimed or columns)).alias("claim"),
    )
    placed, groups = numbered(rows, ["_group"], ["_id", "digest", "claim"], f"{folder}/leaves")
    groups, _ = numbered(groups.withColumn("_all", F.lit(0)).withColumnRenamed("size", "leaves"), ["_all"], ["_group"], f"{folder}/groups")
    groups = groups.select("_group", F.col("pos").alias("tree"), F.col("size").alias("groups"))
    groups.write.parquet(f"{folder}/trees")
    groups = spark.read.parquet(f"{folder}/trees")
    trees = groups.select(F.col("_group").alias("_of"), "tree")
    nodes = placed.join(trees, F.col("_group").eqNullSafe(F.col("_of"))).select("tree", "size", "pos", "digest", "_id", "claim")

    blocks, tops = subtrees(nodes, fanout, f"{folder}/subtrees")
    ways = butterfly(tops, fanout, f"{folder}/rounds")
    subroots = ways.where("block = 0").join(groups.select("tree", "groups"), "tree").select(
        F.lit(0).cast("long").alias("tree"), F.col("groups").alias("size"), F.col("tree").alias("pos"), F.col("top").alias("digest")
    )
    upper, upper_tops = subtrees(subroots, fanout, f"{folder}/upper")
    above = butterfly(upper_tops, fanout, f"{folder}/upper-rounds").select("tree", "block", F.col("top").alias("root"), "path")

    def group_way(row, item, way):
        return {
            "tree": item["pos"], "subroot": item["digest"], "root": row["root"],
            "above": [{"place": p, "others": o} for p, o in way],
        }

    kept = "transform(items, i -> struct(i.pos, i.digest))"
    tree_ways = proofs(upper, above, fanout, f"tree bigint, subroot binary, root binary, above {PATH}", kept, group_way)
    tree_ways.write.parquet(f"{folder}/group-ways")
    whole = ways.join(spark.read.parquet(f"{folder}/group-ways"), "tree")
    whole = whole.select("tree", "block", "subroot", "root", F.concat("path", "above").alias("path"))

    def row_way(row, item, way):
        return {
            id_col: item["_id"], "leaf": item["digest"], "subroot": row["subroot"], "root": row["root"],
            "proof": [{"place": p, "others": o} for p, o in way], "folded": folded(item["claim"], way),
        }

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, leaf binary, subroot binary, root binary, proof {PATH}, folded binary"
    return proofs(blocks, whole, fanout, schema, "items", row_way)


def hex_text(digest: Column | str) -> Column:
    return F.lower(F.hex(digest))


def proof_digest(proof: Column | str) -> Column:
    """The digest of a proof's siblings, level by level."""
    others = F.flatten(F.transform(proof, lambda level: level["others"]))
    return F.sha2(F.concat_ws("", F.transform(others, hex_text)).cast("binary"), 256)
