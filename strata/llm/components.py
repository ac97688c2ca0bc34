"""Connected components of a graph given by edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Times a round doubles the way from a node to the one it is merged into.
JUMPS = 2


def components(edges: DataFrame, folder: str) -> DataFrame:
    """``node`` and ``label`` of all nodes of the stored frame ``edges`` (``a``, ``b``); equal labels are one component.
    The label is a node of the component, the least of those its rounds kept.

    Each round merges every node into its least neighbour, or that one's, and so on; edges are then edges between what is left, and
    those within one node go. So every round works on what the one before has left over, at most its edges. Numbers that are no
    better than hashes (long chains in ascending order) take more rounds. Rounds are stored below ``folder``, which cuts the
    lineage; only the question whether edges are left comes to the driver.
    """
    spark = edges.sparkSession

    def stored(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    merged, turn = [], 0
    while True:
        ends = edges.select("a", "b").union(edges.select("b", "a"))
        near = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        into = stored(near.select("node", F.least("node", "near").alias("into")), f"{turn}/near")
        for jump in range(JUMPS):
            further = into.select(F.col("node").alias("into"), F.col("into").alias("next"))
            into = stored(into.join(further, "into").select("node", F.col("next").alias("into")), f"{turn}/jump{jump}")
        merged.append(into)
        from_a = into.select(F.col("node").alias("a"), F.col("into").alias("x"))
        from_b = into.select(F.col("node").alias("b"), F.col("into").alias("y"))
        left = edges.join(from_a, "a").join(from_b, "b").where("x <> y")
        edges = stored(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{turn}/edges")
        if edges.isEmpty():
            break
        turn += 1
    labels = merged[-1].select("node", F.col("into").alias("label"))
    for turn, into in reversed(list(enumerate(merged[:-1]))):
        # What a round merged its nodes into may have no edge left, and is then the label itself.
        later = labels.select(F.col("node").alias("into"), "label")
        labels = into.join(later, "into", "left").select("node", F.coalesce("label", "into").alias("label"))
        labels = stored(labels, f"{turn}/labels")
    return labels
