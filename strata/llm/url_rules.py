"""URL rules by a sort-merge range join.

A host's key is its labels reversed, each followed by a dot. A rule's host and all its subdomains then are one
interval of keys, the keys that begin with the rule's, and intervals are nested or apart. URLs are range-partitioned
by key and id, so a host with a third of all rows spreads over tasks; a rule goes to every partition its
interval meets. One sorted sweep per partition keeps the stack of intervals open at the current key; among their
rules whose path the URL's path begins with, the longest (host and path together) wins, then the one of the
longer host.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#``
or the end. A null URL or one without ``://`` has an empty host and path and fits no rule. Rules without host or verdict
are ignored, a null path is empty; of several verdicts for one rule ``block`` wins. Repeated rows are judged
each; columns besides id and URL are not read. The driver sees the least and greatest key of each partition only.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strata.session import run_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    host = F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class OpenRules:
    """The stack: per open interval its key, the host, and its rules by path."""

    def __init__(self):
        self.stack: list[tuple[str, str, dict[str, str], list[int]]] = []

    def advance(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def add(self, key: str, host: str, path: str, verdict: str) -> None:
        self.advance(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, host, {}, []))
        _, _, rules, sizes = self.stack[-1]
        if path not in rules or verdict == "block":
            rules[path] = verdict
        if len(path) not in sizes:
            sizes.append(len(path))
            sizes.sort(reverse=True)

    def best(self, key: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        self.advance(key)
        best, size = None, -1
        for _, host, rules, sizes in reversed(self.stack):
            for n in sizes:
                if n <= len(path) and (verdict := rules.get(path[:n])) is not None:
                    if len(host) + n > size:
                        best, size = (host + path[:n], verdict), len(host) + n
                    break
        return best


def judge_urls(
    df: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """Id, ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` of every row.

    ``rules`` has the columns host, path and verdict (allow or block); URLs that no rule fits get ``default``.
    """
    spark = df.sparkSession
    folder = run_dir(spark, "url-rules")
    host, path = host_and_path(F.col(url_col))
    urls = df.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("_key", host_key(F.col("host"))).repartitionByRange("_key", "_id", "path")
    urls.withColumn("_part", F.spark_partition_id()).write.parquet(folder)
    urls = spark.read.parquet(folder)
    ends = urls.groupBy("_part").agg(F.min("_key").alias("a"), F.max("_key").alias("b")).orderBy("a", "b", "_part").collect()
    parts, low, high = [r["_part"] for r in ends], [r["a"].encode() for r in ends], [r["b"].encode() for r in ends]

    def deal(batches):
        """A copy of each rule for every partition with a key in its interval."""
        for batch in batches:
            out = []
            for key, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns)):
                raw = key.encode()
                # Ranges are in order, so those that meet [raw, raw followed by anything] are neighbours.
                here = range(bisect_left(high, raw), bisect_right(low, raw + b"\xff"))
                out += [(parts[i], key, host, path, verdict) for i in here]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)] or [pa.array([], f.type) for f in dealt], schema=dealt)

    schema = "_part int, _key string, host string, path string, verdict string"
    dealt = to_arrow_schema(StructType.fromDDL(schema))
    rules = rules.where("host IS NOT NULL AND verdict IS NOT NULL")
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.select(host_key(F.col("host")).alias("_key"), "host", "path", "verdict").mapInArrow(deal, schema)

    kind = df.schema[id_col].dataType.simpleString()
    none = lambda t: F.lit(None).cast(t)
    events = rules.select("_part", "_key", F.lit(0).alias("_kind"), none(kind).alias("_id"), "host", "path", "verdict")
    events = events.unionByName(urls.withColumns({"_kind": F.lit(1), "verdict": none("string")}))
    events = events.repartitionById(max(parts, default=0) + 1, "_part").sortWithinPartitions("_part", "_key", "_kind")
    result = f"`{id_col}` {kind}, host string, path string, rule string, verdict string"
    arrow = to_arrow_schema(StructType.fromDDL(result))

    def sweep(batches):
        part, rules = None, OpenRules()
        for batch in batches:
            out = []
            for own, key, is_url, row, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns)):
                if own != part:
                    part, rules = own, OpenRules()
                if not is_url:
                    rules.add(key, host, path, verdict)
                elif best := rules.best(key, path):
                    out.append((row, host, path, *best))
                else:
                    out.append((row, host, path, None, default))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return events.select("_part", "_key", "_kind", "_id", "host", "path", "verdict").mapInArrow(sweep, result)
