"""Metric values against targets, alert rules, and card datasets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strata.functions.bands import COMPARE
from strata.functions.exprs import ratio
from strata.operators.enrich import declared


class Target(NamedTuple):
    metric: str
    target: float
    better: str  # "higher" or "lower"


class Rule(NamedTuple):
    metric: str
    op: str
    limit: float
    message: str


# Targets and alert limits declared with the metrics.
TARGETS = (
    Target("retention_crr", 0.7, "higher"),
    Target("avg_clv", 500, "higher"),
    Target("avg_delivery_days", 3, "lower"),
    Target("return_rate", 0.05, "lower"),
    Target("conversion_rate", 0.2, "higher"),
)
RULES = (
    Rule("retention_crr", "<", 0.5, "sales management"),
    Rule("avg_clv", "<", 300, "marketing"),
    Rule("avg_delivery_days", ">", 5, "logistics"),
    Rule("return_rate", ">", 0.1, "quality control"),
    Rule("conversion_rate", "<", 0.2, "sales management"),
)


def metric_rows(df: DataFrame, metrics: Mapping[str, Column | str], period: str | None = None) -> DataFrame:
    """Unpivot metric columns to (metric, period, value)."""
    when = F.col(period).cast("string") if period else F.lit("all")
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                when.alias("period"),
                (F.col(c) if isinstance(c, str) else c).cast("double").alias("value"),
            )
            for name, c in metrics.items()
        ]
    )
    return df.select(F.inline(rows))


def stacked(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def evaluate_metrics(values: DataFrame, targets: Sequence[Target] = TARGETS) -> DataFrame:
    """Each value with its target and whether it is met; metrics without a target keep a null status."""
    goals = _declared(values.sparkSession, targets, "metric string, target double, better string")
    joined = values.join(goals, "metric", "left")
    met = F.when(F.col("better") == "higher", F.col("value") >= F.col("target")).otherwise(
        F.col("value") <= F.col("target")
    )
    status = F.when(met, "met").when(~met, "missed")
    return joined.select("metric", "period", "value", "target", status.alias("status"))


def evaluate_alerts(values: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The (value, rule) pairs that fire. A metric may have several rules."""
    declared = _declared(values.sparkSession, rules, "metric string, op string, limit_value double, message string")
    joined = values.join(declared, "metric")
    fired = reduce(
        lambda a, b: a | b,
        [(F.col("op") == op) & compare(F.col("value"), F.col("limit_value")) for op, compare in COMPARE.items()],
    )
    return joined.where(fired).select("metric", "period", "value", "op", "limit_value", "message")


def _declared(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return declared(spark, [tuple(float(x) if isinstance(x, int) else x for x in r) for r in rows], schema)


def card_scalar(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    return df.agg(value.alias(name))


def card_series(df: DataFrame, x: Column, value: Column, x_name: str = "x", name: str = "value") -> DataFrame:
    """Points of a bar or line card."""
    return df.groupBy(x.alias(x_name)).agg(value.alias(name)).orderBy(x_name)


def card_pie(df: DataFrame, slice_by: Column, value: Column, slice_name: str = "slice", name: str = "value") -> DataFrame:
    """Slices with their share of the slices' total, which is one row however many slices there are."""
    slices = df.groupBy(slice_by.alias(slice_name)).agg(value.alias(name))
    total = slices.agg(F.sum(name)).scalar()
    return slices.withColumn("share", ratio(F.col(name), total)).orderBy(slice_name)


def card_table(df: DataFrame, by: str, k: int, tie: Sequence[str]) -> DataFrame:
    return df.orderBy(F.col(by).desc(), *tie).limit(k)


