"""Ordered rules: the first condition that holds gives the label."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, functions as F

from strata.functions.exprs import col


def exact(x) -> Column:
    """A literal without binary rounding: ``0.8`` becomes decimal 0.8."""
    return F.lit(Decimal(str(x))) if isinstance(x, float) else F.lit(x)


def first_label(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    out = None
    for condition, label in rules:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def at_least(c: Column | str, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first step whose lower limit ``c`` reaches (steps run downwards)."""
    return first_label([(col(c) >= exact(limit), label) for limit, label in steps], otherwise)


def above(c: Column | str, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Like :func:`at_least` with exclusive limits."""
    return first_label([(col(c) > exact(limit), label) for limit, label in steps], otherwise)


def below(c: Column | str, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first step whose upper limit lies above ``c`` (steps run upwards)."""
    return first_label([(col(c) < exact(limit), label) for limit, label in steps], otherwise)


def up_to(c: Column | str, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Like :func:`below` with inclusive limits."""
    return first_label([(col(c) <= exact(limit), label) for limit, label in steps], otherwise)


# Comparison operators allowed in declared rules.
COMPARE = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


def alert_flag(c: Column | str, op: str, limit: float) -> Column:
    """1 when the comparison holds, else 0 (also for a missing value)."""
    return F.when(COMPARE[op](col(c), exact(limit)), 1).otherwise(0)
