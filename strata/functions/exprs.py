"""Small Column builders shared by all operators.

Money is summed as decimal, so totals do not depend on partition order. Ratios
are formed once, from finished totals, as doubles. Only results that do depend
on the order of rows (means of doubles, deviations) are rounded.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MONEY = "decimal(12,2)"
MONEY_TOTAL = "decimal(22,2)"
PLACES = 6


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money_sum(c: Column | str) -> Column:
    return F.sum(c).cast(MONEY_TOTAL)


def number(c: Column | str) -> Column:
    """A double rounded for output; a decimal is rounded before it becomes one."""
    return F.round(col(c), PLACES).cast("double")


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den``; null when the divisor is zero or null."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def mean(c: Column | str) -> Column:
    """Average of a decimal or integer column, from its exact sum."""
    return ratio(F.sum(c), F.count(c))


def whole(c: Column | str) -> Column:
    return col(c).cast("bigint")


def month_index(c: Column | str) -> Column:
    """Months since year 0: differences count calendar boundaries, not full months."""
    return F.year(c) * 12 + F.month(c)


def month_start(c: Column | str) -> Column:
    return F.trunc(c, "MM")


def iso_weekday(c: Column | str) -> Column:
    """Monday = 1 … Sunday = 7."""
    return F.weekday(c) + 1
