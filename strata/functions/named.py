"""The weather formulas as named functions of a session, for SQL text and dashboards.

``register(spark)`` creates temporary SQL functions; Spark puts their bodies into the query, so they cost what the
expressions of :mod:`strata.functions.weather` cost, with the same limits and weights.
"""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import SparkSession

from strata.functions import weather as wx

#: Type of the arguments: wide enough for every measure, and exact.
MEASURE = "DECIMAL(10,2)"


def exact_text(x) -> str:
    """A decimal or whole literal."""
    return format(Decimal(str(x)), "f")


def double_text(x) -> str:
    return f"{x!r}D" if isinstance(x, float) else f"{float(x)!r}D"


def between(c: str, band) -> str:
    return f"{c} BETWEEN {exact_text(band[0])} AND {exact_text(band[1])}"


def heat_index_body(p: Mapping = wx.HEAT_INDEX) -> str:
    felt = f"t + t * h * {exact_text(p['weight'])} * 0.01"
    return (
        f"CAST(CASE WHEN t >= {exact_text(p['min_temperature'])} AND h >= {exact_text(p['min_humidity'])} "
        f"THEN {felt} ELSE t END AS DECIMAL(30,6))"
    )


def wind_chill_body(p: Mapping = wx.WIND_CHILL, k: Mapping = wx.WIND_CHILL_TERMS) -> str:
    blow = f"POW(CAST(w * {exact_text(wx.KMH_PER_MS)} AS DOUBLE), {double_text(p['exponent'])})"
    base, warm, wind, both = (double_text(k[x]) for x in ("base", "temperature", "wind", "both"))
    felt = f"{base} + {warm} * CAST(t AS DOUBLE) - {wind} * {blow} + {both} * CAST(t AS DOUBLE) * {blow}"
    return (
        f"CASE WHEN t <= {exact_text(p['max_temperature'])} AND w > {exact_text(p['min_wind'])} "
        f"THEN {felt} ELSE CAST(t AS DOUBLE) END"
    )


def comfort_index_body() -> str:
    def inside(band) -> str:
        return f"{between('t', band['temperature'])} AND {between('h', band['humidity'])} AND w < {exact_text(band['wind_below'])}"

    def less(score, penalty) -> str:
        return (
            f"{exact_text(score)} - ABS(t - {exact_text(wx.IDEAL_POINT['temperature'])}) * {exact_text(penalty['temperature'])}"
            f" - ABS(h - {exact_text(wx.IDEAL_POINT['humidity'])}) * {exact_text(penalty['humidity'])}"
            f" - w * {exact_text(penalty['wind'])}"
        )

    return (
        f"CAST(CASE WHEN {inside(wx.IDEAL_BAND)} THEN {exact_text(wx.IDEAL_BAND['score'])} "
        f"WHEN {inside(wx.WIDE_BAND)} THEN {less(wx.WIDE_BAND['score'], wx.WIDE_PENALTY)} "
        f"ELSE GREATEST({exact_text(wx.OUTSIDE['floor'])}, {less(wx.OUTSIDE['score'], wx.OUTSIDE_PENALTY)}) END AS DECIMAL(14,3))"
    )


def comfort_category_body() -> str:
    steps = " ".join(f"WHEN i >= {exact_text(limit)} THEN '{label}'" for limit, label in wx.COMFORT_STEPS)
    return f"CASE {steps} ELSE '{wx.COMFORT_REST}' END"


def linear_comfort_body(weights: Mapping = wx.LINEAR_COMFORT) -> str:
    t, h, w = (f"CAST({c} AS DOUBLE) * {double_text(weights[n])}" for c, n in (("t", "temperature"), ("h", "humidity"), ("w", "wind")))
    return f"{t} + {h} - {w}"


def formulas() -> dict[str, tuple[str, str, str]]:
    """name -> (parameters, type, body)"""
    t, h, w = (f"{c} {MEASURE}" for c in "thw")
    return {
        "heat_index": (f"{t}, {h}", "DECIMAL(30,6)", heat_index_body()),
        "wind_chill": (f"{t}, {w}", "DOUBLE", wind_chill_body()),
        "comfort_index": (f"{t}, {h}, {w}", "DECIMAL(14,3)", comfort_index_body()),
        "comfort_category": ("i DECIMAL(14,3)", "STRING", comfort_category_body()),
        "linear_comfort": (f"{t}, {h}, {w}", "DOUBLE", linear_comfort_body()),
    }


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Create the functions, with ``prefix`` before their names; returns the names."""
    names = []
    for name, (parameters, kind, body) in formulas().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {body}")
        names.append(f"{prefix}{name}")
    return names
