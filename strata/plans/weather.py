"""The weather build: staged readings, daily and hourly core tables, marts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import functions as F

from strata.operators import quality, staging, weather
from strata.plans.layers import Model
from strata.functions.weather import DAILY_LIMITS


def day_checks() -> list[quality.Check]:
    """Of the stored days."""
    return [
        *quality.not_null("measurement_date", "avg_temperature", "total_precipitation"),
        quality.accepted_range("avg_humidity", low=0, high=100),
        quality.positive("measurement_count"),
    ]


def reading_checks() -> list[quality.Check]:
    """Of the readings a load adds to the days."""
    return [
        *quality.not_null("measurement_date", *staging.READING_COLUMNS),
        quality.accepted_range("relative_humidity_2m", low=0, high=100),
    ]


def weather_models(
    limits: Mapping[str, float] = DAILY_LIMITS,
    anomaly_limit: float = 5,
    baseline_days: int = 30,
    trailing_limit: float = 5,
    incremental: bool = False,
) -> list[Model]:
    """Models over the sources ``readings`` and ``norms``.

    ``anomaly_limit`` is that of the seasonal mart, ``trailing_limit`` that of the trailing one. With ``incremental``
    the readings carry ``loaded_at`` and only ever grow: a load's partial sums are added to those of its days, its readings'
    comfort is appended, and no stored day is read or written again.
    """

    def present(t):
        return staging.drop_all_null(t["readings"], staging.READING_COLUMNS)

    def by_month(df):
        return df.withColumn("yyyymm", F.date_format("measurement_date", "yyyyMM"))

    def comfort(t):
        scored = weather.comfort(t["stg_readings"])
        return scored.withColumn("yyyymm", F.date_format("reading_ts", "yyyyMM"))

    def dated(t):
        return t["stg_readings"].withColumn("measurement_date", F.to_date("reading_ts"))

    def daily(rows):
        return by_month(weather.daily_weather(rows))

    if incremental:
        tables = [
            Model(
                "int_daily_weather", "core", dated, materialized="states", keys=("measurement_date",), mark="loaded_at",
                aggregate=weather.daily_states, combine=weather.DAY_STATES | {"loaded_at": "max"},
                finish=lambda states: by_month(weather.daily_from_states(states)), checks=reading_checks(),
            ),
            Model(
                "int_comfort_index", "core", lambda t: weather.comfort(t["stg_readings"], ["event_id", "loaded_at"]),
                materialized="append", keys=("event_id",), mark="loaded_at",
            ),
        ]
    else:
        tables = [
            Model(
                "int_daily_weather", "core", lambda t: daily(dated(t)), ("yyyymm",), ("measurement_date",), checks=day_checks()
            ),
            Model("int_comfort_index", "core", comfort, ("yyyymm",), ("reading_ts",)),
        ]
    return [
        Model("stg_readings", "stage", present, materialized="view"),
        Model("stg_weather_metrics", "stage", lambda t: staging.stage_weather(t["readings"], ["event_id"]), materialized="view"),
        *tables,
        Model(
            "int_weather_anomalies",
            "core",
            lambda t: weather.seasonal_anomaly(t["int_daily_weather"], "avg_temperature"),
        ),
        Model(
            "int_norm_deviation",
            "core",
            lambda t: weather.norm_deviation(
                t["int_daily_weather"].select("measurement_date", "avg_temperature"), t["norms"]
            ),
        ),
        Model("int_linear_comfort", "core", lambda t: weather.linear_comfort(t["int_daily_weather"])),
        Model("mart_daily_metrics", "marts", lambda t: weather.daily_alerts(t["int_daily_weather"], limits)),
        Model(
            "mart_anomalies", "marts", lambda t: weather.anomaly_mart(t["int_weather_anomalies"], anomaly_limit)
        ),
        Model("mart_comfort", "marts", lambda t: weather.hourly_comfort(t["int_comfort_index"])),
        Model(
            "mart_trailing",
            "marts",
            lambda t: weather.trailing_baseline(
                t["int_daily_weather"].select("measurement_date", "avg_temperature"),
                "avg_temperature",
                baseline_days,
                trailing_limit,
            ),
        ),
        Model(
            "mart_daily_fact",
            "marts",
            lambda t: weather.daily_weather_fact(
                t["int_daily_weather"], t["int_norm_deviation"], t["int_linear_comfort"]
            ),
        ),
        Model(
            "mart_summary",
            "marts",
            lambda t: weather.weather_summary(t["mart_daily_metrics"], t["mart_anomalies"], t["mart_comfort"]),
            materialized="view",
        ),
    ]
