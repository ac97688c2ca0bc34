"""Weather aggregates: days, hours, baselines, anomalies, comfort, summary.

Daily frames hold one row per calendar day, whatever the number of stations, so
windows over days are small; readings themselves are only grouped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strata.functions import weather
from strata.functions.bands import alert_flag
from strata.functions.exprs import mean, money_sum, month_start, number, ratio, whole
from strata.operators.staging import RUN_METADATA, run_marks

DAY = "measurement_date"


def _day(ts="reading_ts") -> Column:
    return F.to_date(ts).alias(DAY)


def daily_weather(readings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per day (and ``by``), with the load metadata its readings carry."""
    return readings.groupBy(_day(), *by).agg(
        mean("temperature_2m").alias("avg_temperature"),
        F.min("temperature_2m").alias("min_temperature"),
        F.max("temperature_2m").alias("max_temperature"),
        mean("relative_humidity_2m").alias("avg_humidity"),
        mean("wind_speed_10m").alias("avg_wind_speed"),
        F.max("wind_speed_10m").alias("max_wind_speed"),
        money_sum("precipitation").alias("total_precipitation"),
        F.count("*").alias("measurement_count"),
        *run_marks(readings),
    )


#: Partial sums of a day, and how loads combine them.
DAY_STATES = {
    "temperature_sum": "sum", "temperature_count": "sum", "min_temperature": "min", "max_temperature": "max",
    "humidity_sum": "sum", "humidity_count": "sum", "wind_sum": "sum", "wind_count": "sum", "max_wind_speed": "max",
    "total_precipitation": "sum", "measurement_count": "sum",
}


def daily_states(readings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mergeable partial sums per day (and ``by``), with the load metadata: :func:`daily_weather` of all loads is
    :func:`daily_from_states` of their sums, without any of the readings."""
    t, h, w, p = "temperature_2m", "relative_humidity_2m", "wind_speed_10m", "precipitation"
    return readings.groupBy(_day(), *by).agg(
        F.sum(t).alias("temperature_sum"), F.count(t).alias("temperature_count"),
        F.min(t).alias("min_temperature"), F.max(t).alias("max_temperature"),
        F.sum(h).alias("humidity_sum"), F.count(h).alias("humidity_count"),
        F.sum(w).alias("wind_sum"), F.count(w).alias("wind_count"), F.max(w).alias("max_wind_speed"),
        F.sum(p).alias("total_precipitation"), F.count("*").alias("measurement_count"),
        *run_marks(readings),
    )


def daily_from_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The columns of :func:`daily_weather`, one row per row of merged states."""
    return states.select(
        DAY, *by,
        ratio("temperature_sum", "temperature_count").alias("avg_temperature"), "min_temperature", "max_temperature",
        ratio("humidity_sum", "humidity_count").alias("avg_humidity"),
        ratio("wind_sum", "wind_count").alias("avg_wind_speed"), "max_wind_speed",
        F.col("total_precipitation").cast("decimal(22,2)").alias("total_precipitation"), "measurement_count",
        *[c for c in RUN_METADATA if c in states.columns],
    )


def daily_means(readings: DataFrame) -> DataFrame:
    return readings.groupBy(_day()).agg(mean("temperature_2m").alias("avg_temperature"))


def daily_alerts(daily: DataFrame, limits=weather.DAILY_LIMITS) -> DataFrame:
    watched = {
        "temperature": "avg_temperature",
        "humidity": "avg_humidity",
        "wind": "avg_wind_speed",
        "precipitation": "total_precipitation",
    }
    flags = {f"high_{name}_alert": alert_flag(c, ">", limits[name]) for name, c in watched.items()}
    return daily.select(DAY, *watched.values(), *[flag.alias(name) for name, flag in flags.items()])


def comfort(readings: DataFrame, keep: Sequence[str] = ("event_id",)) -> DataFrame:
    """Felt temperatures and comfort of every reading."""
    t, h, w = "temperature_2m", "relative_humidity_2m", "wind_speed_10m"
    scored = readings.withColumn("_index", weather.comfort_index(t, h, w))
    return scored.select(
        *keep,
        "reading_ts",
        t,
        h,
        w,
        number(weather.heat_index(t, h)).alias("heat_index"),
        number(weather.wind_chill(t, w)).alias("wind_chill"),
        F.col("_index").cast("decimal(8,3)").alias("comfort_index"),
        weather.comfort_category("_index").alias("comfort_category"),
    )


def hourly_comfort(scored: DataFrame, alert_below: float = 30) -> DataFrame:
    """Comfort per day and hour; the worst category is that of the lowest index."""
    hours = scored.groupBy(_day(), whole(F.hour("reading_ts")).alias("hour")).agg(
        mean("comfort_index").alias("avg_comfort_index"),
        F.min("comfort_index").alias("min_comfort_index"),
        F.max("comfort_index").alias("max_comfort_index"),
    )
    # The category is a function of the index, so the lowest index names the worst one.
    return hours.withColumns(
        {
            "worst_comfort_category": weather.comfort_category("min_comfort_index"),
            "low_comfort_alert": alert_flag("min_comfort_index", "<", alert_below),
        }
    )


def linear_comfort(daily: DataFrame) -> DataFrame:
    """A simple index on daily means."""
    means = ("avg_temperature", "avg_humidity", "avg_wind_speed")
    return daily.select(DAY, *means, weather.linear_comfort(*means).alias("comfort_index"))


def seasonal_anomaly(
    daily: DataFrame, value: str, day: str = DAY, lookback_days: int | None = None, as_of=None, leave_out_today=False
) -> DataFrame:
    """Each day's value against the mean and spread of its day of the year.

    ``lookback_days`` (with ``as_of``) limits the history of the baseline;
    ``leave_out_today`` compares a day with the other years only. ``daily`` has
    one row per day, so a window by day of the year holds one row per year, and
    the daily frame is computed once.
    """
    x = F.col(value).cast("double")
    counted = F.lit(True) if lookback_days is None else F.col(day) >= F.date_sub(F.lit(as_of), lookback_days)
    dated = daily.withColumn("_doy", F.dayofyear(day))
    past = F.when(counted, x)
    own = W.partitionBy("_doy")
    if leave_out_today:
        stats = _other_years(past, own.orderBy(day))
    else:
        stats = {"_mean": F.avg(past).over(own), "_sd": F.stddev_pop(past).over(own)}
    joined = dated.withColumns(stats)
    mean_, sd = F.col("_mean"), F.col("_sd")
    z = weather.zscore(x, mean_, sd)
    return joined.select(
        day,
        value,
        F.round(mean_, 4).alias("baseline"),
        F.round(sd, 4).alias("baseline_stddev"),
        F.round(x - mean_, 4).alias("anomaly"),
        number(z).alias("z_score"),
        weather.severity(number(z)).alias("severity"),
    )


def _other_years(past: Column, own) -> dict[str, Column]:
    """Mean and spread of a window's rows but the current one: earlier and later rows, combined.

    A window holds one row per year.
    """
    sides = [own.rowsBetween(W.unboundedPreceding, -1), own.rowsBetween(1, W.unboundedFollowing)]
    n1, n2 = (F.count(past).over(s) for s in sides)
    m1, m2 = (F.coalesce(F.avg(past).over(s), F.lit(0.0)) for s in sides)
    s1, s2 = (F.coalesce(F.stddev_pop(past).over(s), F.lit(0.0)) for s in sides)
    n = (n1 + n2).cast("double")
    apart = F.try_divide((m1 - m2) * (m1 - m2) * n1 * n2, n)
    spread = F.try_divide(n1 * s1 * s1 + n2 * s2 * s2 + apart, n)
    return {"_mean": F.try_divide(n1 * m1 + n2 * m2, n), "_sd": F.sqrt(spread)}


def anomaly_mart(anomalies: DataFrame, limit: float = 5) -> DataFrame:
    return anomalies.withColumn("significant_anomaly_alert", alert_flag(F.abs("anomaly"), ">", limit))


def trailing_baseline(daily: DataFrame, value: str, days: int = 30, threshold: float = 5, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the ``days`` days before each day, and whether the day exceeds it by ``threshold``.

    ``daily`` has one row per day (and ``by``): without ``by`` the window runs
    over the calendar, a few hundred rows per year.
    """
    before = W.partitionBy(*by).orderBy(F.unix_date(DAY)).rangeBetween(-days, -1)
    base = F.round(F.avg(F.col(value).cast("double")).over(before), 6)
    with_base = daily.withColumn("historical_avg", base)
    above = F.col(value) - F.col("historical_avg") > F.lit(float(threshold))
    return with_base.withColumn("is_anomaly", F.coalesce(above, F.lit(False)).cast("int"))


def hot_day_count(flagged: DataFrame) -> DataFrame:
    """Days per month above their trailing baseline."""
    return flagged.groupBy(month_start(DAY).alias("month_start")).agg(
        F.sum("is_anomaly").alias("hot_days"), F.count("*").alias("days")
    )


def norm_deviation(daily: DataFrame, norms: DataFrame) -> DataFrame:
    """Daily mean less the norm of its date; days without a norm are left out."""
    joined = daily.join(norms, daily[DAY] == norms["date"]).drop("date")
    return joined.withColumn("temperature_anomaly", F.col("avg_temperature") - F.col("climate_norm"))


def precip_intensity(readings: DataFrame) -> DataFrame:
    """Precipitation per wet hour and day.

    Readings are folded to hours first, so no distinct count over readings is needed.
    """
    wet = F.col("precipitation") > 0
    hours = readings.groupBy(_day(), F.hour("reading_ts").alias("hour")).agg(
        F.sum("precipitation").alias("_rain"), F.max(wet.cast("int")).alias("_wet")
    )
    return hours.groupBy(DAY).agg(
        money_sum("_rain").alias("total_precipitation"),
        F.sum("_wet").alias("wet_hours"),
        ratio(F.sum("_rain"), F.sum("_wet")).alias("precip_intensity"),
    )


def icing_risk_by_day(readings: DataFrame) -> DataFrame:
    risk = weather.icing_risk("temperature_2m", "precipitation")
    return readings.groupBy(_day()).agg(
        F.count_if(risk == "HIGH").alias("high_risk_readings"),
        F.count("*").alias("readings"),
        F.max(F.when(risk == "HIGH", 1).otherwise(0)).alias("icing_alert"),
    )


def daily_stddev(readings: DataFrame) -> DataFrame:
    """Population spread of temperature within a day."""
    return readings.groupBy(_day()).agg(
        F.round(F.stddev_pop(F.col("temperature_2m").cast("double")), 6).alias("temperature_stddev")
    )


def daily_extremes(readings: DataFrame, hot: float = 30, cold: float = -20) -> DataFrame:
    extremes = readings.groupBy(_day()).agg(
        F.min("temperature_2m").alias("min_temperature"), F.max("temperature_2m").alias("max_temperature")
    )
    return extremes.withColumns(
        {"hot_alert": alert_flag("max_temperature", ">", hot), "cold_alert": alert_flag("min_temperature", "<", cold)}
    )


def daily_weather_fact(daily: DataFrame, deviations: DataFrame, comfort_by_day: DataFrame) -> DataFrame:
    """Daily measures with their deviation from the norm and their comfort."""
    facts = daily.select(DAY, "avg_temperature", "avg_humidity", "avg_wind_speed", "total_precipitation")
    return facts.join(deviations.select(DAY, "temperature_anomaly"), DAY, "left").join(
        comfort_by_day.select(DAY, "comfort_index"), DAY, "left"
    )


def weather_summary(alerts: DataFrame, anomalies: DataFrame, hours: DataFrame) -> DataFrame:
    """One row per day: measures, alerts, anomaly and comfort; hours are folded to days first."""
    days = hours.groupBy(DAY).agg(
        F.round(F.avg("avg_comfort_index"), 4).alias("daily_avg_comfort_index"),
        F.min("min_comfort_index").alias("_lowest"),
        F.max("low_comfort_alert").alias("daily_low_comfort_alert"),
    )
    days = days.withColumn("daily_worst_comfort", weather.comfort_category("_lowest")).drop("_lowest")
    odd = anomalies.select(
        DAY, F.col("anomaly").alias("temperature_anomaly"), "severity", "significant_anomaly_alert"
    )
    return alerts.join(odd, DAY, "left").join(days, DAY, "left")


def reaverage(daily: DataFrame, columns: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """Means (and sums) by date again, for tables that may hold several loads of a day."""
    return daily.groupBy(DAY).agg(
        *[number(F.avg(c)).alias(c) for c in columns], *[money_sum(c).alias(c) for c in sums]
    )


