"""Row-level weather rules. Limits are parameters; decimals stay exact."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from strata.functions.bands import above, at_least, below, exact
from strata.functions.exprs import col

# Default limits, weights and labels of the weather formulas.
WIND_STEPS = ((5, "Calm"), (10, "Light"))
WIND_REST = "Strong"
COMFORT_STEPS = ((80, "Excellent"), (60, "Good"), (40, "Fair"), (20, "Poor"))
COMFORT_REST = "Very Poor"
SEVERITY_STEPS = ((3.0, "Extreme"), (2.0, "Significant"), (1.0, "Moderate"))
SEVERITY_REST = "Normal"
HEAT_INDEX = {"min_temperature": 27, "min_humidity": 40, "weight": 0.5}
WIND_CHILL = {"max_temperature": 10, "min_wind": 1.3, "exponent": 0.16}
WIND_CHILL_TERMS = {"base": 13.12, "temperature": 0.6215, "wind": 11.37, "both": 0.3965}
IDEAL_BAND = {"temperature": (18, 24), "humidity": (30, 60), "wind_below": 5, "score": 100}
WIDE_BAND = {"temperature": (15, 27), "humidity": (20, 70), "wind_below": 10, "score": 80}
OUTSIDE = {"score": 50, "floor": 0}
IDEAL_POINT = {"temperature": 21, "humidity": 45}
WIDE_PENALTY = {"temperature": 2, "humidity": 0.5, "wind": 2}
OUTSIDE_PENALTY = {"temperature": 3, "humidity": 0.5, "wind": 3}
LINEAR_COMFORT = {"temperature": 0.5, "humidity": 0.3, "wind": 0.2}
KMH_PER_MS = 3.6
FAHRENHEIT = {"factor": 1.8, "offset": 32}
DAILY_LIMITS = {"temperature": 25, "humidity": 80, "wind": 10, "precipitation": 5}


def fahrenheit(celsius) -> Column:
    return F.round(col(celsius) * exact(FAHRENHEIT["factor"]) + FAHRENHEIT["offset"], 2)


def kmh(ms) -> Column:
    return F.round(col(ms) * exact(KMH_PER_MS), 2)


def wind_category(wind, steps=WIND_STEPS) -> Column:
    return below(wind, steps, WIND_REST)


def icing_risk(temperature, precipitation) -> Column:
    return F.when((col(temperature) < 0) & (col(precipitation) > 0), "HIGH").otherwise("LOW")


def heat_index(temperature, humidity, p=HEAT_INDEX) -> Column:
    t, h = col(temperature), col(humidity)
    felt = t + t * h * exact(p["weight"]) * exact(0.01)
    muggy = (t >= p["min_temperature"]) & (h >= p["min_humidity"])
    return F.when(muggy, felt).otherwise(t)


def wind_chill(temperature, wind, p=WIND_CHILL, k=WIND_CHILL_TERMS) -> Column:
    t = col(temperature).cast("double")
    blow = F.pow((col(wind) * exact(KMH_PER_MS)).cast("double"), F.lit(p["exponent"]))
    felt = k["base"] + k["temperature"] * t - k["wind"] * blow + k["both"] * t * blow
    cold = (col(temperature) <= p["max_temperature"]) & (col(wind) > exact(p["min_wind"]))
    return F.when(cold, felt).otherwise(t)


def comfort_index(temperature, humidity, wind) -> Column:
    """0 to 100: full marks in the ideal band, less with distance from its centre."""
    t, h, w = col(temperature), col(humidity), col(wind)

    def inside(band) -> Column:
        return t.between(*band["temperature"]) & h.between(*band["humidity"]) & (w < band["wind_below"])

    def less(score, penalty) -> Column:
        return (
            F.lit(score)
            - F.abs(t - IDEAL_POINT["temperature"]) * exact(penalty["temperature"])
            - F.abs(h - IDEAL_POINT["humidity"]) * exact(penalty["humidity"])
            - w * exact(penalty["wind"])
        )

    outside = F.greatest(F.lit(OUTSIDE["floor"]), less(OUTSIDE["score"], OUTSIDE_PENALTY))
    return (
        F.when(inside(IDEAL_BAND), F.lit(IDEAL_BAND["score"]))
        .when(inside(WIDE_BAND), less(WIDE_BAND["score"], WIDE_PENALTY))
        .otherwise(outside)
    )


def comfort_category(index, steps=COMFORT_STEPS) -> Column:
    return at_least(index, steps, COMFORT_REST)


def linear_comfort(temperature, humidity, wind, weights=LINEAR_COMFORT) -> Column:
    t, h, w = (col(c).cast("double") for c in (temperature, humidity, wind))
    return t * weights["temperature"] + h * weights["humidity"] - w * weights["wind"]


def zscore(x, mean, stddev) -> Column:
    return F.try_divide(col(x) - col(mean), col(stddev))


def severity(z, steps=SEVERITY_STEPS) -> Column:
    """Class of the absolute z-score; a missing score is normal."""
    return above(F.abs(col(z)), steps, SEVERITY_REST)
