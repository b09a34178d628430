"""Scalar column functions (C1-C7, P1-P3, P13). All are native Catalyst
expressions: no Python runs per row."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference / dashboard for right results.
# Classes: 0 = no rain, 1 = light, 2 = moderate/heavy.
INTENSITY_LABELS = {0: "Sin lluvia", 1: "Ligera", 2: "Moderada/Intensa"}
# Probability bands of the dashboard ring: >= 0.7 high, >= 0.4 medium, else low.
BAND_HIGH = 0.7
BAND_MEDIUM = 0.4
# Alert levels (low, medium, high).
ALERT_LOW, ALERT_MEDIUM, ALERT_HIGH = "bajo", "medio", "alto"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def classify_precip(y, light_threshold: float) -> Column:
    """Missing → missing; == 0 → 0; <= threshold → 1; else 2.
    A negative total therefore yields 1, as in the reference."""
    y = _c(y)
    return (F.when(y.isNull(), F.lit(None).cast("int"))
            .when(y == 0, F.lit(0))
            .when(y <= F.lit(float(light_threshold)), F.lit(1))
            .otherwise(F.lit(2)))


def intensity_label(cls) -> Column:
    """Class → intensity label; unknown → NULL."""
    cls = _c(cls)
    e = F.lit(None).cast("string")
    expr = None
    for k, v in INTENSITY_LABELS.items():
        expr = (F.when(cls == k, F.lit(v)) if expr is None else expr.when(cls == k, F.lit(v)))
    return expr.otherwise(e)


def will_rain(cls) -> Column:
    """Will-rain flag (class > 0)."""
    return _c(cls) > 0


def probability_band(p) -> Column:
    """Ring colour band of a probability."""
    p = _c(p)
    return (F.when(p >= F.lit(BAND_HIGH), F.lit("high"))
            .when(p >= F.lit(BAND_MEDIUM), F.lit("medium"))
            .otherwise(F.lit("low")))


def alert_level(cls, p_rain) -> Column:
    """C4 (our decision, SURVEY §2.14-12): class 2 and P(rain) >= 0.7 → alto;
    P(rain) >= 0.4 → medio; else bajo."""
    cls, p = _c(cls), _c(p_rain)
    return (F.when((cls == 2) & (p >= F.lit(BAND_HIGH)), F.lit(ALERT_HIGH))
            .when(p >= F.lit(BAND_MEDIUM), F.lit(ALERT_MEDIUM))
            .otherwise(F.lit(ALERT_LOW)))


def alert_message(level, horizon_minutes) -> Column:
    """C4 message text: level word plus the horizon in hours (the sentences are
    fixed output values of the dashboard's data)."""
    hours = (_c(horizon_minutes) / 60).cast("int")
    lead = (F.when(_c(level) == ALERT_HIGH, F.lit("Alta"))
            .when(_c(level) == ALERT_MEDIUM, F.lit("Moderada"))
            .otherwise(F.lit("Baja")))
    when = F.when(hours == 1, F.lit("en la próxima hora.")).otherwise(
        F.concat(F.lit("en las próximas "), hours.cast("string"), F.lit(" horas.")))
    return F.concat(lead, F.lit(" probabilidad de precipitación "), when)


# --- time features (P1-P3) ---------------------------------------------------

def year(ts) -> Column:
    return F.year(_c(ts))


def hour(ts) -> Column:
    return F.hour(_c(ts))


def day_of_week(ts) -> Column:
    """Monday = 0 … Sunday = 6 (pandas ``dayofweek``)."""
    return F.weekday(_c(ts))


def month(ts) -> Column:
    return F.month(_c(ts))


def hour_sin(ts) -> Column:
    return F.sin(F.lit(2 * math.pi) * F.hour(_c(ts)) / F.lit(24.0))


def hour_cos(ts) -> Column:
    return F.cos(F.lit(2 * math.pi) * F.hour(_c(ts)) / F.lit(24.0))


# --- rounding (P13) ------------------------------------------------------------

def round_metric(x, digits: int = 4) -> Column:
    """Python ``round`` is half-to-even on the binary value: ``bround``."""
    return F.bround(_c(x), digits)


def percent(x) -> Column:
    """``Math.round(p * 100)`` for non-negative p."""
    return F.round(_c(x) * 100).cast("int")
