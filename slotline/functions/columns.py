"""Column expressions: rounding, clipping, banding, calendar parts and scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotline import fixed


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def slot_round(ts, minutes: int = fixed.SLOT_MINUTES) -> Column:
    """Nearest slot start; a tie goes to the even slot of the epoch grid.

    ``rint`` is half-even and stays a primitive double operation in generated code.
    """
    width = minutes * 60_000_000
    micros = F.unix_micros(as_column(ts).cast("timestamp"))
    return F.timestamp_micros((F.rint(micros / F.lit(float(width))).cast("long") * F.lit(width)))


def half_even(value) -> Column:
    """Round to a whole number, ties to even."""
    return F.rint(as_column(value))


def floor_at(value, low: float = 0.0) -> Column:
    """Lower clip that leaves null alone (``greatest`` would not)."""
    c = as_column(value)
    return F.when(c < low, F.lit(low)).otherwise(c)


def clip(value, low: float = 0.0, high: float = 1.0) -> Column:
    """Two-sided clip that leaves null alone."""
    c = as_column(value)
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def nan_to_null(value) -> Column:
    return F.nanvl(as_column(value).cast("double"), F.lit(None).cast("double"))


def ratio(top, bottom) -> Column:
    """Division that yields null for a zero denominator."""
    return F.try_divide(as_column(top).cast("double"), as_column(bottom).cast("double"))


def at_least_one(value) -> Column:
    """Denominator guard: values below 1 count as 1."""
    c = as_column(value).cast("double")
    return F.when(c < 1.0, F.lit(1.0)).otherwise(c)


def ordinal(value, levels: dict[str, int], default: int = fixed.ORDINAL_DEFAULT) -> Column:
    """Case-insensitive level of a word; unknown or null gives ``default``."""
    word = F.lower(as_column(value))
    out = None
    for name, level in levels.items():
        out = F.when(word == name, level) if out is None else out.when(word == name, level)
    return out.otherwise(default).cast("int")


def band(value, edges: list[float], labels: list[str], outside: str = fixed.NO_BAND) -> Column:
    """Right-closed bands with the lowest edge included; null or outside gives ``outside``."""
    c = as_column(value).cast("double")
    out = F.when(c.isNull() | F.isnan(c) | (c < edges[0]), F.lit(outside))
    for edge, label in zip(edges[1:], labels):
        out = out.when(c <= edge, F.lit(label))
    return out.otherwise(F.lit(outside))


def utilization_band(value) -> Column:
    return band(value, fixed.UTILIZATION_EDGES, fixed.UTILIZATION_LABELS)


def demand_regime(value) -> Column:
    return band(value, fixed.REGIME_EDGES, fixed.REGIME_LABELS)


def risk_band(value) -> Column:
    return band(value, fixed.RISK_EDGES, fixed.RISK_LABELS)


def risk_band_total(value) -> Column:
    """The live variant: no value is outside, the last label is open-ended."""
    c = as_column(value)
    out = None
    for edge, label in zip(fixed.RISK_EDGES[1:-1], fixed.RISK_LABELS):
        out = F.when(c <= edge, label) if out is None else out.when(c <= edge, label)
    return out.otherwise(fixed.RISK_LABELS[-1])


def capacity_pressure(queue, capacity) -> Column:
    return as_column(queue).cast("double") / at_least_one(capacity)


def stress_index(utilization, traffic_level, pressure, bounded: bool = True) -> Column:
    w_use, w_traffic, w_pressure = fixed.STRESS_WEIGHTS
    raw = (
        w_use * as_column(utilization)
        + w_traffic * as_column(traffic_level) / 2
        + w_pressure * as_column(pressure)
    )
    return clip(raw) if bounded else raw


def calendar_columns(slot, minutes: int = fixed.SLOT_MINUTES) -> dict[str, Column]:
    """Calendar parts and their cyclical encodings."""
    t = as_column(slot)
    hour, weekday = F.hour(t), F.weekday(t)
    hour_angle = hour * (2 * math.pi) / 24
    weekday_angle = weekday * (2 * math.pi) / 7
    return {
        "date": F.date_format(t, "yyyy-MM-dd"),
        "month": F.month(t),
        "day": F.dayofmonth(t),
        "day_of_week": weekday,
        "day_name": F.date_format(t, "EEEE"),
        "is_weekend": (weekday >= 5).cast("int"),
        "hour": hour,
        "minute": F.minute(t),
        "slot_index": ((hour * 60 + F.minute(t)) / minutes).cast("int"),
        "hour_sin": F.sin(hour_angle),
        "hour_cos": F.cos(hour_angle),
        "dow_sin": F.sin(weekday_angle),
        "dow_cos": F.cos(weekday_angle),
    }


def free_spaces(capacity, predicted) -> Column:
    """Whole free spaces left at a predicted utilization."""
    return half_even(as_column(capacity) * (1 - clip(predicted)))


def score_columns(
    free_ratio, predicted, pressure, width, upper, bounded: bool = True
) -> dict[str, Column]:
    """The four objective scores of a forecast."""
    ratio_, use = as_column(free_ratio), as_column(predicted)
    load, spread = as_column(pressure), as_column(width)
    if bounded:
        load, spread = clip(load), clip(spread)
    b = fixed.BALANCED_WEIGHTS
    c = fixed.CONGESTION_WEIGHTS
    return {
        "balanced_score": b[0] * ratio_ + b[1] * (1 - use) + b[2] * (1 - load) + b[3] * (1 - spread),
        "low_risk_score": 1 - as_column(upper),
        "low_congestion_score": c[0] * (1 - load) + c[1] * (1 - use),
        "max_availability_score": ratio_,
    }


def anomaly_reason(queue="queue_length", utilization="utilization", gap="spatial_utilization_gap",
                   pressure="capacity_pressure") -> Column:
    cuts = fixed.REASON_CUTS
    return (
        F.when(
            (as_column(queue) >= cuts["queue"]) & (as_column(utilization) >= cuts["utilization"]),
            fixed.REASON_QUEUE,
        )
        .when(as_column(gap) >= cuts["gap"], fixed.REASON_SPATIAL)
        .when(as_column(pressure) >= cuts["pressure"], fixed.REASON_PRESSURE)
        .otherwise(fixed.REASON_OTHER)
    )


def drift_level(psi, labels=fixed.DRIFT_LEVELS) -> Column:
    """One threshold rule, two vocabularies (report levels, operational severities)."""
    c = as_column(psi)
    low, high = fixed.DRIFT_CUTS
    return F.when(c >= high, labels[2]).when(c >= low, labels[1]).otherwise(labels[0])


def low_availability(spaces="predicted_available_spaces_1h", free_ratio="predicted_free_ratio") -> Column:
    return (as_column(spaces) <= fixed.LOW_SPACES) | (as_column(free_ratio) <= fixed.LOW_FREE_RATIO)
