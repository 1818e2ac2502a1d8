"""Column expressions shared by the reports. All are JVM built-ins, no Python UDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole days between two timestamps, truncated toward zero.

    ``datediff`` would count midnights instead, so 23 hours could be one day.
    """
    return F.extract(F.lit("DAY"), later - earlier)


def whole_hours(later: Column, earlier: Column) -> Column:
    gap = later - earlier
    return F.extract(F.lit("DAY"), gap) * F.lit(24).cast("long") + F.extract(F.lit("HOUR"), gap)


def whole_seconds(later: Column, earlier: Column) -> Column:
    """Whole seconds between two timestamps. Subtraction keeps it free of the session time zone."""
    gap = later - earlier
    seconds = F.extract(F.lit("SECOND"), gap).cast("long")
    return (whole_hours(later, earlier) * 60 + F.extract(F.lit("MINUTE"), gap)) * 60 + seconds


def ratio(part: Column, whole: Column, scale: int) -> Column:
    """``part / whole`` of two whole numbers, rounded half away from zero.

    The division is done on decimals with 16 fractional digits: enough to tell a
    rounding tie from its neighbours for any count below 10^11. A zero ``whole``
    gives NULL, where ANSI mode would raise.
    """
    quotient = part.cast("decimal(22,0)") / F.nullif(whole.cast("decimal(18,0)"), F.lit(0).cast("decimal(18,0)"))
    return F.round(quotient, scale).cast("double")


def percent(part: Column, whole: Column, scale: int = 1) -> Column:
    return ratio(part.cast("decimal(20,0)") * F.lit(100), whole, scale)


def delivery_bucket(days: Column, bounds: Sequence[int]) -> Column:
    """Numbered day-range label; the last, open range also takes NULL."""
    lows = [0, *[high + 1 for high in bounds]]
    ranges = [(days <= high, f"{i}. {lows[i - 1]}-{high} days") for i, high in enumerate(bounds, start=1)]
    label = F.when(*ranges[0])
    for within, text in ranges[1:]:
        label = label.when(within, text)
    return label.otherwise(f"{len(lows)}. {lows[-1]}+ days")


def ascending(*names: str) -> list[Column]:
    """Ascending order with NULL last, the order the results are defined in."""
    return [F.asc_nulls_last(name) for name in names]


def descending(*names: str) -> list[Column]:
    """Descending order with NULL first, the order the results are defined in."""
    return [F.desc_nulls_first(name) for name in names]
