"""Values that may be unavailable: null with a reason, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def measure(value: Column, reason: Column | str, units: str | None = None, meaning: str | None = None) -> Column:
    """A measure struct: available where ``value`` is finite, else null with the reason."""
    value = F.when(finite(value), value)
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(
        value.alias("value"), F.when(value.isNotNull(), "available").otherwise("unavailable").alias("availability"), F.when(value.isNull(), reason).alias("reason"),
        F.lit(units).cast("string").alias("units"), F.lit(meaning).cast("string").alias("meaning"),
    )


def relative_difference(value: Column, baseline: Column) -> Column:
    """(value - baseline) / baseline; null where either is missing or the baseline is zero."""
    return F.try_divide(value - baseline, baseline)


def relative_difference_reason(value: Column, baseline: Column) -> Column:
    return F.when(value.isNull() | baseline.isNull(), "one of the compared values is unavailable").when(baseline == 0, "baseline value is zero, relative difference is undefined")


def parse_rate(text: Column) -> Column:
    """Frames per second of '30000/1001' or '25'; null for zero, a zero denominator, or no number."""
    parts = F.split(F.trim(text), "/")
    top = F.get(parts, F.lit(0)).try_cast("double")
    low = F.when(F.size(parts) > 1, F.get(parts, F.lit(1)).try_cast("double")).otherwise(1.0)
    return F.nullif(F.try_divide(top, low), F.lit(0.0))


def snap_rotation(degrees: Column) -> Column:
    """The multiple of 90 nearest to an angle (halves to even), within 0 to 270."""
    return (F.pmod(F.rint(degrees / 90), F.lit(4.0)) * 90).cast("int")


def target_size(width: Column, height: Column, long_side: int) -> tuple[Column, Column]:
    """Size with the long side at most ``long_side``; never larger than the source, one pixel at least."""
    s = F.least(F.lit(1.0), F.lit(float(long_side)) / F.greatest(width, height))
    return F.greatest(F.lit(1.0), F.rint(width * s)).cast("int"), F.greatest(F.lit(1.0), F.rint(height * s)).cast("int")
