"""Numeric expressions."""

from __future__ import annotations

import sys

from pyspark.sql import Column, functions as F

# A value this close below a half-way point counts as half-way, so that binary
# representation error cannot flip a rounded figure between two summation orders.
HALF_TOLERANCE = 1e-6
SMALLEST_NORMAL = sys.float_info.min


def to_number(c: Column) -> Column:
    """Double, null when it does not parse; NaN and infinities count as missing."""
    x = c.try_cast("double")
    return F.when(F.abs(x) < F.lit(float("inf")), x)  # NaN counts as larger than any number


# From here on a double holds no fraction, so scaled values this large are already rounded.
WHOLE_FROM = float(2 ** 53)


def round_half_up(c: Column, digits: int) -> Column:
    """Rounded half away from zero; values without a digit to round, infinities and NaN stay as they are."""
    scale = float(10 ** digits)
    x = c.cast("double")
    rounded = F.signum(x) * F.floor(F.abs(x) * scale + (0.5 + HALF_TOLERANCE)).cast("double") / scale
    return F.when(F.abs(x) * scale < WHOLE_FROM, rounded).otherwise(x)


def log1p_floor0(c: Column) -> Column:
    """log(1 + max(x, 0)); missing stays missing (``greatest`` alone would skip the null)."""
    return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0))))


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def ratio_if_positive(num: Column, den: Column) -> Column:
    """num / den for den > 0, else null."""
    return F.when(den > 0, num / den)


def ratio_to_magnitude(num: Column, den: Column) -> Column:
    """num / abs(den), 0 when undefined."""
    return F.coalesce(num / F.nullif(F.abs(den), F.lit(0.0)), F.lit(0.0))


def percent_of(part: Column, whole: Column) -> Column:
    return round_half_up(part.cast("double") * 100.0 / whole, 2)


def bool_to_int(c: Column) -> Column:
    return c.cast("int")


def neg_log10(p: Column) -> Column:
    """-log10 with p clipped at the smallest normal double (about 307.65)."""
    return -F.log10(F.when(p.isNotNull(), F.greatest(p, F.lit(SMALLEST_NORMAL))))
