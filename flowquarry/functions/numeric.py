"""Scalar helpers: safe numbers, rounding and ordinal severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowquarry.schema import SEVERITIES


def is_finite(c: Column) -> Column:
    """True for a number that is neither NaN nor infinite (null stays null)."""
    return ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def null_if_not_finite(c: Column) -> Column:
    """NaN and both infinities become null."""
    return F.when(is_finite(c), c)


def nan_to_num(c: Column) -> Column:
    """Null, NaN and both infinities become 0."""
    return F.coalesce(null_if_not_finite(c), F.lit(0.0))


def to_number(c: Column) -> Column:
    """Text to double; what does not parse becomes null. Blanks around a number are ignored."""
    return c.try_cast("double")


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` with 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def harmonic(a: Column, b: Column) -> Column:
    """Harmonic mean, 0 when both parts are 0."""
    return ratio(F.lit(2.0) * a * b, a + b)


def exact_round(x: Column, digits: int) -> Column:
    """Round the binary value itself, ties to even: 33.45 (stored a hair above) gives 33.5.

    Spark's own rounding looks at the shortest decimal spelling, where 33.45 is a tie. Here the
    product with 2*10^digits is formed with its rounding error, so the side of the tie is known.
    """
    step = float(2 * 10 ** digits)

    def place(v: Column) -> Column:
        high = v * 134217729.0 - (v * 134217729.0 - v)
        y = v * step
        error = (high * step - y) + (v - high) * step
        m = F.rint(y)
        side = (y - m) + error
        up, down = (m + 1) / 2, (m - 1) / 2
        n = (F.when(m % 2 == 0, m / 2).when(side > 0, up).when(side < 0, down)
             .when(up % 2 == 0, up).otherwise(down))
        return n / float(10 ** digits)
    return F.element_at(F.transform(F.array(x.cast("double")), place), 1)


def severity_name(level: Column) -> Column:
    """0..3 to LOW..CRITICAL, capped at both ends."""
    capped = F.least(F.greatest(level.cast("int"), F.lit(0)), F.lit(len(SEVERITIES) - 1))
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), capped + 1)


def upgrade(base: Column, *reasons: Column) -> Column:
    """Ordinal severity plus one step per true reason; null reasons do not count."""
    level = base
    for r in reasons:
        level = level + F.coalesce(r, F.lit(False)).cast("int")
    return F.least(level, F.lit(len(SEVERITIES) - 1))


def parse_iso(c: Column) -> Column:
    """ISO timestamp text to timestamp, null when malformed."""
    return F.try_to_timestamp(c.cast("string"))
