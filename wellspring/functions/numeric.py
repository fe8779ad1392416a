"""Number helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# 52 bits (13 hexadecimal digits) fill a double's fraction, so every draw is exact.
_DRAW_BITS = (1 << 52) - 1


def round2(c: Column) -> Column:
    """Two decimals, half to even on the scaled value."""
    return F.rint(c * 100) / 100


def null_if_nan(c: Column) -> Column:
    return F.when(F.isnan(c), None).otherwise(c)


def null_if_zero(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def strict_least(*cols: Column) -> Column:
    """Smallest value, null as soon as one input is null (``least`` skips nulls)."""
    known = cols[0].isNotNull()
    for c in cols[1:]:
        known = known & c.isNotNull()
    return F.when(known, F.least(*cols))


def uniform(seed: int, *key: Column) -> Column:
    """A draw in [0, 1) fixed by the key, so it survives re-partitioning and retries."""
    digits = F.substring(F.md5(F.concat_ws("-", F.lit(seed), *key)), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(_DRAW_BITS + 1))


def tidy(c: Column, digits: int = 6) -> Column:
    """Rounded for comparison between engines; adding zero removes a negative zero."""
    return F.round(c, digits) + F.lit(0.0)
