"""Numeric columns: rounding, clamping, the review score, code decoding."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnOrName, _c


def round_half_up(c: ColumnOrName, dp: int) -> Column:
    """ROUND with halves away from zero; exact when the input is decimal."""
    return F.round(_c(c), dp)


def or_default(c: ColumnOrName, value) -> Column:
    return F.coalesce(_c(c), value if isinstance(value, Column) else F.lit(value))


def as_int(pred: Column) -> Column:
    """Boolean as 0/1 so it can be summed, averaged or used in arithmetic."""
    return pred.cast("int")


def clip(c: ColumnOrName, lo=None, hi=None) -> Column:
    x = _c(c)
    if hi is not None:
        x = F.least(x, F.lit(hi) if not isinstance(hi, Column) else hi)
    if lo is not None:
        x = F.greatest(x, F.lit(lo) if not isinstance(lo, Column) else lo)
    return x


def review_score(rating: ColumnOrName, job_sat: ColumnOrName, env_sat: ColumnOrName,
                 wlb: ColumnOrName) -> Column:
    """60 % from the 1-4 rating, 40 % from the three 1-4 mood scores, 2 dp.

    Computed in exact decimals: rating*15 + (js+es+wlb)*10/3.  The third
    decimal is always 0, 3 or 6, so there is never a half to round.
    """
    mood = (_c(job_sat) + _c(env_sat) + _c(wlb)).cast("decimal(10,0)")
    exact = _c(rating).cast("decimal(10,0)") * 15 + mood * 10 / 3
    return F.round(exact, 2).cast("decimal(5,2)")


def decode(c: ColumnOrName, mapping: dict) -> Column:
    """Literal code -> label lookup (small fixed maps only)."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.create_map(*pairs)[_c(c)]


# The labels the entry forms show for the coded scales.
EDUCATION_LEVELS = {1: "Below college", 2: "College", 3: "Bachelor's", 4: "Master's", 5: "Doctorate"}
RATING_LABELS = {1: "1 - Low", 2: "2 - Good", 3: "3 - Excellent", 4: "4 - Outstanding"}
SATISFACTION_LABELS = {1: "1 - Low", 2: "2 - Medium", 3: "3 - High", 4: "4 - Very high"}
