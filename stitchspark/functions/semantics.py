"""Cell-typing, rounding and default rules shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as a number in a text cell.
NUMERIC_TEXT = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
# Fixed value: spellings of a true flag.
TRUE_WORDS = ("1", "true", "yes")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c, default: float = 0.0, dialect: str = "sane") -> Column:
    """Text cell to double.

    ``sane``: unparsable, NaN and infinite cells take the default.
    ``strict``: unparsable cells become 0 and NaN / infinities are kept.
    ``numbers_only``: text is never parsed, only real numbers pass (see :func:`num_value`).
    """
    text = F.trim(col(c).cast("string"))
    if dialect == "numbers_only":
        return F.lit(0.0)
    parsed = F.when(text.rlike(NUMERIC_TEXT), text.try_cast("double"))
    if dialect == "strict":
        special = (
            F.when(F.lower(text).isin("nan", "+nan", "-nan"), F.lit(float("nan")))
            .when(F.lower(text).isin("inf", "+inf", "infinity", "+infinity"), F.lit(float("inf")))
            .when(F.lower(text).isin("-inf", "-infinity"), F.lit(float("-inf")))
        )
        return F.coalesce(parsed, special, F.lit(0.0))
    return num_value(parsed, default)


def num_value(c, default: float = 0.0) -> Column:
    """Typed double with null, NaN and infinity replaced by the default."""
    v = col(c).cast("double")
    # Only a real number less itself is 0; rules name many measures, and one short test of each keeps their code small.
    return F.when(v - v == 0.0, v).otherwise(F.lit(float(default)))


def flag(c) -> Column:
    """Text flag to boolean, missing is false."""
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def key_text(c) -> Column:
    """Group key as text; a missing key is the empty text."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def half_even(c, digits: int = 0) -> Column:
    """Round half to even at a number of digits."""
    scale = float(10 ** digits)
    return F.rint(col(c) * scale) / scale if digits else F.rint(col(c))


def rounded_delta(after, before, digits: int = 8) -> Column:
    """Difference rounded before it is compared, so that gates need no epsilon."""
    return half_even(col(after) - col(before), digits)


def mean0(c) -> Column:
    """Average where the empty group is 0."""
    return F.coalesce(F.avg(c), F.lit(0.0))


def clamp01(c) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(c)))


def clipped(value, threshold) -> Column:
    """Share of a threshold, in [0, 1]; a threshold of 0 or less gives 0."""
    t = F.lit(threshold) if isinstance(threshold, (int, float)) else col(threshold)
    return F.when(t <= 0, F.lit(0.0)).otherwise(clamp01(col(value) / t))


def minmax_norm(value, lo, hi, invert: bool = False, eps: float = 1e-12) -> Column:
    span = col(hi) - col(lo)
    scaled = clamp01((col(value) - col(lo)) / F.when(F.abs(span) < eps, F.lit(1.0)).otherwise(span))
    scaled = (F.lit(1.0) - scaled) if invert else scaled
    return F.when(F.abs(span) < eps, F.lit(0.0)).otherwise(scaled)
