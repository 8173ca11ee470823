"""Numeric column expressions: coercion, rounding, shrinkage, bands.

All helpers build Catalyst expressions, so they stay inside whole-stage
codegen and never leave the JVM.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal number, optional sign and exponent. Text such as "10d",
# "1,000" or "€10M" is not a number and becomes NULL (Spark's cast would
# accept "10d" as a double literal).
NUMERIC_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Words that mean "missing" in a text export, besides the empty string.
NULL_WORDS = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "#N/A", "<NA>", "-nan", "n/a")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN -> NULL. Spark orders NaN above every number; the engine never keeps it."""
    c = _c(c)
    return F.when(~F.isnan(c), c)


def to_number(c) -> Column:
    """Safe numeric coercion. Numbers pass, bad text and NaN become NULL."""
    c = _c(c)
    s = F.trim(c.cast("string"))
    return F.when(s.rlike(NUMERIC_RE), nan_to_null(s.try_cast("double")))


def null_words(c, words: Sequence[str] = NULL_WORDS) -> Column:
    """Text column with the usual missing-value words mapped to NULL."""
    c = _c(c)
    return F.when(~F.trim(c).isin(list(words)), c)


def round_half_even(c, n: int = 0) -> Column:
    """Round the scaled binary value half-to-even: ``rint(x*10^n)/10^n``.

    Same result as a vectorised ``round`` in numpy/pandas; Spark's ``round`` is
    HALF_UP on the decimal form and differs on ties such as 0.25.
    """
    c = _c(c)
    if n == 0:
        return F.rint(c)
    scale = float(10 ** n)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def r9(c) -> Column:
    """Round a derived double to 9 decimals so results do not depend on summation order."""
    return round_half_even(c, 9)


def clip(c, lo: float, hi: float) -> Column:
    return F.least(F.greatest(_c(c), F.lit(lo)), F.lit(hi))


def shrink(value, weight, target: float = 0.5) -> Column:
    """Pull ``value`` toward ``target`` by a weight clipped to [0, 1].

    NULL value counts as the target, NULL weight as 0 (full shrink).
    """
    w = F.coalesce(clip(weight, 0.0, 1.0), F.lit(0.0))
    return F.lit(target) + (F.coalesce(_c(value), F.lit(target)) - F.lit(target)) * w


def attempts(volume_per90, minutes) -> Column:
    """Season attempts behind a percentage, from its per-90 volume."""
    return _c(volume_per90) * _c(minutes) / F.lit(90.0)


def evidence(minutes, full_season: float = 1800.0) -> Column:
    """``round(sqrt(min(1, minutes/full)), 3)``, rounded before use."""
    return round_half_even(F.sqrt(F.least(F.lit(1.0), _c(minutes) / F.lit(float(full_season)))), 3)


def flip(pct, lower_is_better) -> Column:
    """``1 - pct`` where lower is better."""
    return F.when(_c(lower_is_better), F.lit(1.0) - _c(pct)).otherwise(_c(pct))


def blend(score, strength, weight: float = 0.35) -> Column:
    """X11: ``((score/100)*(1-w) + (strength/100)*w) * 100``, NULL if strength is NULL."""
    s = _c(strength)
    return F.when(s.isNotNull(),
                  ((_c(score) / F.lit(100.0)) * F.lit(1.0 - weight)
                   + (s / F.lit(100.0)) * F.lit(weight)) * F.lit(100.0))


def bucketize(c, edges: Sequence[float], labels: Sequence[str], other: str | None = "nan") -> Column:
    """Right-closed bins ``(e0, e1] -> labels[0]`` ...; outside -> ``other``.

    Not ``ml.Bucketizer``, which is left-closed.
    """
    c = _c(c)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (c > F.lit(float(lo))) & (c <= F.lit(float(hi)))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(other))


def null_if_nonpositive(c) -> Column:
    """Zero (or less) means missing."""
    c = _c(c)
    return F.when(c > 0, c)


def safe_div(a, b) -> Column:
    """Division that gives NULL instead of raising on a zero divisor (ANSI on)."""
    return F.try_divide(_c(a), _c(b))
