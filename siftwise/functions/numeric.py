"""Numeric helpers shared by metric operators.

Rounding is applied to ``x * 10^d`` with an integer target so that a value is
rounded the same way whichever engine holds the identical double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def round_half_even(col, digits: int) -> Column:
    """Banker's rounding to ``digits`` decimals (Python/numpy ``round``)."""
    s = float(10 ** digits)
    return F.bround(_c(col) * s, 0) / s


def round_fixed(col, digits: int = 6) -> Column:
    """Half-away-from-zero rounding used for comparable raw metric values."""
    s = float(10 ** digits)
    return F.round(_c(col) * s, 0) / s


def safe_div(num, den) -> Column:
    """``num / den`` or 0 when ``den`` is 0 (never raises under ANSI mode)."""
    n, d = _c(num), _c(den)
    return F.when(d == 0, F.lit(0.0)).otherwise(n.cast("double") / d.cast("double"))


def null_div(num, den) -> Column:
    """``num / den`` or NULL when ``den`` is 0."""
    n, d = _c(num), _c(den)
    return F.when(d == 0, F.lit(None).cast("double")).otherwise(n.cast("double") / d.cast("double"))


def f1(p, r) -> Column:
    """Harmonic mean ``2pr/(p+r)``, 0 when both are 0."""
    p, r = _c(p), _c(r)
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * (p * r) / (p + r))
