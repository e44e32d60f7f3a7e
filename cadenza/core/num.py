"""Number conventions shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(col: Column | str, digits: int) -> Column:
    """Half-even rounding; noise far below the last digit cannot flip a tie."""
    return F.bround(F.round(F.col(col) if isinstance(col, str) else col, digits + 6), digits)


def clamp(col: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), col))


def finite(col: Column) -> Column:
    """NaN and infinities become NULL."""
    bad = F.isnan(col) | (F.abs(col) == F.lit(float("inf")))
    return F.when(~bad, col)


def js_round(col: Column, step: float = 1.0) -> Column:
    """Round half towards plus infinity on a grid of ``step``."""
    return F.floor(col / F.lit(step) + F.lit(0.5)) * F.lit(step)


def odd_window(samples: float) -> int:
    """Odd smoothing window of at least three samples."""
    return max(3, int(samples) | 1)
