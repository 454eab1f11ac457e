"""Rounding used at outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column) -> Column:
    """Six decimals, half away from zero (what both SQL engines do)."""
    return F.round(c, 6)


def half_even(c: Column, digits: int) -> Column:
    """Half-to-even rounding for serialised documents."""
    return F.bround(c, digits)
