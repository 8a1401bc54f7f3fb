"""Clipping helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at_least(low: float, value: Column) -> Column:
    return F.greatest(F.lit(low), value)


def clip(value: Column, low: float, high: float) -> Column:
    return at_least(low, F.least(F.lit(high), value))
