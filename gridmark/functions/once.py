"""Evaluating shared expressions once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later steps read many times.

    The optimiser copies the expression behind an alias into every filter that
    uses it, so a parsed token or a clamped edge would be evaluated, and its code
    generated, dozens of times. Here a projection evaluates everything together,
    sharing common parts, and a one-row generator hands over finished values that
    no later step can be merged with. Both are row-local. The generator is an outer one: from
    a plain one the optimiser infers a filter on the array's size, which would evaluate all of it once more.
    """
    fields = [column.alias(name) for name, column in columns.items()]
    evaluated = df.select("*", F.array(F.struct(*fields)).alias("_once"))
    return evaluated.select(*df.columns, F.inline_outer("_once"))
