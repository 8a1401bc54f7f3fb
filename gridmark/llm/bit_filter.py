"""A filter of ids in bounded room, so that rows with texts are not shuffled to find those with an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23  # no result depends on it


def _slot(column: Column) -> Column:
    return F.pmod(F.xxhash64(column.cast("bigint")), F.lit(BITS))


def split(rows: DataFrame, column: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose id may be in the first column of `ids`, all other rows); what goes round is a bit an id, BITS of them at most."""
    of_id = _slot(F.col(ids.columns[0]))
    words = ids.select(F.shiftright(of_id, 5).alias("_word"), F.expr("1L").alias("_one"), (of_id % 32).cast("int").alias("_place")).groupBy("_word").agg(
        F.bit_or(F.call_function("shiftleft", F.col("_one"), F.col("_place"))).alias("_bits")
    )
    of_row = _slot(F.col(column))
    placed = rows.withColumns({"_word": F.shiftright(of_row, 5), "_place": (of_row % 32).cast("int")})
    known = placed.join(F.broadcast(words), "_word", "left")
    found = F.coalesce(F.call_function("shiftright", F.col("_bits"), F.col("_place")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return known.where(found).select(*rows.columns), known.where(~found).select(*rows.columns)
