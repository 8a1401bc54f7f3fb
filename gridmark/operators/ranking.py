"""Exact ranks, order statistics and running values without one task per group.

A window over a large group would put that group into one task. Here a group is
cut into ordered buckets: bucket totals are tiny and are accumulated first, and
every row then only needs its place inside its own bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on equal keys where NULL equals NULL; the keys stay those of the left side."""
    renamed = right.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    match = F.lit(True)
    for i, key in enumerate(keys):
        match = match & F.col(key).eqNullSafe(F.col(f"_key{i}"))
    return left.join(renamed, match).drop(*[f"_key{i}" for i in range(len(keys))])


def log_bucket(value: Column) -> Column:
    """Monotone bucket of a double, fine around zero and coarse far from it.

    It only steers balance: ranks stay exact for any monotone bucketing. There
    are fewer than 70,000 buckets over the whole range of finite doubles.
    """
    scaled = F.floor(F.log2(F.abs(value) * 1024.0 + 1.0) * 32.0)
    return F.when(F.isnan(value), F.lit(1_000_000)).otherwise(
        (F.signum(value) * F.least(scaled, F.lit(999_999))).cast("int")
    )


def cumulative_counts(
    df: DataFrame, group: list[str], value: str, weights: dict[str, Column], bucket: Column,
    descending: bool = False,
) -> DataFrame:
    """Running totals over the distinct values of each group, in value order.

    Equal values form one step. Every weight ``x`` gives ``x`` (the step itself),
    ``cum_x`` (all steps up to and including it) and ``all_x`` (the whole group).
    Rows are first combined per distinct value, before any shuffle, so a value
    shared by a third of all rows costs one row per task.
    """
    names = list(weights)
    steps = (
        df.groupBy(*group, value)
        .agg(*[w.alias(n) for n, w in weights.items()])
        .withColumn("_bucket", bucket)
    )
    totals = steps.groupBy(*group, "_bucket").agg(*[F.sum(n).alias(f"_t_{n}") for n in names])
    order = F.desc if descending else F.asc
    whole = Window.partitionBy(*group)
    upto = whole.orderBy(order("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group,
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{n}").over(upto), F.lit(0)).alias(f"_o_{n}") for n in names],
        *[F.sum(f"_t_{n}").over(whole).alias(f"all_{n}") for n in names],
    )
    inside = (
        Window.partitionBy(*group, "_bucket")
        .orderBy(order(value))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = steps.select(
        "*", *[F.sum(n).over(inside).alias(f"_l_{n}") for n in names]
    )
    return null_safe_join(local, offsets, [*group, "_bucket"]).select(
        *group,
        value,
        *names,
        *[(F.col(f"_o_{n}") + F.col(f"_l_{n}")).alias(f"cum_{n}") for n in names],
        *[f"all_{n}" for n in names],
    )


def order_statistics(
    df: DataFrame, group: list[str], value: str, positions: dict[str, Column],
    extra: list[Column] | None = None,
) -> DataFrame:
    """Exact values at zero-based sorted positions of each group.

    A position is an expression of ``all_n``, the group's row count. ``extra``
    aggregates see ``value`` and its multiplicity ``n``. NULL values are not
    counted; a group without any other value has no row.
    """
    ladder = cumulative_counts(
        df.filter(F.col(value).isNotNull()), group, value, {"n": F.count("*")}, log_bucket(F.col(value))
    )
    picks = [
        F.min(F.when(F.col("cum_n") > position, F.col(value))).alias(name)
        for name, position in positions.items()
    ]
    return ladder.groupBy(*group).agg(*picks, *(extra or []))


def running_best(
    df: DataFrame, group: list[str], order: str, value: str, chunk: int = 1 << 16,
    initial: float = 0.0,
) -> DataFrame:
    """Flag rows whose value beats every earlier one of the group.

    ``order`` is an integer sequence number, unique in its group. The running
    maximum is taken per chunk of the sequence and over the chunk maxima.
    """
    keyed = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(float(chunk))).cast("bigint"))
    before = (
        Window.partitionBy(*group)
        .orderBy("_chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        keyed.groupBy(*group, "_chunk")
        .agg(F.max(value).alias("_top"))
        .select(*group, "_chunk", F.max("_top").over(before).alias("_carried"))
    )
    inside = (
        Window.partitionBy(*group, "_chunk")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    best = F.coalesce(
        F.greatest(F.col("_carried"), F.col("_local"), F.lit(initial)), F.lit(initial)
    )
    local = keyed.withColumn("_local", F.max(value).over(inside))
    return (
        null_safe_join(local, carried, [*group, "_chunk"])
        .withColumn("best_before", best)
        .withColumn("is_best", F.col(value) > F.col("best_before"))
        .drop("_chunk", "_carried", "_local")
    )


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows of each group; the limit runs before the shuffle for small ``k``."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def numbered(df: DataFrame, group: list[str], lead: str, order: list[Column], name: str, width: int = 1 << 12) -> DataFrame:
    """Row numbers of each group in an order whose first column is the integer ``lead``.

    Only rows whose ``lead`` falls in one stretch of ``width`` numbers are ranked together; the counts of earlier stretches are added.
    """
    stretch = F.floor(F.col(lead) / F.lit(float(width))).cast("bigint")
    # As fields of one value NULL equals NULL, and rows that lie by it for their ranks lie there for the join.
    cut = df.withColumn("_place", F.struct(*group, stretch.alias("_stretch")))
    earlier = Window.partitionBy(*[f"_place.{g}" for g in group]).orderBy("_place._stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy("_place").agg(F.count("*").alias("_n")).select("_place", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_place").orderBy(lead, *order))
    ranked = cut.withColumn("_rank", inside).join(before, "_place")
    return ranked.withColumn(name, F.col("_rank") + F.col("_before")).drop("_place", "_rank", "_before")


def hash_order(seed: int, *keys: str) -> Column:
    """Seeded pseudo-random order: hex digest of the seed and the key columns."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]), 256)


def hash_bucket(digest: Column) -> Column:
    """First 16 bits of a hex digest."""
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")


def cut_points(
    df: DataFrame, group: list[str], digest: str, tie: str, cuts: dict[str, Column]
) -> DataFrame:
    """Where exact rank limits fall in a hash-ordered group.

    A cut is an expression of ``total``, the group's row count: the number of
    rows that lie at or before it. The result has one row per group with
    ``<cut>_digest`` and ``<cut>_tie``, the last row inside the cut (NULL for an
    empty cut), so labelling all rows afterwards needs no rank and no shuffle.

    Only bucket counts and the rows of the few buckets that contain a cut are
    shuffled.
    """
    bucketed = df.select(*group, digest, tie, hash_bucket(F.col(digest)).alias("_bucket"))
    counts = bucketed.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*group)
    upto = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ladder = counts.select(
        *group,
        "_bucket",
        (F.sum("_n").over(upto) - F.col("_n")).alias("_before"),
        F.sum("_n").over(upto).alias("_upto"),
        F.sum("_n").over(whole).alias("total"),
    )
    for name, limit in cuts.items():
        ladder = ladder.withColumn(f"_k_{name}", limit.cast("bigint"))
    holds = {
        name: (F.col("_before") < F.col(f"_k_{name}")) & (F.col(f"_k_{name}") <= F.col("_upto"))
        for name in cuts
    }
    any_cut = F.lit(False)
    for hit in holds.values():
        any_cut = any_cut | hit
    picked = ladder.select(
        *group, "_bucket", "_before", any_cut.alias("_any"),
        *[F.when(hit, F.col(f"_k_{name}")).alias(f"_k_{name}") for name, hit in holds.items()],
    ).filter("_any")
    rank = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(digest, tie))
    inside = null_safe_join(bucketed, picked, [*group, "_bucket"]).withColumn(
        "_rank", rank + F.col("_before")
    )
    found = []
    for name in cuts:
        at = F.col("_rank") == F.col(f"_k_{name}")
        found.append(F.max(F.when(at, F.col(digest))).alias(f"{name}_digest"))
        found.append(F.max(F.when(at, F.col(tie))).alias(f"{name}_tie"))
    return inside.groupBy(*group).agg(*found)
