"""Deterministic, exactly sized dataset splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmark.config import SplitRatio
from gridmark.operators.ranking import cut_points, hash_order

# Strata are combinations of enumerated values (two domains, negative or not),
# so a table with one row per stratum is tiny; see ``max_strata``.
MAX_STRATA = 1_000


def _half_even(total: Column, share: float) -> Column:
    return F.rint(total * F.lit(share)).cast("bigint")


def _floor(total: Column, share: float) -> Column:
    return F.floor(total * F.lit(share)).cast("bigint")


def _checked(table: DataFrame, limit: int) -> DataFrame:
    """Broadcast a small table whose row count is checked when the query runs."""
    rows = table.agg(F.count("*")).scalar()
    fits = F.when(rows <= limit, F.lit(True)).otherwise(
        F.raise_error(F.lit(f"more than {limit} strata: raise max_strata or pass None"))
    )
    return F.broadcast(table.filter(fits))


def assign_splits(
    samples: DataFrame,
    strata: list[str],
    key: str,
    ratios: SplitRatio = SplitRatio(),
    seed: int = 42,
    rounding: str = "half_even",
    tie: str | None = None,
    max_strata: int | None = MAX_STRATA,
) -> DataFrame:
    """Add ``split`` (train, val, test) with exact sizes in every stratum.

    Rows are ordered by a seeded hash of ``key`` (then ``tie``), which must be
    unique together. ``half_even`` rounds the train and val sizes, ``floor``
    cuts them; the remainder is test. With ``max_strata`` the cut table is
    broadcast after a row-count check; ``None`` leaves the join to the optimiser.
    """
    size = {"half_even": _half_even, "floor": _floor}[rounding]
    tie = tie or key
    total = F.col("total")
    n_train = F.least(size(total, ratios.train), total)
    n_val = F.least(size(total, ratios.val), total - n_train)
    ordered = samples.withColumn("_digest", hash_order(seed, key))
    cuts = cut_points(
        ordered, strata, "_digest", tie, {"train": n_train, "val": n_train + n_val}
    )
    cuts = cuts.select(
        *[F.col(s).alias(f"_s{i}") for i, s in enumerate(strata)],
        *[F.col(c) for c in cuts.columns if c not in strata],
    )
    if max_strata is not None:
        cuts = _checked(cuts, max_strata)
    match = F.lit(True)
    for i, name in enumerate(strata):
        match = match & F.col(name).eqNullSafe(F.col(f"_s{i}"))
    place = F.struct(F.col("_digest"), F.col(tie))

    def within(cut: str) -> Column:
        limit = F.struct(F.col(f"{cut}_digest"), F.col(f"{cut}_tie"))
        return F.col(f"{cut}_digest").isNotNull() & (place <= limit)

    split = F.when(within("train"), "train").when(within("val"), "val").otherwise("test")
    return ordered.join(cuts, match, "left").select(*samples.columns, split.alias("split"))


def stratified_split(samples: DataFrame, key: str = "sha256", **options) -> DataFrame:
    """Split by domain and negative flag with half-even rounding."""
    return assign_splits(samples, ["domain", "is_negative"], key, **options)


def floor_split(files: DataFrame, by: str, key: str, **options) -> DataFrame:
    """Split the files of each class with floor cuts."""
    return assign_splits(files, [by], key, rounding="floor", **options)


def shuffled(samples: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Pseudo-random row order inside every split."""
    return samples.orderBy("split", hash_order(seed, "split", key), key)


def keep_first(
    df: DataFrame, group: str, key: str, n: int, seed: int = 42,
    max_groups: int | None = MAX_STRATA,
) -> DataFrame:
    """At most ``n`` rows per group in a seeded order, exact for any ``n``.

    ``key`` must be unique. Only bucket counts are shuffled; the rows themselves
    are filtered in place against one cut per group. Up to ``max_groups`` cuts
    are broadcast; ``None`` leaves the join to the optimiser, for any number of groups.
    """
    ordered = df.withColumn("_digest", hash_order(seed, key))
    cuts = cut_points(
        ordered, [group], "_digest", key, {"keep": F.least(F.lit(n), F.col("total"))}
    ).select(F.col(group).alias("_group"), "keep_digest", "keep_tie")
    place = F.struct(F.col("_digest"), F.col(key))
    limit = F.struct(F.col("keep_digest"), F.col("keep_tie"))
    if max_groups is not None:
        cuts = _checked(cuts, max_groups)
    return (
        ordered.join(cuts, F.col(group).eqNullSafe(F.col("_group")))
        .filter(place <= limit)
        .select(*df.columns)
    )


def sample_per_split(
    samples: DataFrame, key: str, n: int, seed: int = 42, max_groups: int | None = MAX_STRATA
) -> DataFrame:
    """``n`` pseudo-random rows of every split."""
    return keep_first(samples, "split", key, n, seed, max_groups)


def pool_union(pools: dict[str, DataFrame], domains: dict[str, str], cap: int | None = None,
               key: str = "image_path", uncapped: tuple[str, ...] = ("negative",)) -> DataFrame:
    """Union of the source pools, tagged with pool and domain, with an optional cap per pool.

    Directory order is arbitrary, so the cap keeps the first rows of a fixed
    hash order. Negative pools are never capped.
    """
    tagged = [
        pool.withColumn("pool", F.lit(name)).withColumn("domain", F.lit(domains[name]))
        for name, pool in pools.items()
    ]
    union = tagged[0]
    for other in tagged[1:]:
        union = union.unionByName(other)
    if cap is None:
        return union
    free = F.col("pool").isin(*uncapped)
    return keep_first(union.filter(~free), "pool", key, cap).unionByName(union.filter(free))


def split_leakage(samples: DataFrame, content: str = "sha256") -> DataFrame:
    """Contents that occur in more than one split; empty after an exact dedup."""
    return (
        samples.groupBy(content)
        .agg(F.count_distinct("split").alias("n_splits"), F.count("*").alias("n"))
        .filter(F.col("n_splits") > 1)
    )
