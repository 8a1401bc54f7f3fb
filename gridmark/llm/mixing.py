"""Temperature mixing of sources, realised as budgeted block permutations. DataFrame functions only.

Token shares p are raised to an exponent and normalised: w ~ p ** t. At 1 the mix is as found, at 0
all sources weigh alike. The exponent is bisected to the flattest mix whose entropy is at most
`entropy` and in which no source is read more than `epochs` times; limits that no exponent meets (up to 1 if
`epochs` is given, up to 8 otherwise) give the largest exponent tried. The budget, unless given, is that at
which the largest source is read exactly once, so that nothing is dropped at exponents up to 1.

A source with a budget of e epochs gives floor(e) whole passes, each in its own order by a seeded
hash, and the front of one more. The passes of a source, one after the other, are cut into blocks in which
every source has the tokens of its weight: block b of all sources together is one mixed batch.

Running sums over a source go by ranges of its hashes, at most a few thousand rows each, so a
source with a third of all rows spreads over many tasks.

Defined results: a null source is a source of its own; null and empty texts have no tokens (a source
without any has weight 0 and is read once); rows equal in doc_id and text go together; repeated rows are copies
each; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmark.session import materialize

EPOCHS = 2.0
BLOCK_TOKENS = 1 << 20
RANGE_ROWS = 1000
STEPS = 60  # halvings of the exponent
MOST = 8.0  # largest exponent tried


def words(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def order_key(seed: int, epoch: Column) -> Column:
    """Place of a row in the order of one pass: a hash of its doc_id and text."""
    return F.xxhash64(F.lit(seed), epoch.cast("int"), F.col("doc_id"), F.col("text_hash"))


def temperature(totals: Column, entropy: float | None, epochs: float | None, budget: float | None) -> Column:
    """The bisected exponent for an array of token counts, all positive."""
    largest = F.array_max(totals)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    def powered(t: Column) -> Column:
        return F.transform(totals, lambda x: F.exp(t * F.ln(x / largest)))

    def within(t: Column) -> Column:
        raw = powered(t)
        z = total(raw)
        good = F.lit(True)
        if entropy is not None:
            good = good & (-total(F.transform(raw, lambda x: (x / z) * F.ln(x / z))) <= F.lit(entropy))
        if epochs is not None:
            tokens = F.lit(float(budget)) if budget is not None else largest * z
            read = F.zip_with(raw, totals, lambda x, n: x / z * tokens / n)
            good = good & (F.array_max(read) <= F.lit(epochs * (1 + 1e-12)))
        return good

    def halve(bounds: Column, _: Column) -> Column:
        middle = (bounds["low"] + bounds["high"]) / 2
        good = within(middle)
        return F.struct(F.when(good, bounds["low"]).otherwise(middle).alias("low"), F.when(good, middle).otherwise(bounds["high"]).alias("high"))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(MOST if epochs is None else 1.0).alias("high"))
    ends = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve)
    return F.when(within(F.lit(0.0)), F.lit(0.0)).otherwise(ends["high"])


def mixing_plan(tokens: DataFrame, entropy: float | None = None, epochs: float | None = EPOCHS, budget: int | None = None) -> DataFrame:
    """A row for each source: n, total, exponent, weight, passes (whole ones), rest (tokens of one more).

    tokens(source, tokens). The bisection holds one number for each source in one row.
    """
    sums = materialize(tokens.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("total")))
    known = sums.where(F.col("total") > 0)
    exponent = known.agg(F.array_sort(F.collect_list(F.col("total").cast("double"))).alias("totals")).select(
        temperature(F.col("totals"), entropy, epochs, budget).alias("exponent"),
        F.array_max("totals").alias("largest"), "totals",
    )
    exponent = exponent.withColumn(
        "z", F.aggregate("totals", F.lit(0.0), lambda a, x: a + F.exp(F.col("exponent") * F.ln(x / F.col("largest"))))
    ).drop("totals")
    raw = F.exp(F.col("exponent") * F.ln(F.col("total") / F.col("largest")))
    whole = F.lit(float(budget)) if budget is not None else F.col("largest") * F.col("z")
    found = exponent.select(F.struct("exponent", "largest", "z").alias("found")).scalar()  # one row
    plan = sums.withColumn("found", found).select("*", "found.*").withColumn(
        "weight", F.when(F.col("total") > 0, raw / F.col("z")).otherwise(0.0)
    )
    plan = plan.withColumn("wanted", F.when(F.col("total") > 0, F.round(F.col("weight") * whole)).otherwise(0).cast("bigint"))
    passes = F.when(F.col("total") > 0, F.floor(F.col("wanted") / F.col("total"))).otherwise(1)
    rest = F.when(F.col("total") > 0, F.col("wanted") - F.col("passes") * F.col("total")).otherwise(0)
    return materialize(
        plan.withColumn("passes", passes.cast("int")).withColumn("rest", rest.cast("bigint")).select(
            "source", "n", "total", F.coalesce("exponent", F.lit(1.0)).alias("exponent"), "weight", "wanted", "passes", "rest"
        )
    )


def token_rows(docs: DataFrame, source: str = "source") -> DataFrame:
    """doc_id, source, tokens and a hash of the text."""
    return docs.select(
        "doc_id", F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        words(F.col("text")).alias("tokens"), F.xxhash64("text").alias("text_hash"),
    )


def ordered_passes(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Every row in every pass of its source, with `key` and the tokens `before` it in that pass."""
    share = plan.select("source", "n", "total", "weight", "passes", "rest")
    times = F.col("passes") + F.when(F.col("rest") > 0, 1).otherwise(0)
    wide = rows.join(F.broadcast(share), "source") if share.count() <= 100_000 else rows.join(share, "source")
    wide = wide.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    wide = wide.withColumn("key", order_key(seed, F.col("epoch")))
    part = F.floor((F.col("key").cast("double") / F.lit(2.0**64) + 0.5) * F.ceil(F.col("n") / RANGE_ROWS)).cast("bigint")
    wide = materialize(wide.withColumn("range", part))
    ranges = wide.groupBy("source", "epoch", "range").agg(F.sum("tokens").alias("sum"))
    ahead = Window.partitionBy("source", "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("source", "epoch", "range", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "epoch", "range").orderBy("key").rangeBetween(Window.unboundedPreceding, -1)
    summed = wide.withColumn("in_range", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    return summed.join(ranges, ["source", "epoch", "range"]).withColumn("before", F.col("base") + F.col("in_range")).drop("range", "base", "in_range")


def mix(
    docs: DataFrame, seed: int = 0, block_tokens: int = BLOCK_TOKENS,
    entropy: float | None = None, epochs: float | None = EPOCHS, budget: int | None = None, source: str = "source",
) -> DataFrame:
    """doc_id, source, epoch, tokens, block and position (tokens of the source before the row) of every copy read."""
    rows = materialize(token_rows(docs, source))
    plan = mixing_plan(rows, entropy, epochs, budget)
    placed = ordered_passes(rows, plan, seed)
    read = placed.where((F.col("epoch") < F.col("passes")) | (F.col("before") < F.col("rest")))
    position = F.col("epoch") * F.col("total") + F.col("before")
    block = F.when(F.col("weight") > 0, F.floor(position / (F.col("weight") * block_tokens))).otherwise(0)
    return read.select("doc_id", "source", "epoch", "tokens", position.alias("position"), block.alias("block"))


def mixed_documents(
    docs: DataFrame, seed: int = 0, entropy: float | None = None, epochs: float | None = EPOCHS,
    budget: int | None = None, source: str = "source",
) -> DataFrame:
    """The documents with their own columns, each as often as the plan reads it.

    Texts are not shuffled: the last pass of a source ends at a known hash, one number a source.
    """
    rows = materialize(token_rows(docs, source))
    plan = mixing_plan(rows, entropy, epochs, budget)
    last = ordered_passes(rows, plan.where(F.col("rest") > 0), seed).where(
        (F.col("epoch") == F.col("passes")) & (F.col("before") < F.col("rest"))
    )
    cuts = plan.select("source", "passes").join(last.groupBy("source").agg(F.max("key").alias("cut")), "source", "left")
    cuts = materialize(cuts.select(F.col("source").alias("_source"), F.col("passes").alias("_passes"), F.col("cut").alias("_cut")))
    named = F.coalesce(docs[source].cast("string"), F.lit(""))
    key = F.xxhash64(F.lit(seed), F.col("_mix._passes"), docs["doc_id"], F.xxhash64(docs["text"]))
    small = cuts.select("_source", F.struct("_passes", "_cut").alias("_mix"))
    joined = docs.join(F.broadcast(small) if small.count() <= 100_000 else small, named == F.col("_source"))
    times = F.col("_mix._passes") + F.when(key <= F.col("_mix._cut"), 1).otherwise(0)
    columns = [docs[c] for c in docs.columns]
    return joined.where(times > 0).select(*columns, F.explode(F.sequence(F.lit(1), times)).alias("_copy")).select(*[F.col(f"`{c}`") for c in docs.columns])
