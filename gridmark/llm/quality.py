"""Quality rules whose cutoffs keep the false rejection of good documents within a stated risk.

Each rule is a ratio that is high in bad texts, with a fixed grid of cutoffs. For every stratum
(language), rule and cutoff, the labelled documents give n good ones, k of which the rule would
reject. The cutoff is admissible if the exact binomial probability of at most k rejections among
n, were the true rate `risk / rules`, is at most `level / tests`, tests being all strata, rules and cutoffs
(Bonferroni); that is the exact upper bound of the rate lying below its share of the risk. So, with
probability 1 - level, no stratum loses more than `risk` of its good documents to all rules
together. Of the admissible cutoffs the one is used that catches most bad documents, a lost good one
counting against COST of them, and among equals the highest; where there are too few labels none is
admissible, and the rule rejects nothing.

Defined results: a null text has no words and fails the base rule; a null language is a stratum of its
own; labels that are null are ignored, several labels of one document count as bad if one is; repeated
rows are judged alike; an empty table gives no rows; columns beside those used are kept as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmark.llm import bit_filter, worker_memory
from gridmark.llm.tables import slices, utf8_column
from gridmark.llm.word_hashes import TextWords, mix, repeated, run_hashes
from gridmark.session import materialize

RISK, LEVEL = 0.05, 0.05
COST = 5  # bad documents that must be caught for each good one that is lost
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
BROADCAST_STRATA = 10_000
SLICE = 1 << 20  # bytes of text counted together
GRID = 20  # cutoffs of a rule: 1/20, 2/20, ... of its largest sensible value

COUNTS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_upper n_letters n_shouts"
).split()
# A rule: counted thing, what it is a share of, and the largest cutoff of its grid.
RULES: dict[str, tuple[str, str, float]] = {
    "symbols": ("n_symbols", "word_chars", 0.5),
    "duplicate_lines": ("n_dup_lines", "n_lines", 1.0),
    "repeated_words": ("n_repeat_words", "n_words", 1.0),
    "capitals": ("n_upper", "n_letters", 1.0),
    "exclamations": ("n_shouts", "n_words", 1.0),
}

_SYMBOL, _UPPER, _LETTER, _SHOUT, _HEAD = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_SHOUT[list(b"!?")] = True
_HEAD[:0x80] = _HEAD[0xC0:] = True  # first bytes of code points


def count_features(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The COUNTS of each text, one row a count."""
    words = TextWords(raw, bounds)
    of_text = np.repeat(np.arange(words.n_texts), words.counts).astype(np.uint64)
    hashes, whole = words.windows(5)
    n = len(hashes)
    at = np.flatnonzero(whole)
    twice, _ = repeated(hashes[at] ^ mix(of_text[:n][at] + np.uint64(1)))
    edges = np.zeros(len(of_text) + 1, np.int64)
    np.add.at(edges, at[twice], 1)
    np.add.at(edges, at[twice] + 5, -1)
    covered = np.cumsum(edges[:-1]) > 0

    # Lines: runs between line ends, cut at the ends of texts, too.
    cuts = np.unique(np.concatenate([np.flatnonzero(raw == 10) + 1, bounds]))
    starts, ends = cuts[:-1], cuts[1:]
    text = np.searchsorted(bounds, starts, side="right") - 1
    ends = ends - ((raw[ends - 1] == 10) & (ends > starts)) if len(starts) else ends
    inside = np.concatenate([[0], np.cumsum(words.inside)])
    worded = inside[ends] > inside[starts]
    starts, ends, text = starts[worded], ends[worded], text[worded]
    lengths = ends - starts
    in_line = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    _, again = repeated(run_hashes(raw[in_line], lengths) ^ mix(text.astype(np.uint64) + np.uint64(1)))
    return np.stack([
        words.counts,
        words.per_text(words.inside & _HEAD[raw]),
        words.per_text(_SYMBOL[raw]),
        np.bincount(text[again], minlength=words.n_texts),
        words.per_text_of_words(covered),
        np.bincount(text, minlength=words.n_texts),
        words.per_text(_UPPER[raw]),
        words.per_text(_LETTER[raw]),
        words.per_text(_SHOUT[raw]),
    ]).astype(np.int64)


def counts_of(text: Column) -> Column:
    """The COUNTS of a text as a struct. Only texts go to Python; the other columns of their rows stay where they are."""
    kinds = T.StructType([T.StructField(name, T.LongType()) for name in COUNTS])

    @F.arrow_udf(kinds)
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker_memory.claim("quality")
        for texts in batches:
            parts = slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", SLICE)
            found = [np.zeros((len(COUNTS), 0), np.int64), *[count_features(*utf8_column(part.column("text"))) for part in parts]]
            yield pa.StructArray.from_arrays([pa.array(v) for v in np.concatenate(found, axis=1)], names=COUNTS)

    # Filters on the counts must not evaluate them once more.
    return counted.asNondeterministic()(text)


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Two columns: `row`, a struct of all given columns, and `counts`, a struct of the COUNTS."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return packed.select("row", counts_of(F.col("row")[text]).alias("counts"))


def ratio(counts: Column, rule: str) -> Column:
    part, whole, _ = RULES[rule]
    return counts[part] / F.greatest(counts[whole], F.lit(1))


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])


def log_binomial_tail(k: int, n: int, p: float) -> float:
    """Natural logarithm of P(X <= k) for X binomial(n, p), summed exactly term by term."""
    if k >= n:
        return 0.0
    i = np.arange(k + 1)
    steps = np.log((n - i[:-1]) / (i[:-1] + 1.0)) + math.log(p) - math.log1p(-p)
    terms = n * math.log1p(-p) + np.concatenate([[0.0], np.cumsum(steps)])
    top = terms.max()
    return float(top + math.log(np.exp(terms - top).sum()))


def risk_controlled_cutoffs(features: DataFrame, labels: DataFrame, strata: int, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """stratum, cutoffs: a map from rule to its cutoff.

    features(doc_id, stratum, counts) of the labelled documents at least; strata: how many all documents have. Documents are first counted by stratum, rule, grid cell and
    label, so a stratum with a third of all rows is a few hundred numbers.
    """
    judged = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = features.where(~base_failed(F.col("counts"))).join(judged, "doc_id")
    cells = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.least(F.lit(GRID), F.ceil(ratio(F.col("counts"), rule) / (top / GRID))).cast("int").alias("cell"))
        for rule, (_, _, top) in RULES.items()
    ])
    table = (
        labelled.select("stratum", (F.col("quality") > 0).alias("good"), F.explode(cells).alias("c"))
        .groupBy("stratum", "c.rule", "c.cell").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    )
    bound = math.log(level / max(1, strata * len(RULES) * GRID))

    def best_cutoff(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        good, bad = (
            np.bincount(rows["cell"].to_numpy(), weights=rows[name].to_numpy(), minlength=GRID + 1).astype(np.int64)
            for name in ("good", "bad")
        )
        n, best, found = int(good.sum()), 0, []
        for c in range(GRID - 1, 0, -1):  # cutoff c rejects the cells above c
            lost, caught = int(good[c + 1 :].sum()), int(bad[c + 1 :].sum())
            if n and caught - COST * lost > best and log_binomial_tail(lost, n, risk / len(RULES)) <= bound:
                best, found = caught - COST * lost, [c * RULES[key[1]][2] / GRID]
        return pd.DataFrame({"stratum": key[0], "rule": key[1], "cutoff": pd.Series(found, dtype=float)})

    chosen = table.groupBy("stratum", "rule").applyInPandas(best_cutoff, "stratum string, rule string, cutoff double")
    return chosen.groupBy("stratum").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "cutoff")))).alias("cutoffs"))


def rejected(counts: Column, cutoffs: Column) -> Column:
    """True if a rule with a cutoff finds its ratio above it (in the cells of the grid)."""
    hits = [
        F.coalesce(F.ceil(ratio(counts, rule) / (top / GRID)) > F.round(cutoffs[rule] / (top / GRID)), F.lit(False))
        for rule, (_, _, top) in RULES.items()
    ]
    return F.greatest(*hits)


def stratum_of(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def _strata(narrow: DataFrame) -> int:
    return narrow.select("stratum").distinct().count()


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """doc_id, counts, base_failed, kept of every document."""
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", stratum_of(F.col(stratum)).alias("stratum"))
    counted = with_counts(narrow).select("row.doc_id", "row.stratum", "counts")
    features = materialize(counted)
    cutoffs = risk_controlled_cutoffs(features, labels, _strata(narrow), risk, level)
    failed = base_failed(F.col("counts"))
    return features.join(cutoffs, "stratum", "left").select(
        "doc_id", "counts", failed.alias("base_failed"), (~failed & ~rejected(F.col("counts"), F.col("cutoffs"))).alias("kept")
    )


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """The documents that are kept, with the columns they came with."""
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", stratum_of(F.col(stratum)).alias("stratum"))
    judged = labels.select("doc_id", "quality")
    # Only labelled documents are needed for the cutoffs. Their counts meet the labels, texts are not shuffled for that.
    some, _ = bit_filter.split(narrow, "doc_id", judged.select("doc_id"))
    strata = with_counts(some).select("row.doc_id", "row.stratum", "counts")
    number = _strata(narrow)
    cutoffs = materialize(risk_controlled_cutoffs(materialize(strata), judged, number, risk, level))
    # One row a stratum; a few kilobytes in many small files would pass for too much to broadcast, and texts be shuffled.
    cutoffs = F.broadcast(cutoffs) if number <= BROADCAST_STRATA else cutoffs
    counts = F.col("counts")
    rows = with_counts(docs).withColumn("stratum", stratum_of(F.col(f"row.{stratum}")))
    kept = rows.join(cutoffs, "stratum", "left").where(~base_failed(counts) & ~rejected(counts, F.col("cutoffs")))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
