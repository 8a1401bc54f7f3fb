"""Toxicity by a learned lexicon, misspellings included, and the words around each hit.

From one part of the labelled rows the lexicon is learned: words, and stems of words, whose documents are mostly
toxic. Words of all texts are matched by a Levenshtein automaton that is intersected with the trie of
terms, and of the frequent words behind stems. What a misspelling of a word weighs follows from the labelled documents
that hold one. Every hit is weighed by its window of words: quotation marks and reporting verbs speak for a quotation, words
of address for abuse. From another part of the labelled rows a logistic regression on these counts gives the score.

The rows to learn from are bounded (LEXICON_ROWS, FIT_ROWS, by a hash of doc_id); all else covers every text whole.

Defined results: a null or empty text has no hits and a score all the same; a null doc_id is not held out; several labels of a document
count as toxic if one is; repeated rows score alike; without usable labels every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmark.llm.lexicon_trie import Trie
from gridmark.llm.tables import slices
from gridmark.session import materialize

LEXICON_ROWS, FIT_ROWS = 30_000, 15_000
STEMS = range(3, 9)  # lengths of stems
MIN_TOXIC, MIN_ODDS, MAX_TERMS = 5, 2.0, 500
PRIOR = 2.0  # documents with a misspelling that weigh as much as the odds of the word itself
ONE_WORD = 0.85  # a stem is left to its word if that word has so much of the stem's toxic documents
WINDOW = 8
MEMORY = 1_000_000  # tokens remembered by each Python worker
THRESHOLD = 0.3

# Signs of quotation, reporting verbs, and words of address, by language.
QUOTES = "\"“”„«»‘’"
REPORTING = set(
    "said says wrote writes called calls quoted quote reported sagte schrieb nannte zitierte berichtete "
    "dit écrit appelé cité déclaré dijo escribió llamó citó informó".split()
)
ADDRESS = set("you your you're yours u du dich dir dein ihr euch tu te toi ton vous votre tú ti usted ustedes vosotros".split())
FEATURES = ("plain", "quoted", "addressed", "misspelled", "terms", "weight", "dense", "length")


_ENDS = re.compile(r"^[\W\d_]+|[\W_]+$")


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def bare(token: str) -> str:
    """Lower case, without what is not a letter at the ends; digits and signs inside stay, as misspellings."""
    return token.lower() if token.isalpha() else _ENDS.sub("", token.lower())


def _sample(rows: DataFrame, bound: int) -> DataFrame:
    """About `bound` rows at most, by a hash of doc_id."""
    n = max(1, rows.count())
    share = min(1.0, 0.95 * bound / n)
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))


def learn_lexicon(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], set[str], dict[str, float]]:
    """Terms (stems end in *) with the logarithm of the odds of their documents being toxic; the words whose misspellings count; and what those weigh.

    MAX_TERMS terms at most. Misspellings are sought of all words among them, and of the words behind stems that
    MIN_TOXIC toxic documents hold.
    """
    # Copies would give the words of one toxic text the weight of many; whole texts count once a label.
    picked = materialize(docs.join(F.broadcast(labels), "doc_id").select("text", "toxic").dropDuplicates(["text", "toxic"]))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").fill_null("").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = {bare(token) for token in set(text.split())}
                found[toxic > 0].update(w for w in words if len(w) > 2)
                found[toxic > 0].update({w[:n] + "*" for w in words for n in STEMS if len(w) >= n})
            terms = list(found[0].keys() | found[1].keys())
            columns = [pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in found)]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "clean", "toxic"])

    totals = {r["toxic"]: r["count"] for r in picked.groupBy("toxic").count().collect()}  # two rows
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return {}, set(), {}
    odds = F.ln((F.col("toxic") + 0.5) / (toxic + 1)) - F.ln((F.col("clean") + 0.5) / (clean + 1))
    counts = picked.mapInArrow(counted, "term string, clean bigint, toxic bigint").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = materialize(counts.where(F.col("toxic") >= MIN_TOXIC))
    strong = counts.where(F.col("toxic") >= max(MIN_TOXIC, toxic // 100)).withColumn("odds", odds).where(F.col("odds") >= MIN_ODDS)
    best = strong.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "term").limit(10 * MAX_TERMS).collect()
    most: dict[str, int] = {}  # of each stem, the toxic documents of its most frequent word
    for row in best:
        for n in STEMS:
            if not row["term"].endswith("*"):
                stem = row["term"][:n] + "*"
                most[stem] = max(most.get(stem, 0), row["toxic"])
    lexicon: dict[str, float] = {}
    for row in best:
        term = row["term"]
        word = term.rstrip("*")
        covered = any(word[:n] + "*" in lexicon for n in STEMS) or most.get(term, 0) >= ONE_WORD * row["toxic"]
        if not covered and len(lexicon) < MAX_TERMS:
            lexicon[term] = row["odds"]
    stems = [t for t in lexicon if t.endswith("*")]
    behind = F.lit(False)
    for n in STEMS:
        behind |= F.concat(F.substring("term", 1, n), F.lit("*")).isin([t for t in stems if len(t) == n + 1])
    frequent = counts.where(~F.endswith("term", F.lit("*")) & behind).select("term").collect() if stems else []
    misspelled = {t for t in lexicon if not t.endswith("*")} | {r["term"] for r in frequent}
    return lexicon, misspelled, _weigh_misspellings(picked, lexicon, misspelled, toxic, clean)


def _weigh_misspellings(picked: DataFrame, lexicon: dict[str, float], misspelled: set[str], toxic: int, clean: int) -> dict[str, float]:
    """Odds of the misspellings that labelled texts hold: those of the word, corrected by the documents seen."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon, misspelled)
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in (part for whole in batches for part in slices(whole, "text")):
            for text, is_toxic in zip(batch.column("text").fill_null("").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found[is_toxic > 0].update({bare(t) for t in set(text.split()) if (hit := scorer.hit(t)) and hit[1]})
        words = list(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in found)], names=["word", "clean", "toxic"])

    sums = picked.mapInArrow(near, "word string, clean bigint, toxic bigint").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    scorer, weights = Scorer(lexicon, misspelled), {}
    for row in sums.collect():  # words of at most LEXICON_ROWS rows that are near a term
        odds = scorer.match(row["word"])[2]
        share = 1 / (1 + math.exp(-odds) * clean / toxic)  # toxic ones among PRIOR documents of these odds
        seen = math.log((row["toxic"] + PRIOR * share) / toxic) - math.log((row["clean"] + PRIOR * (1 - share)) / clean)
        weights[row["word"]] = max(0.0, seen)
    return weights


class Scorer:
    """Counts of hits in a text; remembers what it found for each token."""

    def __init__(self, lexicon: dict[str, float], misspelled: set[str], weights: dict[str, float] | None = None):
        self.odds, self.weights = lexicon, weights or {}
        exact = [t for t in lexicon if not t.endswith("*") and t not in misspelled]
        self.trie = Trie(sorted(misspelled), [t[:-1] for t in lexicon if t.endswith("*")], exact)
        self.known: dict[str, tuple[str, int, float] | bool] = {}

    def term(self, word: str) -> str:
        """The term of a word of the trie: itself, or the longest stem it begins with."""
        return word if word in self.odds else next(word[:n] + "*" for n in self.trie.stem_lengths if word[:n] in self.trie.stems)

    def match(self, token: str) -> tuple[str, int, float] | bool:
        """Term, distance and odds."""
        word = bare(token)
        found = self.trie.find(word) if word else None
        if not found:
            return False
        term = self.term(found[0])
        odds = self.odds[term] / (1 + found[1])
        return term, found[1], self.weights.get(word, odds) if found[1] else odds

    def hit(self, token: str) -> tuple[str, int, float] | bool:
        """match, remembered."""
        hit = self.known.get(token)
        if hit is None:
            hit = self.match(token)
            if len(token) <= 64:
                self.known[token] = hit
        return hit

    def features(self, text: str) -> list[float]:
        tokens = text.split()
        found = list(map(self.known.get, tokens))
        if None in found:
            if len(self.known) > MEMORY:
                self.known.clear()
            for i, hit in enumerate(found):
                if hit is None:
                    found[i] = self.hit(tokens[i])
        plain = quoted = addressed = misspelled = weight = 0.0
        terms: dict[str, float] = {}
        if any(found):
            for i, hit in enumerate(found):
                if not hit:
                    continue
                term, distance, odds = hit
                share = min(1.0, odds * (1 + distance) / self.odds[term])  # a misspelling that is as often meant otherwise counts less
                before, after = tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + 1 + WINDOW]
                near = {bare(t) for t in before + after}
                opened = sum(t.count(q) for t in before for q in QUOTES) % 2 == 1
                own = tokens[i][:1] in QUOTES or opened
                is_quoted = own or bool(near & REPORTING)
                is_addressed = bool(near & ADDRESS)
                plain += share * (not is_quoted and not is_addressed)
                quoted += share * is_quoted
                addressed += share * (is_addressed and not is_quoted)
                misspelled += share * (distance > 0)
                terms[term] = max(terms.get(term, 0.0), share)
                weight += odds * (0.5 if is_quoted else 1.25 if is_addressed else 1.0)
        n = len(tokens)
        return [
            math.log1p(plain), math.log1p(quoted), math.log1p(addressed), math.log1p(misspelled), math.log1p(sum(terms.values())),
            math.log1p(weight), min(1.0, 20.0 * (plain + addressed + quoted) / max(n, 20)), math.log1p(n) / 10,
        ]


def with_features(docs: DataFrame, lexicon: dict[str, float], misspelled: set[str], weights: dict[str, float]) -> DataFrame:
    """doc_id and the FEATURES of every text."""
    names = ["doc_id", *FEATURES]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon, misspelled, weights)
        for batch in (part for whole in batches for part in slices(whole, "text", 4 << 20)):
            rows = np.array([scorer.features(t) for t in batch.column("text").fill_null("").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in rows.T)], names=names)

    schema = "doc_id bigint, " + ", ".join(f"{name} double" for name in FEATURES)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(scored, schema)


def fit(rows: np.ndarray, toxic: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression, the constant last, by Newton's method."""
    x = np.hstack([rows, np.ones((len(rows), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * rows.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (p - toxic) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document. Only labels of rows that are not held out are used."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    third = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 3
    for_lexicon = materialize(_sample(usable.where(~third), LEXICON_ROWS))
    for_fit = materialize(_sample(usable.where(third), FIT_ROWS))
    features = materialize(with_features(docs, *learn_lexicon(docs, for_lexicon)))
    sample = features.join(F.broadcast(for_fit), "doc_id").select(*FEATURES, "toxic").toPandas()  # FIT_ROWS at most
    toxic = sample["toxic"].to_numpy(float)
    if len(sample) and 0 < toxic.sum() < len(toxic):
        w = fit(sample[list(FEATURES)].to_numpy(float), toxic)
        linear = sum((F.col(name) * float(v) for name, v in zip(FEATURES, w, strict=False)), F.lit(float(w[-1])))
        score = 1 / (1 + F.exp(-linear))
    else:
        score = F.lit(0.0)
    return features.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )
