"""Language of texts by cross-parsing: the language whose suffix automaton needs fewest phrases wins.

A text is read as its lower-cased letters, any run of other characters being one blank. Cross-parsing takes again and again
the longest match with a language's labelled text (at least one symbol); a suffix automaton of that
text finds it by following transitions until there is none. Phrases cost log2 of the length of the labelled text each,
so their number is normalised by it and by the length of the text (a cross entropy in bits a symbol).

The automata are learned from a bounded sample: of up to MAX_LANGUAGES languages with most labelled rows, up to SAMPLE_ROWS
different texts each, chosen by the hash of the whole text, and of a longer text SAMPLE_CHARS code points from a
place that the hash gives; MODEL_SYMBOLS symbols in all, shared equally. Everything else covers whole texts: those longer
than SEGMENT symbols are parsed in segments, a phrase ending with its segment, so that thousands of segments
step through the automata together, one table lookup a symbol and language.

Defined results: a null text or one without letters is `und` with score 0, and so is every text where nothing can be
learned; ties go to the language first in order; rows whose id is null are never learned from and not held out;
repeated rows are predicted alike, copies are learned once; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmark.llm.tables import slices, utf8_column
from gridmark.operators.ranking import top_per_group
from gridmark.session import materialize

MAX_LANGUAGES, SAMPLE_ROWS, SAMPLE_CHARS = 64, 400, 2000
MODEL_SYMBOLS = 1 << 17
CELL_BITS = 12
LETTERS = 60  # letters that automata know, the most frequent of the sample; others match nothing
SEGMENT = 1024
UNKNOWN = "und"
DECODED = 1 << 22  # bytes decoded at a time
BLANK = 0


@lru_cache(maxsize=1)
def _lower_letters() -> np.ndarray:
    """The lower-case form of every code point that is a letter, else 0."""
    found = np.zeros(0x110000, np.int32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            found[point] = ord(low) if len(low) == 1 else point
    return found


def letters_of(text: str) -> str:
    """A text as automata see it: lower-case letters, one blank for everything between them."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = _lower_letters()[points]
    low[low == 0] = 32
    return " ".join(low.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").split())


def suffix_automaton(texts: list[np.ndarray]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings of the texts (state 0 is the empty string)."""
    moves: list[dict[int, int]] = [{}]
    longest, link = [0], [-1]

    def split(state: int, symbol: int) -> int:
        """The state of `state` extended by `symbol`, where that transition exists; cloned if it stands for longer strings."""
        target = moves[state][symbol]
        if longest[target] == longest[state] + 1:
            return target
        moves.append(dict(moves[target]))
        longest.append(longest[state] + 1)
        link.append(link[target])
        clone = link[target] = len(moves) - 1
        while state >= 0 and moves[state].get(symbol) == target:
            moves[state][symbol] = clone
            state = link[state]
        return clone

    for text in texts:
        last = 0
        for symbol in text.tolist():
            if symbol in moves[last]:
                last = split(last, symbol)
                continue
            moves.append({})
            longest.append(longest[last] + 1)
            link.append(0)
            new, state = len(moves) - 1, last
            while state >= 0 and symbol not in moves[state]:
                moves[state][symbol] = new
                state = link[state]
            if state >= 0:
                link[new] = split(state, symbol)
            last = new
    return moves


class Model:
    """One table of transitions for all languages.

    An entry holds where to go, as the place of the next state's row, and the phrases that end by reading the
    symbol: none along a match; one where a match cannot go on; one more if the symbol matches nowhere.
    """

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        texts = {name: [letters_of(t) for t in samples[name]] for name in self.languages}
        points, counts = np.unique(np.array([ord(c) for ts in texts.values() for t in ts for c in t if c != " "], np.int64), return_counts=True)
        self.letters = points[np.argsort(-counts, kind="stable")[:LETTERS]]
        self.width = len(self.letters) + 2
        self.symbol = np.where(_lower_letters() > 0, self.width - 1, BLANK).astype(np.uint8)
        known = np.zeros(0x110000, np.uint8)
        known[self.letters] = np.arange(1, len(self.letters) + 1)
        known = known[_lower_letters()]
        self.symbol[known > 0] = known[known > 0]
        share = MODEL_SYMBOLS // max(1, len(self.languages))
        tables, self.roots, self.bits, used = [], [], [], 0
        for name in self.languages:
            table, size = self._table([self._symbols(t) for t in texts[name]], share, used)
            tables.append(table)
            self.roots.append(used)
            self.bits.append(np.log2(size + 2.0))
            used += len(table)
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.roots = np.array(self.roots, np.int32)
        self.bits = np.array(self.bits)

    def _symbols(self, text: str) -> np.ndarray:
        """Symbols of a normal text with a blank on either side."""
        points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.symbol[points]

    def _table(self, texts: list[np.ndarray], share: int, base: int) -> tuple[np.ndarray, int]:
        parts, left = [], share
        for text in texts:
            # Letters that no automaton knows end a stretch of labelled text.
            for part in np.split(text, np.flatnonzero(text == self.width - 1)):
                part = part[part != self.width - 1][:left]
                left -= len(part)
                parts.append(part)
        moves = suffix_automaton(parts)
        first = [base + moves[0].get(symbol, 0) * self.width for symbol in range(self.width)]
        missing = np.array([(place << 2) | (1 if symbol in moves[0] else 2) for symbol, place in enumerate(first)], np.int32)
        table = np.tile(missing, (len(moves), 1))
        table[0] = [(place << 2) | (0 if symbol in moves[0] else 1) for symbol, place in enumerate(first)]
        rows = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
        symbols = np.fromiter((s for m in moves for s in m), np.int64, len(rows))
        targets = np.fromiter((t for m in moves for t in m.values()), np.int64, len(rows))
        table[rows, symbols] = (base + targets * self.width) << 2
        return table.reshape(-1), share - left

    def read(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts without blanks that follow blanks or begin a text, and their bounds."""
        parts, first = [], 0
        while first < len(raw):
            last = min(len(raw), first + DECODED)
            while last < len(raw) and (raw[last] & 0xC0) == 0x80:
                last += 1
            text = raw[first:last].tobytes().decode("utf-8", "surrogatepass")
            parts.append(self.symbol[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)])
            first = last
        symbols = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[bounds]
        blank = symbols == BLANK
        after = np.concatenate([[True], blank[:-1]]) if len(blank) else blank
        after[heads[:-1][heads[:-1] < len(symbols)]] = True
        kept = ~(blank & after)
        return symbols[kept], np.concatenate([[0], np.cumsum(kept)])[heads]

    def phrases(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Phrases of every text (rows) in every language; a text begins after a blank."""
        sizes = np.diff(bounds)
        pieces = np.maximum(1, -(-sizes // SEGMENT))
        text = np.repeat(np.arange(len(sizes)), pieces)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = bounds[text] + number * SEGMENT
        lengths = np.minimum(SEGMENT, bounds[text + 1] - starts)
        order = np.argsort(-lengths, kind="stable")
        starts, text, begins = starts[order], text[order], number[order] == 0
        active = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), side="left")
        begun = self.table[self.roots + BLANK]
        state = np.where(begins, (begun >> 2)[:, None], self.roots[:, None]).astype(np.int32)
        ended = np.where(begins, (begun & 3)[:, None], 0).astype(np.int32)
        for step, n in enumerate(active.tolist()):
            found = self.table[state[:, :n] + symbols[starts[:n] + step]]
            ended[:, :n] += found & 3
            state[:, :n] = found >> 2
        ended += state != self.roots[:, None]
        return np.stack([np.bincount(text, weights=row, minlength=len(sizes)) for row in ended], axis=1).astype(np.int64)

    def predict(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and bits a symbol of each text."""
        n = len(bounds) - 1
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n)
        symbols, places = self.read(raw, bounds)
        lettered = np.diff(np.concatenate([[0], np.cumsum(symbols != BLANK)])[places]) > 0
        bits = self.phrases(symbols, places) * self.bits
        best = bits.argmin(axis=1)
        least = bits[np.arange(n), best]
        # 2 to the minus bits is the probability of a text under a language; the score is the winner's share.
        score = np.where(lettered, 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(axis=1), 0.0)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
        return names, score, np.where(lettered, least / (np.diff(places) + 1), 0.0)


@lru_cache(maxsize=1)
def _model(samples: tuple[tuple[str, tuple[str, ...]], ...]) -> Model:
    return Model({name: list(texts) for name, texts in samples})


def _first_hashes(once: DataFrame) -> DataFrame:
    """The rows of each language below a hash that leaves SAMPLE_ROWS or a little more.

    Rows are counted by leading bits of the hash, so a language of any size is a table of so many counts.
    """
    cell = F.shiftright("hash", 64 - CELL_BITS)
    counts = once.groupBy("lang", cell.alias("cell")).count()
    before = Window.partitionBy("lang").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).where(F.col("before") < SAMPLE_ROWS)
    cuts = inside.groupBy("lang").agg(F.max("cell").alias("cut"))
    return once.join(F.broadcast(cuts), "lang").where(cell <= F.col("cut")).drop("cut")  # MAX_LANGUAGES rows at most


def learn_samples(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[tuple[str, tuple[str, ...]], ...]:
    """(language, texts) of the bounded sample; the driver gets SAMPLE_ROWS * SAMPLE_CHARS code points a language at most."""
    rows = labelled.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    usable = rows.where(F.col("key").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashed = materialize(usable.select("key", "lang", F.xxhash64("text").alias("hash")))
    names = [r["lang"] for r in hashed.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()]
    # Copies and groups of copies count once.
    once = hashed.where(F.col("lang").isin(names)).groupBy("lang", "hash").agg(F.min("key").alias("key"))
    picked = top_per_group(_first_hashes(once), ["lang"], [F.col("hash")], SAMPLE_ROWS).drop("rank")
    some = usable.withColumn("hash", F.xxhash64("text")).join(F.broadcast(picked), ["key", "lang", "hash"])
    at = F.pmod(F.col("hash"), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)).cast("int") + 1
    found = some.select("lang", "hash", F.substr("text", at, F.lit(SAMPLE_CHARS)).alias("text")).distinct().collect()
    texts: dict[str, list[str]] = {name: [] for name in names}
    for row in sorted(found, key=lambda r: (r["lang"], r["hash"], r["text"])):
        texts[row["lang"]].append(row["text"])
    return tuple((name, tuple(texts[name])) for name in sorted(texts))


def identify(docs: DataFrame, samples: tuple[tuple[str, tuple[str, ...]], ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score, bits (a symbol) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for part in (p for batch in batches for p in slices(batch, "text")):
            names, score, bits = model.predict(*utf8_column(part.column("text")))
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array(names, pa.string()), pa.array(score), pa.array(bits)], names=["key", "lang_pred", "score", "bits"]
            )

    kind = named.schema["key"].dataType.simpleString()
    return named.mapInArrow(predicted, f"key {kind}, lang_pred string, score double, bits double").withColumnRenamed("key", key)
