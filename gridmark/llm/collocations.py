"""Collocations: phrases of a few words that occur together more often than their parts would.

Frequent n-grams are found without counting all of them. The first pass sends the hashes of n-grams to hash buckets, and each
bucket keeps a mergeable Misra-Gries summary of more than mass / threshold counters, mass being all that
occurs in the bucket: the counts it gives up are then fewer than the threshold, so every n-gram that is
frequent survives, and a bucket's memory follows from its share of the mass. Survivors are known to the second pass as a filter of
fixed size at most (no result depends on it: what it lets through by chance is counted and found too rare). The second pass
counts what survives exactly, with its words. All later steps are joins and groups of frequent phrases.

Everything is counted per language. Words are runs of bytes other than blank and tab, within pieces that end at
`.,;:!?` and line ends; A-Z are lower-cased. n-grams stay within pieces, overlaps count. In the second pass 64-bit hashes
stand for phrases, in the first fewer bits (a chance of letting a rare one through).

Defined results: null texts are empty, null languages are `und`; repeated rows count each; other columns are ignored; an empty
table gives no rows. Scores are exact up to counts of 10**15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmark.llm.tables import slices, utf8_column
from gridmark.llm.word_hashes import LOWER, mix, run_hashes
from gridmark.operators.ranking import top_per_group
from gridmark.operators.skew import join_per_key
from gridmark.session import materialize

LONGEST, THRESHOLD, NESTED_PERCENT, BEST = 3, 10, 50, 2000
SCALE = 1_000_000
UNKNOWN = "und"
BUCKET_BYTES = 8 << 20  # text of a bucket, about
MOST_BUCKETS = 1 << 17
MOST_PARTITIONS = 20_000
SLICE = 2 << 20  # bytes of text read together
HELD = 3_000_000  # n-grams that a task holds before it sends them on
PHRASES_HELD = 700_000  # phrases that a task holds in the second pass
MERGED = 1_000_000  # entries merged into a summary at a time
MOST_FILTER_BITS = 1 << 27
SALTS = 64  # groups of a language in which its best phrases are sought first
# Bits of the hashes in the first pass by the bytes of all texts: differences between those a task sends then fit
# two, three or four bytes. Fewer bits let more rare n-grams through, so more text needs more.
KEY_BITS = ((1 << 33, 34), (1 << 41, 42), (1 << 63, 50))

_BREAK, _SEPARATES = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\v\f\r")] = True
_SEPARATES[[9, 32]] = True
_SEPARATES |= _BREAK
_WEIGHTS = np.random.default_rng(11).integers(1, 2**63, 16, dtype=np.uint64) * 2 + 1


class PieceWords:
    """Words of a batch of texts, and the n-grams that lie within a piece."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, langs: list[bytes]):
        raw = LOWER[raw]
        inside = ~_SEPARATES[raw]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = bounds[:-1][bounds[:-1] < len(raw)]
        begins[edges] = inside[edges]
        starts = np.flatnonzero(begins)
        self.bytes = raw[inside]
        first = np.searchsorted(np.flatnonzero(inside), starts) if len(starts) else np.zeros(0, np.int64)
        self.lengths = np.diff(np.append(first, len(self.bytes)))
        self.text = np.searchsorted(bounds, starts, side="right") - 1
        # Piece numbers grow with each break and each text.
        self.piece = np.cumsum(_BREAK[raw])[starts] + self.text if len(starts) else self.text
        self.langs = langs
        names, self.lang_of_text = np.unique(np.array(langs, object), return_inverse=True) if langs else (np.zeros(0, object), np.zeros(0, np.int64))
        self.names = [bytes(n) for n in names]
        sizes = np.array([len(n) + 1 for n in self.names], np.int64)
        self.name_hashes = run_hashes(np.frombuffer(b"".join(n + b"\n" for n in self.names), np.uint8), sizes)
        self.words = run_hashes(self.bytes, self.lengths)
        self.lang = self.lang_of_text[self.text]

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all n-grams of a size."""
        n = max(0, len(self.words) - size + 1)
        at = np.flatnonzero(self.piece[:n] == self.piece[size - 1 : size - 1 + n])
        total = self.name_hashes[self.lang[at]] + np.uint64(size)
        for i in range(size):
            total += self.words[at + i] * _WEIGHTS[i]
        return at, mix(total)

    def word_totals(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the empty phrase of each language, and its words."""
        counts = np.bincount(self.lang, minlength=len(self.names))
        return mix(self.name_hashes), counts.astype(np.int64)

    def phrases(self, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes and lengths of phrases by first word and size: language, line end, words with blanks between them. Also how they begin."""
        ends = np.cumsum(self.lengths + 1)
        spaced = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
        spaced[np.arange(len(self.bytes)) + np.repeat(np.arange(len(self.lengths)), self.lengths)] = self.bytes
        begins = ends[at] - self.lengths[at] - 1
        lengths = np.where(size > 0, ends[at + np.maximum(size, 1) - 1] - 1 - begins, 0)
        names = np.frombuffer(b"".join(n + b"\n" for n in self.names), np.uint8)
        name_sizes = np.array([len(n) + 1 for n in self.names], np.int64)
        lang = self.lang[at]
        head = name_sizes[lang]
        out = np.empty(int((head + lengths).sum()), np.uint8)
        firsts = np.cumsum(head + lengths) - (head + lengths)
        out[_runs(firsts, head)] = names[_runs((np.cumsum(name_sizes) - name_sizes)[lang], head)]
        out[_runs(firsts + head, lengths)] = spaced[_runs(begins, lengths)]
        begun = np.zeros(len(at), np.uint64)
        for i in range(8):
            begun = begun << np.uint64(8) | np.where(i < lengths, spaced[np.minimum(begins + i, len(spaced) - 1)] if len(spaced) else 0, 0).astype(np.uint64)
        return out, head + lengths, begun


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every run."""
    return np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def _words_of(batch: pa.RecordBatch) -> Iterator[PieceWords]:
    for part in slices(batch, "text", SLICE):
        langs = [(UNKNOWN if lang is None else lang).encode() for lang in part.column("lang").to_pylist()]
        yield PieceWords(*utf8_column(part.column("text")), langs)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One row at a time, since rows are long."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first, so that leading zeros are runs."""
    return values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()


def _numbers(blob: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _cuts(keys: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of sorted keys by their leading bits."""
    if not len(keys):
        return []
    bucket = (keys >> np.uint64(shift)).astype(np.int64)
    firsts = np.flatnonzero(np.diff(bucket, prepend=-1))
    return list(zip(bucket[firsts].tolist(), firsts.tolist(), np.append(firsts[1:], len(keys)).tolist(), strict=True))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the sum of their counts, and a place of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    firsts = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    sums = np.add.reduceat(counts[order], firsts) if len(firsts) else np.zeros(0, np.int64)
    return keys[firsts], sums, order[firsts]


class Summary:
    """Misra-Gries counters of one bucket; `lost` is the most that a count is too low."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts, _ = _summed(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        over = len(self.keys) - self.capacity
        if over > 0:
            # The largest of the counts beyond the capacity is taken off all.
            cut = int(np.partition(self.counts, over - 1)[over - 1])
            self.lost += cut
            self.counts -= cut
            kept = self.counts > 0
            self.keys, self.counts = self.keys[kept], self.counts[kept]

    def at_least(self, threshold: int) -> np.ndarray:
        return self.keys[self.counts + self.lost >= threshold]


def _filter_places(keys: np.ndarray, key_bits: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word of the filter of each key, by its leading bits, and the bits it sets there."""
    spread = mix(keys)
    bits = np.zeros(len(keys), np.uint64)
    for i in range(4):
        bits |= np.uint64(1) << ((spread >> np.uint64(6 * i)) & np.uint64(63))
    return (keys >> np.uint64(key_bits - (words.bit_length() - 1))).astype(np.int64), bits


def survivors(docs: DataFrame, buckets: int, longest: int, threshold: int, key_bits: int, filter_words: int) -> np.ndarray:
    """First pass: the filter of all n-grams that may be frequent."""
    shift = key_bits - (buckets.bit_length() - 1)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        mass = np.zeros(buckets, np.int64)
        names = ["bucket", "kind", "mass", "keys", "counts"]

        def packed() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            rows = _cuts(keys, shift)
            steps = np.diff(keys, prepend=np.zeros(1, np.uint64))
            for bucket, first, end in rows:
                mass[bucket] += int(counts[first:end].sum())
                steps[first] = keys[first]
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int32()), pa.array([1] * len(rows), pa.int32()), pa.array([0] * len(rows), pa.int64()),
                pa.array([_planes(steps[a:b]) for _, a, b in rows], pa.binary()), pa.array([_planes(counts[a:b].astype("<u4")) for _, a, b in rows], pa.binary()),
            ], names=names)

        for words in (w for batch in batches for w in _words_of(batch)):
            held += [words.grams(size)[1] >> np.uint64(64 - key_bits) for size in range(1, longest + 1)]
            if sum(map(len, held)) > HELD:
                yield packed()
                held.clear()
        yield packed()
        some = np.flatnonzero(mass)
        none = pa.nulls(len(some), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.zeros(len(some), np.int32)), pa.array(mass[some]), none, none], names=names)

    per_bucket = filter_words // buckets

    def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mass, summary, waiting = -1, 0, Summary(0), []

        def flush() -> None:
            if waiting:
                summary.merge(np.concatenate([k for k, _ in waiting]), np.concatenate([c for _, c in waiting]))
                waiting.clear()

        def part() -> pa.RecordBatch:
            flush()
            words = np.zeros(per_bucket, np.uint64)
            place, bits = _filter_places(summary.at_least(threshold), key_bits, filter_words)
            np.bitwise_or.at(words, place - now * per_bucket, bits)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([words.tobytes()], pa.binary())], names=["bucket", "words"])

        for batch in batches:
            for row in _rows(batch):
                if row["bucket"] != now:
                    if now >= 0:
                        yield part()
                    now, mass, summary = row["bucket"], 0, Summary(0)
                if not row["kind"]:  # the masses of a bucket come first
                    mass += row["mass"]
                    summary.capacity = mass // threshold + 1
                    continue
                waiting.append((np.cumsum(_numbers(row["keys"], "<u8")), _numbers(row["counts"], "<u4").astype(np.int64)))
                if sum(len(k) for k, _ in waiting) > MERGED:
                    flush()
        if now >= 0:
            yield part()

    rows = docs.mapInArrow(sent, "bucket int, kind int, mass bigint, keys binary, counts binary")
    dealt = rows.repartition(min(buckets, MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket", "kind")
    found = np.zeros(filter_words, np.uint64)
    for row in dealt.mapInArrow(summarised, "bucket int, words binary").collect():
        found[row["bucket"] * per_bucket : (row["bucket"] + 1) * per_bucket] = np.frombuffer(row["words"], np.uint64)
    return found


def _combined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(hash, count, size, phrase bytes, phrase lengths, beginnings) with each hash once."""
    hashes, counts, sizes, raw, lengths, begun = (np.concatenate([p[i] for p in parts]) for i in range(6))
    keys, sums, at = _summed(hashes, counts)
    starts = np.cumsum(lengths) - lengths
    return keys, sums, sizes[at], raw[_runs(starts[at], lengths[at])], lengths[at], begun[at]


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, threshold: int = THRESHOLD) -> DataFrame:
    """lang, phrase, k (words), f of all phrases of up to `longest` words found `threshold` times or more.

    The empty phrase (k = 0) has the words of the language, however few.
    """
    named = docs.select(F.col("text").cast("string"), F.col("lang").cast("string"))
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, 1 << (size // BUCKET_BYTES).bit_length())
    key_bits = next(bits for most, bits in KEY_BITS if size < most)
    # About as many bits as bytes of text, or the most: 64 bits a word, one word a bucket at least.
    filter_words = max(buckets, 1 << (max(1 << 20, min(MOST_FILTER_BITS, 1 << size.bit_length())) // 64).bit_length() - 1)
    shared = docs.sparkSession.sparkContext.broadcast(survivors(named, buckets, longest, threshold, key_bits, filter_words))
    shift = 64 - (buckets.bit_length() - 1)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def packed() -> pa.RecordBatch:
            hashes, counts, sizes, raw, lengths, begun = _combined(held)
            rows = _cuts(hashes, shift) if buckets > 1 else [(0, 0, len(hashes))]
            # Within a bucket by how phrases begin, so that neighbours are alike and compress.
            order = np.concatenate([a + np.argsort(begun[a:b], kind="stable") for _, a, b in rows] or [np.zeros(0, np.int64)])
            starts = np.cumsum(lengths) - lengths
            raw, counts, sizes, lengths = raw[_runs(starts[order], lengths[order])], counts[order], sizes[order], lengths[order]
            ends = np.concatenate([[0], np.cumsum(lengths)])
            blobs = lambda values: pa.array([_planes(values[a:b]) for _, a, b in rows], pa.binary())
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int32()), blobs(counts.astype("<u4")), blobs(sizes.astype("u1")),
                pa.array([raw[ends[a] : ends[b]].tobytes() for _, a, b in rows], pa.binary()), blobs(lengths.astype("<u4")),
            ], names=["bucket", "counts", "sizes", "raw", "lengths"])

        known = shared.value
        for words in (w for batch in batches for w in _words_of(batch)):
            totals = words.word_totals()
            some = np.flatnonzero(totals[1])
            first_of_lang = np.zeros(len(words.names), np.int64)
            first_of_lang[words.lang[::-1]] = np.arange(len(words.lang))[::-1]
            found = [(totals[0][some], totals[1][some], first_of_lang[some], np.zeros(len(some), np.int64))]
            for size in range(1, longest + 1):
                at, hashes = words.grams(size)
                place, bits = _filter_places(hashes >> np.uint64(64 - key_bits), key_bits, filter_words)
                hit = (known[place] & bits) == bits
                keys, sums, which = _summed(hashes[hit], np.ones(int(hit.sum()), np.int64))
                found.append((keys, sums, at[hit][which], np.full(len(keys), size)))
            hashes, counts, at, sizes = (np.concatenate([p[i] for p in found]) for i in range(4))
            held.append((hashes, counts, sizes, *words.phrases(at, sizes)))
            if sum(len(h[0]) for h in held) > PHRASES_HELD:
                held[:] = [_combined(held)]
                if len(held[0][0]) > PHRASES_HELD // 2:
                    yield packed()
                    held.clear()
        if held:
            yield packed()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []

        def part() -> pa.RecordBatch:
            _, counts, sizes, raw, lengths, _ = _combined(held)
            held.clear()
            some = (counts >= threshold) | (sizes == 0)
            ends = np.cumsum(lengths)
            raw = raw[_runs((ends - lengths)[some], lengths[some])]
            offsets = np.concatenate([[0], np.cumsum(lengths[some])])
            texts = pa.LargeStringArray.from_buffers(int(some.sum()), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw.tobytes()))
            return pa.RecordBatch.from_arrays([texts.cast(pa.string()), pa.array(sizes[some].astype(np.int32)), pa.array(counts[some])], names=["named", "k", "f"])

        for batch in batches:
            for row in _rows(batch):
                if row["bucket"] != now and held:
                    yield part()
                now = row["bucket"]
                raw, lengths = np.frombuffer(row["raw"], np.uint8), _numbers(row["lengths"], "<u4").astype(np.int64)
                held.append((
                    run_hashes(raw, lengths), _numbers(row["counts"], "<u4").astype(np.int64), _numbers(row["sizes"], "u1").astype(np.int64),
                    raw, lengths, np.zeros(len(lengths), np.uint64),
                ))
                if len(held) > 1 and sum(len(h[0]) for h in held) > MERGED:
                    held[:] = [_combined(held)]
        if held:
            yield part()

    rows = named.mapInArrow(sent, "bucket int, counts binary, sizes binary, raw binary, lengths binary")
    dealt = rows.repartition(min(buckets, MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket")
    phrases = dealt.mapInArrow(counted, "named string, k int, f bigint")
    return materialize(phrases).select(
        F.substring_index("named", "\n", -1).alias("phrase"),
        F.expr(r"substr(named, 1, length(named) - length(substring_index(named, '\n', -1)) - 1)").alias("lang"), "k", "f", "named",
    )


def _span(words: Column, first: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def scored(frequent: DataFrame, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, k, f, l, r, score of every candidate by its lowest-scoring cut."""
    phrases = frequent.where("k > 0")
    words = F.split("phrase", " ", -1)
    named = lambda part: F.concat("lang", F.lit("\n"), part)
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = phrases.where("k > 1").select("lang", "phrase", "k", "f", words.alias("words"), cut).select(
        "lang", "phrase", "k", "f", "cut", named(_span(F.col("words"), F.lit(1), F.col("cut"))).alias("left"),
        named(_span(F.col("words"), F.col("cut") + 1, F.col("k") - F.col("cut"))).alias("right"),
    )
    sides = phrases.where(F.col("k") < longest)
    for side, count in (("left", "l"), ("right", "r")):
        # A part has at most f / threshold candidates, so only parts that hold much of the mass are hot.
        cuts = join_per_key(cuts, sides.select(F.col("named").alias(side), F.col("f").alias(count)), side, count)
    wide = lambda c: f"CAST({c} AS DECIMAL(15, 0))"
    score = F.expr(f"({wide('f')} * {wide('f')} * CAST({SCALE} AS DECIMAL(7, 0))) div ({wide('l')} * {wide('r')})")
    least = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("s")
    return cuts.groupBy("lang", "phrase", "k", "f").agg(least).select("lang", "phrase", "k", "f", "s.l", "s.r", "s.score")


def without_nested(candidates: DataFrame, longest: int = LONGEST, percent: int = NESTED_PERCENT) -> DataFrame:
    """Candidates that no longer candidate with at least `percent` of their occurrences holds."""
    words = F.split("phrase", " ", -1)
    spans = F.expr("flatten(transform(sequence(2, k - 1), s -> transform(sequence(1, k - s + 1), i -> array_join(slice(words, i, s), ' '))))")
    held = candidates.where("k > 2").select("lang", "f", words.alias("words"), "k").select("lang", "f", F.explode(spans).alias("phrase"))
    most = held.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    joined = candidates.where(F.col("k") < longest).join(most, ["lang", "phrase"], "left").where(F.expr(f"NOT coalesce(100 * longer >= {percent} * f, false)"))
    return joined.drop("longer").unionByName(candidates.where(F.col("k") >= longest))


def best_phrases(kept: DataFrame, best: int = BEST) -> DataFrame:
    """The first `best` of each language with their rank; a language is first cut into SALTS groups."""
    order = [F.desc("score"), F.desc("f"), F.asc("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = top_per_group(salted, ["lang", "salt"], order, best).drop("rank", "salt")
    return top_per_group(some, ["lang"], order, best)


def collocations(docs: DataFrame, longest: int = LONGEST, threshold: int = THRESHOLD, percent: int = NESTED_PERCENT, best: int = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    frequent = frequent_phrases(docs, longest, threshold)
    candidates = materialize(scored(frequent, longest))
    ranked = best_phrases(without_nested(candidates, longest, percent), best)
    totals = frequent.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
