"""Exact n-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct 5-word windows, as 64-bit hashes. Two sets can only be as
similar as the threshold if their prefixes, in an order of all hashes that puts rare ones first,
share something. A prefix of |x| - ceil(t|x|) + m hashes must share m of them. Every document
chooses m by its estimated cost: prefix entries to index, plus the pairs to verify, which
frequent hashes in the prefix make many and each further required match makes fewer. A pair needs as many
shared prefix hashes as the smaller m of the two, and as many as the overlap of sets of their sizes leaves over
for the prefixes.

Equal sets are joined to one representative first. For every document it is counted how many of its
prefix hashes stand in other prefixes at all; no pair can share more. Pairs are verified in two steps: every
document with the one among those of a hash that shares most, as an original does, which links groups of
copies without listing their pairs; then, exactly, all candidate pairs that are not yet in one component and
that the counts do not rule out. With large components documents meet set by set in bounded parts, and pairs there are no rows. So no link between components is lost, and components are those of all links.

Defined results: null and empty texts have empty sets and stand alone; texts of fewer than five
words are one window; repeated rows are equal documents; a null doc_id keeps a null component; rows that share
a doc_id with different texts are judged each by its own text; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmark.llm import packed_rows, worker_memory
from gridmark.llm.components import components
from gridmark.llm.tables import slices, utf8_column
from gridmark.llm.word_hashes import TextWords, mix
from gridmark.session import materialize

SIMILAR = 80  # percent
FREQUENT = 1 << 18  # at most so many frequent hashes are known by their counts
LEAST, COUNTS = 4, 1 << 16  # counts from which a hash is frequent, and up to which they are told apart to find the limit
COUNTED = 4_000_000  # hashes that a task counts together
MOST_MATCHES = 8
PER_BUCKET = 100_000  # prefix hashes of a bucket, about
FILTER_BITS = 1 << 23  # of the prefilter of documents; no result depends on it
PROFILE = "doc_id bigint, n bigint, sign_a bigint, sign_b bigint, matches int, prefix binary"
BIG = 64  # documents of a large component; no result depends on it
PAIRS = 500_000  # pairs of places that a task looks at together
MEMBERS, ASKED = 256, 1024  # sets of a large component, and sets asking, that meet in one group, about
POSTING = {"token": "<u8", "doc": "<i8", "size": "<i4", "matches": "u1", "shared": "<i4", "comp": "<i8", "big": "u1"}
PLAIN = {name: POSTING[name] for name in ("token", "doc")}
BESIDE = {name: POSTING[name] for name in ("token", "doc", "comp", "big")}
SHARED = {"doc": "<i8", "comp": "<i8", "shared": "<i4"}
MEETING = {"a": "<i8", "b": "<i8", "need": "<i4", "n": "<i4"}
PAIR_SHARE = 16  # buckets of hashes for a place of pairs


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    return TextWords(*utf8_column(batch.column("text")), lower=True).shingle_sets()


def frequent_hashes(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that are frequent in the table, sorted, and their counts (lower bounds).

    Tasks count hashes that occur twice or more in a part of their texts. The FREQUENT largest sums or fewer are sent to
    the driver, from LEAST on: a limit that grew with the table would leave ever larger groups unknown, whose pairs grow with their square.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory.claim("near_duplicates")

        def counts() -> pa.RecordBatch:
            hashes, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            some = n > 1
            return pa.RecordBatch.from_arrays([pa.array(hashes[some].view(np.int64)), pa.array(n[some].astype(np.int64))], names=["token", "n"])

        held: list[np.ndarray] = []
        for batch in (part for whole in batches for part in slices(whole, "text")):
            held += _sets(batch)
            if sum(map(len, held)) > COUNTED:
                yield counts()
                held = []
        yield counts()

    sums = materialize(docs.select("text").mapInArrow(worker_memory.trimmed(counted), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")))
    found = sums.where(F.col("n") >= _least_count(sums)).toPandas()
    hashes = found["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found["n"].to_numpy(np.int64)[order]


def _least_count(sums: DataFrame) -> int:
    """The smallest count, LEAST or more, that at most FREQUENT hashes reach."""
    rows = sums.where(F.col("n") >= LEAST).groupBy(F.least("n", F.lit(COUNTS)).alias("n")).agg(F.count("*").alias("hashes"), F.sum("n").alias("total"))
    by_count = sorted(rows.collect(), reverse=True)  # at most COUNTS rows
    reached, least = 0, None
    for n, hashes, _ in by_count:
        reached += hashes
        if reached > FREQUENT:
            # If even those of COUNTS or more are too many: at most FREQUENT can hold 1 in FREQUENT of all.
            return least or -(-sum(row["total"] for row in by_count) // FREQUENT)
        least = n
    return LEAST


def required(n: int | np.ndarray) -> int | np.ndarray:
    """Least overlap of a set of n hashes with any similar one."""
    return -(-SIMILAR * n // 100)


def choose_prefix(tokens: np.ndarray, counts: np.ndarray) -> tuple[int, np.ndarray]:
    """(required matches, prefix) of a set sorted by rarity; counts are the estimated documents of each hash."""
    n = len(tokens)
    if not n:
        return 0, tokens
    need = int(required(n))
    spare = n - need
    most = min(MOST_MATCHES, need)
    meet = np.cumsum(counts - 1)[spare : spare + most].astype(float)  # meetings with other documents, by matches
    matches = np.arange(1, most + 1)
    cost = spare + matches + meet / matches * (1 + n / 16)
    best = int(np.argmin(cost))
    return best + 1, tokens[: spare + best + 1]


def profiles(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, size and signature of its set, required matches and prefix, of every document."""
    hashes, counts = frequent

    def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory.claim("near_duplicates")
        for batch in (part for whole in batches for part in slices(whole, "text")):
            sets = _sets(batch)
            sizes = np.array([len(s) for s in sets], np.int64)
            all_ = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            df = np.ones(len(all_), np.int64)
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, all_), len(hashes) - 1)
                hit = hashes[at] == all_
                df[hit] = counts[at[hit]]
            ends = np.cumsum(sizes)
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(all_ + np.uint64(salt)), dtype=np.uint64)]) for salt in (1, 2)]
            signs = [(s[ends] - s[ends - sizes]).view(np.int64) for s in sums]
            matches, prefixes = [], []
            for first, end in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                tokens, n = all_[first:end], df[first:end]
                order = np.argsort(n, kind="stable")  # hashes are in order already
                m, prefix = choose_prefix(tokens[order], n[order])
                matches.append(m)
                prefixes.append(prefix.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(signs[0]), pa.array(signs[1]), pa.array(matches, pa.int32()), pa.array(prefixes, pa.binary())],
                names=["doc_id", "n", "sign_a", "sign_b", "matches", "prefix"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(worker_memory.trimmed(profiled), PROFILE)


def _postings(reps: DataFrame, buckets: int, kinds: dict[str, str]) -> DataFrame:
    """Prefix hashes with what is asked of its document, packed by bucket of the hash."""
    sources = {name: {"doc": "rep", "size": "n"}.get(name, name) for name in kinds if name != "token"}

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = batch.column("prefix").to_pylist()
            if not prefixes:
                continue
            token = np.frombuffer(b"".join(prefixes), "<u8")
            times = [len(p) // 8 for p in prefixes]
            columns = {"token": token}
            for name, source in sources.items():
                columns[name] = np.repeat(batch.column(source).to_numpy().astype(kinds[name]), times)
            yield packed_rows.scatter((mix(token) % np.uint64(buckets)).astype(np.int64), columns)

    rows = reps.select(*sources.values(), "prefix").mapInArrow(worker_memory.trimmed(packed), packed_rows.schema(list(kinds)))
    return packed_rows.dealt(rows, buckets)


def _groups(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of runs of equal hashes in a sorted array."""
    starts = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1]) if len(token) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(token)))


def shared_prefixes(reps: DataFrame, buckets: int) -> DataFrame:
    """rep, shared, prefix: its prefix hashes that stand in another prefix, too, and how many. Those that share none are left out.

    Hashes that stand nowhere else meet nothing; most do, and they travel only once.
    """

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = packed_rows.gather(batches, PLAIN)
        order = np.argsort(found["token"], kind="stable")
        _, sizes = _groups(found["token"][order])
        order = order[np.repeat(sizes > 1, sizes)]
        if len(order):
            columns = {name: values[order] for name, values in found.items()}
            yield packed_rows.scatter((mix(columns["doc"].view(np.uint64)) % np.uint64(buckets)).astype(np.int64), columns)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = packed_rows.gather(batches, PLAIN)
        order = np.argsort(found["doc"], kind="stable")
        doc, token = found["doc"][order], found["token"][order]
        if not len(doc):
            return
        starts, sizes = _groups(doc)
        prefixes = [token[first : first + n].tobytes() for first, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(doc[starts]), pa.array(sizes.astype(np.int32)), pa.array(prefixes, pa.binary())], names=["rep", "shared", "prefix"])

    marks = _postings(reps, buckets, PLAIN).mapInArrow(worker_memory.trimmed(marked), packed_rows.schema(list(PLAIN)))
    return packed_rows.dealt(marks, buckets).mapInArrow(worker_memory.trimmed(joined), "rep bigint, shared int, prefix binary")


def shared_with_big(reps: DataFrame, buckets: int) -> DataFrame:
    """rep, comp, shared: for each large component other than its own, how many of its prefix hashes stand in a prefix there."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = packed_rows.gather(batches, BESIDE)
        order = np.lexsort((found["comp"], found["token"]))
        starts, sizes = _groups(found["token"][order])
        order = order[np.repeat(sizes > 1, sizes)]
        starts, sizes = _groups(found["token"][order])
        docs, comps = _beside_big({name: values[order] for name, values in found.items()}, starts, sizes)
        rank = np.lexsort((comps, docs))
        docs, comps = docs[rank], comps[rank]
        first = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (comps[1:] != comps[:-1])])) if len(docs) else np.zeros(0, np.int64)
        if len(first):
            n = np.diff(np.append(first, len(docs))).astype("<i4")
            docs, comps = docs[first], comps[first]
            bucket = (mix(docs.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            yield packed_rows.scatter(bucket, {"doc": docs, "comp": comps, "shared": n})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = packed_rows.gather(batches, SHARED)
        order = np.lexsort((found["comp"], found["doc"]))
        doc, comp, n = (found[name][order] for name in ("doc", "comp", "shared"))
        if not len(doc):
            return
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (comp[1:] != comp[:-1])]))
        sums = np.add.reduceat(n, first).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(comp[first]), pa.array(sums)], names=["rep", "comp", "shared"])

    marks = _postings(reps, buckets, BESIDE).mapInArrow(worker_memory.trimmed(marked), packed_rows.schema(list(SHARED)))
    return packed_rows.dealt(marks, buckets).mapInArrow(worker_memory.trimmed(summed), "rep bigint, comp bigint, shared int")


def _beside_big(found: dict[str, np.ndarray], starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, large component) for every hash at which a document stands beside a component not its own."""
    docs, comps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(starts):
        has_big = np.maximum.reduceat(found["big"], starts) > 0
        has_big &= np.minimum.reduceat(found["comp"], starts) != np.maximum.reduceat(found["comp"], starts)
        for start, size in zip(starts[has_big].tolist(), sizes[has_big].tolist(), strict=True):
            part = slice(start, start + size)
            for comp in np.unique(found["comp"][part][found["big"][part] > 0]):
                others = found["doc"][part][found["comp"][part] != comp]
                docs.append(others)
                comps.append(np.full(len(others), comp))
    return np.concatenate(docs), np.concatenate(comps)


def _summed(a: np.ndarray, b: np.ndarray, need: np.ndarray, times: np.ndarray | None = None) -> tuple:
    """Equal pairs as one, with the number of times they met."""
    order = np.lexsort((b, a))
    a, b, need = a[order], b[order], need[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    if times is None:
        met = np.diff(np.append(first, len(a)))
    else:
        met = np.add.reduceat(times[order], first) if len(a) else times
    return a[first], b[first], need[first], met.astype(np.int64)


def _fits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes that allow the similarity."""
    small, large = np.minimum(x, y).astype(np.int64), np.maximum(x, y).astype(np.int64)
    return 100 * small >= SIMILAR * large


def _needed(found: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Prefix hashes that two similar sets must share.

    Both prefixes ask for their matches. Besides, of the overlap that the sizes demand, what is not shared within
    the prefixes must lie behind the prefix that ends first in the order of hashes, so in at most that many hashes.
    """
    mx, my, nx, ny = (found[name][i].astype(np.int64) for name in ("matches", "size") for i in (x, y))
    overlap = -(-SIMILAR * (nx + ny) // (100 + SIMILAR))
    return np.maximum(np.minimum(mx, my), overlap - np.maximum(required(nx) - mx, required(ny) - my))


def _can_meet(found: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Pairs whose sizes allow the similarity, and that share enough with anyone."""
    most = np.minimum(found["shared"][x], found["shared"][y])
    return _fits(found["size"][x], found["size"][y]) & (most >= need)


def _pairs_with_first(found: dict[str, np.ndarray]) -> Iterator[tuple]:
    """Every document of a hash with the first one: the one that shares most."""
    starts, sizes = _groups(found["token"])
    hub, at = np.repeat(starts, sizes), np.arange(len(found["token"]))
    need = _needed(found, at, hub)
    good = (found["doc"] != found["doc"][hub]) & _can_meet(found, at, hub, need)
    yield found["doc"][hub[good]], found["doc"][good], need[good]


def _pairs_across(found: dict[str, np.ndarray]) -> Iterator[tuple]:
    """Pairs of a hash that lie in different components, none of them large, in pieces of bounded size."""
    small = found["big"] == 0
    found = {name: values[small] for name, values in found.items()}
    starts, sizes = _groups(found["token"])
    comp = found["comp"]
    mixed = sizes > 1
    if len(starts):
        mixed &= np.minimum.reduceat(comp, starts) != np.maximum.reduceat(comp, starts)
    starts, sizes = starts[mixed], sizes[mixed]
    # Every place of these groups with all places behind it in its group, a bounded number of pairs at a time.
    at = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    behind = np.repeat(starts + sizes, sizes) - 1 - at
    upto = np.cumsum(behind)
    held, n, first = [], 0, 0
    while first < len(at):
        done = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, done + PAIRS, side="right")))
        counts = behind[first:last]
        x = np.repeat(at[first:last], counts)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(counts) - counts, counts)
        first = last
        apart = comp[x] != comp[y]
        x, y = x[apart], y[apart]
        apart = _fits(found["size"][x], found["size"][y])
        x, y = x[apart], y[apart]
        need = _needed(found, x, y)
        good = _can_meet(found, x, y, need)
        held.append((found["doc"][x[good]], found["doc"][y[good]], need[good]))
        n += len(held[-1][0])
        if n > 2 * PAIRS:
            yield tuple(np.concatenate(p) for p in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(p) for p in zip(*held, strict=True))


def meetings(reps: DataFrame, buckets: int, across: bool) -> DataFrame:
    """a < b, need, n: pairs of representatives that meet, and in how many prefix hashes.

    A pair meets in as many tasks as it shares hashes in, more of them the more tasks there are. What tasks have counted travels
    packed to the place of the pair and is a row only there, one a pair, unless a task holds more than COUNTED.
    """
    paired = _pairs_across if across else _pairs_with_first
    places = max(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), buckets // PAIR_SHARE)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = packed_rows.gather(batches, POSTING)
        order = np.lexsort((found["doc"], -found["shared"], found["token"]))
        starts, sizes = _groups(found["token"][order])
        order = order[np.repeat(sizes > 1, sizes)]
        found = {name: values[order] for name, values in found.items()}
        for a, b, need in paired(found):
            columns = dict(zip(MEETING, _summed(np.minimum(a, b), np.maximum(a, b), need), strict=True))
            if len(columns["a"]):
                place = mix(mix(columns["a"].view(np.uint64)) ^ columns["b"].view(np.uint64)) % np.uint64(places)
                yield packed_rows.scatter(place.astype(np.int64), {name: columns[name].astype(kind) for name, kind in MEETING.items()})

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def sums() -> pa.RecordBatch:
            a, b, need, n = _summed(*(np.concatenate(parts) for parts in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(need.astype(np.int32)), pa.array(n)], names=list(MEETING))

        for batch in batches:
            held.append(tuple(packed_rows.gather(iter([batch]), MEETING).values()))
            if sum(len(part[0]) for part in held) > COUNTED:
                yield sums()
                held = []
        if held:
            yield sums()

    rows = _postings(reps, buckets, POSTING).mapInArrow(worker_memory.trimmed(met), packed_rows.schema(list(MEETING)))
    return packed_rows.dealt(rows, places).mapInArrow(worker_memory.trimmed(together), "a bigint, b bigint, need int, n bigint")


def candidates(reps: DataFrame, buckets: int, across: bool) -> DataFrame:
    """a < b: pairs of representatives that share as many prefix hashes as they must."""
    pairs = meetings(reps, buckets, across)
    good = pairs.groupBy("a", "b").agg(F.min("need").alias("need"), F.sum("n").alias("n")).where(F.col("n") >= F.col("need"))
    if across:
        return good.select("a", "b")
    # One partner is enough for now: that with most in common. What it leaves apart is compared across components.
    return good.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")


def _filter_words(ids: DataFrame) -> np.ndarray:
    """A bit for the hash of every id, FILTER_BITS of them, whatever the number of ids."""
    word = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    rows = ids.select(F.shiftright(word, 5).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {FILTER_BITS}) & 31 as int))").alias("bit"))
    found = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most FILTER_BITS / 32 rows
    words = np.zeros(FILTER_BITS // 32, np.int64)
    words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return words


def _sets_of(docs: DataFrame, ids: DataFrame, as_bytes: bool = False) -> DataFrame:
    """id, tokens: the sets of the documents with these ids (and of few others), made again from their texts; as arrays or bytes."""
    words = _filter_words(ids)
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("slot").to_numpy()
            keep = (words[at >> 5] >> (at & 31)) & 1
            for part in slices(batch.filter(pa.array(keep.astype(bool))), "text"):
                sets = _sets(part)
                if as_bytes:
                    tokens = pa.array([s.tobytes() for s in sets], pa.binary())
                else:
                    ends_ = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                    values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                    tokens = pa.ListArray.from_arrays(pa.array(ends_), pa.array(values))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), tokens], names=["id", "tokens"])

    sets = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("slot", slot)
    return sets.mapInArrow(worker_memory.trimmed(made), f"id bigint, tokens {'binary' if as_bytes else 'array<bigint>'}")


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose sets are similar; sets are made again from the texts of these documents."""
    ends = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    sets = _sets_of(docs, ends)
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(100 * shared >= SIMILAR * (F.size("x") + F.size("y") - shared)).select("a", "b")


def large_links(docs: DataFrame, grouped: DataFrame, buckets: int) -> DataFrame:
    """a, b: the links between the members of large components and documents outside of them.

    A document whose prefix meets that of a member is asked, with its whole set, what it shares with all sets of the component together,
    which bounds its overlap with each. Where that is enough, its set meets those of the members in parts of bounded
    size, and overlaps are counted there; pairs are no rows unless they link.
    """
    met = shared_with_big(grouped, buckets).select("rep").distinct().withColumn("meets", F.lit(1))
    wanted = grouped.drop("prefix").join(met, "rep", "left").where(F.col("meets").isNotNull() | (F.col("big") > 0)).drop("meets")
    sets = _sets_of(docs, wanted.select(F.col("rep").alias("id")), as_bytes=True)
    whole = materialize(wanted.join(sets.select(F.col("id").alias("rep"), F.col("tokens").alias("prefix")), "rep"))
    shares = shared_with_big(whole, buckets).withColumnRenamed("comp", "large")
    large = whole.where(F.col("big") > 0).groupBy(F.col("comp").alias("large")).agg(F.count("*").alias("members"), F.min("n").alias("least"))
    size = F.greatest(F.col("least"), F.ceil(SIMILAR * F.col("n") / 100))  # of the smallest member that fits
    enough = F.col("shared") * (100 + SIMILAR) >= SIMILAR * (F.col("n") + size)
    asked = materialize(shares.join(whole.select("rep", "n"), "rep").join(large, "large").where(enough).select("rep", "large").distinct())
    parts = asked.groupBy("large").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("askers")).join(large, "large").select(
        "large", "askers", F.ceil(F.col("members") / MEMBERS).cast("int").alias("shards"))
    spread = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["large", "shard", "asker", "asks", "rep", "n", "prefix"]
    queries = asked.join(whole.select("rep", "n", "prefix"), "rep").join(parts, "large").withColumns({"asker": spread("askers"), "asks": F.lit(True)})
    members = whole.where(F.col("big") > 0).withColumnRenamed("comp", "large").join(parts, "large").withColumns({"shard": spread("shards"), "asks": F.lit(False)})
    both = queries.withColumn("shard", every("shards")).select(columns).unionByName(members.withColumn("asker", every("askers")).select(columns))
    return both.groupBy("large", "shard", "asker").applyInArrow(_links_within, "a bigint, b bigint")


def _links_within(rows: pa.Table) -> pa.Table:
    """Similar pairs of an asking set and a member's."""
    asks = rows.column("asks").to_numpy()
    reps, sizes, blobs = rows.column("rep").to_numpy(), rows.column("n").to_numpy(), rows.column("prefix").to_pylist()
    inside = np.flatnonzero(~asks)
    tokens = np.frombuffer(b"".join([blobs[i] for i in inside.tolist()]), "<u8")
    owner = np.repeat(np.arange(len(inside)), [len(blobs[i]) // 8 for i in inside.tolist()])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in np.flatnonzero(asks).tolist():
        own = np.frombuffer(blobs[i], "<u8")
        first, end = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
        n = end - first
        at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        shared = np.bincount(owner[at], minlength=len(inside))
        hits = inside[100 * shared >= SIMILAR * (sizes[i] + sizes[inside] - shared)]
        left.append(np.minimum(reps[hits], reps[i]))
        right.append(np.maximum(reps[hits], reps[i]))
    return pa.table({"a": np.concatenate(left).astype(np.int64), "b": np.concatenate(right).astype(np.int64)})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    spark = docs.sparkSession
    known = materialize(profiles(docs, frequent_hashes(docs)))
    real = known.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = materialize(
        real.groupBy("sign_a", "sign_b", "n").agg(F.min("doc_id").alias("rep"), F.first("matches").alias("matches"), F.first("prefix").alias("prefix"))
    )
    total = classes.agg(F.sum(F.length("prefix")) / 8).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")), int(total // PER_BUCKET))
    # Documents that share no prefix hash with any other are done, and so are hashes that stand in one prefix only.
    plain = classes.select("rep", "n", "matches", F.col("rep").alias("comp"), F.lit(0).alias("big"))
    alone = materialize(plain.join(shared_prefixes(classes, buckets), "rep"))
    links = materialize(verified(docs, materialize(candidates(alone, buckets, across=False))))
    first = components(links)
    # Large components meet other documents set by set, others pair by pair.
    large = first.groupBy("component").count().where(F.col("count") >= BIG).select("component", F.lit(1).alias("is_big"))
    named = first.withColumnRenamed("node", "rep").join(large, "component", "left")
    grouped = alone.drop("comp", "big").join(named, "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    grouped = materialize(grouped.withColumn("big", F.coalesce("is_big", F.lit(0))).drop("component", "is_big"))
    rest = materialize(candidates(grouped, buckets, across=True))
    more = verified(docs, rest) if rest.limit(1).count() else rest
    if large.limit(1).count():
        more = more.unionAll(large_links(docs, grouped, buckets))
    more = materialize(more)
    final = components(links.unionAll(more)) if more.limit(1).count() else first
    named = classes.select("sign_a", "sign_b", "n", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("sign_a", "sign_b", "n", F.coalesce("component", "rep").alias("named"))
    found = known.select("doc_id", "n", "sign_a", "sign_b").join(named, ["sign_a", "sign_b", "n"], "left")
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("named", "doc_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, with their own columns, whose doc_id names their group; of rows that repeat it, one for each text.

    Texts are not shuffled by group: the ids that go are found first. Rows without an id stay, as nothing links them.
    """
    found = near_duplicates(docs)
    named = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_kept"))
    twice = named.groupBy("_kept").count().where(F.col("count") > 1).select("_kept")
    kept = docs.join(named.distinct(), docs["doc_id"].cast("bigint") == F.col("_kept"), "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))
    if not twice.limit(1).count():
        return kept
    # Rows of one id are one document only if their texts are equal.
    again = kept.join(twice, kept["doc_id"].cast("bigint") == F.col("_kept"), "left_semi").groupBy("doc_id", F.sha2("text", 256)).agg(
        F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")
    )
    single = kept.join(twice, kept["doc_id"].cast("bigint") == F.col("_kept"), "left_anti")
    return single.unionByName(again.select(*[F.col("row")[c].alias(c) for c in docs.columns]))
