"""Suffix-array removal of byte strings that an earlier document holds.

A byte goes if it lies in a string of `size` bytes that also starts in a document with a smaller id.
Whole suffix arrays are too large to shuffle, so only suffixes at anchors are: places whose hash of `GRAM`
bytes is the least in some window of `size` bytes. Equal windows have equal anchors, so every repeat is met
at an anchor of its own; none is missed.

1. Anchors of all texts meet by hash. Copies with equal surroundings (all bytes that share a window with the
   anchor) form one class; in all its documents but the first, all these windows go.
2. The first document of each class may still share part of its surroundings with another class of the same
   hash. There, the windows of all classes, which are suffixes of the surroundings, are put in order by
   deep-shallow sorting, and a window goes if an equal one stands with it that belongs to an earlier document.
3. Spans of removed bytes meet the texts again, by document.

Frequent strings are no trouble: their copies are one class, and classes are sorted, never paired.

Defined results: a null text is empty; matches do not cross documents; documents are ordered by doc_id, and, where
ids are null (first) or repeated, by their texts, as documents of their own; other columns are ignored; an empty table gives
no rows. Long texts are cut for the hashing with an overlap, so memory does not follow them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmark.llm import packed_rows
from gridmark.llm.deep_shallow import runs, sort_windows
from gridmark.llm.tables import slices, utf8_column
from gridmark.llm.word_hashes import mix
from gridmark.session import materialize

SIZE, GRAM = 50, 20
SEGMENT = 1 << 20  # bytes hashed at a time
PER_BUCKET = 200_000  # anchors of a bucket, about
_VALUES = np.random.default_rng(50).integers(1, 2**63, 256, dtype=np.uint64) * 2 + 1
_BASE = np.uint64(0xD6E8FEB86659FD93)
_POWER = {n: np.uint64(pow(int(_BASE), n, 2**64)) for n in (1, 2, 4, 8)}
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
ANCHOR = {"hash": "<u8", "around": "<u8", "doc": "<i8", "at": "<u4"}
SPAN = {"doc": "<i8", "start": "<u4", "end": "<u4", "open": "u1", "hash": "<u8"}
REST = "hash bigint, doc bigint, at bigint, left int, bytes binary"


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes (16 + 4) from each place."""
    h, by_length = _VALUES[raw], {}
    for length in (1, 2, 4, 8):
        h = h[:-length] * _POWER[length] + h[length:]
        by_length[2 * length] = h
    n = len(raw) - GRAM + 1
    return mix(by_length[16][:n] * _POWER[4] + by_length[4][16 : 16 + n])


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of every `width` neighbours, by doubling."""
    out, reach = values, 1
    while 2 * reach <= width:
        out = best(out[:-reach], out[reach:])
        reach *= 2
    return best(out[: len(values) - width + 1], out[width - reach :]) if reach < width else out


def anchors(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of consecutive texts in `raw`."""
    if len(raw) < SIZE:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams, width = gram_hashes(raw), SIZE - GRAM + 1
    least = sliding(grams, width, np.minimum)
    crossing = np.zeros(len(least) + 1, np.int64)  # windows that would cross the end of a text
    np.add.at(crossing, np.clip(bounds[1:-1] - SIZE + 1, 0, len(least)), 1)
    np.add.at(crossing, np.clip(bounds[1:-1], 0, len(least)), -1)
    least[np.cumsum(crossing[:-1]) > 0] = 0
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    at = np.flatnonzero((sliding(padded, width, np.maximum)[: len(grams)] == grams) & (grams > 0))
    return at, grams[at]


def surroundings(raw: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of raw[start:end] for each anchor, with how much of it lies before and behind `at`."""
    forward = powers_of(_BASE, len(raw))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[raw] * forward[: len(raw)], dtype=np.uint64)])
    back = powers_of(_INVERSE, len(raw))[start]
    shape = (at - start).astype(np.uint64) * np.uint64(1 << 20) + (end - at).astype(np.uint64)
    return mix((sums[end] - sums[start]) * back + shape * np.uint64(0x9E3779B97F4A7C15))


_POWERS: dict[int, np.ndarray] = {}


def powers_of(base: np.uint64, n: int) -> np.ndarray:
    held = _POWERS.get(int(base))
    if held is None or len(held) < n + 1:
        steps = np.full(1 << max(16, int(n + 1).bit_length()), base, np.uint64)
        steps[0] = 1
        held = _POWERS[int(base)] = np.multiply.accumulate(steps)
    return held


def _segments(raw: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(index of each text, place of its part in it, bytes, offsets): texts together up to SEGMENT, long ones in overlapping parts."""
    first, n = 0, len(bounds) - 1
    while first < n:
        size = bounds[first + 1] - bounds[first]
        if size > SEGMENT:
            for start in range(0, int(size), SEGMENT):
                a = bounds[first] + max(0, start - 2 * SIZE)
                b = min(bounds[first + 1], bounds[first] + start + SEGMENT + 2 * SIZE)
                yield np.array([first]), np.array([a - bounds[first]]), raw[a:b], np.array([0, b - a])
            first += 1
            continue
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + SEGMENT, side="right")) - 1)
        yield np.arange(first, last), np.zeros(last - first, np.int64), raw[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def _anchor_rows(docs: DataFrame, buckets: int) -> DataFrame:
    """Anchors of all texts, packed by bucket of their hash."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", 8 << 20)):
            raw, bounds = utf8_column(batch.column("text"))
            ids = batch.column("uid").to_numpy()
            columns: dict[str, list[np.ndarray]] = {name: [] for name in ANCHOR}
            for texts, shifts, part, edges in _segments(raw, bounds):
                at, hashes = anchors(part, edges)
                text = np.searchsorted(edges, at, side="right") - 1
                start = np.maximum(at - (SIZE - GRAM), edges[text])
                end = np.minimum(at + SIZE, edges[text + 1])
                whole = np.ones(len(at), bool)
                if len(texts) == 1 and (shifts[0] or bounds[texts[0] + 1] - bounds[texts[0]] > SEGMENT):
                    # Parts of a long text overlap: an anchor counts where its surroundings are complete.
                    size = bounds[texts[0] + 1] - bounds[texts[0]]
                    whole = ((start > 0) | (shifts[0] == 0)) & ((end < len(part)) | (shifts[0] + len(part) == size))
                for name, values in (("hash", hashes), ("around", surroundings(part, start, end, at)), ("doc", ids[texts[text]]), ("at", at - edges[text] + shifts[text])):
                    columns[name].append(values[whole].astype(ANCHOR[name]))
            joined = {name: np.concatenate(parts) if parts else np.zeros(0, ANCHOR[name]) for name, parts in columns.items()}
            yield packed_rows.scatter((mix(joined["hash"]) % np.uint64(buckets)).astype(np.int64), joined)

    return docs.mapInArrow(found, packed_rows.schema(list(ANCHOR))).repartition("bucket")


def _classified(anchor_rows: DataFrame, buckets: int) -> DataFrame:
    """Packed by bucket of the document: spans that go (open = 0), and anchors whose surroundings are to be compared (open = 1)."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = packed_rows.gather(batches, ANCHOR)
        order = np.argsort(rows["hash"], kind="stable")
        hashes = rows["hash"][order]
        starts, sizes = runs(hashes[1:] != hashes[:-1], len(order))
        order = order[np.repeat(sizes > 1, sizes)]
        order = order[np.lexsort((rows["doc"][order], rows["around"][order], rows["hash"][order]))]
        rows = {name: values[order] for name, values in rows.items()}
        n = len(order)
        new_hash = rows["hash"][1:] != rows["hash"][:-1]
        group, group_size = runs(new_hash, n)
        kind, kind_size = runs(new_hash | (rows["around"][1:] != rows["around"][:-1]), n)
        first = np.repeat(rows["doc"][kind], kind_size)  # first document of the class
        least = np.repeat(np.minimum.reduceat(rows["doc"], group), group_size) if n else rows["doc"]
        kinds = np.repeat(np.add.reduceat(np.isin(np.arange(n), kind).astype(np.int64), group), group_size) if n else rows["doc"]
        gone = rows["doc"] > first
        # Of a hash with several classes, one anchor of every class is a source, and all of its first document ask.
        lead = np.zeros(n, bool)
        lead[kind] = True
        most = np.repeat(np.maximum.reduceat(rows["doc"], group), group_size) if n else rows["doc"]
        asks = (kinds > 1) & (least < most) & ~gone & (lead | (first > least))
        at = rows["at"].astype(np.int64)
        for some, open_ in ((gone, 0), (asks, 1)):
            picked = np.flatnonzero(some)
            start = np.maximum(at[picked] - (SIZE - GRAM), 0) if not open_ else at[picked]
            doc = rows["doc"][picked]
            columns = {
                "doc": doc, "start": start.astype("<u4"), "end": (at[picked] + SIZE).astype("<u4"),
                "open": np.full(len(picked), open_, "u1"), "hash": rows["hash"][picked] if open_ else np.zeros(len(picked), "<u8"),
            }
            if len(picked):
                yield packed_rows.scatter((mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64), columns)

    return anchor_rows.mapInArrow(met, packed_rows.schema(list(SPAN)))


def _text_rows(docs: DataFrame, buckets: int) -> DataFrame:
    """Texts, compressed, in the same shape and buckets as packed spans."""

    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("uid").to_numpy()
            bucket = (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            for part in range(0, len(ids), 1000):
                texts = batch.column("text")[part : part + 1000].fill_null("").to_pylist()
                blobs = [pa.compress(t.encode(), codec="zstd", asbytes=True) for t in texts]
                sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[part : part + 1000]), batch.column("uid")[part : part + 1000], batch.column("doc_id")[part : part + 1000], sizes, pa.array(blobs, pa.binary())],
                    names=["bucket", "uid", "doc_id", "size", "text"],
                )

    return docs.mapInArrow(squeezed, "bucket int, uid bigint, doc_id bigint, size bigint, text binary")


def _together(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Texts and spans of a bucket in one task; one shuffle for both."""
    names = [c for c in (*texts.columns, *SPAN) if c != "bucket"]
    left = texts.select("bucket", *texts.columns[1:], *[F.lit(None).cast("binary").alias(c) for c in SPAN])
    empty = {"uid": "bigint", "doc_id": "bigint", "size": "bigint", "text": "binary"}
    right = spans.select("bucket", *[F.lit(None).cast(kind).alias(c) for c, kind in empty.items()], *SPAN)
    return left.unionAll(right).repartition("bucket").select(*names)


def _held(batches: Iterator[pa.RecordBatch]) -> tuple[list[tuple], dict[str, np.ndarray]]:
    """The compressed texts of a task, and its spans in order of document and place."""
    texts: list[tuple] = []
    parts: dict[str, list[bytes]] = {name: [] for name in SPAN}
    for batch in batches:
        is_text = batch.column("text").is_valid()
        some = batch.filter(is_text)
        texts += zip(*[some.column(c).to_pylist() for c in ("uid", "doc_id", "size", "text")], strict=True)
        rest = batch.filter(pa.compute.invert(is_text))
        for name in SPAN:
            parts[name].extend(rest.column(name).to_pylist())
    spans = {name: packed_rows.unpack(parts[name], kind) for name, kind in SPAN.items()}
    order = np.lexsort((spans["start"], spans["doc"]))
    return texts, {name: values[order] for name, values in spans.items()}


def _asked(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """The surroundings of the anchors that are to be compared."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_ = _held(batches)
        docs = open_["doc"]
        columns: list[list] = [[], [], [], [], []]
        for uid, _, size, blob in held:
            a, b = np.searchsorted(docs, uid), np.searchsorted(docs, uid, side="right")
            if a == b:
                continue
            text = pa.decompress(blob, size, codec="zstd", asbytes=True)
            for at, hash_ in zip(open_["start"][a:b].tolist(), open_["hash"][a:b].view(np.int64).tolist(), strict=True):
                first = max(0, at - (SIZE - GRAM))
                for column, value in zip(columns, (hash_, uid, at, at - first, text[first : at + SIZE]), strict=True):
                    column.append(value)
            if len(columns[0]) > 50_000:
                yield _rest_batch(columns)
                columns = [[], [], [], [], []]
        yield _rest_batch(columns)

    return _together(texts, spans).mapInArrow(cut, REST)


def _rest_batch(columns: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["hash", "doc", "at", "left", "bytes"])


def _compared(asked: DataFrame, buckets: int) -> DataFrame:
    """Spans of windows that an earlier document holds, by deep-shallow sorting of all windows of a task."""

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=None) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        by_hash = np.argsort(table.column("hash").to_numpy(), kind="stable")
        hashes = table.column("hash").to_numpy()[by_hash]
        starts, sizes = runs(hashes[1:] != hashes[:-1], len(hashes))
        ends = np.cumsum(sizes)
        first = 0
        while first < len(starts):  # whole hashes, about 20,000 anchors at a time
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + 20_000, side="right")))
            piece = table.take(pa.array(by_hash[starts[first] : ends[last - 1]]))
            first = last
            if (found := _windows(piece)) is not None:
                doc, start, end = found
                columns = {
                    "doc": doc, "start": start.astype("<u4"), "end": end.astype("<u4"),
                    "open": np.zeros(len(doc), "u1"), "hash": np.zeros(len(doc), "<u8"),
                }
                yield packed_rows.scatter((mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64), columns)

    return asked.repartition("hash").mapInArrow(ordered, packed_rows.schema(list(SPAN)))


def _windows(piece: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    blobs = piece.column("bytes").to_pylist()
    n, wide = len(blobs), 2 * SIZE - GRAM
    length = np.array([len(b) for b in blobs], np.int64)
    rows = np.frombuffer(b"".join(b.ljust(wide + 8, b"\0") for b in blobs), np.uint8).reshape(n, wide + 8)
    doc, at = piece.column("doc").to_numpy(), piece.column("at").to_numpy()
    left = piece.column("left").to_numpy().astype(np.int64)
    _, group = np.unique(piece.column("hash").to_numpy(), return_inverse=True)
    # A window is compared at the anchors that are least in it, which equal windows share.
    grams = np.stack([gram_hashes(r) for r in rows[:, :wide]]) if n < 64 else _row_grams(rows[:, :wide])
    places = wide - SIZE + 1
    least = np.stack([grams[:, j : j + SIZE - GRAM + 1].min(axis=1) for j in range(places)], axis=1)
    own = grams[np.arange(n), left]
    good = (least == own[:, None]) & (np.arange(places)[None, :] + SIZE <= length[:, None])
    row, place = np.nonzero(good)
    if not len(row):
        return None
    order, classes = sort_windows(rows, group[row], row, place, SIZE)
    starts, sizes = runs(classes[1:] != classes[:-1], len(classes))
    owner = doc[row[order]]
    least_doc = np.repeat(np.minimum.reduceat(owner, starts), sizes)
    gone = order[owner > least_doc]
    if not len(gone):
        return None
    start = at[row[gone]] - left[row[gone]] + place[gone]
    return merged(doc[row[gone]], start, start + SIZE)


def _row_grams(rows: np.ndarray) -> np.ndarray:
    """gram_hashes of every row at once."""
    n, wide = rows.shape
    flat = gram_hashes(np.ascontiguousarray(rows).reshape(-1))
    out = np.concatenate([flat, np.zeros(GRAM - 1, np.uint64)]).reshape(n, wide)
    return out[:, : wide - GRAM + 1]


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document joined where they touch or overlap."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int64), end[order].astype(np.int64)
    firsts = np.concatenate([[True], doc[1:] != doc[:-1]])
    block = np.cumsum(firsts) - 1
    lift = block * np.int64(1 << 33)  # keeps the running maximum within a document
    reach = np.maximum.accumulate(end + lift)
    fresh = np.concatenate([[True], start[1:] + lift[1:] > reach[:-1]])
    at = np.flatnonzero(fresh)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], reach[last] - lift[last]


def _removed(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """What is left of each text, as counts, digest and spans."""
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, starts array<bigint>, ends array<bigint>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, spans_ = _held(batches)
        doc, start, end = merged(spans_["doc"], spans_["start"], spans_["end"])
        rows = []
        for uid, doc_id, size, blob in held:
            text = pa.decompress(blob, size, codec="zstd", asbytes=True) if size else b""
            a, b = np.searchsorted(doc, uid), np.searchsorted(doc, uid, side="right")
            starts, ends = start[a:b].tolist(), np.minimum(end[a:b], size).tolist()
            kept, place = hashlib.sha256(), 0
            view = memoryview(text)
            for s, e in zip(starts, ends, strict=True):
                kept.update(view[place:s])
                place = e
            kept.update(view[place:])
            rows.append((doc_id, size, sum(ends) - sum(starts), len(starts), kept.hexdigest(), starts, ends))
            if len(rows) == 10_000:
                yield _removed_batch(rows)
                rows = []
        yield _removed_batch(rows)

    return _together(texts, spans).mapInArrow(cut, schema)


def _removed_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, and the removed byte ranges (starts, ends)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ids = docs.groupBy("doc_id").count().where(F.col("doc_id").isNull() | (F.col("count") > 1))
    if ids.limit(1).count():  # ids do not order the rows: number them
        ordered = docs.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text")
        docs = materialize(ordered.withColumn("uid", F.monotonically_increasing_id()))
    else:
        docs = docs.withColumn("uid", F.col("doc_id"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * parts, int(total // 18 // PER_BUCKET))
    spans = materialize(_classified(_anchor_rows(docs, buckets), buckets))
    texts = _text_rows(docs, buckets)
    is_open = F.substring("open", 1, 1) == F.lit(b"\x01")  # all records of a packed row are of one kind
    rest = _compared(_asked(texts, spans.where(is_open)), buckets)
    return _removed(texts, spans.where(~is_open).unionAll(rest))
