"""The best truth of every detection of a cell, compared in arrays.

Rows come cell by cell, a cell's detections before its truths. Detections are kept, truths are looked at block by block, so a task's
memory follows the detections of one cell, which the caller bounds, and never the truths or the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# No result depends on these values.
STEPS = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.0)  # IoU of the first round
DOWN = 0.2  # from one round to the next
BLOCK = 1 << 17  # truths looked at together
PAIRS = 1 << 17  # pairs compared at once
FEW = 1 << 18  # pairs that are not worth an index
FIRST = 8  # candidates a box should have, on average, in its first round
STRIP = 256  # boxes that look for all they overlap at once
NONE = np.iinfo(np.int64).max


class Boxes:
    """Centres and sizes with the edges and areas that ``functions.boxes.Box`` has."""

    def __init__(self, xc: np.ndarray, yc: np.ndarray, w: np.ndarray, h: np.ndarray) -> None:
        self.xc, self.yc, self.w, self.h = xc, yc, w, h
        self.x0, self.y0, self.x1, self.y1 = xc - w / 2.0, yc - h / 2.0, xc + w / 2.0, yc + h / 2.0
        self.area = w * h

    def __len__(self) -> int:
        return len(self.xc)


class Best:
    """The best truth of every box so far: its IoU, id and class, as a place among ``kinds``."""

    def __init__(self, n: int) -> None:
        self.iou, self.id, self.kind = np.zeros(n), np.full(n, NONE), np.full(n, -1, np.int32)


def distinct(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of equal boxes, and which of these each box is."""
    order = np.lexsort(parts)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for part in parts:
        new[1:] |= np.diff(part[order]) != 0
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


class _Band:
    """Truths of like widths and heights, by the cells of a grid, row by row."""

    def __init__(self, truths: Boxes, places: np.ndarray) -> None:
        w, h = truths.w[places], truths.h[places]
        self.sizes = (w.min(), w.max()), (h.min(), h.max())
        most = int(math.sqrt(4 * len(places))) + 1
        cells = []
        self.grid = []
        for place, (_, largest) in zip((truths.xc[places], truths.yc[places]), self.sizes):
            first = place.min()
            size = max(largest / 4.0, (place.max() - first) / most, np.finfo(float).tiny)
            cells.append(np.floor((place - first) / size).astype(np.int64))
            self.grid.append((first, size, int(cells[-1].max()) + 1))
        self.across = self.grid[0][2]
        cell = cells[1] * self.across + cells[0]
        self.order = places[np.argsort(cell, kind="stable")]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=self.across * self.grid[1][2]))])

    def runs(self, boxes: Boxes, who: np.ndarray, tau: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretches of ``order`` that hold all truths of an IoU of at least ``tau`` with a box: boxes, starts, lengths.

        The IoU of two boxes is the largest when they are concentric and of sizes as like as can be. The intersection of boxes of
        areas A and B is at least tau / (1 + tau) (A + B), so their overlap in a dimension is at least this by the smaller
        size of the other one. Bounds are taken a little wider than rounding asks for.
        """
        (w0, w1), (h0, h1) = self.sizes
        w, h, area = boxes.w[who], boxes.h[who], boxes.area[who]
        like_w, like_h = np.clip(w, w0, w1), np.clip(h, h0, h1)
        less_w, less_h = np.minimum(w, like_w), np.minimum(h, like_h)
        shared = less_w * less_h
        some = np.flatnonzero(shared >= tau * (1.0 - 1e-6) * (area + like_w * like_h - shared))
        who, w, h, area = who[some], w[some], h[some], area[some]
        least = tau[some] / (1.0 + tau[some]) * (1.0 - 1e-6)
        off_x = (w + w1) / 2.0 - least * (area + w0 * like_h[some]) / less_h[some] + w * 1e-6
        off_y = (h + h1) / 2.0 - least * (area + h0 * like_w[some]) / less_w[some] + h * 1e-6
        ends = []
        for place, off, (first, size, n) in zip((boxes.xc[who], boxes.yc[who]), (off_x, off_y), self.grid):
            ends.append((np.clip(np.floor((place - off - first) / size), 0, n), np.clip(np.floor((place + off - first) / size), -1, n - 1)))
        some = np.flatnonzero((off_x >= 0) & (off_y >= 0) & (ends[0][0] <= ends[0][1]) & (ends[1][0] <= ends[1][1]))
        left, right, top, bottom = (e[some].astype(np.int64) for pair in ends for e in pair)
        rows = bottom - top + 1
        every = rows > len(self.order)  # more rows than truths: all of them
        rows[every] = 1
        which = np.repeat(np.arange(len(some)), rows)
        row = (top[which] + np.arange(len(which)) - np.repeat(np.cumsum(rows) - rows, rows)) * self.across
        starts = np.where(every[which], 0, self.starts[row + left[which]])
        return who[some][which], starts, np.where(every[which], len(self.order), self.starts[row + right[which] + 1]) - starts


def _bands(truths: Boxes) -> list[list[_Band]]:
    """Bands, those of like widths together."""
    w, h = (np.floor(np.log2(size) * 2.0) for size in (truths.w, truths.h))
    order = np.lexsort((h, w))
    wide = np.split(order, np.flatnonzero(np.diff(w[order])) + 1)
    return [[_Band(truths, places) for places in np.split(column, np.flatnonzero(np.diff(h[column])) + 1)] for column in wide]


def _runs(bands: list[list[_Band]], boxes: Boxes, who: np.ndarray, tau: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Every band with boxes that may find a truth there: boxes, order, starts, lengths."""
    w = boxes.w[who]
    for column in bands:
        w0, w1 = min(band.sizes[0][0] for band in column), max(band.sizes[0][1] for band in column)
        some = np.flatnonzero((w1 >= w * tau * (1.0 - 1e-6)) & (w >= w0 * tau * (1.0 - 1e-6)))
        if len(some):
            near, least = who[some], tau[some]
            for band in column:
                found, starts, lengths = band.runs(boxes, near, least)
                yield found, band.order, starts, lengths


def _compare(boxes: Boxes, truths: Boxes, ids: np.ndarray, kinds: np.ndarray, d: np.ndarray, t: np.ndarray, best: Best) -> None:
    """Pairs of boxes ``d`` (pairs of one box side by side) and truths ``t``; of equal IoU the smallest id is best."""
    across = np.minimum(boxes.x1[d], truths.x1[t]) - np.maximum(boxes.x0[d], truths.x0[t])
    down = np.minimum(boxes.y1[d], truths.y1[t]) - np.maximum(boxes.y0[d], truths.y0[t])
    met = np.flatnonzero((across > 0) & (down > 0))
    d, t, shared = d[met], t[met], across[met] * down[met]
    whole = boxes.area[d] + truths.area[t] - shared
    whole[whole <= 0] = np.inf
    iou = shared / whole
    iou[np.isnan(iou)] = np.inf  # infinite areas: NaN is the largest number for Spark
    good = np.flatnonzero(iou > 0)
    if not len(good):
        return
    d, t, iou = d[good], t[good], iou[good]
    first = np.flatnonzero(np.diff(d, prepend=-1))
    top = np.maximum.reduceat(iou, first)
    # Truths lie by their ids.
    tied = np.where(iou == np.repeat(top, np.diff(first, append=len(d))), t, len(truths))
    t, d = np.minimum.reduceat(tied, first), d[first]
    better = (top > best.iou[d]) | ((top == best.iou[d]) & (ids[t] < best.id[d]))
    d, t = d[better], t[better]
    best.iou[d], best.id[d], best.kind[d] = top[better], ids[t], kinds[t]


def _look(boxes: Boxes, truths: Boxes, ids: np.ndarray, kinds: np.ndarray, who: np.ndarray, order: np.ndarray, starts: np.ndarray,
          lengths: np.ndarray, best: Best) -> None:
    """Compare boxes with stretches of ``order``, so many pairs at a time."""
    some = np.flatnonzero(lengths)
    who, starts, lengths = who[some], starts[some].astype(np.int64), lengths[some].astype(np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < len(ends):
        before = int(ends[at] - lengths[at])
        upto = max(at + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
        n = lengths[at:upto]
        place = np.repeat(starts[at:upto] - (ends[at:upto] - n - before), n) + np.arange(int(ends[upto - 1]) - before)
        _compare(boxes, truths, ids, kinds, np.repeat(who[at:upto], n), order[place], best)
        at = upto


def _all_overlapping(boxes: Boxes, truths: Boxes, ids: np.ndarray, kinds: np.ndarray, who: np.ndarray, best: Best) -> None:
    """Compare boxes with every truth they overlap: strips of boxes downwards, truths of a strip and of like widths from left to right."""
    who = who[np.argsort(boxes.y0[who], kind="stable")]
    for k in range(0, len(who), STRIP):
        strip = who[k : k + STRIP]
        near = np.flatnonzero((truths.y1 > boxes.y0[strip].min()) & (truths.y0 < boxes.y1[strip].max()))
        octave = np.frexp(truths.w[near])[1]
        for o in np.unique(octave):
            some = near[octave == o]
            some = some[np.argsort(truths.x0[some], kind="stable")]
            # Before the first all end left of the box, from the last on all begin right of it.
            first = np.searchsorted(np.maximum.accumulate(truths.x1[some]), boxes.x0[strip], "right")
            last = np.searchsorted(truths.x0[some], boxes.x1[strip], "left")
            _look(boxes, truths, ids, kinds, strip, some, first, np.maximum(0, last - first), best)


def improve(boxes: Boxes, truths: Boxes, ids: np.ndarray, kinds: np.ndarray, best: Best) -> None:
    """Take a block of truths, by ascending ids, into the best of the boxes.

    A round finds all pairs of at least an IoU, which is lower from round to round though never below a box's best so far. A box is done
    when its best reaches that of its round. Boxes too small for their place, whose edges are rounded too much for
    bounds, look at all they overlap.
    """
    fit = np.isfinite(boxes.area)
    for place, size in ((boxes.xc, boxes.w), (boxes.yc, boxes.h)):
        fit &= size >= (np.abs(place) + size) * 1e-6
    if len(boxes) * len(truths) <= FEW:
        fit[:] = False
    _all_overlapping(boxes, truths, ids, kinds, np.flatnonzero(~fit), best)
    who = np.flatnonzero(fit)
    if not len(who):
        return
    bands = _bands(truths)
    sample = who[:: max(1, len(who) >> 8)]
    step = next(s for s in STEPS if not s or sum(
        int(run[-1].sum()) for run in _runs(bands, boxes, sample, np.full(len(sample), s))) >= FIRST * len(sample))
    tau = np.maximum(best.iou[who], step)
    while len(who):
        for run in _runs(bands, boxes, who, tau):
            _look(boxes, truths, ids, kinds, *run, best)
        on = best.iou[who] < tau
        who, tau = who[on], tau[on]
        tau = np.maximum(best.iou[who], np.where(tau > DOWN, tau - DOWN, 0.0))


class _Cell:
    """Detections of a cell, and the truths that wait for their turn."""

    def __init__(self) -> None:
        self.rows: list[pa.RecordBatch] = []
        self.waiting: list[pa.RecordBatch] = []
        self.waits = 0
        self.boxes: Boxes | None = None
        self.kinds: dict[object, int] = {}

    def add(self, rows: pa.RecordBatch, truth_id: str) -> None:
        seen = rows.column(truth_id).null_count  # NULLs come first, and they are detections
        if seen:
            self.rows.append(rows.slice(0, seen))
        # Truths that no detection can meet are left out.
        if seen < rows.num_rows and self.rows:
            self.waiting.append(rows.slice(seen))
            self.waits += rows.num_rows - seen
            if self.waits >= BLOCK:
                self.take(truth_id)

    def take(self, truth_id: str) -> None:
        if self.boxes is None:
            parts = _parts(pa.Table.from_batches(self.rows))
            places, self.which = distinct(parts)
            self.boxes, self.best = Boxes(*[p[places] for p in parts]), Best(len(places))
        if not self.waits:
            return
        block = pa.Table.from_batches(self.waiting)
        self.waiting, self.waits = [], 0
        parts, ids = _parts(block), block.column(truth_id).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
        places = np.sort(distinct(parts)[0])
        coded = block.column("class_id").combine_chunks().dictionary_encode()
        codes = np.array([self.kinds.setdefault(v, len(self.kinds)) for v in coded.dictionary.to_pylist()] + [-1], np.int32)
        kinds = codes[pc.fill_null(coded.indices, len(codes) - 1).to_numpy(zero_copy_only=False)]
        improve(self.boxes, Boxes(*[p[places] for p in parts]), ids[places], kinds[places], self.best)

    def claims(self, truth_id: str, own: list[str], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """The detections with IoU, negative truth id and truth class, NULL without any overlap."""
        if not self.rows:
            return
        self.take(truth_id)
        none = (self.best.iou == 0)[self.which]
        iou = np.where(np.isinf(self.best.iou), np.nan, self.best.iou)[self.which]
        values = pa.array(list(self.kinds), kind).take(pa.array(self.best.kind, mask=self.best.kind < 0))
        answers = [pa.array(iou, mask=none), pa.array(-self.best.id[self.which], mask=none), values.take(pa.array(self.which))]
        at = 0
        for rows in self.rows:
            n = rows.num_rows
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in own] + [a.slice(at, n) for a in answers], names=[*own, "_iou", "_neg", "_kind"])
            at += n


def _parts(rows: pa.Table) -> list[np.ndarray]:
    return [rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("xc", "yc", "w", "h")]


def claims(batches: Iterator[pa.RecordBatch], cell: list[str], own: list[str], truth_id: str) -> Iterator[pa.RecordBatch]:
    """Best truths of detections that lie sorted by cell and truth id, detections having none."""
    now, last = _Cell(), None
    with np.errstate(all="ignore"):
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for name in cell:
                column = batch.column(name)
                new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
            new[0] = last is not None and [batch.column(c)[0].as_py() for c in cell] != last
            kind = batch.schema.field("class_id").type
            at = 0
            for cut in [*np.flatnonzero(new).tolist(), batch.num_rows]:
                if cut > at:
                    now.add(batch.slice(at, cut - at), truth_id)
                if cut < batch.num_rows:
                    yield from now.claims(truth_id, own, kind)
                    now = _Cell()
                at = cut
            last = [batch.column(c)[batch.num_rows - 1].as_py() for c in cell]
        if last is not None:
            yield from now.claims(truth_id, own, kind)
