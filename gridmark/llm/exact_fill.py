"""Best-fit packing by exact complements, planned on the table of lengths.

The plan needs only how many pieces there are of each length, at most `capacity` numbers, so
it is the same work for any number of documents. Sums of one, two and three lengths that are
still available are indexed; a length takes the combination that fills its gap exactly, as
often as all its parts last. What finds no exact complement is placed best fit, longest first.
"""

from __future__ import annotations

import numpy as np


class SumIndex:
    """Counts of singles, pairs and triples of available lengths by their sum, kept as lengths run out.

    Repeats of one length within a combination are counted here and checked when it is taken.
    """

    def __init__(self, available: np.ndarray):
        self.capacity = len(available) - 1
        self.left = available.copy()
        self.single = (available > 0).astype(np.int64)
        ordered = np.convolve(self.single, self.single)[: self.capacity + 1]
        same = np.zeros_like(ordered)
        same[0::2] = self.single[: len(same[0::2])]
        self.pair = (ordered + same) // 2
        self.triple = np.zeros(self.capacity + 1, np.int64)
        lengths = np.flatnonzero(self.single)
        for length in lengths:  # triples whose longest part is this one
            below = np.zeros(self.capacity + 1, np.int64)
            parts = lengths[lengths <= length]
            mark = np.zeros(length + 1, np.int64)
            mark[parts] = 1
            pairs = np.convolve(mark, mark)
            pairs[0::2] += mark[: len(pairs[0::2])]
            pairs = (pairs // 2)[: self.capacity + 1 - length]
            below[length : length + len(pairs)] = pairs
            self.triple += below

    def take(self, length: int, times: int) -> None:
        self.left[length] -= times
        if self.left[length] == 0:
            self._gone(length)

    def _gone(self, x: int) -> None:
        size = self.capacity + 1
        pair = self.pair.copy()
        pair[x:] -= self.single[: size - x]  # x with any length, itself included
        three = np.zeros(size, np.int64)
        three[x:] = self.pair[: size - x]  # x with any pair, pairs of x included
        self.triple -= three
        self.pair = pair
        self.single[x] = 0

    def fill(self, gap: int) -> list[int] | None:
        """Available lengths, one to three, longest first, that sum to the gap; fewest parts preferred."""
        if gap == 0:
            return []
        if self.left[gap] > 0:
            return [gap]
        if self.pair[gap] > 0 and (two := self._two(gap, self.left)):
            return two
        if self.triple[gap] > 0:
            longest = np.flatnonzero(self.left[: gap + 1])
            for a in longest[self.pair[gap - longest] > 0][::-1]:
                left = self.left.copy()
                left[a] -= 1
                if two := self._two(gap - int(a), left):
                    return [int(a), *two]
        return None

    @staticmethod
    def _two(gap: int, left: np.ndarray) -> list[int] | None:
        a = np.arange(gap // 2 + gap % 2, gap)
        good = (left[a] > 0) & (left[gap - a] > 0) & ((2 * a != gap) | (left[a] > 1))
        found = a[good]
        return [int(found[-1]), int(gap - found[-1])] if len(found) else None


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(number of sequences, lengths in each) so that every piece is used once and no sequence overflows."""
    available = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        available[length] = n
    index, plan = SumIndex(available), []
    rest = np.zeros(capacity + 1, np.int64)
    for length in range(capacity, 0, -1):
        while index.left[length] > 0:
            index.left[length] -= 1  # this piece is not available for its own gap
            parts = index.fill(capacity - length)
            index.left[length] += 1
            if parts is None:
                rest[length] = index.left[length]
                index.take(length, int(rest[length]))
                break
            bins = [length, *parts]
            times = min(int(index.left[x]) // bins.count(x) for x in set(bins))
            for x in set(bins):
                index.take(x, times * bins.count(x))
            plan.append((times, bins))
    return plan + _best_fit(rest, capacity)


def _best_fit(rest: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Best fit, longest first, over groups of sequences with equal contents."""
    open_: list[list] = [[] for _ in range(capacity + 1)]  # by gap: [times, lengths]
    for length in range(capacity, 0, -1):
        n = int(rest[length])
        gap = length
        while n:
            while gap <= capacity and not open_[gap]:
                gap += 1
            if gap > capacity:  # no gap is large enough: new sequences, as full of this length as can be
                each = min(capacity // length, n)
                open_[capacity - each * length].append([n // each, [length] * each])
                n -= n // each * each
                gap = length
                continue
            times, bins = open_[gap].pop()
            used = min(times, n)
            if used < times:
                open_[gap].append([times - used, bins])
            open_[gap - length].append([used, [*bins, length]])
            n -= used
            if gap - length >= length:
                gap = length
    return [(times, bins) for groups in open_ for times, bins in groups]


def slots(plan: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by their rank among pieces of that length (columns sorted by length, first).

    A slot takes `each` pieces of one length in every sequence from `sequence` on, beginning at `offset`.
    """
    rows, used, sequence = [], {}, 0
    for times, bins in plan:
        offset = 0
        for length in sorted(set(bins), reverse=True):
            each = bins.count(length)
            rows.append((length, used.get(length, 0), sequence, each, offset))
            used[length] = used.get(length, 0) + times * each
            offset += length * each
        sequence += times
    rows.sort()
    names = ("length", "first", "sequence", "each", "offset")
    return {name: np.array(values, np.int64) for name, values in zip(names, zip(*rows, strict=True), strict=True)} if rows else {name: np.zeros(0, np.int64) for name in names}
