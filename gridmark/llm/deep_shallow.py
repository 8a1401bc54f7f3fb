"""Deep-shallow sorting of many short suffixes: multikey quicksort, then blind tries.

The shallow phase orders suffixes by their first bytes, a machine word at a time, each word only within
runs that were equal so far. Runs that are equal to the shallow depth share a long prefix; they are
ordered by a blind trie, which branches on the first byte that differs and compares whole strings once an insertion.
"""

from __future__ import annotations

import numpy as np


class BlindTrie:
    """Byte strings of equal length; equal ones share a leaf.

    An inner node is (depth, children by byte); a leaf is (string, members).
    """

    def __init__(self):
        self.root = None

    def add(self, text: bytes, member: int) -> None:
        if self.root is None:
            self.root = (text, [member])
            return
        node = self.root
        while isinstance(node[1], dict):  # blindly: any child will do where none fits
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        other = node[0]
        if other == text:
            node[1].append(member)
            return
        depth = common_prefix(text, other)
        node, parent = self.root, None
        while isinstance(node[1], dict) and node[0] < depth:
            parent, node = node, node[1][text[node[0]]]
        leaf = (text, [member])
        if isinstance(node[1], dict) and node[0] == depth:
            node[1][text[depth]] = leaf
            return
        split = (depth, {text[depth]: leaf, other[depth]: node})
        if parent is None:
            self.root = split
        else:
            parent[1][text[parent[0]]] = split

    def leaves(self) -> list[list[int]]:
        """Members of equal strings, strings in order."""
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if isinstance(node[1], dict):
                stack.extend(node[1][byte] for byte in sorted(node[1], reverse=True))
            else:
                out.append(node[1])
        return out


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two different strings of equal length."""
    different = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (different.bit_length() + 7) // 8


def words_at(rows: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of each row, as big-endian numbers; rows end in eight spare bytes."""
    wide = rows.astype(np.uint64)
    n = rows.shape[1] - 7
    out = np.zeros((len(rows), n), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | wide[:, i : i + n]
    return out


def runs(different: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of runs, from marks of entries that differ from the one before."""
    starts = np.concatenate([[0], np.flatnonzero(different) + 1]) if n else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, n))


def sort_windows(
    rows: np.ndarray, group: np.ndarray, row: np.ndarray, at: np.ndarray, size: int, shallow: int = 2
) -> tuple[np.ndarray, np.ndarray]:
    """Order windows rows[row, at:at+size] within their group; returns (order, class of equal windows in that order).

    `shallow` words of eight bytes are sorted by multikey quicksort, a word at a time; the rest by blind tries.
    """
    n = len(row)
    words = words_at(rows)
    order = np.argsort(group, kind="stable")
    keys = group[order]
    different = keys[1:] != keys[:-1]
    for level in range(shallow):
        starts, sizes = runs(different, n)
        rank = np.repeat(np.arange(len(starts)), sizes)
        word = words[row[order], at[order] + 8 * level]
        again = np.lexsort((word, rank))
        order, word, rank = order[again], word[again], rank[again]
        different = (rank[1:] != rank[:-1]) | (word[1:] != word[:-1])
    starts, sizes = runs(different, n)
    classes = np.zeros(n, np.int64)
    classes[1:] = np.cumsum(different)
    # A trie of two leaves is one comparison: done for all such runs at once.
    two = starts[sizes == 2]
    if len(two):
        a, b = order[two], order[two + 1]
        offsets = [*range(8 * shallow, size - 7, 8), size - 8]
        unlike = np.zeros(len(two), bool)
        after = np.zeros(len(two), bool)
        for offset in offsets:
            x, y = words[row[a], at[a] + offset], words[row[b], at[b] + offset]
            after |= ~unlike & (x > y)
            unlike |= x != y
        order[two[after]], order[two[after] + 1] = b[after], a[after]
        split = np.zeros(n, np.int64)
        split[two[unlike] + 1] = 1
        classes += np.cumsum(split)
    many = sizes > 2
    splits = np.zeros(n, np.int64)
    for start, count in zip(starts[many].tolist(), sizes[many].tolist(), strict=True):
        trie = BlindTrie()
        members = order[start : start + count].copy()
        first, places = row[members].tolist(), at[members].tolist()
        for i, (r, p) in enumerate(zip(first, places, strict=True)):
            trie.add(rows[r, p + 8 * shallow : p + size].tobytes(), i)
        place = start
        for leaf in trie.leaves():
            order[place : place + len(leaf)] = members[leaf]
            if place > start:
                splits[place] = 1
            place += len(leaf)
    return order, classes + np.cumsum(splits)
