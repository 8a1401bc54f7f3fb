"""Levenshtein automata intersected with a trie of terms."""

from __future__ import annotations


class Automaton:
    """All strings within `most` edits of a word, as a bit-parallel automaton.

    A state is most + 1 sets of places in the word; set j holds the places reached with at most j edits.
    """

    def __init__(self, word: str, most: int):
        self.most, self.end = most, 1 << len(word)
        self.all = (self.end << 1) - 1
        self.places: dict[str, int] = {}
        for i, char in enumerate(word):
            self.places[char] = self.places.get(char, 0) | (2 << i)

    def start(self) -> tuple[int, ...]:
        return tuple((2 << j) - 1 & self.all for j in range(self.most + 1))

    def step(self, state: tuple[int, ...], char: str) -> tuple[int, ...]:
        match = self.places.get(char, 0)
        before, now = state[0], (state[0] << 1) & match
        out = [now]
        for held in state[1:]:
            now = ((held << 1) & match | before | before << 1 | now << 1) & self.all
            before = held
            out.append(now)
        return tuple(out)

    def edits(self, state: tuple[int, ...]) -> int | None:
        """Edits with which the word ends in this state, None if it does not."""
        for j, held in enumerate(state):
            if held & self.end:
                return j
        return None


def letters(word: str) -> int:
    """The letters of a word as bits; letters that share a bit only make it less exact."""
    bits = 0
    for char in word:
        bits |= 1 << (ord(char) & 63)
    return bits


def _letters_fit(own: int, terms: list[tuple[int, int]]) -> bool:
    """An edit takes one letter away and adds one, at most."""
    for other, most in terms:
        if (own & ~other).bit_count() <= most and (other & ~own).bit_count() <= most:
            return True
    return False


def tolerated(term: str) -> int:
    """Edits a term tolerates: none below five letters, one below nine, else two."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Trie:
    """Terms by their letters. Words match misspelled, too; stems match what begins with them, `exact` words themselves only."""

    END = ""

    def __init__(self, words: list[str], stems: list[str], exact: list[str] = ()):
        self.root: dict = {}
        self.words, self.stems = {*words, *exact}, set(stems)
        self.stem_lengths = sorted({len(s) for s in stems}, reverse=True)
        # Of most + 1 pieces of a term at least one is unchanged. By length of the other word: beginnings, ends, inner pieces, with the letters and edits of their terms.
        self.pieces: dict[int, tuple[dict[str, list[tuple[int, int]]], ...]] = {}
        for word in words:
            most = tolerated(word)
            if not most:
                continue
            node = self.root
            for char in word:
                node = node.setdefault(char, {})
            node[self.END] = word
            cut, own = len(word) // (most + 1), (letters(word), most)
            for n in range(len(word) - most, len(word) + most + 1):
                begins, ends, inner = self.pieces.setdefault(n, ({}, {}, {}))
                begins.setdefault(word[:cut], []).append(own)
                ends.setdefault(word[most * cut :], []).append(own)
                if most == 2:
                    inner.setdefault(word[cut : 2 * cut], []).append(own)
        self.cuts = {n: tuple(sorted({len(p) for p in part}) for part in found) for n, found in self.pieces.items()}

    def worth(self, word: str) -> bool:
        """False only for words that are near no term."""
        found = self.pieces.get(len(word))
        if found is None:
            return False
        begins, ends, inner = self.cuts[len(word)]
        own = letters(word)
        for n in begins:
            if (terms := found[0].get(word[:n])) and _letters_fit(own, terms):
                return True
        for n in ends:
            if (terms := found[1].get(word[-n:])) and _letters_fit(own, terms):
                return True
        for n in inner:  # two edits move an inner piece by two places at most
            for at in range(max(0, n - 2), n + 3):
                if (terms := found[2].get(word[at : at + n])) and _letters_fit(own, terms):
                    return True
        return False

    def find(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its distance: the word itself, the longest stem it begins with, or a term within the edits allowed."""
        if word in self.words:
            return word, 0
        for n in self.stem_lengths:
            if word[:n] in self.stems:
                return word[:n] + "*", 0
        if not self.worth(word):
            return None
        automaton, best = Automaton(word, 2 if len(word) > 6 else 1), None
        stack = [(self.root, automaton.start())]
        while stack:
            node, state = stack.pop()
            for char, child in node.items():
                if char == self.END:
                    far = automaton.edits(state)
                    if far is not None and far <= tolerated(child) and (best is None or (far, child) < best):
                        best = (far, child)
                    continue
                after = automaton.step(state, char)
                if after[-1]:
                    stack.append((child, after))
        return (best[1], best[0]) if best else None
