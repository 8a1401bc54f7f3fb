"""Token ids of whole texts by a public tokenizer, remembered word by word.

Both tokenizers cut a text into words before they merge, and a merge never crosses a word.
So the ids of a text are those of its blank-separated pieces, one after the other, and a
piece seen before need not be merged again. The memory is bounded; it changes no result.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gridmark.llm import worker_memory

os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores already

from tokenizers import Tokenizer  # noqa: E402

MEMORY = 800_000  # pieces remembered by each Python worker, about 200 bytes each
BATCH_BYTES = 4 << 20  # of text cut into pieces at a time
BLANK, WORD_END = "\u0120", "</w>"  # how the vocabularies write a blank before, and the end of, a word
MARKS = ".,;:!?*#$%&|"  # marks that are words of their own behind letters
LONGEST = 48  # code points of the longest piece that is remembered


class PieceEncoder:
    """Ids of a text as little-endian unsigned 32-bit integers.

    `blank_joins_next`: a single blank belongs to the word behind it (byte-level tokenizers);
    otherwise blanks and line ends vanish. Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, blank_joins_next: bool):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.blank = " " if blank_joins_next else ""
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids[0] if blank_joins_next else -1
        vocab = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocab.values()) + 1, bool)  # tokens that begin (with a blank) or end a word
        self.edge[[i for token, i in vocab.items() if (token[0] == BLANK if self.blank else token.endswith(WORD_END))]] = True

    def ids(self, text: str) -> bytes:
        found = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(found, "<u4").tobytes()

    def learn(self, pieces: list[str]) -> None:
        """Remember the ids of pieces: letters in one call, letters and a mark as two words, others one by one.

        When the newer half of the memory is full, it becomes the older half, and what the older half held and
        nobody asked for again is forgotten.
        """
        if len(self.known) > MEMORY // 2:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        letters, marked = [], []
        for piece in pieces:
            held = older.get(piece)
            if held is not None:
                known[piece] = held
            elif piece.isalpha():
                letters.append(piece)
            else:
                marked.append(piece)
        cut = [(piece, "\n" if piece[:1] == "\n" else "", piece.lstrip("\n").rstrip(MARKS)) for piece in marked]
        for line in ("", "\n"):
            heads = {head for _, before, head in cut if before == line and head.isalpha() and line + head not in known}
            if not line:
                heads.update(letters)
            if heads:
                self._learn_letters(list(heads), line)
        rest = [piece for piece in letters if piece not in known]
        for piece, before, head in cut:
            got = known.get(before + head) if head.isalpha() else None  # behind others, a mark may be in one word with them
            if got is None:
                rest.append(piece)
            elif len(piece) > len(before) + len(head):
                tail = piece[len(before) + len(head) :]
                if tail not in self.tails:
                    self.tails[tail] = self.ids(tail)
                known[piece] = got + self.tails[tail]
        found = self.tokenizer.encode_batch_fast([self._own(piece) for piece in rest], add_special_tokens=False)
        known.update((piece, np.array(e.ids, "<u4").tobytes()) for piece, e in zip(rest, found, strict=True))

    def _own(self, piece: str) -> str:
        """A piece with its blank, if it is not the first of a line."""
        return piece if piece[:1] == "\n" else self.blank + piece

    def _learn_letters(self, letters: list[str], line: str) -> None:
        """Pieces of letters are one word each. Nothing is remembered if the tokenizer saw other words."""
        text = "".join([line + word for word in letters]) if line else self.blank + " ".join(letters)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        edge = ids == self.line_end if line else self.edge[ids]
        ends = [*np.flatnonzero(edge).tolist(), len(ids)] if self.blank else [0, *(np.flatnonzero(edge) + 1).tolist()]
        blob = ids.tobytes()
        if len(ends) == len(letters) + 1:
            self.known.update((line + piece, blob[4 * a : 4 * b]) for piece, a, b in zip(letters, ends, ends[1:], strict=False))

    def cut(self, text: str) -> tuple[str, str | None] | None:
        """The first piece, and the others as one text (None if there are none); None for a text that must be left whole."""
        if not self.blank:
            return "", text.replace("\n", " ")
        if "  " in text or " \n" in text:
            return None
        if "\n" in text and "\n\n" not in text and "\n " not in text:
            text = text.replace("\n", " \n")  # a single line end is a word of its own, and no blank follows
        first, blank, others = text.partition(" ")
        return first, others if blank else None

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text. Each piece is looked up once, however often the texts hold it."""
        out: list[bytes] = []
        places, bodies, leads = [], [], []
        for text in texts:
            parts = self.cut(text)
            if parts is None:
                out.append(self.ids(text))
                continue
            first, others = parts
            lead = bool(first) and not first[0].isspace() and "\n" not in first and self.line_end >= 0
            if lead:  # behind a line end, as at the beginning, a word has no blank
                others = "\n" + first if others is None else f"{others} \n{first}"
            if others is not None:
                places.append(len(out))
                bodies.append(others)
                leads.append(lead)
            out.append(b"" if lead or not first else self.ids(first))
        if not bodies:
            return out
        lists = pc.split_pattern(pa.array(bodies, pa.large_string()), " ")
        pieces = lists.flatten().dictionary_encode()
        found = pa.array(self._looked_up(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(pieces.indices)
        _, bounds, raw = found.buffers()
        bounds, raw = np.frombuffer(bounds, np.int64), memoryview(raw or b"")
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())  # pieces up to the end of each text
        done = 0
        for at, lead, last, end in zip(places, leads, bounds[ends - 1].tolist(), bounds[ends].tolist(), strict=True):
            # The word behind the added line end comes first, without the line end.
            out[at] = b"".join((raw[last + 4 : end], raw[done:last]) if lead else (out[at], raw[done:end]))
            done = end
        return out

    def _looked_up(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces."""
        found = list(map(self.known.get, pieces))
        holes = [i for i, got in enumerate(found) if got is None]
        if holes:
            self.learn([pieces[i] for i in holes if len(pieces[i]) <= LONGEST])
        for i in holes:
            got = self.known.get(pieces[i])
            found[i] = self.ids(self._own(pieces[i])) if got is None else got
        return found


@lru_cache(maxsize=4)
def _encoder(path: str, blank_joins_next: bool) -> PieceEncoder:
    return PieceEncoder(path, blank_joins_next)


worker_memory.forgets(_encoder.cache_clear)


def encoder(path: str, blank_joins_next: bool) -> PieceEncoder:
    """The worker's encoder; workers live longer than tasks, so its memory does, too, until another operator comes."""
    worker_memory.claim(path)
    return _encoder(path, blank_joins_next)
