"""Pieces without Spark, against brute force."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from gridmark.llm import chat, repeats, worker_memory
from gridmark.llm.deep_shallow import BlindTrie, sort_windows
from gridmark.llm.exact_fill import plan_sequences, slots
from gridmark.llm.lexicon_trie import Trie, tolerated
from gridmark.llm.near_duplicates import choose_prefix, required
from gridmark.llm.quality import log_binomial_tail
from gridmark.llm.tokenizing import PieceEncoder


@pytest.mark.parametrize("seed", range(12))
def test_plans_use_every_piece_once_and_fit(seed):
    rng = random.Random(seed)
    capacity, n = rng.choice([10, 30, 100]), rng.choice([0, 1, 5, 50, 400])
    counts = Counter(rng.randint(1, capacity) for _ in range(n))
    plan = plan_sequences(counts, capacity)
    used = Counter()
    for times, bins in plan:
        assert times > 0 and sum(bins) <= capacity
        for length in bins:
            used[length] += times
    assert used == counts
    total = sum(length * c for length, c in counts.items())
    assert sum(t for t, _ in plan) <= max(-(-total // capacity), int(1.12 * total / capacity) + 1, sum(c for x, c in counts.items() if 2 * x > capacity))
    place = slots(plan)
    assert sum(place["each"]) >= (1 if n else 0)


def test_exact_complements_fill_sequences():
    plan = plan_sequences({70: 2, 30: 1, 20: 1, 10: 1}, 100)
    assert sorted((t, sorted(b)) for t, b in plan) == [(1, [10, 20, 70]), (1, [30, 70])]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(6))
def test_automaton_and_trie_find_the_nearest_term(seed):
    rng = random.Random(seed)
    words = list({"".join(rng.choice("abc") for _ in range(rng.randint(3, 11))) for _ in range(6)})
    trie = Trie(words, [])
    for _ in range(300):
        word = list(rng.choice(words)) if rng.random() < 0.6 else [rng.choice("abcd") for _ in range(rng.randint(1, 13))]
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(word) + 1)
            word[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "d"])
        word = "".join(word)
        near = [_distance(word, w) for w in words if _distance(word, w) <= tolerated(w)]
        found = trie.find(word)
        assert (found[1] if found else None) == (min(near) if near else None)


def test_stems_match_what_begins_with_them():
    trie = Trie(["stupid"], ["abc"])
    assert trie.find("abcdef") == ("abc*", 0) and trie.find("stupd") == ("stupid", 1) and trie.find("") is None


def test_deep_shallow_order_is_that_of_the_strings():
    rng = random.Random(3)
    for n in (0, 1, 3, 40):
        rows = np.zeros((n, 88), np.uint8)
        base = [bytes(rng.choice(b"ab") for _ in range(80)) for _ in range(3)]
        for i in range(n):
            line = bytearray(rng.choice(base))
            line[rng.randrange(80)] = 99
            rows[i, :80] = list(line)
        row, at = np.repeat(np.arange(n), 31), np.tile(np.arange(31), n)
        group = np.repeat(np.array([rng.randrange(2) for _ in range(n)], np.int64), 31)
        order, classes = sort_windows(rows, group, row, at, 50)
        keys = [(int(group[i]), rows[row[i], at[i] : at[i] + 50].tobytes()) for i in order]
        assert keys == sorted(keys) and sorted(order.tolist()) == list(range(len(row)))
        assert all((x == y) == (a == b) for x, y, a, b in zip(keys, keys[1:], classes, classes[1:]))


def test_blind_trie_orders_and_groups():
    trie = BlindTrie()
    words = [b"abc", b"abd", b"xbc", b"abc", b"aac"]
    for i, word in enumerate(words):
        trie.add(word, i)
    assert trie.leaves() == [[4], [0, 3], [1], [2]] and BlindTrie().leaves() == []


def test_every_window_has_an_anchor_and_equal_windows_equal_ones():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abc ") for _ in range(rng.choice([0, 30, 49, 50, 51, 300]))) for _ in range(12)] + [b"a" * 200, b"ab" * 90]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    at, _ = repeats.anchors(raw, bounds)
    for start, text in zip(bounds, texts):
        for i in range(len(text) - 49):
            assert ((at >= start + i) & (at <= start + i + 30)).any()


@pytest.mark.parametrize("name, joins", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_give_the_ids_of_whole_texts(name, joins):
    encoder = PieceEncoder(public_tokenizers.path(name), joins)
    texts = ["", " ", "  a", "a  b", "a \n b", "a\n\n b\tc 's don't it's. a.'s", "É é x. É... x?!", "<|endoftext|> a", "a ",
             "x" * 99 + " y", "\n\n", "12  34 5,6", "\nA", "A\nB.\nC d\ne", "a \nb", "a\n b", "x\n", "a\r\nb", "İ ı ß"]
    texts.append(" ".join("İ" + chr(97 + i % 26) * (i // 26) for i in range(300)))
    texts.append("\n".join("Word" + chr(97 + i % 26) * (i // 26) + ". next" for i in range(300)))
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode(texts)):
            assert ids == encoder.ids(text), text


@pytest.mark.parametrize("name, joins", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_marks_behind_other_marks_are_one_word_with_them(name, joins):
    encoder = PieceEncoder(public_tokenizers.path(name), joins)
    heads = [f"a{end}" for end in (">", ")", "</w>", '"', "]", "'", "-", "1", "e\u0301")]
    encoder.encode(["x " + " ".join(heads)])  # known when the marks come
    for text in ["x " + " ".join(head + tail for head in heads) for tail in (",", ".", ",.", "|>", "!!")]:
        assert encoder.encode([text]) == [encoder.ids(text)], text


def test_freed_memory_goes_back_at_the_end_of_a_task(monkeypatch):
    done = []
    monkeypatch.setattr(worker_memory, "_give_back", lambda: done.append("back"))

    def step(batches):
        for batch in batches:
            yield batch
        done.append("step")

    assert list(worker_memory.trimmed(step)(iter([1, 2]))) == [1, 2]
    assert done == ["step", "back"]


def test_binomial_tail():
    from math import comb, exp

    for n, k, p in ((10, 3, 0.2), (40, 0, 0.05), (5, 5, 0.3), (100, 7, 0.1)):
        assert abs(exp(log_binomial_tail(k, n, p)) - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-9


def test_prefixes_grow_with_the_cost_of_candidates():
    tokens = np.arange(100, dtype=np.uint64)
    cheap, first = choose_prefix(tokens, np.ones(100, np.int64))
    dear, longer = choose_prefix(tokens, np.full(100, 1000))
    assert cheap == 1 and len(first) == 100 - required(100) + 1
    assert dear > 1 and len(longer) == 100 - required(100) + dear
    assert choose_prefix(tokens[:0], np.zeros(0, np.int64))[0] == 0


def test_chat_round_trip_and_layouts():
    hard = "<|im_end|><|im_start|>assistant ok <\\| <\\\\| < | \\"
    turns = [("user", hard), ("assistant", hard), ("odd\nrole\\n<|", ""), ("assistant", "")]
    formatted, spans = chat.format_turns(turns)
    assert chat.parse_turns(formatted) == turns
    assert [chat.unescape(formatted[a : a + n]) for a, n in spans] == [hard, ""]
    records = [
        {"prompt": "p", "response": "r"}, {"instruction": "p", "output": "r"},
        {"conversations": [{"from": "human", "value": "p"}, {"from": "gpt", "value": "r"}]},
        {"dialog": {"turns": [{"speaker": {"role": "user"}, "text": "p"}, {"speaker": {"role": "assistant"}, "text": "r"}]}},
        {"messages": [{"role": "user", "content": "p"}, {"role": "assistant", "content": "r"}]},
    ]
    for record in records:
        mapping = chat.MAPPINGS[chat.fingerprint(chat.field_paths(record))]
        assert chat.canonical_turns(record, mapping) == [("user", "p"), ("assistant", "r")]
    assert chat.fingerprint(chat.field_paths({"a": [1, {"b": True}]})) not in chat.MAPPINGS
