"""Collocations against plain counting, and the guarantee of the summaries."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from gridmark.llm import collocations

DOCS = "doc_id bigint, text string, lang string, phrase string, k int, f string, named string, salt int"


def expected(rows, longest=3, threshold=10, percent=50, best=2000):
    counts, totals, out = Counter(), Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, *words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {g: n for g, n in counts.items() if n >= threshold}
    scored = []
    for gram, a in found.items():
        lang, words = gram[0], gram[1:]
        if len(words) < 2:
            continue
        inside = lambda other: any(other[1 + i : 1 + i + len(words)] == words for i in range(len(other) - len(words)))
        if any(o[0] == lang and len(o) > len(gram) and 100 * n >= percent * a and inside(o) for o, n in found.items()):
            continue
        cuts = [(10**6 * a * a // (found[gram[: k + 1]] * found[(lang, *gram[k + 1 :])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        scored.append((lang, -score, -a, " ".join(words).encode(), found[gram[: k + 1]], found[(lang, *gram[k + 1 :])]))
    for lang in {s[0] for s in scored}:
        own = sorted(s for s in scored if s[0] == lang)[:best]
        out += [(lang, i + 1, s[3].decode(), -s[2], s[4], s[5], totals[lang], -s[1]) for i, s in enumerate(own)]
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcÄé-'", k=rng.randint(1, 4))) for _ in range(60)]
    texts = []
    for i in range(n):
        words = [rng.choice(vocabulary[: 5 + 55 * (j % 2)]) for j in range(rng.choice([0, 1, 2, 30, 200]))]
        texts.append(("".join(w + rng.choice(["  ", " ", " ", "\t", ". ", ",", "\n"]) for w in words), ["en", "de", None, "a\nb"][i % 4]))
    return texts + [("New York City " * 40 + "new YORK. of of of of of of of of of of of of", "en"), (None, "en"), ("", None), ("\n. ,", "only"), ("x " * 30_000, "de")]


def frame(spark, rows):
    return spark.createDataFrame([(i, text, lang, "p", 1, "f", "n", 1) for i, (text, lang) in enumerate(rows)], DOCS)


@pytest.mark.parametrize("bucket_bytes, held", [(8 << 20, 3_000_000), (1 << 11, 500)])
def test_collocations(spark, monkeypatch, bucket_bytes, held):
    monkeypatch.setattr(collocations, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(collocations, "HELD", held)
    rows = corpus(5, 120)
    rows += rows[:10]  # repeated rows count each
    found = collocations.collocations(frame(spark, rows).repartition(5))
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == expected(rows)


def test_limits_are_parameters(spark):
    rows = corpus(6, 60)
    found = collocations.collocations(frame(spark, rows), longest=4, threshold=6, percent=30, best=20)
    assert sorted(tuple(r) for r in found.collect()) == expected(rows, 4, 6, 30, 20)


def test_nothing(spark):
    assert collocations.collocations(frame(spark, []).limit(0)).collect() == []
    assert collocations.collocations(frame(spark, [(None, None), ("a b c", "en")])).collect() == []


def test_frequent_keys_survive_merged_summaries():
    rng = np.random.default_rng(2)
    parts = [np.concatenate([rng.integers(10**6, 2**40, 900), rng.choice(40, 100)]).astype(np.uint64) for _ in range(30)]
    mass, threshold = sum(map(len, parts)), 50
    summary = collocations.Summary(mass // threshold + 1)
    for part in parts:
        keys, counts = np.unique(part, return_counts=True)
        summary.merge(keys, counts)
        assert len(summary.keys) <= summary.capacity
    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
    frequent = set(keys[counts >= threshold].tolist())
    assert 0 < summary.lost < threshold
    assert frequent and frequent <= set(summary.at_least(threshold).tolist())
