"""Cross-parsing against substring search, and languages of held-out texts."""

import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridmark.llm import language, queries
from gridmark.llm.tables import utf8_column

DOCS = "doc_id bigint, text string, lang string, key string, score string, hash int, bits int"


def phrases(train, text, segment):
    """Longest matches, one after the other, in segments; the first has the blank before the text, too."""
    text = " " + text
    parts, count = [text[: segment + 1], *[text[k : k + segment] for k in range(segment + 1, len(text), segment)]], 0
    for part in parts:
        at = 0
        while at < len(part):
            end = at + 1
            while end <= len(part) and any(part[at:end] in t for t in train):
                end += 1
            count += 1
            at = max(end - 1, at + 1)
    return count


@pytest.mark.parametrize("segment", [7, 1024])
def test_phrases(monkeypatch, segment):
    monkeypatch.setattr(language, "SEGMENT", segment)
    rng = random.Random(segment)
    for _ in range(20):
        samples = {"x": ["".join(rng.choices("abc ,é", k=rng.randint(0, 40))) for _ in range(3)], "y": ["".join(rng.choices("abz. Ä", k=30))]}
        texts = ["".join(rng.choices("abczÉ q.\n", k=rng.randint(0, 60))) for _ in range(10)]
        model = language.Model(samples)
        found = model.phrases(*model.read(*utf8_column(pa.array(texts))))
        for text, counts in zip(texts, found.tolist(), strict=True):
            plain = re.sub(" +", " ", "".join(c.lower() if c.isalpha() else " " for c in text)).lstrip(" ")
            trains = [[f" {language.letters_of(t)} " for t in samples[name]] for name in model.languages]
            assert counts == [phrases(t, plain, segment) for t in trains], text


def words(rng, lang, n):
    parts = {"aa": ["ka", "lo", "mi", "tér"], "bb": ["sch", "ung", "er", "ka"]}[lang]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


def test_held_out_languages(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, ("aa", "bb")[i % 2], rng.choice([3, 10, 200])), ("aa", "bb")[i % 2], "k", "s", 1, 1) for i in range(200)]
    rows += [(300, rows[0][1], "aa", "k", "s", 1, 1)] * 30  # copies
    odd = [(None, None, None), (None, "ka lo", "aa"), (400, None, "aa"), (401, "", "bb"), (402, " 12 !?\n", None), (403, "Ωμέγα Γ", None), (404, words(rng, "bb", 60_000), None)]
    docs = spark.createDataFrame(rows + [(*o, "k", "s", 1, 1) for o in odd], DOCS).repartition(4)
    samples = language.learn_samples(docs.where(F.coalesce(F.col("doc_id") < 100, F.lit(True))))
    assert [name for name, _ in samples] == ["aa", "bb"]
    assert sum(t == rows[0][1] for t in samples[0][1]) == 1
    found = {(r["doc_id"], r["lang_pred"]): r for r in language.identify(docs, samples).collect()}
    truth = {i: lang for i, _, lang, *_ in rows}
    right = [(i, lang) in found for i, lang in truth.items() if i >= 100]
    assert sum(right) > 0.95 * len(right)
    assert {(400, "und"), (401, "und"), (402, "und"), (404, "bb"), (403, "aa"), (None, "und"), (None, "aa")} <= set(found)
    assert all(0 <= r["score"] <= 1 and (r["score"] == 0) == (r["lang_pred"] == "und") for r in found.values())


def test_nothing_to_learn_and_nothing_to_predict(spark):
    docs = spark.createDataFrame([(1, "ab", None, "k", "s", 1, 1), (2, "12", "en", "k", "s", 1, 1)], DOCS)
    samples = language.learn_samples(docs)
    assert samples == ()
    assert [r["lang_pred"] for r in language.identify(docs, samples).collect()] == ["und", "und"]
    assert language.identify(docs.limit(0), (("en", ("abc",)),)).collect() == []


def test_query_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    found = queries.op12_language_id(spark, sf_dir).collect()
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [r for r in found if r["held_out"]]
    assert len(found) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert sum(r["lang_pred"] == truth[r["doc_id"]][0] for r in held) >= 0.95 * len(held)
