"""Every operator against a brute-force version, and its defined results at the edges."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridmark.llm import bit_filter, chat, components, mixing, near_duplicates, packing, personal_data, quality, repeats, token_orc, topk, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, row string, counts int"


def corpus(seed=4, n=60):
    """Texts with copies, near copies, shared passages, repeats, junk, nulls, empty and long ones."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 8, 40, 120, 300]))]
        text = " ".join(words)
        if i % 7 == 1 and texts:
            text = rng.choice(texts)
        if i % 7 == 2 and texts:
            near = rng.choice(texts).split(" ")
            near[rng.randrange(len(near))] = "changed"
            text = " ".join(near)
        if i % 5 == 3:
            text = text[: len(text) // 2] + "\n" + passage + "\n" + text[len(text) // 2 :]
        if i % 11 == 4:
            text += " call +49 (30) 1234-5678 or mail a.b@c-d.org, 10.0.0.255 999.1.1.1 4111 1111 1111 1111"
        texts.append(text)
    texts += ["", None, "éé é ÉÉ\n\n\té", "same line\nsame line\nSame line\n \nsame line", "x" * 3000, "ab " * 900, passage, passage.upper()]
    return [(i, t, ["en", "de", None][i % 3], f"s{i % 4}" if i % 9 else None, "r", i) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, repeated rows."""
    return spark.createDataFrame([(None, "one two three four five six " * 9, "en", "a", "r", 0), (None, None, None, None, None, None),
                                  (5, "one two three four five six " * 9, "en", "a", "r", 1), (5, "one two three four five six " * 9, "en", "a", "r", 1),
                                  (5, "other", "en", "a", "r", 2), (-7, "", "", "", "", 3)], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(60)] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")


def empty(df):
    return df.where("1 = 0")


def test_top_k(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.choice([-0.4, -0.1, 0.0, 0.2, 0.3])) for _ in range(6)], "x") for i in range(90)]
    rows += [(200, None, "x"), (220, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x"), (240, [float("nan")] * 6, "x"), (260, [float("inf")] * 6, "x"), (280, [0.5, 0.5], "x"), (None, [0.1] * 6, "x")]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string")
    found = {}
    for r in topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=5).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    import numpy as np

    scaled = {i: np.floor(64 * np.array(v, np.float32).astype(float)) for i, v, _ in rows[:90]}
    expected = {}
    for q in range(0, 90, 20):
        best = sorted((-int(scaled[q] @ scaled[c]), c) for c in scaled if c != q)[:5]
        expected[q] = [(rank, c, -s) for rank, (s, c) in enumerate(best, 1)]
    assert {q: sorted(v) for q, v in found.items()} == expected
    assert topk.top_k(empty(vectors), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_a_long_query_among_several_blocks(spark, monkeypatch):
    """The query's own block is not the only one whose numbers must hold its products."""
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = random.Random(8)
    vectors = {i: [rng.choice([299, 300]) for _ in range(64)] for i in range(1, 100)}
    vectors[0] = [rng.choice([1499, 1501]) for _ in range(64)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "vec_id bigint, embedding array<double>")
    found = sorted((r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") == 0, k=20, scale=1).collect())
    best = sorted((-sum(a * b for a, b in zip(vectors[0], v, strict=True)), i) for i, v in vectors.items() if i)[:20]
    assert found == [(rank, i, -score) for rank, (score, i) in enumerate(best, 1)]


def test_quality_counts_and_verdicts(docs, labels, odd):
    rows = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    for doc_id, text, *_ in corpus():
        words = WORD.findall(text or "")
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [line for line in (text or "").split("\n") if WORD.search(line)]
        c = rows[doc_id]["counts"]
        assert (c["n_words"], c["word_chars"], c["n_dup_lines"], c["n_repeat_words"]) == (
            len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(covered)), text
        assert c["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text or ""))
        assert rows[doc_id]["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert not (rows[doc_id]["base_failed"] and rows[doc_id]["kept"])
    assert quality.judge(odd, labels).count() == 6 and quality.judge(empty(docs), labels).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if r["kept"]}


def test_cutoffs_reject_junk_and_keep_the_risk(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("word" + ("###" if i % 4 == 0 else "") + str(rng.randrange(999)) for _ in range(30)), "en") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(4000)], "doc_id bigint, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.judge(docs, labels).where("kept").collect()}
    assert kept == {i for i in range(4000) if i % 4}
    few = quality.judge(docs, labels.where("doc_id < 100")).where("kept").count()
    assert few == 4000  # too few labels: no cutoff is admissible


def _sets(rows):
    out = {}
    for doc_id, text in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[doc_id] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else ({tuple(words)} if words else set())
    return out


def _components(sets):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_both_paths_count_the_same_strata(spark):
    """Languages without labels count as tests in the operator and in the filtering stage alike."""
    rows = [(i, "good words " * 9 + f"number {i} here in this line", "en") for i in range(1000)]
    rows += [(5000 + i, f"### $$$ %%% junk{i} ### $$$ " + " ".join(f"w{i}x{j}" for j in range(9)), "en") for i in range(60)]
    rows += [(9000 + i, " ".join(f"v{i}y{j}" for j in range(12)), f"l{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    marks = spark.createDataFrame([(r[0], int(r[0] < 5000)) for r in rows if r[0] < 9000], "doc_id bigint, quality int")
    kept = {r["doc_id"] for r in quality.judge(df, marks).where("kept").collect()}
    assert kept == {r["doc_id"] for r in quality.keep_good(df, marks).collect()}


def test_near_duplicates(docs, odd):
    sets = _sets((r[0], r[1]) for r in corpus())
    named = _components(sets)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.near_duplicates(docs).collect()}
    assert found == {i: (len(sets[i]), named[i]) for i in sets}
    kept = near_duplicates.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(named.values()))
    assert near_duplicates.near_duplicates(odd).count() == 6
    assert Counter(r["doc_id"] for r in near_duplicates.one_of_each(odd).collect()) == {None: 2, 5: 2, -7: 1}
    assert near_duplicates.near_duplicates(empty(docs)).count() == 0


def test_large_components_meet_others_set_by_set(spark, monkeypatch):
    """Groups of near copies, and documents just below and above the threshold beside them, with parts of few sets."""
    for name, value in (("BIG", 3), ("MEMBERS", 2), ("ASKED", 2)):
        monkeypatch.setattr(near_duplicates, name, value)
    rng = random.Random(11)
    rows = []
    for group in range(4):
        base = [f"g{group}w{i}" for i in range(120)]
        for k in range(14):
            words = list(base)
            # One edit is similar to the base and to most others, three are similar to few.
            for e in range(rng.choice([1, 1, 1, 2, 2, 3])):
                words[rng.randrange(120)] = f"e{k if rng.random() < 0.5 else k - 1}x{e}"
            rows.append((len(rows), " ".join(words)))
        rows.append((len(rows), " ".join(base[:60] + [f"g{(group + 1) % 4}w{i}" for i in range(60, 120)])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(df).collect()}
    want = _components(_sets(rows))
    assert found == want and 4 < len(set(want.values())) < 45


def test_links_across_stars(spark):
    """A chain of near copies: each is similar to the next, not to the first."""
    words = [f"w{i}" for i in range(204)]
    rows = []
    for step in range(8):
        for k in range(4 * step):
            words[k * 6 % 204] = f"x{k}"
        rows.append((step + 10, " ".join(words)))
    sets = _sets(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(df).collect()}
    assert found == _components(sets)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (None, 1), (7, 7)], "a bigint, b bigint")
    found = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert found == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def _base_spans(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_personal_data(spark, docs, odd):
    extra = ["a@b.c_x@y.z q", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4", " 4111 1111 1111 1111 ", "4111-1111-1111-1111x4111111111111111",
             "+1 (555) 123-4567 +49.30.1234567.", "5@", "@", "+", "1" * 60, "12 34 56 78 90 12 34 56 78", "x@y.z@w.v", "4111  1111 1111 1111 1111",
             "-4111111111111111-", "a" * 5000 + "@", "1 " * 3000, "+1" + " " * 3000, "a@b" + ".c" * 4000, "é a.b@c.de 😀 10.0.0.1"]
    rows = corpus() + [(1000 + i, t, "en", "s", "r", 0) for i, t in enumerate(extra)]
    found = {r["doc_id"]: r for r in personal_data.personal_data(spark.createDataFrame(rows, DOCS)).collect()}
    kinds = ("email", "ip", "card", "phone")
    for doc_id, text, *_ in rows:
        spans = _base_spans(text or "")
        listed = ",".join(f"{kinds[k]}:{a}:{e}" for a, k, e in spans)
        r = found[doc_id]
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), text
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[1] == i for s in spans) for i in range(4)]
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))
    assert personal_data.personal_data(odd).count() == 6 and personal_data.personal_data(empty(docs)).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"please note contact number: +49 30 1234567{i % 10} thank you") for i in range(30)]
    rows += [(100 + i, f"please note contact number: KX-99{i}-12A, thank you") for i in range(3)]
    rows += [(200 + i, f"the year {1900 + i} was good") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: r["spans"] for r in personal_data.personal_data(df).collect()}
    text = dict(rows)
    for i in range(100, 103):
        kind, start, end = found[i].split(":")
        assert kind == "id" and text[i][int(start) : int(end)] == f"KX-99{i - 100}-12A"
    assert all(found[i] == "" for i in range(200, 230))
    clean = {r["doc_id"]: r["text"] for r in personal_data.redact(df).collect()}
    assert clean[100] == "please note contact number: [ID], thank you" and "[PHONE]" in clean[0] and clean[200] == text[200]


def test_texts_of_very_many_tokens(spark):
    words = [f"w{i}" if i % 3 else f"é{i}@b.c" for i in range(200_000)]
    text = " ".join(words)
    df = spark.createDataFrame([(1, text), (2, "x " * 400_000 + "a@b.c"), (3, "1 " * 100_000)], "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in personal_data.personal_data(df).collect()}
    places = [m.span() for m in re.finditer(r"[0-9]+@b[.]c", text)]
    assert found[1]["spans"] == ",".join(f"email:{a}:{b}" for a, b in places) and found[1]["n_email"] == 66_667
    assert found[2]["spans"] == "email:800000:800005" and found[3]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in personal_data.redact(df).collect()}
    assert clean[1] == re.sub(r"[0-9]+@b[.]c", "[EMAIL]", text) and clean[2] == "x " * 400_000 + "[EMAIL]"


def test_keys_are_found_by_shape_and_teach_their_context(spark):
    rng = random.Random(1)
    key = lambda n: "".join(rng.choices("0123456789abcdef", k=n)) + "a1"
    rows = [(i, f'xy{i} token = "{key(38)}" zz{i}') for i in range(20)]
    rows += [(100, 'x1 token = "pa55word" z2'), (101, "room 4711b is free"), (102, f"digest {key(38)} stands alone"), (103, f"mail token = me@{'a' * 40}.org")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: r["spans"] for r in personal_data.personal_data(df).collect()}
    text = dict(rows)
    for i in [*range(20), 100]:
        kind, start, end = found[i].split(":")
        assert kind == "id" and text[i][int(start) - 1] == text[i][int(end)] == '"'
    assert found[101] == found[102] == "" and found[103].startswith("email:") and "id" not in found[103]


def test_contexts_find_what_base_spans_cover_elsewhere(spark):
    rows = [(i, f"please note contact number: +49 30 1234567{i % 10} thank you") for i in range(30)]
    rows += [(100, "reach them at +49 0171-5551234 today"), (101, "please note contact number: 0171-5551234, thank you"), (102, "lot 0171-5551234 is sold")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: r["spans"] for r in personal_data.personal_data(df).collect()}
    assert found[100].startswith("phone:") and "id" not in found[100] and found[102] == ""
    assert found[101] == "id:28:40"
    assert {r["doc_id"]: r["text"] for r in personal_data.redact(df).collect()}[101] == "please note contact number: [ID], thank you"


def test_mixing(spark, docs, odd):
    rows = mixing.token_rows(docs)
    plan = {r["source"]: r for r in mixing.mixing_plan(rows).collect()}
    assert abs(sum(r["weight"] for r in plan.values()) - 1) < 1e-9
    assert max(r["wanted"] / r["total"] for r in plan.values() if r["total"]) <= 2.001
    totals = Counter()
    for _, text, _, source, *_ in corpus():
        totals[source or ""] += len(WORD.findall(text or ""))
    assert {s: r["total"] for s, r in plan.items()} == totals
    read = mixing.mix(docs, seed=3, block_tokens=500)
    got = Counter()
    most = max(len(WORD.findall(t or "")) for _, t, *_ in corpus())
    for r in read.collect():
        got[r["source"]] += r["tokens"]
    assert all(0 <= got[s] - plan[s]["wanted"] <= most for s in plan)
    assert read.where("epoch = 0").count() == docs.count()
    copies = mixing.mixed_documents(docs, seed=3)
    assert copies.columns == docs.columns
    assert Counter(r["doc_id"] for r in copies.collect()) == Counter(r["doc_id"] for r in read.collect())
    skewed = spark.createDataFrame([("a", 800), ("b", 150), ("c", 50)], "source string, tokens bigint")
    target = 0.9
    entropy = mixing.mixing_plan(skewed, entropy=target, epochs=None).selectExpr("-sum(weight * ln(weight)) AS h").first()["h"]
    assert abs(entropy - target) < 1e-6
    assert mixing.mix(odd).where("epoch = 0").count() == 6 and mixing.mix(empty(docs)).count() == 0
    assert mixing.mixed_documents(empty(docs)).count() == 0


def test_chat_records(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "system", "s"), (2, 1, "user", None), (2, 2, "assistant", "<|im_end|>"),
            (3, None, None, "x"), (None, 0, "user", "n"), (4, 0, "user", "q"), (4, 0, "user", "q"), (5, 0, "assistant", "long " * 9000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    out = chat.format_records(chat.conversation_records(df))
    found = {r["conv_id"]: r for r in chat.digest_formatted(out).collect()}
    groups = {}
    for c, turn, role, text in rows:
        groups.setdefault(c, []).append((turn if turn is not None else -1, role or "", text or ""))
    for c, turns in groups.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert found[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert (found[c]["n_turns"], found[c]["loss_chars"]) == (len(turns), len(loss))
        assert found[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    bad = spark.createDataFrame([(1, None), (2, "no json"), (3, '{"who": 1}'), (4, "[1]")], "conv_id bigint, record string")
    assert chat.format_records(bad).where("problem IS NOT NULL AND formatted = ''").count() == 4
    assert chat.digest_formatted(chat.format_records(chat.conversation_records(empty(df)))).count() == 0


def test_token_files(spark, docs, odd, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    start, expected = 0, {}
    for doc_id, text, *_ in sorted(corpus()):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        expected[doc_id] = (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    target = str(tmp_path / "orc")
    token_orc.write_token_orc(docs, target, path, 2)
    assert {r["doc_id"]: tuple(r)[1:] for r in token_orc.token_index(spark, target).collect()} == expected
    one = token_orc.read_token_orc(spark, target, [7]).collect()
    assert len(one) == 1 and len(one[0]["ids"]) == expected[7][1]
    assert token_orc.token_orc(odd, path, 2).count() == 6 and token_orc.token_orc(empty(docs), path, 2).count() == 0


def test_packing(docs, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    rows = packing.pack_documents(docs, path, 0, capacity=256).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc_id, text, *_ in corpus():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in pieces] == [(s, min(256, len(ids) - s)) for s in range(0, len(ids), 256)]
        for r in pieces:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
    total = 0
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
        total += at
    gaps = []  # plain best fit, longest first
    for length in sorted((r["length"] for r in rows), reverse=True):
        fitting = [g for g in gaps if g >= length]
        if fitting:
            gaps.remove(min(fitting))
        gaps.append((min(fitting) if fitting else 256) - length)
    assert -(-total // 256) <= len(by_sequence) <= len(gaps) + 2
    assert packing.pack_documents(odd, path, 0).count() == 6 and packing.pack_documents(empty(docs), path, 0).count() == 0


def _without_repeats(rows):
    first = {}
    rows = sorted(rows)
    for doc_id, text in rows:
        for k in range(len(text) - 49):
            first.setdefault(text[k : k + 50], doc_id)
    out = {}
    for doc_id, text in rows:
        gone = bytearray(len(text))
        for k in range(len(text) - 49):
            if first[text[k : k + 50]] < doc_id:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(text, gone) if not g)
        runs = sum(1 for k in range(len(text)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[doc_id] = (len(text), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("segment", [1 << 20, 700])
def test_repeats(docs, segment, monkeypatch):
    if segment < 1 << 20:  # long texts are cut; in this process, as workers have their own module
        import numpy as np

        text = ("".join(chr(97 + i * i % 26) for i in range(5000)) + "tail " * 30).encode()
        raw, bounds = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        whole = set(repeats.anchors(raw, bounds)[0].tolist())
        monkeypatch.setattr(repeats, "SEGMENT", segment)
        seen = set()
        for _, shifts, part, edges in repeats._segments(raw, bounds):
            seen |= {int(a + shifts[0]) for a in repeats.anchors(part, edges)[0]}
        assert whole <= seen
        return
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(docs).collect()}
    assert found == _without_repeats((r[0], (r[1] or "").encode()) for r in corpus())


def test_repeats_at_edges(spark, docs, odd):
    rng = random.Random(9)
    base = "".join(rng.choice("ab ") for _ in range(400))
    rows = [(i, base[rng.randrange(200) :][: rng.choice([49, 50, 51, 120])] + rng.choice(["", "x", "q" * 60]) + base[rng.randrange(300) :]) for i in range(40)]
    rows += [(100, "z" * 500), (101, "z" * 60 + "y" + "z" * 55), (102, "zz")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(df).collect()}
    assert found == _without_repeats((i, t.encode()) for i, t in rows)
    rows = repeats.remove_repeats(odd).collect()
    assert len(rows) == 6 and sum(r["n_removed"] == r["n_bytes"] > 0 for r in rows) == 2
    assert repeats.remove_repeats(empty(docs)).count() == 0


def test_toxicity(spark, docs, labels, odd):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, marks = [], []
    for i in range(1200):
        text = [rng.choice(words) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            text[rng.randrange(40)] = rng.choice(["dreckwort", "Dreckwort,", "schuftig"])
            text[rng.randrange(40)] = rng.choice(["dreckwort", "schuftig"])
        rows.append((i, " ".join(text)))
        marks.append((i, 1, int(toxic)))
    rows += [(5000, "you are a dreckw0rt and schuftg"), (5001, " ".join(words[:30])), (5002, ""), (5003, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    lab = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    found = {r["doc_id"]: r for r in toxicity.score_documents(df, lab).collect()}
    held = [i for i, _, _ in marks if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in found.items() if r["held_out"] and i < 1200} == set(held)
    right = sum(found[i]["predicted"] == int(i % 5 == 0) for i in held)
    assert right / len(held) > 0.97
    assert found[5000]["predicted"] == 1 and found[5001]["predicted"] == found[5002]["predicted"] == found[5003]["predicted"] == 0
    assert toxicity.score_documents(odd, labels).count() == 6
    assert {r["score"] for r in toxicity.score_documents(docs, empty(labels)).collect()} == {0.0}
    assert toxicity.score_documents(empty(docs), labels).count() == 0


def test_misspellings_of_all_terms_count(spark):
    """Of rare words, and of words behind a stem; a clean word that is near a term does not count."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(2000):
        text = [rng.choice(words) for _ in range(30)]
        if i % 2 == 0:  # rare in toxic texts is one of 80
            text[3] = "murkswort" if i % 160 == 0 else rng.choice(["zornig", "zornige", "zornigen"])
            text[9] = "trottel"
        else:
            text[5] = "trotten"
        rows.append((i, " ".join(text), int(i % 2 == 0)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    lexicon, misspelled, weights = toxicity.learn_lexicon(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    scorer = toxicity.Scorer(lexicon, misspelled, weights)
    assert any(t.endswith("*") for t in lexicon) and "murkswort" in lexicon
    assert scorer.match("murksw0rt")[:2] == ("murkswort", 1)
    assert scorer.match("z0rnigen")[0].endswith("*") and scorer.match("z0rnigen")[1] == 1
    assert scorer.features("ein murksw0rt")[5] > 0 and scorer.features("sie z0rnigen")[5] > 0
    assert scorer.features("sie trotten")[5] == 0 < scorer.features("ein tr0ttel")[5]


def test_texts_that_begin_alike_are_learned_each(spark):
    """Documents of a source with a fixed header; copies count once, with each of their labels."""
    head = "This text is published under the licence of its source. "
    rows = [(i, head + (f"murkswort number {i}" if i % 2 else f"harmless number {i}"), i % 2) for i in range(200)]
    rows += [(1000 + i, "kopie kopie", 1) for i in range(50)] + [(2000, "kopie kopie", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    lexicon, _, _ = toxicity.learn_lexicon(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert "murkswort" in lexicon and not any("harmless".startswith(t.rstrip("*")) or "kopie".startswith(t.rstrip("*")) for t in lexicon)


def test_quotation_is_not_abuse():
    scorer = toxicity.Scorer({"moron": 5.0}, {"moron"})
    abuse, quoted = scorer.features("you are such a moron today"), scorer.features('he wrote "moron" on the wall')
    assert abuse[2] > 0 and quoted[1] > 0 and quoted[2] == 0 and abuse[5] > quoted[5]


def test_pipeline(spark, tmp_path, labels):
    import corpus_pipeline

    frame = spark.createDataFrame(corpus(), "doc_id bigint, text string, lang string, source string, url string, n_chars int")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes), name
        if name in ("quality_rules", "ngram_jaccard_join"):
            assert after.count() < docs.count()
        if name == "personal_data":
            assert after.count() == docs.count() and after.where("text LIKE '%a.b@c-d.org%'").count() == 0
        if name == "source_mixing":
            assert after.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
        docs = after.cache()
        docs.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
    none = str(tmp_path / "none")
    empty(frame).write.parquet(none + "/documents.parquet")
    labels.write.parquet(none + "/labels.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0


def test_one_very_frequent_hash_does_not_hide_other_frequent_ones(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "FREQUENT", 8)
    monkeypatch.setattr(near_duplicates, "COUNTED", 10**9)
    texts = ["all of us say this"] * 400 + [f"phrase number {i} is here" for i in range(7)] * 6 + [f"only {i} is said twice" for i in range(20)] * 2
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").coalesce(1)
    hashes, counts = near_duplicates.frequent_hashes(docs)
    assert sorted(counts.tolist()) == [6] * 7 + [400]
    monkeypatch.setattr(near_duplicates, "FREQUENT", 7)  # no room for the seven of one count
    assert near_duplicates.frequent_hashes(docs)[1].tolist() == [400]


def test_pairs_that_meet_in_many_tasks_are_one_row_each(spark, monkeypatch):
    rng = np.random.default_rng(4)
    shared = rng.integers(1, 2**62, 400, dtype=np.uint64)
    sets = [np.sort(np.concatenate([shared[rng.random(400) < 0.95], rng.integers(1, 2**62, 5, dtype=np.uint64)])) for _ in range(30)]
    data = [(i - 3, len(s), 1, len(s), i - 3, 0, bytearray(s.tobytes())) for i, s in enumerate(sets)]
    reps = spark.createDataFrame(data, "rep long, n long, matches int, shared int, comp long, big int, prefix binary")
    want = {(i - 3, j - 3): len(np.intersect1d(sets[i], sets[j])) for i in range(30) for j in range(i + 1, 30)}
    rows = near_duplicates.meetings(reps, 64, across=True).collect()
    assert len(rows) == len(want) and {(r["a"], r["b"]): r["n"] for r in rows} == want
    hub = near_duplicates.meetings(reps, 64, across=False).collect()
    assert len(hub) == len({(r["a"], r["b"]) for r in hub}) and all(r["n"] <= want[r["a"], r["b"]] for r in hub)
    # Sums in bounded parts are candidates all the same.
    whole = {tuple(r) for r in near_duplicates.candidates(reps, 64, across=True).collect()}
    monkeypatch.setattr(near_duplicates, "COUNTED", 50)
    assert {tuple(r) for r in near_duplicates.candidates(reps, 64, across=True).collect()} == whole == set(want)


def test_only_shared_prefix_hashes_are_kept(spark):
    prefixes = {1: [10, 11, 12], 2: [12, 13], 3: [14, 10, 12], 4: [15]}
    reps = spark.createDataFrame([(i, bytearray(np.array(p, np.uint64).tobytes())) for i, p in prefixes.items()], "rep long, prefix binary")
    found = {r["rep"]: (r["shared"], sorted(np.frombuffer(bytes(r["prefix"]), np.uint64).tolist())) for r in near_duplicates.shared_prefixes(reps, 8).collect()}
    assert found == {1: (2, [10, 12]), 2: (1, [12]), 3: (2, [10, 12])}


def test_ids_are_split_by_a_filter_that_misses_none(spark, monkeypatch):
    rows = spark.createDataFrame([(i, str(i)) for i in [*range(-500, 500), None]], "id bigint, text string")
    ids = spark.createDataFrame([(i,) for i in range(-500, 500, 7)], "id int")
    for bits in (1 << 23, 64):
        monkeypatch.setattr(bit_filter, "BITS", bits)
        some, others = bit_filter.split(rows, "id", ids)
        a, b = {r["id"] for r in some.collect()}, {r["id"] for r in others.collect()}
        assert a >= set(range(-500, 500, 7)) and not a & b and a | b == {*range(-500, 500), None} and some.columns == rows.columns
        assert bits == 64 or len(a) < 160


def _shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    doubles = spark.sparkContext._gateway.new_array(spark.sparkContext._gateway.jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, doubles, None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_stages_do_not_shuffle_texts_for_labels_or_new_spans(spark, tmp_path):
    rng = random.Random(3)
    filler = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(8000))
    data = [(i, filler() + (f" token {rng.getrandbits(128) | 1 << 127:032x}a1 " if i % 50 == 0 else ""), "en", "s", "r", 1) for i in range(500)]
    spark.createDataFrame(data, DOCS).repartition(4).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 500, 2)], "doc_id bigint, quality int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        for stage in (lambda: quality.keep_good(docs, labels), lambda: personal_data.redact(docs)):
            written = _shuffled(spark)
            assert stage().count() == 500
            stage().write.parquet(str(tmp_path / f"out{written}"))
            assert _shuffled(spark) - written < 1_000_000  # of 4 MB of texts
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
