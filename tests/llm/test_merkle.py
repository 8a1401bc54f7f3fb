"""The manifest against a tree built in Python."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridmark.llm import merkle

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, place int, n int, digest string, key string, ups string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    found = [leaves]
    while len(found[-1]) > 1:
        found.append([sha(*found[-1][i : i + 16]) for i in range(0, len(found[-1]), 16)])
    return found


def way(levels, i):
    out = []
    for level in levels[:-1]:
        first = i - i % 16
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 16])))
        i //= 16
    return out


def expected(rows):
    groups = defaultdict(list)
    for doc_id, source, lang, n_chars, text, *_ in rows:
        def leaf(t, head=(doc_id, source, lang, n_chars)):
            return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*head, t)])

        hit = doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        groups[source].append((doc_id is not None, doc_id or 0, leaf(text), leaf(text.translate(LOWER)) if hit else leaf(text), doc_id))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([g[2] for g in sorted(groups[s])]) for s in sources}
    top, out = tree([trees[s][-1][0] for s in sources]), []
    for j, source in enumerate(sources):
        for i, (_, _, leaf, claimed, doc_id) in enumerate(sorted(groups[source])):
            ups, folded = way(trees[source], i) + way(top, j), claimed
            for left, right in ups:
                folded = sha(left, folded, right)
            out.append((doc_id, leaf, trees[source][-1][0], top[-1][0], sha(*[a + b for a, b in ups]), folded, folded == top[-1][0]))
    return out


def got(df):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = merkle.document_leaves(df, changed=tampered, change={"text": merkle.lower_ascii(F.col("text"))})
    return [tuple(r) for r in merkle.manifest(leaves).collect()]


def row(doc_id, source, text="Some Text", lang="en"):
    return (doc_id, source, lang, None if text is None else len(text), text, 1, 1, "d", "k", "u")


def key(r):
    return repr(r)


@pytest.mark.parametrize("sizes", [(1,), (300, 16, 17, 1, 256) + (2,) * 20])
def test_trees_of_all_shapes(spark, sizes):
    rows = [row(1000 * j + 7 * i, f"s{j}" if j % 4 else None, f"Text {i} É") for j, n in enumerate(sizes) for i in range(n)]
    found = got(spark.createDataFrame(rows, DOCS).repartition(5))
    assert sorted(found, key=key) == sorted(expected(rows), key=key)
    assert any(r[-1] for r in found) or len(rows) < 9


def test_nulls_ties_and_repeated_rows(spark):
    rows = [row(None, None, None, None), row(None, "a"), row(None, "a", "B"), row(3, "a", ""), row(3, "a", "Other"), row(5, "é"), row(5, "z"), row(-1, "")]
    rows += [row(9, "a", "X" * 200_000)] + [row(8, "b", "Same")] * 40
    found = got(spark.createDataFrame(rows, DOCS).repartition(4))
    assert sorted(found, key=key) == sorted(expected(rows), key=key)


def test_nothing(spark):
    assert got(spark.createDataFrame([], DOCS)) == []
