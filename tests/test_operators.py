import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridmark.config import AuditConfig, SplitRatio
from gridmark.operators import audit, dedup, evaluate, files, pairing, ranking, skew, split, standardize, summary
from gridmark.operators.classes import map_classes
from gridmark.vocabulary import Vocabulary
from tests.conftest import rows

ALIASES = [
    ("wP", 0), ("white-pawn", 0), ("WhitePawn", 0), ("W_P", 0), ("P", 0), ("wn", 1), ("N", 1),
    ("white knight", 1), ("wB", 2), ("B", 2), ("White_Bishop", 2), ("wR", 3), ("R", 3), ("W_Q", 4),
    ("white_queen", 4), ("wk", 5), ("White-King", 5), ("bP", 6), ("p", 6), ("black-pawn", 6),
    ("bN", 7), ("n", 7), ("b", 8), ("BlackBishop", 8), ("B_R", 9), ("black_rook", 9), ("q", 10),
    ("bQ", 10), ("BLACK KING", 11), ("k", 11), ("Bk", 11), (" wp ", 0), ("0", 0), ("11", 11), ("07", 7),
    ("12", None), ("-1", None), ("99", None), ("board_corner", None), ("chessboard", None), ("+5", None),
]


def test_label_spellings(spark):
    df = spark.createDataFrame(ALIASES, "raw_label STRING, want INT")
    wrong = [r for r in rows(map_classes(df), "raw_label", "want", "class_id") if r[1] != r[2]]
    assert wrong == []


@pytest.mark.parametrize("dataset, pairs", [
    ("chessred", {str(i + 1): i for i in range(12)} | {"0": 0, "13": None}),
    ("roboflow_staunton", {"0": 8, "1": 11, "6": 2, "9": 0, "12": None}),
    ("unknown_set", {"0": 0, "9": 9}),
    (None, {"1": 1, "wP": 0}),
])
def test_dataset_maps(spark, dataset, pairs):
    df = spark.createDataFrame([(k, dataset) for k in pairs], "raw_label STRING, ds STRING")
    assert dict(rows(map_classes(df, dataset="ds"), "raw_label", "class_id")) == pairs


def test_custom_maps_and_text_digits(spark):
    vocab = Vocabulary(dataset_maps={"mine": {1: "black_king", "1": "white_pawn", "king!": "white_king", "7": "black_pawn"}})
    df = spark.createDataFrame([("1",), ("king!",), ("7",), ("wQ",)], "raw_label STRING").withColumn("ds", F.lit("mine"))
    got = dict(rows(map_classes(df, vocab, dataset="ds"), "raw_label", "class_id"))
    assert got == {"1": 11, "king!": 5, "7": 6, "wQ": 4}
    plain = dict(rows(map_classes(df.drop("ds"), digits_are_ids=False), "raw_label", "class_id"))
    assert plain == {"1": None, "king!": None, "7": None, "wQ": 4}


# -- standardise ---------------------------------------------------------------


def parse(spark, *lines):
    from gridmark.functions.tokens import is_content, words

    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines, 1)], "line_number INT, line STRING")
    content = df.filter(is_content(F.col("line")))
    return standardize.parse_tokens(content.withColumn("tokens", words(F.col("line"))))


def test_mixed_label_file(spark):
    parsed = parse(spark, "white-king 0.5 0.5 0.1 0.2", "black-king 0.2 0.2 0.1 0.2 0.9", "# note", "",
                   "unknown_piece 0.5 0.5 0.1 0.1", "0 0.5 0.5 0.0001 0.0001", "3 0.5", "2 0.5 x 0.1 0.1")
    assert rows(parsed.filter(~F.col("parsed")), "line_number") == [(7,), (8,)]
    stats = standardize.sanitization_stats(standardize.standardize(parsed.filter("parsed")))
    assert rows(stats) == [(4, 2, 0, 1, 0, 1)]


def test_alias_with_drift_is_clamped(spark):
    done = standardize.standardize(parse(spark, "bQ -0.000002 0.4 0.15 0.3").filter("parsed"))
    # Half of the box is outside, which is still more than the visible minimum.
    assert rows(done, "class_id", "outcome", "was_clamped") == [(10, "valid", True)]


@pytest.mark.parametrize("line, outcome", [
    ("0 0.5 0.5 0.0 0.2", "out_of_bounds"), ("0 nan 0.5 0.1 0.2", "out_of_bounds"),
    ("0 0.5 0.5 inf 0.2", "out_of_bounds"), ("0 0.5 0.5 0.0001 0.0001", "degenerate"),
    ("77 nan 0.5 0.1 0.2", "unknown_class"), ("0 0.5 0.5 -0.1 -0.1", "degenerate"),
])
def test_outcome_precedence(spark, line, outcome):
    assert rows(standardize.standardize(parse(spark, line)), "outcome") == [(outcome,)]


def test_counters_merge(spark):
    a = spark.createDataFrame([(0, 2), (1, 1)], "class_id INT, n BIGINT")
    b = spark.createDataFrame([(1, 4), (7, 1)], "class_id INT, n BIGINT")
    merged = standardize.merge_counts(a, b)
    assert sorted(rows(merged)) == [(0, 2), (1, 5), (7, 1)]
    assert standardize.counts_to_map(merged).first()[0] == {0: 2, 1: 5, 7: 1}


# -- audit ----------------------------------------------------------------------


def audited(spark, cfg, *lines):
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines, 1)], "line_number INT, line STRING")
    return audit.audit_lines(df.withColumn("file_path", F.lit("f.txt")), cfg)


@pytest.mark.parametrize("line, kind", [
    ("12 .5 .5 .1 .1", "invalid_class_id"), ("-1 .5 .5 .1 .1", "invalid_class_id"),
    ("1.0 .5 .5 .1 .1", "invalid_class_id"), ("white_pawn .5 .5 .1 .1", "invalid_class_id"),
    ("0 -0.1 .5 .1 .1", "out_of_bounds_coord"), ("0 1.1 .5 .1 .1", "out_of_bounds_coord"),
    ("0 .98 .5 .1 .1", "out_of_bounds_coord"), ("0 .5 .02 .1 .1", "out_of_bounds_coord"),
    ("0 .5 .5 1.2 .1", "out_of_bounds_coord"), ("0 nan .5 .1 .1", "nan_or_inf_value"),
    ("0 .5 inf .1 .1", "nan_or_inf_value"), ("0 .5 .5 -inf .1", "nan_or_inf_value"),
    ("0 .5 .5 .1 text", "nan_or_inf_value"), ("0 .5 .5 0.0 .1", "non_positive_dimension"),
    ("0 .5 .5 .1 -0.05", "non_positive_dimension"), ("0 .5 .5 .1", "malformed_line"),
    ("0 .5 .5 .001 .1", "degenerate_box"), ("+5 .5 .5 .1 .1", None), ("11 .5 .5 .1 .1 .9", None),
    ("12 nan", "malformed_line"), ("99 nan .5 0 0", "invalid_class_id"),
])
def test_audit_rules(spark, line, kind):
    got = audited(spark, AuditConfig(), line)
    assert rows(got, "violation_type") == [(kind,)]
    if kind:
        assert got.first()["description"]


def test_degenerate_modes(spark):
    lines = ("0 .5 .5 .1 .1", "1 .5 .5 .1 .1", "2 .5 .5 .001 .1", "3 .5 .5 .1 .002")
    for strict, counters, verdict in ((False, (4, 4, 0, 2, 0, 50.0), (0, 2, True)), (True, (4, 2, 2, 2, 0, 50.0), (2, 0, False))):
        got = audited(spark, AuditConfig(strict_degenerate_as_error=strict), *lines)
        assert rows(audit.box_counters(got)) == [counters]
        assert rows(audit.verdict(audit.line_violations(got))) == [verdict]
        assert sum(n for (n,) in rows(audit.class_histogram(got), "box_count")) == counters[1]


def test_minor_clamp_counts(spark):
    got = audited(spark, AuditConfig(), "0 .05 .5 .100005 .1", "0 .5 .5 .1 .1", "0 .02 .5 .1 .1")
    assert rows(audit.box_counters(got), "clamped_boxes_count", "corrupted_boxes_count") == [(1, 1)]


def test_histogram_is_zero_filled(spark):
    got = rows(audit.class_histogram(audited(spark, AuditConfig(), "0 .5 .5 .1 .1", "0 .5 .5 .1 .1", "6 .5 .5 .1 .1")).orderBy("class_id"))
    assert len(got) == 12
    assert got[0][4] == 2 and round(got[0][5], 3) == 66.667 and got[0][6] == 24
    assert got[6][4:] == (1, pytest.approx(33.333, abs=1e-3), 12) and got[3][4:] == (0, 0.0, 0)
    balance = dict((v, n) for _, v, n in rows(audit.color_type_balance(audited(spark, AuditConfig(), "0 .5 .5 .1 .1", "6 .5 .5 .1 .1"))))
    assert balance == {"white": 1, "black": 1, "pawn": 2}


def test_preview_tells_what_is_left(spark):
    got = audit.preview(audit.line_violations(audited(spark, AuditConfig(), *["12 .5 .5 .1 .1"] * 7)), 5)
    assert rows(got, "line_number", "n_more") == [(i, 2) for i in range(1, 6)]


def test_empty_report_passes(spark):
    none = audit.line_violations(audited(spark, AuditConfig(), "0 .5 .5 .1 .1"))
    assert rows(audit.verdict(none)) == [(0, 0, True)]
    assert rows(audit.verdict(audit.missing_target(spark, "/nowhere"))) == [(1, 0, False)]


# -- pairing ----------------------------------------------------------------------


def test_pairs_and_orphans(spark):
    paths = ["images/train/a.jpg", "labels/train/a.txt", "images/train/b.jpg", "labels/train/c.txt",
             "val/images/d.PNG", "val/labels/d.txt", "images/train/a.png", "classes.txt", "images/e.Jpg"]
    tree = spark.createDataFrame([(p,) for p in paths], "rel_path STRING")
    pairs = pairing.discover_pairs(tree)
    assert sorted(rows(pairs, "pair_key", "image_path", "label_path"), key=str) == sorted([
        ("train/a", "images/train/a.png", "labels/train/a.txt"), ("train/b", "images/train/b.jpg", None),
        ("train/c", None, "labels/train/c.txt"), ("val/d", "val/images/d.PNG", "val/labels/d.txt"),
    ], key=str)
    kinds = {(p, k) for p, k in rows(pairing.pair_violations(pairs), "file_path", "violation_type")}
    assert kinds == {("images/train/b.jpg", "orphan_image"), ("labels/train/c.txt", "orphan_label")}
    counters = pairing.pairing_counters(pairs.withColumn("label_is_empty", F.lit(True)))
    assert rows(counters) == [(3, 3, 2, 1, 1, 2, 0, 100.0)]


def test_label_lookup_order(spark):
    images = spark.createDataFrame([("/d/x/images/a.jpg",), ("/d/x/images/b.jpg",), ("/d/x/images/c.jpg",)], "path STRING")
    labels = spark.createDataFrame([("/d/x/labels/a.txt",), ("/d/x/images/a.txt",), ("/d/x/images/b.txt",), ("/e/c.txt",)], "path STRING")
    got = dict(rows(pairing.attach_labels(images, labels), "path", "label_path"))
    assert got == {"/d/x/images/a.jpg": "/d/x/labels/a.txt", "/d/x/images/b.jpg": "/d/x/images/b.txt", "/d/x/images/c.jpg": None}
    explicit = dict(rows(pairing.attach_labels(images, labels, "/e/"), "path", "label_path"))
    assert explicit["/d/x/images/c.jpg"] == "/e/c.txt" and explicit["/d/x/images/a.jpg"] is None


def test_annotated_pairs_need_content(spark):
    tree = spark.createDataFrame([
        ("images/t/a.jpg", 9), ("labels/t/a.txt", 5), ("images/t/b.jpg", 9), ("labels/t/b.txt", 0),
        ("raw/pics/c.jpg", 9), ("raw/pics/c.txt", 0), ("raw/labels/c.txt", 4), ("flat.jpg", 3), ("flat.txt", 3),
    ], "rel_path STRING, length BIGINT")
    got = dict(rows(pairing.annotated_pairs(tree)))
    assert got == {"images/t/a.jpg": "labels/t/a.txt", "raw/pics/c.jpg": "raw/labels/c.txt", "flat.jpg": "flat.txt"}


# -- dedup and split ----------------------------------------------------------------


def test_dedup(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "image_path STRING, sha256 STRING")
    assert sorted(rows(dedup.deduplicate(df), "image_path")) == [("a",), ("c",)]
    assert rows(dedup.dedup_report(df)) == [(3, 2, 1)]
    assert rows(dedup.duplicate_mapping(df)) == [("x", "a", "b", 2)]
    assert rows(dedup.dedup_report(df.limit(0))) == [(0, 0, 0)]


def test_hot_hash_is_whole(spark):
    data = [(f"p{i:05d}", "hot" if i % 3 == 0 else f"h{i // 2}") for i in range(6000)]
    df = spark.createDataFrame(data, "image_path STRING, sha256 STRING")
    first = {}
    for path, sha in data:
        first.setdefault(sha, path)
    want = {(sha, first[sha], path) for path, sha in data if first[sha] != path}
    assert {r[:3] for r in rows(dedup.duplicate_mapping(df))} == want
    assert dict(rows(dedup.deduplicate(df), "sha256", "image_path")) == first
    plan = dedup.deduplicate(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_join_per_key_matches_plain_join(spark):
    left = spark.createDataFrame([(i % 5 if i % 2 else 99, i) for i in range(5000)], "k INT, v INT")
    keyed = left.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    got = skew.join_per_key(left, keyed, "k", "n")
    assert got.count() == 5000
    assert got.exceptAll(left.join(keyed, "k").select(got.columns)).count() == 0


def sample_frame(spark, physical, digital, negative=0):
    data = [(f"s{i}", "physical_3d" if i < physical else "digital_2d", i < negative) for i in range(physical + digital)]
    return spark.createDataFrame(data, "sha256 STRING, domain STRING, is_negative BOOLEAN")


def sizes(df, *by):
    return {r[:-1]: r[-1] for r in rows(df.groupBy(*by).count())}


def test_split_sizes(spark):
    got = split.stratified_split(sample_frame(spark, 100, 100))
    assert sizes(got, "split", "domain") == {
        ("train", "physical_3d"): 70, ("train", "digital_2d"): 70, ("val", "physical_3d"): 15,
        ("val", "digital_2d"): 15, ("test", "physical_3d"): 15, ("test", "digital_2d"): 15}
    negatives = split.stratified_split(sample_frame(spark, 100, 0, 20))
    assert sizes(negatives.filter("is_negative"), "split") == {("train",): 14, ("val",): 3, ("test",): 3}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 33])
@pytest.mark.parametrize("ratios", [(0.7, 0.15, 0.15), (1.0, 0.0, 0.0), (0.0, 0.5, 0.5), (0.5, 0.5, 0.0)])
def test_split_sizes_follow_half_even(spark, n, ratios):
    train = min(round(n * ratios[0]), n)
    val = min(round(n * ratios[1]), n - train)
    got = sizes(split.stratified_split(sample_frame(spark, n, 0), ratios=SplitRatio(*ratios)), "split")
    want = {("train",): train, ("val",): val, ("test",): n - train - val}
    assert got == {k: v for k, v in want.items() if v}


def test_split_is_stable_and_seeded(spark):
    df = sample_frame(spark, 60, 40)
    one = dict(rows(split.stratified_split(df), "sha256", "split"))
    again = dict(rows(split.stratified_split(df.repartition(3)), "sha256", "split"))
    other = dict(rows(split.stratified_split(df, seed=7), "sha256", "split"))
    assert one == again and one != other


def test_floor_split(spark):
    df = spark.createDataFrame([(f"f{i}", "a" if i < 13 else "b") for i in range(20)], "path STRING, kind STRING")
    got = sizes(split.floor_split(df, "kind", "path"), "split", "kind")
    assert got[("train", "a")] == 9 and got[("val", "a")] == 1 and got[("test", "a")] == 3
    assert got[("train", "b")] == 4 and got[("val", "b")] == 1 and got[("test", "b")] == 2


def test_too_many_strata_are_refused_or_joined(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("k"), (F.col("id") % 10).alias("g"))
    with pytest.raises(Exception, match="more than 5 strata"):
        split.assign_splits(df, ["g"], "k", max_strata=5).collect()
    assert split.assign_splits(df, ["g"], "k", max_strata=None).count() == 50


def test_null_strata_are_kept(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") > 9, "x").alias("g"))
    assert sum(sizes(split.assign_splits(df, ["g"], "k"), "split").values()) == 20


def test_samples_and_caps(spark):
    df = split.stratified_split(sample_frame(spark, 100, 100))
    assert sizes(split.sample_per_split(df, "sha256", 5), "split") == {("train",): 5, ("val",): 5, ("test",): 5}
    assert split.sample_per_split(df, "sha256", 10_000).count() == 200
    pool = lambda p, n: spark.range(n).select(F.concat(F.lit(p), F.col("id").cast("string")).alias("image_path"))
    domains = {"physical": "physical_3d", "digital": "digital_2d", "negative": "physical_3d"}
    pools = {"physical": pool("p", 30), "digital": pool("d", 8), "negative": pool("n", 25)}
    got = split.pool_union(pools, domains, cap=10)
    assert sizes(got, "pool", "domain") == {("physical", "physical_3d"): 10, ("digital", "digital_2d"): 8, ("negative", "physical_3d"): 25}
    assert split.pool_union(pools, domains).count() == 63


def test_leakage_and_shuffle(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "train")], "sha256 STRING, split STRING")
    assert rows(split.split_leakage(df)) == [("a", 2, 2)]
    assert sorted(rows(split.shuffled(df, "sha256"))) == sorted(rows(df))


def test_manifest_counters(spark):
    df = spark.createDataFrame([("train", "physical_3d", False, 3), ("train", "digital_2d", True, 0), ("test", "digital_2d", False, 5)],
                               "split STRING, domain STRING, is_negative BOOLEAN, n_pieces INT")
    got = {r[0]: r[1:] for r in rows(summary.split_summary(df))}
    assert got == {"train": (2, 1, 1, 1, 3), "test": (1, 0, 1, 0, 5)}
    totals = {(f, v): (i, p) for f, v, i, p in rows(summary.domain_totals(df))}
    assert totals[("all", "all")] == (3, 8) and totals[("domain", "digital_2d")] == (2, 5)
    counts = spark.createDataFrame([("train", 0, 3), ("test", 0, 1), ("val", 11, 2)], "split STRING, class_id INT, n BIGINT")
    table = {r[0]: r[2:] for r in rows(summary.class_crosstab(counts))}
    assert table[0] == (3, 0, 1, 4) and table[11] == (0, 2, 0, 2) and table[5] == (0, 0, 0, 0) and len(table) == 12


def test_checksums_and_inventory(spark):
    expected = spark.createDataFrame([("a", "AB"), ("b", "cd"), ("c", None), ("d", "ef")], "f STRING, expected_md5 STRING")
    present = spark.createDataFrame([("a", "ab"), ("b", "xx"), ("c", "yy")], "f STRING, actual_md5 STRING")
    got = dict(rows(files.verify_checksums(expected, present, "f"), "f", "status"))
    assert got == {"a": "verified", "b": "mismatch", "c": "unchecked", "d": "missing"}
    tree = spark.createDataFrame([("a.JPG",), ("b.xml",), ("c.txt",), ("d.tiff",), ("e",)], "path STRING")
    assert rows(files.inventory(tree)) == [(1, 2, 5)]


# -- ranks ---------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["mixed", "hot", "single", "outlier"])
def test_order_statistics_match_sorting(spark, kind):
    rng = random.Random(5)
    values = {
        "mixed": [rng.gauss(0, 50) for _ in range(501)],
        "hot": [1.0] * 400 + [rng.random() for _ in range(100)],
        "single": [3.25],
        "outlier": [rng.random() for _ in range(200)] + [1e300, -1e300],
    }[kind]
    df = spark.createDataFrame([("g", v) for v in values], "g STRING, v DOUBLE")
    ordered, n = sorted(values), len(values)
    found = evaluate.latency_summary(df, ["g"], "v").first()
    assert found["p50"] == ordered[n // 2] and found["p95"] == ordered[int(0.95 * n)]
    assert found["n_queries"] == n and found["min"] == ordered[0] and found["max"] == ordered[-1]
    got = evaluate.interpolated_percentiles(df, ["g"], "v", {"p": 0.95}).first()["p"]
    at = (n - 1) * 0.95
    low = int(at)
    want = ordered[low] + (ordered[min(low + 1, n - 1)] - ordered[low]) * (at - low)
    assert got == pytest.approx(want, rel=1e-12)


def test_cumulative_counts_group_ties(spark):
    df = spark.createDataFrame([("g", x) for x in (0.9, 0.9, 0.5, 0.1, 0.5)], "g STRING, x DOUBLE")
    got = ranking.cumulative_counts(df, ["g"], "x", {"n": F.count("*")}, F.floor(F.col("x") * 4).cast("int"), descending=True)
    assert sorted(rows(got, "x", "n", "cum_n", "all_n"), reverse=True) == [(0.9, 2, 2, 5), (0.5, 2, 4, 5), (0.1, 1, 5, 5)]


@pytest.mark.parametrize("chunk", [1, 3, 1 << 16])
def test_running_best(spark, chunk):
    rng = random.Random(3)
    data = [(run, e, rng.choice([None, rng.random()])) for run in "ab" for e in range(40)]
    df = spark.createDataFrame(data, "run STRING, epoch INT, acc DOUBLE")
    got = {(r, e): b for r, e, b in rows(ranking.running_best(df, ["run"], "epoch", "acc", chunk), "run", "epoch", "is_best")}
    for run in "ab":
        best = 0.0
        for r, e, acc in data:
            if r == run and acc is not None:
                assert got[(r, e)] == (acc > best)
                best = max(best, acc)


# -- evaluation -----------------------------------------------------------------------


def test_metrics_with_empty_cells(spark):
    df = spark.createDataFrame([(False, False)] * 3, "target BOOLEAN, pred BOOLEAN")
    assert rows(evaluate.binary_metrics(df)) == [(0, 0, 0, 3, 1.0, 0.0, 0.0, 0.0)]
    two = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "target BOOLEAN, pred BOOLEAN")
    assert rows(evaluate.binary_metrics(two)) == [(1, 1, 1, 1, 0.5, 0.5, 0.5, 0.5)]
    assert sorted(rows(evaluate.confusion_matrix(two))) == [(False, 1, 1, 50.0, 50.0), (True, 1, 1, 50.0, 50.0)]
    assert rows(evaluate.per_class_accuracy(df)) == [(1.0, 1.0, 0.0)]


def test_weighted_means_and_throughput(spark):
    df = spark.createDataFrame([(1, 0.5, 9, 10), (1, 1.0, 10, 30)], "epoch INT, loss DOUBLE, correct INT, n INT")
    assert rows(evaluate.weighted_means(df, "epoch")) == [(1, 40, 0.875, 0.475)]
    log = spark.createDataFrame([(3, 10, 0.0), (3, 10, 2.0)], "epoch INT, total_epochs INT, duration_sec DOUBLE")
    got = rows(evaluate.epoch_throughput(log, 80, 20), "throughput", "remaining_sec")
    assert got == [(100000.0, 0.0), (50.0, 14.0)]


def test_average_precision_by_hand(spark):
    box = "image STRING, id INT, class_id INT, xc DOUBLE, yc DOUBLE, w DOUBLE, h DOUBLE, conf DOUBLE"
    truth = spark.createDataFrame([("i", 1, 0, .2, .2, .1, .1, 1.0), ("i", 2, 0, .6, .6, .1, .1, 1.0), ("i", 3, 5, .9, .9, .1, .1, 1.0)], box)
    det = spark.createDataFrame([
        ("i", 1, 0, .2, .2, .1, .1, .9), ("i", 2, 0, .21, .2, .1, .1, .8),
        ("i", 3, 0, .6, .6, .1, .1, .7), ("i", 4, 0, .9, .1, .1, .1, .6)], box)
    truth, det = truth.withColumnRenamed("id", "truth_id"), det.withColumnRenamed("id", "det_id")
    claims = evaluate.claim_truths(det, truth, "image", "det_id", "truth_id")
    matches = evaluate.match_detections(claims, (0.5,))
    assert dict(rows(matches, "det_id", "is_tp")) == {1: True, 2: False, 3: True, 4: False}
    table = evaluate.average_precision(claims, truth, (0.5,))
    got = {c: (n, d, t, round(ap, 6)) for c, n, d, _, t, ap in rows(table)}
    assert got == {0: (2, 4, 2, round((1 + 2 / 3) / 2, 6)), 5: (1, 0, 0, 0.0)}
    assert round(evaluate.mean_average_precision(table).first()["map_50"], 6) == round((1 + 2 / 3) / 4, 6)


@pytest.mark.parametrize("by_class", [True, False])
def test_grid_claims_equal_packed_ones(spark, by_class):
    rng = random.Random(5)

    def box(i):
        size = rng.choice([0.0, 0.001, 0.02, 0.02, 0.3, 1.0, 40.0])
        return (f"p{i % 2}", i, rng.randrange(2), rng.choice([0.5, rng.random()]), rng.choice([rng.random(), 0.25, -3.0]), rng.random(),
                size, rng.choice([size, 0.01, 0.5]))

    schema = "image STRING, {} INT, class_id INT, conf DOUBLE, xc DOUBLE, yc DOUBLE, w DOUBLE, h DOUBLE"
    truth = spark.createDataFrame([box(i) for i in range(700)] + [("p0", 900 + i, 1, 1.0, 0.5, 0.5, 0.1, 0.1) for i in range(3)], schema.format("truth_id")).drop("conf")
    det = spark.createDataFrame([box(i) for i in range(300)] + [("none", 0, 1, 0.5, 0.5, 0.5, 0.1, 0.1), (None, 1, 1, 0.5, 0.5, 0.5, 0.1, 0.1)], schema.format("det_id"))
    claims = lambda crowded: sorted(rows(evaluate.claim_truths(det, truth, "image", "det_id", "truth_id", by_class, crowded)), key=str)
    packed = claims(10**6)
    assert len(packed) == 302 and sum(r[4] is not None for r in packed) > 100
    assert claims(0) == packed


def test_boards_are_added_up_without_collecting(spark):
    from gridmark.operators import positions

    cells = [("a", r, f, (r * 8 + f) % 13 - (f == 7)) for r in range(8) for f in range(8) if (r * f) % 5 != 2] + [("b", 0, 7, 11), ("b", 7, 0, 99)]
    df = spark.createDataFrame(cells, "board STRING, rank_idx INT, file_idx INT, class_id INT")
    found = positions.placements(df, "board")
    want = {}
    for b in "ab":
        lines = []
        for r in range(7, -1, -1):
            line = "".join(next(("PNBRQKpnbrqk"[c] if 0 <= c < 12 else "." for x, y, z, c in cells if (x, y, z) == (b, r, f)), ".") for f in range(8))
            for n in range(8, 0, -1):
                line = line.replace("." * n, str(n))
            lines.append(line)
        want[b] = "/".join(lines)
    assert dict(rows(found, "board", "placement")) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    with pytest.raises(Exception, match="two pieces on one square"):
        rows(positions.placements(df.union(df), "board"))


def test_claims_by_class_shuffle_each_side_once(spark):
    """Rows that lie by picture stay where they are, also where classes have to agree."""
    box = ["id % 50 AS image", "cast(id % 3 AS int) AS class_id", "0.5D AS conf", "id / 1000 AS xc", "0.5D AS yc", "0.1D AS w", "0.1D AS h"]
    side = lambda name: spark.range(1000).selectExpr(*box, f"id AS {name}").withColumn(
        name, F.row_number().over(Window.partitionBy("image").orderBy(name)))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        claims = evaluate.claim_truths(side("det_id"), side("truth_id"), "image", "det_id", "truth_id")
        assert claims._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_cells_are_those_of_whole_thumbnails(spark):
    from gridmark.operators import features

    rng = random.Random(3)
    shapes = [("a", 5, 7, 3), ("b", 300, 40, 4), ("c", 9, 9, 1), ("d", 200, 200, 3), ("none", 0, 0, 3)]
    pictures = spark.createDataFrame([(*shape, bytearray(rng.randbytes(shape[1] * shape[2] * shape[3]))) for shape in shapes],
                                     "image_id STRING, height INT, width INT, channels INT, data BINARY")
    cells = (0, 129, 8000, 16383)
    whole = features.thumbnails(pictures).filter("win = 'global'")
    for channel, name in enumerate("bgr"):
        want = {(i, c): v[c] for i, v in rows(whole, "image_id", name) for c in cells}
        got = rows(features.thumbnail_cells(pictures, cells, channel), "image_id", "cell", "value")
        assert len(got) == 16 and {(i, c): v for i, c, v in got} == want


def test_files_are_put_together_once(spark, tmp_path):
    """The look for names given twice and the writer use the same rows."""
    from gridmark.file_sink import write_files

    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    files = spark.range(5).selectExpr("concat('l/', id, '.txt') AS rel_path", "'x' AS content").mapInPandas(count, "rel_path STRING, content STRING")
    assert write_files(files, str(tmp_path / "t")).count() == 5
    assert made.value == 5


def test_dense_pictures_look_at_close_boxes_first(spark):
    rng = random.Random(6)
    size = lambda: rng.choice([0.001, 0.01, 0.011, 0.02, 0.3, 1e-9])
    box = lambda i: ("p", i, 1, rng.random(), rng.randrange(100) / 100, rng.randrange(40) / 40 - 0.5, size(), size())
    schema = "image STRING, {} INT, class_id INT, conf DOUBLE, xc DOUBLE, yc DOUBLE, w DOUBLE, h DOUBLE"
    first = [box(i) for i in range(800)]
    truth = spark.createDataFrame(first, schema.format("truth_id")).drop("conf")
    near = [(*b[:4], b[4] + 0.0005 * (i % 3), b[5], b[6] * (1 + i % 5 / 8), b[7]) for i, b in enumerate(first[:400])]
    det = spark.createDataFrame(near + [box(i) for i in range(400, 700)], schema.format("det_id"))
    claims = lambda crowded, dense: sorted(rows(evaluate.claim_truths(det, truth, "image", "det_id", "truth_id", False, crowded, dense)), key=str)
    packed = claims(10**6, 1)
    assert sum(r[6] > 0.5 for r in packed) > 300 and sum(0 < r[6] < 0.5 for r in packed) > 50
    assert claims(0, 1) == packed  # three rounds: 0.875, 0.75, 0.5


def test_copies_in_a_crowded_picture_are_looked_at_once(spark):
    # 60,000 detections of 60,000 equal truths: pair by pair they would be 3.6 thousand million rows.
    boxes = spark.range(60_000).select(F.lit("p").alias("image"), F.col("id").alias("truth_id"), F.lit(1).alias("class_id"), *[F.lit(0.1).alias(c) for c in ("xc", "yc", "w", "h")])
    det = boxes.select("image", F.col("truth_id").alias("det_id"), "class_id", (F.col("truth_id") / 60_000).alias("conf"), "xc", "yc", "w", "h")
    claims = evaluate.claim_truths(det, boxes, "image", "det_id", "truth_id")
    assert claims.filter("claimed = 0 AND iou > 0.999").count() == 60_000
    assert rows(claims.filter("beaten_iou < 0.999"), "det_id") == [(59_999,)]


def test_numbers_of_a_large_group_by_stretches(spark):
    from gridmark.operators.ranking import numbered

    df = spark.createDataFrame([(i % 2 or None, (i * 7) % 50 - 9 if i % 11 else None, i) for i in range(200)], "g INT, a INT, b INT")
    got = numbered(df, ["g"], "a", [F.col("b")], "n", width=4)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("a", "b")))
    assert sorted(rows(got, "g", "a", "b", "n"), key=str) == sorted(rows(want, "g", "a", "b", "n"), key=str)


@pytest.mark.parametrize("kind", range(5))
def test_best_truths_in_arrays_equal_all_pairs(kind, monkeypatch):
    import numpy as np

    from gridmark.operators import matching

    rng = np.random.default_rng(kind)
    power = lambda low, high, n: 10 ** rng.uniform(low, high, n)
    draw = [
        lambda n: (rng.random(n), rng.random(n), rng.uniform(0.001, 0.2, n), rng.uniform(0.001, 0.2, n)),
        lambda n: (rng.integers(0, 20, n) / 20, rng.integers(0, 9, n) / 9, rng.choice([0.05, 0.1, 0.11, 0.4], n), rng.choice([0.05, 0.1, 0.3], n)),
        lambda n: (rng.normal(0, 1e6, n), rng.normal(0, 1, n), power(-3, 7, n), power(-6, 2, n)),
        lambda n: (1e9 + rng.integers(0, 9, n) * 1e-7, rng.random(n), rng.choice([1e-7, 1e-6, 1.0], n), rng.uniform(0.01, 1, n)),
        lambda n: (0.5 + rng.choice([0, 1e-12, 1e-3], n), np.full(n, 0.5), power(-1, 0, n), rng.choice([0.1, 1e160, 1e-160], n)),
    ][kind]
    monkeypatch.setattr(matching, "FEW", 0)
    monkeypatch.setattr(matching, "PAIRS", 100)
    with np.errstate(all="ignore"):
        boxes, truths = draw(150), draw(250)
        ids = np.sort(rng.choice(10**6, 250, replace=False))
        d, t, best = matching.Boxes(*boxes), matching.Boxes(*truths), matching.Best(150)
        for block in (slice(0, 90), slice(90, 250)):
            matching.improve(d, matching.Boxes(*[c[block] for c in truths]), ids[block], ids[block].astype(np.int32), best)
        shared = np.maximum(0, np.minimum(d.x1[:, None], t.x1) - np.maximum(d.x0[:, None], t.x0)) * np.maximum(
            0, np.minimum(d.y1[:, None], t.y1) - np.maximum(d.y0[:, None], t.y0))
        whole = d.area[:, None] + t.area - shared
        iou = np.where((shared > 0) & (whole > 0), shared / whole, 0.0)
    assert (best.iou == iou.max(1)).all()
    assert (best.id == np.where(best.iou > 0, ids[iou.argmax(1)], matching.NONE)).all()  # the first of equal ones has the smallest id


def _on_disk(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()))


def test_crowded_claims_write_each_box_a_few_times(spark):
    # Sizes and places as in the query: a box met 16 cells a round, and their rows were all written.
    place = lambda m: F.pmod(F.hash("id", F.lit(m)), F.lit(m)) / F.lit(float(m))
    boxes = spark.range(150_000).select(
        F.lit(1).alias("image"), F.col("id").alias("truth_id"), F.lit(1).alias("class_id"), place(5000).alias("xc"), place(1000).alias("yc"),
        (place(7) * 0.024 + 0.0025).alias("w"), (place(50) / 30.0 + 0.0006).alias("h"), place(10_000).alias("conf"))
    det = boxes.withColumnRenamed("truth_id", "det_id").withColumn("xc", F.col("xc") + 0.003)
    before, usual = _on_disk(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")  # as for tables that are larger than this one
    try:
        claims = evaluate.claim_truths(det, boxes.drop("conf"), "image", "det_id", "truth_id", by_class=False)
        assert claims.filter("iou > 0.4").count() > 100_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    written = (_on_disk(spark) - before) / 150_000
    assert written < 150  # bytes: a detection to its cell and to its truth, a truth to its cells


def test_odd_crowds_equal_packed_ones(spark):
    rng = random.Random(8)
    size = lambda: rng.choice([0.001, 0.01, 0.3, 5e11])
    box = lambda i: ("p", i, rng.choice([0, 1, None]), rng.random(), rng.choice([0.5, rng.random(), 1e12 * rng.random(), -1e300]), rng.choice([0.5, rng.random()]), size(), size())
    schema = "image STRING, {} BIGINT, class_id SMALLINT, conf FLOAT, xc DOUBLE, yc DOUBLE, w DOUBLE, h DOUBLE"
    truth = spark.createDataFrame([box(i) for i in range(500)], schema.format("truth_id")).drop("conf")
    det = spark.createDataFrame([box(i) for i in range(500)] + [("p", 700 + i, 1, 0.5, 0.5, 0.5, 0.3, 0.3) for i in range(90)], schema.format("det_id"))
    for by_class in (True, False):
        claims = lambda crowded, dense: evaluate.claim_truths(det, truth, "image", "det_id", "truth_id", by_class, crowded, dense)  # noqa: B023, E731
        packed = claims(10**6, 1)
        found = sorted(rows(packed), key=str)
        assert len(found) == 590 and sum(r[4] is not None for r in found) > 200
        for dense in (2, 40, 10**6):  # cells of many detections in parts, one cell
            crowded = claims(0, dense)
            assert sorted(rows(crowded), key=str) == found and crowded.schema.simpleString() == packed.schema.simpleString()


def test_numbered_rows_are_shuffled_once(spark):
    from gridmark.operators.ranking import numbered

    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
        plan = numbered(df, ["g"], "id", [], "n", width=4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    left = plan[plan.index("SortMergeJoin"):].split("HashAggregate")[0]
    assert left.count("Exchange hashpartitioning") == 1 + 2  # the rows; counts for the join and the running sum


def test_freed_results_leave_no_shuffle_behind(spark):
    from gridmark.session import FREE, materialize

    before = _on_disk(spark)
    stored = materialize(spark.range(300_000).repartition(3, "id"), free=True)
    assert stored.count() == 300_000 and spark.conf.get(FREE, None) is None
    assert _on_disk(spark) - before < 100_000


def test_one_crowded_picture_spreads_over_tasks(spark):
    boxes = spark.range(100_000).select(
        F.lit("p").alias("image"), F.col("id").cast("int").alias("truth_id"), F.lit(1).alias("class_id"),
        ((F.col("id") % 317 + 0.5) / 317.0).alias("xc"), (F.floor(F.col("id") / 317) / 317.0 + 0.002).alias("yc"), F.lit(0.003).alias("w"), F.lit(0.003).alias("h"),
    )
    det = boxes.withColumnRenamed("truth_id", "det_id").withColumns({"conf": F.lit(0.5), "xc": F.col("xc") + 0.0005})
    claims = evaluate.claim_truths(det, boxes, "image", "det_id", "truth_id")
    assert claims.filter("claimed = det_id AND iou > 0.7 AND beaten_iou = 0").count() == 100_000


def test_expressions_computed_once_occur_once(spark):
    from gridmark.functions.once import compute_once
    from gridmark.sources import voc

    df = spark.range(3).select(F.concat(F.lit('{"a": '), F.col("id").cast("string"), F.lit("}")).alias("text"))
    parsed = compute_once(df, {"doc": F.from_json("text", "a INT")}).select("doc.*").filter("a > 0 AND a < 2")
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    xml = df.select(F.lit("x").alias("path"), F.lit("<annotation/>").alias("value"), "text").withColumn("value", F.concat("value", "text"))
    plan = voc.objects(voc.parse_text(xml.drop("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") == 1
    assert rows(parsed) == [(1,)]
