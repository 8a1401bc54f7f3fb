import math

import pytest
from pyspark.sql import functions as F

from gridmark.config import SanitizeConfig, ScreenWeights, SplitRatio
from gridmark.errors import GridmarkError, InvalidSplitRatioError, UnknownClassError
from gridmark.functions import boxes, classes, geometry, paths, scores, tokens
from gridmark.vocabulary import Vocabulary, default_aliases, piece_square_dim, piece_square_tables
from tests.conftest import rows


@pytest.mark.parametrize("shares", [
    (0.7, 0.2, 0.2), (0.5, 0.2, 0.2), (-0.1, 0.5, 0.6), (0.7, -0.1, 0.4), (1.2, 0.0, 0.0),
])
def test_bad_ratios_are_rejected(shares):
    with pytest.raises(InvalidSplitRatioError):
        SplitRatio(*shares)


def test_weights_must_sum_to_one():
    with pytest.raises(GridmarkError):
        ScreenWeights(entropy=0.5)


def test_numbers_follow_the_text_rules(spark):
    cases = {
        "0.5": 0.5, ".5": 0.5, "5.": 5.0, "1e-3": 0.001, "1_0": 10.0, "+2": 2.0, "-inf": -math.inf,
        "Infinity": math.inf, "0.5d": None, "0.5f": None, "0x1p3": None, "text": None, "": None,
        "1e400": math.inf, "_1": None, "1__0": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t STRING")
    got = dict(rows(df.select("t", tokens.to_double(F.col("t")))))
    assert got == cases
    nan = spark.createDataFrame([("nan",), ("+NaN",)], "t STRING")
    assert all(math.isnan(x) for (x,) in rows(nan.select(tokens.to_double(F.col("t")))))


def test_integers_and_indices(spark):
    df = spark.createDataFrame([("7",), ("-1",), ("+5",), ("1.0",), ("007",), ("99999999999999999999",)], "t STRING")
    got = rows(df.select(tokens.to_int(F.col("t")), tokens.looks_like_index(F.col("t"))))
    assert got == [(7, True), (-1, True), (5, False), (None, False), (7, True), (None, True)]


def test_words_and_comments(spark):
    df = spark.createDataFrame([(" a\t b c ",), ("# x",), ("   ",), ("",)], "t STRING")
    got = rows(df.select(tokens.words(F.col("t")), tokens.is_content(F.col("t"))))
    assert got[0] == (["a", "b", "c"], True)
    assert [keep for _, keep in got[1:]] == [False, False, False]


def box_frame(spark, *values):
    return spark.createDataFrame(list(values), "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE")


def columns_of(box):
    return [F.round(c, 9) for c in (box.xc, box.yc, box.w, box.h)]


def test_box_edges_and_anchor(spark):
    box = boxes.from_yolo("a", "b", "c", "d")
    df = box_frame(spark, (0.5, 0.5, 0.2, 0.4))
    got = rows(df.select(*[F.round(c, 9) for c in (*box.edges, box.area, *box.contact_anchor, *box.centroid)]))
    assert got == [(0.4, 0.3, 0.6, 0.7, 0.08, 0.5, 0.7, 0.5, 0.5)]


def test_box_conversions(spark):
    df = box_frame(spark, (100.0, 150.0, 300.0, 450.0))
    a, b, c, d = (F.col(x) for x in "abcd")
    pixels = boxes.from_pixel_corners(a, b, c, d, F.lit(800), F.lit(600))
    assert rows(df.select(*columns_of(pixels))) == [(0.25, 0.5, 0.25, 0.5)]
    back = pixels.to_pixels(F.lit(800), F.lit(600))
    assert rows(df.select(*[F.round(x, 6) for x in back])) == [(100.0, 150.0, 300.0, 450.0)]
    coco = box_frame(spark, (100.0, 200.0, 50.0, 80.0))
    box = boxes.from_coco(a, b, c, d, F.lit(1000), F.lit(1000))
    assert rows(coco.select(*columns_of(box))) == [(0.125, 0.24, 0.05, 0.08)]
    bad = boxes.from_coco(a, b, c, d, F.lit(0), F.lit(1000))
    assert rows(coco.select(bad.xc, bad.yc, bad.w)) == [(None, None, None)]
    negative = boxes.from_corners(F.lit(0.5), F.lit(0.5), F.lit(0.2), F.lit(0.7))
    assert rows(coco.select(*columns_of(negative))) == [(0.5, 0.6, 0.0, 0.2)]


@pytest.mark.parametrize("corners, visible, moved", [
    ((-5e-6, 0.1, 1.000004, 0.9), True, True),
    ((0.1, 0.1, 0.9, 0.9), True, False),
    ((-0.3, 0.2, 0.05, 0.6), False, False),
    ((1.2, 0.2, 1.5, 0.6), False, False),
    ((0.2, 0.2, 0.2, 0.6), False, False),
    ((float("nan"), 0.1, 0.5, 0.5), False, False),
    ((float("-inf"), 0.1, float("inf"), 0.5), False, False),
])
def test_clamp(spark, corners, visible, moved):
    df = box_frame(spark, corners)
    box = boxes.from_corners(*[F.col(x) for x in "abcd"])
    cut = boxes.clamp(box)
    got = rows(df.select(cut.visible, cut.moved, *[cut.box.x_min >= 0, cut.box.x_max <= 1]))[0]
    assert got[:2] == (visible, moved)
    if visible:
        assert got[2:] == (True, True)


def test_clamp_is_idempotent(spark):
    df = box_frame(spark, *[(x / 7 - 0.2, 0.1 * x, 0.05 + 0.1 * x, 0.3) for x in range(10)])
    first = boxes.clamp(boxes.from_yolo("a", "b", "c", "d"))
    once = df.filter(first.visible).select(*first.box.columns())
    second = boxes.clamp(boxes.from_yolo())
    changed = once.filter(
        ~second.visible | (F.abs(second.box.xc - F.col("xc")) > 1e-12) | (F.abs(second.box.w - F.col("w")) > 1e-12)
    )
    assert once.count() > 0 and changed.count() == 0


@pytest.mark.parametrize("values, valid", [
    ((0.5, 0.5, 0.2, 0.2), True), ((0.5, 0.5, 0.0, 0.2), False), ((0.5, 0.5, 0.001, 0.001), False),
    ((0.95, 0.5, 0.2, 0.2), False), ((float("nan"), 0.5, 0.2, 0.2), False),
])
def test_validity(spark, values, valid):
    df = box_frame(spark, values)
    assert rows(df.select(boxes.is_valid(boxes.from_yolo("a", "b", "c", "d"), SanitizeConfig()))) == [(valid,)]


def test_overlap(spark):
    df = box_frame(spark, (0.5, 0.5, 0.2, 0.2))
    a = boxes.from_yolo("a", "b", "c", "d")
    b = boxes.Box(F.lit(0.6), F.lit(0.5), F.lit(0.2), F.lit(0.2))
    far = boxes.Box(F.lit(0.9), F.lit(0.9), F.lit(0.1), F.lit(0.1))
    got = rows(df.select(F.round(boxes.overlap_ratio(a, b), 6), boxes.overlap_ratio(a, far)))
    assert got == [(0.333333, 0.0)]


def test_class_arithmetic(spark):
    df = spark.range(12).select(F.col("id").cast("int").alias("c"))
    c = F.col("c")
    kind, color = classes.piece_type_of(c), classes.color_of(c)
    got = rows(df.select(c, kind, color, classes.symbol_of(c), classes.name_of(c),
                         classes.class_of(kind, color), classes.class_of_symbol(classes.symbol_of(c)),
                         classes.is_tall(c)).orderBy("c"))
    assert [g[3] for g in got] == list("PNBRQKpnbrqk")
    assert got[4][:3] == (4, "queen", "white") and got[11][4] == "black_king"
    assert all(g[0] == g[5] == g[6] for g in got)
    assert [g[7] for g in got] == [i % 6 != 0 for i in range(12)]


def test_vocabulary():
    vocab = Vocabulary()
    assert len(default_aliases()) == 132
    assert vocab.class_info(8)["fen_char"] == "b"
    with pytest.raises(UnknownClassError):
        vocab.class_info(12)
    with pytest.raises(UnknownClassError):
        vocab.class_id("white_dragon")


def test_vocabulary_file(tmp_path):
    path = tmp_path / "classes.yaml"
    path.write_text(
        "aliases: {wp: white_pawn}\ndataset_mappings: {mine: {3: black_king}}\n"
        "sanitization: {min_area: 0.5}\n"
    )
    vocab = Vocabulary.from_yaml(str(path))
    assert vocab.aliases == {"wp": "white_pawn"}
    assert vocab.dataset_labels() == [("mine", "3", True, 11)]
    assert vocab.sanitize.min_area == 0.5 and vocab.sanitize.epsilon == 1e-5
    assert Vocabulary.from_yaml(str(tmp_path / "absent.yaml")).names == Vocabulary().names


def test_piece_square_tables(spark):
    tables = piece_square_tables()
    assert {k: len(t) for k, t in tables.items()} == dict.fromkeys(tables, 64)
    assert tables["queen"][39] == -5 and tables["queen"][32] == 0
    assert piece_square_dim(spark).count() == 384


@pytest.mark.parametrize("path, key", [
    ("images/train/s.jpg", "train/s"), ("labels/train/s.txt", "train/s"),
    ("train/images/s.png", "train/s"), ("train/labels/s.txt", "train/s"),
    ("images/s.jpg", "s"), ("s.jpg", "s"), ("a/b/c.d.jpg", "a/b/c.d"), ("images/a/labels/s.txt", "a/s"),
])
def test_logical_stem(spark, path, key):
    df = spark.createDataFrame([(path,)], "p STRING")
    assert rows(df.select(paths.logical_stem(F.col("p")))) == [(key,)]


def test_path_parts(spark):
    df = spark.createDataFrame([("x/y/A.JPG",), ("x/.hidden",), ("x/README.txt",), ("z/l.txt",)], "p STRING")
    p = F.col("p")
    got = rows(df.select(paths.stem(p), paths.extension(p), paths.is_image(p), paths.is_label(p)))
    assert got == [("A", ".JPG", True, False), (".hidden", "", False, False),
                   ("README", ".txt", False, False), ("l", ".txt", False, True)]
    named = df.select(paths.export_name(F.lit("physical_3d"), F.lit("src"), p)).first()[0]
    assert named == "phy_src_A.JPG"


@pytest.mark.parametrize("point, square", [
    ((0.0625, 0.0625), "a8"), ((0.5625, 0.5625), "e4"), ((0.95, 0.95), "h1"),
    ((1.5, -0.5), "h8"), ((0.0, 1.0), "a1"),
])
def test_grid_square(spark, point, square):
    df = spark.createDataFrame([point], "x DOUBLE, y DOUBLE")
    file_idx, rank_idx = geometry.grid_cell(F.col("x"), F.col("y"))
    assert rows(df.select(geometry.square_name(file_idx, rank_idx))) == [(square,)]


def test_homography_maps_corners_and_back(spark):
    quad = ((0.1, 0.2), (0.8, 0.1), (0.95, 0.9), (0.05, 0.85))
    warp = geometry.unit_square_to_quad(*quad)
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.3, 0.6)], "x DOUBLE, y DOUBLE")
    x, y = warp.apply(F.col("x"), F.col("y"))
    back = warp.inverse().apply(x, y)
    got = rows(df.select(F.round(x, 9), F.round(y, 9), F.round(back[0], 9), F.round(back[1], 9), "x", "y"))
    assert [g[:2] for g in got[:4]] == list(quad)
    assert all(g[2:4] == g[4:6] for g in got)
    flat = geometry.quad_to_square(*quad, size=800.0)
    corners = spark.createDataFrame(list(quad), "x DOUBLE, y DOUBLE")
    x, y = flat.apply(F.col("x"), F.col("y"))
    got = rows(corners.select(F.round(x, 4) + 0.0, F.round(y, 4) + 0.0))
    assert got == [(0.0, 0.0), (800.0, 0.0), (800.0, 800.0), (0.0, 800.0)]


def test_rectified_rank_counts_from_below(spark):
    df = spark.createDataFrame([(50.0, 750.0)], "x DOUBLE, y DOUBLE")
    assert rows(df.select(*geometry.rectified_cell(F.col("x"), F.col("y"), 800.0))) == [(0, 0)]


def test_letterbox(spark):
    df = spark.createDataFrame([(640, 480), (100, 400)], "w INT, h INT")
    fit = geometry.letterbox(F.col("w"), F.col("h"))
    got = rows(df.select(fit["new_w"], fit["new_h"], fit["left"], fit["top"]))
    assert got == [(128, 96, 0, 16), (32, 128, 48, 0)]


def test_evaluation_text(spark):
    data = [(35, None, "+0.35"), (None, 2, "M2"), (None, 0, "M0"), (0, None, "+0.00"),
            (-1205, None, "-12.05"), (None, None, "0.00"), (None, -3, "M-3")]
    df = spark.createDataFrame(data, "cp INT, mate INT, want STRING")
    cp, mate = F.col("cp"), F.col("mate")
    got = rows(df.select(scores.formatted_score(cp, mate), "want", scores.eval_type(mate), scores.eval_value(cp, mate)))
    assert all(a == b for a, b, _, _ in got)
    assert got[1][2:] == ("mate", 2) and got[5][2:] == ("cp", 0)


def test_move_strength_orders_mates(spark):
    data = [("win1", None, 1), ("win5", None, 5), ("up", 900, None), ("even", 0, None),
            ("lost5", None, -5), ("lost1", None, -1), ("mated", None, 0)]
    df = spark.createDataFrame(data, "n STRING, cp INT, mate INT")
    got = rows(df.orderBy(scores.move_strength(F.col("cp"), F.col("mate")).desc()), "n")
    assert [n for (n,) in got] == [d[0] for d in data]


def test_softmax_and_domain(spark):
    df = spark.createDataFrame([(1000.0, 1001.0), (2.0, -1.0)], "z0 DOUBLE, z1 DOUBLE")
    got = rows(df.select(*scores.domain_from_logits(F.col("z0"), F.col("z1"))))
    assert got[0][0] == "physical_3d" and abs(got[0][1] - 0.731058) < 1e-6
    assert got[1][0] == "digital_2d"
    s = spark.createDataFrame([(0.5,), (0.25,), (0.75,), (0.9,), (0.1,)], "s DOUBLE")
    domain, confidence = scores.domain_from_score(F.col("s"))
    got = rows(s.select(domain, F.round(confidence, 6), scores.is_ambiguous(F.col("s"))))
    assert got == [("physical_3d", 0.0, True), ("digital_2d", 0.5, True), ("physical_3d", 0.5, True),
                   ("physical_3d", 0.8, False), ("digital_2d", 0.8, False)]


START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR"


@pytest.mark.parametrize("fen, warnings", [
    (START, []),
    ("rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQ1BNR", ["missing_white_king"]),
    ("rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBKKBNR", ["duplicate_white_king"]),
    ("rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNP", ["pawn_on_edge_rank", "too_many_white_pawns"]),
    ("8/8/8/8", ["malformed_placement", "missing_black_king", "missing_white_king"]),
    ("k7/44/8/8/8/8/8/K7", ["malformed_placement"]),
])
def test_legality(spark, fen, warnings):
    df = spark.createDataFrame([(fen,)], "f STRING")
    got = df.select(scores.legality_warnings(F.col("f"))).first()[0]
    assert sorted(got) == sorted(warnings)


def test_static_score(spark):
    data = [(START,), ("rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNB1KBNR",), ("8/8/8/8/8/8/4P3/8",), ("8/8/8/8/8/8/8/8",)]
    df = spark.createDataFrame(data, "f STRING")
    got = [s for (s,) in rows(df.select(scores.static_score(F.col("f"))))]
    # A white pawn on its start rank reads the second listed row.
    assert got == [0, -900 - piece_square_tables()["queen"][3], 150, 0]
    full = spark.createDataFrame([(START + " w KQkq - 0 1",)], "f STRING")
    assert full.select(scores.static_score(scores.placement_of(F.col("f")))).first()[0] == 0
