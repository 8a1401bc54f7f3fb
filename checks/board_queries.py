"""Geometry, parallax, position and evaluation-table queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from gridmark.functions import geometry, scores
from gridmark.operators import parallax, positions
from gridmark.operators.contracts import (
    box_checks, classification_checks, contract_violations, square_checks,
)
from gridmark.vocabulary import PIECE_VALUES, SYMBOLS, PIECE_TYPES, piece_square_tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


ROW = "image_id, l_linenumber, l_partkey, l_suppkey"
TIES = ["l_partkey", "l_suppkey", "l_linenumber"]


def cell(x: str) -> str:
    return f"CAST(floor(greatest(0.0, least(0.999999, {x})) * 8.0) AS INTEGER)"


def name(file: str, rank_top: str) -> str:
    return f"('abcdefgh')[{file} + 1] || (8 - {rank_top})"


ASSIGNED = f"""v_cell AS (
  SELECT *, {cell('xc')} AS fi, {cell('yc')} AS cr, {cell('yc + h / 2.0')} AS br FROM v_pieces),
v_assigned AS (
  SELECT *, class_id % 6 <> 0 AS is_tall, {name('fi', 'cr')} AS centroid_square, {name('fi', 'br')} AS contact_square,
    abs(cr - br) AS rank_error, cr <> br AS is_misassigned, (yc + h / 2.0 - yc) * 640 AS pixel_displacement FROM v_cell)"""


def assigned(spark, sf_dir):
    return parallax.assign_squares(v.pieces(spark, sf_dir))


@query(f"""WITH {v.PIECES}, {ASSIGNED} SELECT {ROW}, is_tall, centroid_square, contact_square, rank_error,
  is_misassigned, round(pixel_displacement, 6) AS pixel_displacement FROM v_assigned""")
def grid_assign(spark, sf_dir):
    return assigned(spark, sf_dir).select(
        "image_id", *v.ROW_KEY, "is_tall", "centroid_square", "contact_square", "rank_error",
        "is_misassigned", v.r6(F.col("pixel_displacement"), "pixel_displacement"),
    )


PER_IMAGE = """v_image AS (
  SELECT image_id, count(*) AS total_pieces, count(*) FILTER (is_tall) AS tall_pieces_count,
    count(*) FILTER (NOT is_misassigned) AS centroid_correct_count,
    count(*) FILTER (is_misassigned) AS centroid_misassigned_count, count(*) AS contact_correct_count,
    100.0 * count(*) FILTER (NOT is_misassigned) / CAST(count(*) AS DOUBLE) AS centroid_accuracy_pct,
    CAST(100 AS DOUBLE) AS contact_accuracy_pct,
    CASE WHEN count(*) FILTER (is_tall) = 0 THEN 0.0 ELSE 100.0 * count(*) FILTER (is_tall AND NOT is_misassigned)
      / CAST(count(*) FILTER (is_tall) AS DOUBLE) END AS tall_piece_centroid_accuracy_pct,
    avg(rank_error) AS average_rank_error, max(rank_error) AS max_rank_error
  FROM v_assigned GROUP BY image_id)"""


def rounded(df, *columns):
    return df.withColumns({c: v.r6(F.col(c)) for c in columns})


@query(f"""WITH {v.PIECES}, {ASSIGNED}, {PER_IMAGE} SELECT * REPLACE (
  round(centroid_accuracy_pct, 6) AS centroid_accuracy_pct, round(average_rank_error, 6) AS average_rank_error,
  round(tall_piece_centroid_accuracy_pct, 6) AS tall_piece_centroid_accuracy_pct) FROM v_image""")
def parallax_per_image(spark, sf_dir):
    return rounded(
        parallax.per_image(assigned(spark, sf_dir)), "centroid_accuracy_pct", "average_rank_error",
        "tall_piece_centroid_accuracy_pct",
    )


@query(f"""WITH {v.PIECES}, {ASSIGNED}, {PER_IMAGE} SELECT count(*) AS images,
  CAST(sum(total_pieces) AS BIGINT) AS total_pieces, CAST(sum(tall_pieces_count) AS BIGINT) AS tall_pieces,
  round(avg(centroid_accuracy_pct), 6) AS centroid_accuracy_pct, round(avg(contact_accuracy_pct), 6) AS contact_accuracy_pct,
  round(avg(tall_piece_centroid_accuracy_pct), 6) AS tall_centroid_accuracy_pct,
  round(avg(average_rank_error), 6) AS average_rank_error FROM v_image""")
def parallax_macro(spark, sf_dir):
    return rounded(
        parallax.macro_average(parallax.per_image(assigned(spark, sf_dir))),
        "centroid_accuracy_pct", "contact_accuracy_pct", "tall_centroid_accuracy_pct",
        "average_rank_error",
    )


# A trapezoid with corners (i, d), (1-i, d), (1, 1), (0, 1): closed form of its warp.
SWEEP = f"""v_deg AS (SELECT *, floor(640 * 0.15 * ((90 - deg) / 60)) / CAST(640 AS DOUBLE) AS i,
    floor(640 * 0.25 * ((90 - deg) / 60)) / CAST(640 AS DOUBLE) AS d
  FROM (SELECT unnest([30, 45, 60, 75])::DOUBLE AS deg) q),
v_warp AS (SELECT *, 2 * i AS g FROM v_deg),
v_base AS (
  SELECT *, xc AS bx, yc + h / 2.0 AS by0, -2 * i AS gh FROM v_pieces, v_warp),
v_moved AS (
  SELECT *, (bx * (1 - 2 * i) + i + by0 * -i) / (1 + gh * by0) AS nx, (by0 * (1 + gh - d) + d) / (1 + gh * by0) AS ny
  FROM v_base),
v_kept AS (
  SELECT *, ny - h * (1 - 0.3 * (1 - ny)) / 2.0 AS nyc, h * (1 - 0.3 * (1 - ny)) AS nh FROM v_moved
  WHERE nx BETWEEN 0 AND 1 AND ny - h * (1 - 0.3 * (1 - ny)) / 2.0 BETWEEN 0 AND 1)
SELECT deg AS elevation_deg, count(*) AS total_pieces, round(avg(nx), 5) AS mean_x, round(avg(nyc), 5) AS mean_y,
  round(avg(nh), 5) AS mean_h FROM v_kept GROUP BY deg"""


@query(f"WITH {v.PIECES}, {SWEEP}")
def angle_sweep_boxes(spark, sf_dir):
    tilted = parallax.tilted_boxes(v.pieces(spark, sf_dir))
    return tilted.groupBy("elevation_deg").agg(
        F.count("*").alias("total_pieces"),
        F.round(F.avg("xc"), 5).alias("mean_x"),
        F.round(F.avg("yc"), 5).alias("mean_y"),
        F.round(F.avg("h"), 5).alias("mean_h"),
    )


SWEEP_BACK = SWEEP[: SWEEP.index("SELECT deg AS")].replace("FROM v_pieces, v_warp", "FROM v_off, v_warp") + f"""
, v_back AS (SELECT *, (nyc - d) / ((1 + gh - d) - gh * nyc) AS cy, (ny - d) / ((1 + gh - d) - gh * ny) AS ay FROM v_kept),
v_flat AS (SELECT *, (nx * (1 + gh * cy) - i + cy * i) / (1 - 2 * i) AS cx,
    (nx * (1 + gh * ay) - i + ay * i) / (1 - 2 * i) AS ax FROM v_back),
v_sq AS (SELECT deg, image_id, class_id % 6 <> 0 AS is_tall, abs({cell('cy')} - {cell('ay')}) AS rank_error,
    {cell('cy')} <> {cell('ay')} OR {cell('cx')} <> {cell('ax')} AS is_misassigned FROM v_flat),
v_img AS (SELECT deg, image_id, count(*) AS n, count(*) FILTER (is_tall) AS tall,
    100.0 * count(*) FILTER (NOT is_misassigned) / CAST(count(*) AS DOUBLE) AS acc,
    CASE WHEN count(*) FILTER (is_tall) = 0 THEN 0.0 ELSE 100.0 * count(*) FILTER (is_tall AND NOT is_misassigned)
      / CAST(count(*) FILTER (is_tall) AS DOUBLE) END AS tall_acc, avg(rank_error) AS err FROM v_sq GROUP BY 1, 2)
SELECT deg AS elevation_deg, count(*) AS images, CAST(sum(n) AS BIGINT) AS total_pieces, CAST(sum(tall) AS BIGINT) AS tall_pieces,
  round(avg(acc), 4) AS centroid_accuracy_pct, CAST(100 AS DOUBLE) AS contact_accuracy_pct,
  round(avg(tall_acc), 4) AS tall_centroid_accuracy_pct, round(avg(err), 4) AS average_rank_error FROM v_img GROUP BY deg"""


OFF = f"{v.PIECES}, v_off AS (SELECT * REPLACE (xc + 0.0003 AS xc, yc + 0.0003 AS yc) FROM v_pieces)"


def off_grid(spark, sf_dir):
    """Pieces moved off round fractions, where rounding and cell borders would be ties."""
    return v.pieces(spark, sf_dir).withColumns({c: F.col(c) + 0.0003 for c in ("xc", "yc")})


@query(f"""WITH {OFF}, x AS (SELECT *, (30 + l_suppkey % 40) / CAST(640 AS DOUBLE) AS i,
  floor((30 + l_suppkey % 40) / 2) / CAST(640 AS DOUBLE) AS d FROM v_off),
y AS (SELECT *, (xc * (1 - 2 * i) + i - yc * i) / (1 - 2 * i * yc) AS nx,
  (yc * (1 - 2 * i - d) + d) / (1 - 2 * i * yc) AS ny FROM x)
SELECT {ROW}, round(nx, 6) AS xc, round(ny, 6) AS yc, round(w * (0.8 + 0.4 * yc), 6) AS w,
  round(h * (0.8 + 0.4 * yc), 6) AS h FROM y WHERE nx BETWEEN 0 AND 1 AND ny BETWEEN 0 AND 1""")
def perspective_boxes(spark, sf_dir):
    moved = parallax.perspective_boxes(off_grid(spark, sf_dir), F.lit(30) + F.col("l_suppkey") % 40)
    return rounded(moved.select("image_id", *v.ROW_KEY, "xc", "yc", "w", "h"), "xc", "yc", "w", "h")


@query(f"WITH {OFF}, {SWEEP_BACK}")
def angle_sweep(spark, sf_dir):
    swept = parallax.angle_sweep(off_grid(spark, sf_dir))
    macro = parallax.macro_average(
        parallax.per_image(swept, "elevation_deg", "image_id"), "elevation_deg"
    )
    names = ("centroid_accuracy_pct", "tall_centroid_accuracy_pct", "average_rank_error")
    return macro.withColumns({c: F.round(c, 4) for c in names})


# Corners of a parallelogram: its rectification is affine, so SQL can state it directly.
@query(f"""WITH {v.PIECES}, q AS (SELECT *, (l_suppkey % 7) / CAST(100 AS DOUBLE) AS s FROM v_pieces)
SELECT {ROW}, round((xc - s * yc) * 800, 4) AS x, round(yc * 800, 4) AS y FROM q""")
def homography_point(spark, sf_dir):
    shear = (F.col("l_suppkey") % 7) / F.lit(100.0)
    one, zero = F.lit(1.0), F.lit(0.0)
    corners = (zero, zero), (one, zero), (shear + 1.0, one), (shear, one)
    pieces, warp = geometry.attach_quad(v.pieces(spark, sf_dir), *corners)
    x, y = warp.rectifying(800.0).apply(F.col("xc"), F.col("yc"))
    return pieces.select(
        "image_id", *v.ROW_KEY, (F.round(x, 4) + 0.0).alias("x"), (F.round(y, 4) + 0.0).alias("y")
    )


def seen(u, w):
    """A true perspective of the unit square: both lower terms of the quotient differ from zero."""
    depth = u * 0.2 + w * 0.1 + 1.0
    return (u * 0.8 + w * 0.1 + 0.05) / depth, (u * 0.05 + w * 0.7 + 0.1) / depth


# Rectifying what the camera saw gives the board again, so SQL need not know the matrix.
@query(f"""WITH {v.PIECES} SELECT {ROW}, round(xc * 800, 4) AS x, round(yc * 800, 4) AS y FROM v_pieces""")
def perspective_point(spark, sf_dir):
    corners = [tuple(F.lit(c) for c in seen(u, w)) for u, w in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))]
    pieces, warp = geometry.attach_quad(v.pieces(spark, sf_dir), *corners)
    x, y = warp.rectifying(800.0).apply(*seen(F.col("xc"), F.col("yc")))
    return pieces.select(
        "image_id", *v.ROW_KEY, (F.round(x, 4) + 0.0).alias("x"), (F.round(y, 4) + 0.0).alias("y")
    )


@query(f"""WITH {v.PIECES} SELECT {ROW}, CAST(floor(xc * 799.0 / 100.0) AS INTEGER) AS file_idx,
  CAST(7 - floor(yc * 799.0 / 100.0) AS INTEGER) AS rank_idx FROM v_pieces""")
def rectified_square(spark, sf_dir):
    file_idx, rank_idx = geometry.rectified_cell(F.col("xc") * 799.0, F.col("yc") * 799.0, 800.0)
    return v.pieces(spark, sf_dir).select(
        "image_id", *v.ROW_KEY, file_idx.alias("file_idx"), rank_idx.alias("rank_idx")
    )


# -- boards --------------------------------------------------------------------

ON_BOARD = f"""v_det AS (
  SELECT *, {cell('xc')} AS file_idx,
    7 - {cell("CASE WHEN domain = 'physical_3d' THEN yc + h / 2.0 ELSE yc END")} AS rank_idx FROM v_pieces),
v_nms AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, file_idx, rank_idx
    ORDER BY conf DESC, l_partkey, l_suppkey, l_linenumber) AS rn FROM v_det) q WHERE rn = 1)"""

BOARD = f"""{v.PIECES}, {ON_BOARD},
v_cells AS (SELECT image_id, (7 - rank_idx) * 8 + file_idx AS pos, ('{SYMBOLS}')[class_id + 1] AS ch FROM v_nms),
v_grid AS (SELECT i.image_id, p.pos, coalesce(c.ch, '.') AS ch
  FROM (SELECT DISTINCT image_id FROM v_cells) i CROSS JOIN (SELECT unnest(range(64)) AS pos) p
  LEFT JOIN v_cells c ON c.image_id = i.image_id AND c.pos = p.pos),
v_rank AS (SELECT image_id, pos // 8 AS r, string_agg(ch, '' ORDER BY pos) AS line FROM v_grid GROUP BY 1, 2),
v_fen AS (SELECT image_id, string_agg(replace(replace(replace(replace(replace(replace(replace(replace(line,
  '........', '8'), '.......', '7'), '......', '6'), '.....', '5'), '....', '4'), '...', '3'), '..', '2'), '.', '1'),
  '/' ORDER BY r) AS placement, string_agg(line, '' ORDER BY r) AS board FROM v_rank GROUP BY 1)"""


def on_board(spark, sf_dir):
    return positions.detections_on_board(v.pieces(spark, sf_dir), F.col("domain"))


def resolved(spark, sf_dir):
    return positions.one_per_square(on_board(spark, sf_dir), "image_id", TIES)


def boards(spark, sf_dir):
    return positions.placements(resolved(spark, sf_dir), "image_id")


@query(f"WITH {v.PIECES}, {ON_BOARD} SELECT {ROW}, file_idx, rank_idx FROM v_nms")
def square_nms(spark, sf_dir):
    return resolved(spark, sf_dir).select("image_id", *v.ROW_KEY, "file_idx", "rank_idx")


@query(f"""WITH {v.PIECES}, {ON_BOARD}, k AS (SELECT *, class_id % 6 = 5 AND row_number() OVER (
    PARTITION BY image_id, class_id ORDER BY conf DESC, l_partkey, l_suppkey, l_linenumber) > 1 AS was_demoted FROM v_nms)
SELECT {ROW}, CASE WHEN was_demoted THEN class_id - 1 ELSE class_id END AS class_id, was_demoted FROM k""")
def king_demotion(spark, sf_dir):
    return positions.demote_extra_kings(resolved(spark, sf_dir), "image_id", TIES).select(
        "image_id", *v.ROW_KEY, "class_id", "was_demoted"
    )


@query(f"""WITH {v.PIECES}, {ON_BOARD}, o AS (SELECT image_id, avg(rank_idx) FILTER (class_id < 6) AS wm,
  avg(rank_idx) FILTER (class_id >= 6) AS bm FROM v_nms GROUP BY 1)
SELECT image_id, round(wm, 6) AS white_mean_rank, round(bm, 6) AS black_mean_rank,
  coalesce(wm > bm, false) AS is_flipped FROM o""")
def orientation(spark, sf_dir):
    found = positions.orientation(resolved(spark, sf_dir), "image_id")
    return rounded(found, "white_mean_rank", "black_mean_rank")


@query("""WITH b AS (SELECT c_custkey AS board_id, CAST(c_custkey % 50 AS DOUBLE) AS x0, CAST(c_custkey % 30 AS DOUBLE) AS y0,
  400.0 + c_nationkey * 8 AS side FROM customer), p AS (SELECT unnest(range(64)) AS pos)
SELECT board_id, ('abcdefgh')[pos % 8 + 1] || (8 - pos // 8) AS square, CAST(pos % 8 AS INTEGER) AS file_idx,
  CAST(7 - pos // 8 AS INTEGER) AS rank_idx, round(x0 + side / 8.0 * (pos % 8), 6) AS sq_x_min,
  round(y0 + side / 8.0 * (pos // 8), 6) AS sq_y_min, round(x0 + side / 8.0 * (pos % 8 + 1), 6) AS sq_x_max,
  round(y0 + side / 8.0 * (pos // 8 + 1), 6) AS sq_y_max FROM b, p""")
def grid_slicer(spark, sf_dir):
    return rounded(
        positions.grid_squares(board_boxes(spark, sf_dir)),
        "sq_x_min", "sq_y_min", "sq_x_max", "sq_y_max",
    )


def board_boxes(spark, sf_dir):
    x, y = (F.col("c_custkey") % 50).cast("double"), (F.col("c_custkey") % 30).cast("double")
    side = F.col("c_nationkey") * 8 + 400.0
    return v.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("board_id"), x.alias("x_min"), y.alias("y_min"),
        (x + side).alias("x_max"), (y + side).alias("y_max"),
    )


@query("""SELECT o_orderkey, o_custkey AS board_id, CASE WHEN fx BETWEEN 0 AND 7 AND fy BETWEEN 0 AND 7
  THEN ('abcdefgh')[fx + 1] || (8 - fy) END AS square FROM (
  SELECT o_orderkey, o_custkey, CAST(floor((x - o_custkey % 50) / (side / 8.0)) AS INTEGER) AS fx,
    CAST(floor((y - o_custkey % 30) / (side / 8.0)) AS INTEGER) AS fy FROM (
    SELECT o_orderkey, o_custkey, (o_orderkey % 700) + 0.37 AS x, (o_orderkey * 7 % 500) + 0.41 AS y,
      CAST(400 + c_nationkey * 8 AS DOUBLE) AS side FROM orders JOIN customer ON o_custkey = c_custkey) q) z""")
def square_lookup(spark, sf_dir):
    points = v.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("board_id"),
        (F.col("o_orderkey") % 700 + 0.37).alias("x"), (F.col("o_orderkey") * 7 % 500 + 0.41).alias("y"),
    )
    cells = positions.grid_squares(board_boxes(spark, sf_dir))
    return positions.lookup_square(points, cells, "board_id").select("o_orderkey", "board_id", "square")


@query(f"WITH {BOARD} SELECT image_id, placement FROM v_fen")
def fen_serialize(spark, sf_dir):
    return boards(spark, sf_dir)


@query(f"""WITH {BOARD} SELECT image_id, ('abcdefgh')[pos % 8 + 1] || (8 - pos // 8) AS square, ch AS piece
FROM v_cells""")
def fen_explode(spark, sf_dir):
    exploded = positions.explode_placement(boards(spark, sf_dir))
    return exploded.filter(F.col("piece") != ".").drop("placement")


@query(f"""WITH {BOARD}, c AS (SELECT *, len(board) - len(replace(board, 'K', '')) AS wk,
    len(board) - len(replace(board, 'k', '')) AS bk, len(board) - len(replace(board, 'P', '')) AS wp,
    len(board) - len(replace(board, 'p', '')) AS bp FROM v_fen),
w AS (SELECT image_id, concat_ws(',', CASE WHEN wk = 0 THEN 'missing_white_king' END, CASE WHEN bk = 0 THEN 'missing_black_king' END,
  CASE WHEN wk > 1 THEN 'duplicate_white_king' END, CASE WHEN bk > 1 THEN 'duplicate_black_king' END,
  CASE WHEN wp > 8 THEN 'too_many_white_pawns' END, CASE WHEN bp > 8 THEN 'too_many_black_pawns' END,
  CASE WHEN regexp_matches(board[1:8] || board[57:64], '[Pp]') THEN 'pawn_on_edge_rank' END) AS warnings FROM c)
SELECT image_id, warnings, warnings = '' AS is_legal, CASE WHEN warnings <> '' THEN 'E1004' END AS error_code FROM w""")
def fen_legality(spark, sf_dir):
    checked = positions.legality(boards(spark, sf_dir))
    return checked.select(
        "image_id", F.array_join("warnings", ",").alias("warnings"), "is_legal", "error_code"
    )


def _worth_sql() -> str:
    """VALUES list of (symbol, square counted from a1, worth), written out from the public tables."""
    rows = []
    for symbol in SYMBOLS:
        piece = SYMBOLS.lower().index(symbol.lower())
        table = piece_square_tables()[PIECE_TYPES[piece]]
        for square in range(64):
            index = square if symbol.isupper() else square ^ 56
            worth = PIECE_VALUES[piece] + table[index]
            rows.append(f"('{symbol}', {square}, {worth if symbol.isupper() else -worth})")
    return ", ".join(rows)


@query(f"""WITH {BOARD}, t(ch, sq, worth) AS (VALUES {_worth_sql()})
SELECT image_id, CAST(sum(worth) AS BIGINT) AS score FROM v_cells
JOIN t ON t.ch = v_cells.ch AND t.sq = (7 - pos // 8) * 8 + pos % 8 GROUP BY 1""")
def static_score(spark, sf_dir):
    return boards(spark, sf_dir).select(
        "image_id", scores.static_score(F.col("placement")).cast("bigint").alias("score")
    )


# -- stored evaluations ----------------------------------------------------------


@query(f"""WITH {v.EVALUATIONS} SELECT fen_id, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN score_mate IS NOT NULL THEN 'mate' ELSE 'cp' END AS eval_type,
  coalesce(score_mate, score_cp, 0) AS eval_value, l_partkey % 10 = 0 AS is_terminal,
  CASE WHEN score_mate IS NOT NULL THEN 'M' || score_mate ELSE (CASE WHEN score_cp < 0 THEN '-' ELSE '+' END)
    || (abs(score_cp) // 100) || '.' || lpad(CAST(abs(score_cp) % 100 AS VARCHAR), 2, '0') END AS formatted_score
FROM v_evals""")
def evaluation_format(spark, sf_dir):
    cp, mate = F.col("score_cp"), F.col("score_mate")
    move = F.when(F.col("l_partkey") % 10 == 0, "").otherwise("e2e4")
    return v.evaluations(spark, sf_dir).select(
        "fen_id", *v.ROW_KEY, scores.eval_type(mate).alias("eval_type"),
        scores.eval_value(cp, mate).alias("eval_value"), scores.is_terminal(move).alias("is_terminal"),
        scores.formatted_score(cp, mate).alias("formatted_score"),
    )


@query(f"""WITH {v.EVALUATIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY fen_id ORDER BY
  CASE WHEN score_mate > 0 THEN 10000000 - score_mate WHEN score_mate <= 0 THEN -10000000 - score_mate ELSE score_cp END DESC,
  l_partkey, l_suppkey, l_linenumber) AS rank FROM v_evals)
SELECT fen_id, rank, score_cp, score_mate, l_partkey FROM r WHERE rank <= 3""")
def top_moves(spark, sf_dir):
    best = positions.top_moves(v.evaluations(spark, sf_dir), "fen_id", 3, TIES)
    return best.select("fen_id", "rank", "score_cp", "score_mate", "l_partkey")


# -- contracts ---------------------------------------------------------------------


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity - 2 AS x0, l_tax * 100 AS y0,
    l_discount * 600 AS x1, l_quantity AS y1, l_extendedprice / 90000.0 AS conf FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',',
  CASE WHEN NOT least(x0, y0, x1, y1) >= 0 THEN 'negative_coordinate' END, CASE WHEN x1 < x0 THEN 'inverted_x' END,
  CASE WHEN y1 < y0 THEN 'inverted_y' END, CASE WHEN conf NOT BETWEEN 0 AND 1 THEN 'confidence_range' END) AS broken FROM b""")
def contract_checks(spark, sf_dir):
    rules = box_checks(
        F.col("l_quantity") - 2, F.col("l_tax") * 100, F.col("l_discount") * 600,
        F.col("l_quantity"), F.col("l_extendedprice") / 90000.0,
    )
    checked = contract_violations(v.table(spark, sf_dir, "lineitem"), rules)
    return checked.select("l_orderkey", *v.ROW_KEY, F.array_join("broken", ",").alias("broken"))


@query("""SELECT event_id, concat_ws(',', CASE WHEN event_type NOT IN ('digital_2d', 'physical_3d') THEN 'unknown_domain' END,
  CASE WHEN value / 100.0 NOT BETWEEN 0 AND 1 THEN 'confidence_range' END,
  CASE WHEN user_id % 3 = 2 THEN 'unknown_method' END, CASE WHEN value - 5 < 0 THEN 'negative_latency' END) AS broken FROM (
  SELECT event_id, user_id, value, CASE WHEN event_type = 'click' THEN 'digital_2d' WHEN event_type = 'view' THEN 'physical_3d'
    ELSE event_type END AS event_type FROM events) q""")
def classification_contract(spark, sf_dir):
    domain = F.when(F.col("event_type") == "click", "digital_2d").when(
        F.col("event_type") == "view", "physical_3d").otherwise(F.col("event_type"))
    method = F.when(F.col("user_id") % 3 == 0, "heuristic").when(
        F.col("user_id") % 3 == 1, "neural").otherwise("other")
    rules = classification_checks(domain, F.col("value") / 100.0, method, F.col("value") - 5)
    checked = contract_violations(v.table(spark, sf_dir, "events"), rules)
    return checked.select("event_id", F.array_join("broken", ",").alias("broken"))


@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 11 > 7 THEN 'bad_square_name' END,
  CASE WHEN o_orderkey % 11 > 7 THEN 'bad_file_index' END, CASE WHEN o_custkey % 9 > 7 THEN 'bad_rank_index' END) AS broken
FROM orders""")
def square_contract(spark, sf_dir):
    letters = F.substring(F.lit("ABCDEFGHIJK"), (F.col("o_orderkey") % 11 + 1).cast("int"), F.lit(1))
    square = F.concat(F.lit(" "), letters, (F.col("o_custkey") % 8 + 1).cast("string"))
    rules = square_checks(square, F.col("o_orderkey") % 11, F.col("o_custkey") % 9)
    checked = contract_violations(v.table(spark, sf_dir, "orders"), rules)
    return checked.select("o_orderkey", F.array_join("broken", ",").alias("broken"))
