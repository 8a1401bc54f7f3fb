"""From piece detections to board positions, and reports on stored positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmark.functions import geometry, scores
from gridmark.functions.boxes import from_yolo
from gridmark.functions.classes import color_of, file_letter
from gridmark.functions.once import compute_once
from gridmark.operators.ranking import top_per_group
from gridmark.vocabulary import SYMBOLS


def grid_squares(boards: DataFrame) -> DataFrame:
    """The 64 square boxes of every board box (``x_min, y_min, x_max, y_max``)."""
    cells = boards.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(63))))
    row, file = F.floor(F.col("_cell") / 8).cast("int"), F.pmod("_cell", F.lit(8))
    step_x = (F.col("x_max") - F.col("x_min")) / 8.0
    step_y = (F.col("y_max") - F.col("y_min")) / 8.0
    return cells.select(
        *[c for c in boards.columns if c not in ("x_min", "y_min", "x_max", "y_max")],
        geometry.square_name(file, row).alias("square"),
        file.cast("int").alias("file_idx"),
        (F.lit(7) - row).alias("rank_idx"),
        (F.col("x_min") + step_x * file).alias("sq_x_min"),
        (F.col("y_min") + step_y * row).alias("sq_y_min"),
        (F.col("x_min") + step_x * (file + 1)).alias("sq_x_max"),
        (F.col("y_min") + step_y * (row + 1)).alias("sq_y_max"),
    )


def lookup_square(points: DataFrame, cells: DataFrame, board: str, x: str = "x", y: str = "y") -> DataFrame:
    """Square of a point from irregular cells of the same board.

    Cells are packed into one 64-entry array per board, so the range condition is
    a scan of that array after an equi-join, never a join of points with cells.
    """
    packed = cells.groupBy(board).agg(
        F.collect_list(
            F.struct("square", "sq_x_min", "sq_x_max", "sq_y_min", "sq_y_max")
        ).alias("_cells")
    )
    hit = F.filter(
        "_cells",
        lambda c: (F.col(x) >= c.sq_x_min) & (F.col(x) < c.sq_x_max)
        & (F.col(y) >= c.sq_y_min) & (F.col(y) < c.sq_y_max),
    )
    return points.join(packed, board, "left").select(
        *points.columns, F.get(hit, F.lit(0)).getField("square").alias("square")
    )


def detections_on_board(df: DataFrame, domain: Column, rectify: geometry.Homography | None = None) -> DataFrame:
    """File and rank (0 is rank 1) of each detection by the anchor of its domain."""
    x, y = geometry.anchor_for(domain, from_yolo())
    if rectify is not None:
        x, y = rectify.apply(x, y)
    file_idx, top = geometry.grid_cell(x, y)
    return df.withColumn("file_idx", file_idx).withColumn("rank_idx", F.lit(7) - top)


def one_per_square(df: DataFrame, board: str, ties: list[str], conf: str = "conf") -> DataFrame:
    """Strongest detection of every square.

    The rank limit of one runs before the shuffle: each task sends at most 64
    rows per board, however many detections a board has.
    """
    order = [F.desc(conf), *[F.asc(t) for t in ties]]
    return top_per_group(df, [board, "file_idx", "rank_idx"], order, 1).drop("rank")


def demote_extra_kings(df: DataFrame, board: str, ties: list[str], conf: str = "conf",
                       to_class: str = "queen") -> DataFrame:
    """Keep the strongest king of each side, turn the others into another piece.

    The kept kings are found with a rank limit of one before the shuffle, and
    are matched again by board and square, so at most 64 rows share a key.
    Needs at most one detection per square.
    """
    shift = {"queen": 1, "pawn": 5}[to_class]
    is_king = F.pmod("class_id", F.lit(6)) == 5
    order = [F.desc(conf), *[F.asc(t) for t in ties]]
    key = [board, "file_idx", "rank_idx"]
    kept = (
        top_per_group(df.filter(is_king), [board, "class_id"], order, 1)
        .select(*key)
        .withColumn("_kept", F.lit(True))
    )
    demoted = is_king & F.col("_kept").isNull()
    return (
        df.join(kept, key, "left")
        .withColumn("was_demoted", demoted)
        .withColumn("class_id", F.when(demoted, F.col("class_id") - shift).otherwise(F.col("class_id")))
        .drop("_kept")
    )


def orientation(df: DataFrame, board: str) -> DataFrame:
    """Mean rank of each side and whether the board is upside down.

    A board is inverted when White stands higher than Black on average; boards
    with one side only are taken as upright.
    """
    white = color_of(F.col("class_id")) == "white"
    return df.groupBy(board).agg(
        F.avg(F.when(white, F.col("rank_idx"))).alias("white_mean_rank"),
        F.avg(F.when(~white, F.col("rank_idx"))).alias("black_mean_rank"),
    ).withColumn(
        "is_flipped",
        F.coalesce(F.col("white_mean_rank") > F.col("black_mean_rank"), F.lit(False)),
    )


def flip(df: DataFrame, flipped: Column) -> DataFrame:
    """Rotate the squares of flipped boards by half a turn."""
    turn = lambda c: F.when(flipped, 7 - F.col(c)).otherwise(F.col(c))
    return df.withColumn("file_idx", turn("file_idx")).withColumn("rank_idx", turn("rank_idx"))


def placements(df: DataFrame, board: str) -> DataFrame:
    """Piece placement string of every board, from at most one piece per square.

    A rank is one number of eight hexadecimal digits, a digit a square, so boards are added up without collecting their pieces.
    """
    index = ((F.lit(7) - F.col("rank_idx")) * 8 + F.col("file_idx")).cast("int")
    known = index.between(0, 63)
    digit = F.when(F.col("class_id").between(0, len(SYMBOLS) - 1), F.col("class_id") + 1).otherwise(0).cast("bigint")
    place = F.element_at(F.array(*[F.lit(1 << 4 * (7 - f)) for f in range(8)]), F.pmod(index, F.lit(8)) + 1)
    lines = [F.coalesce(F.sum(F.when(F.floor(index / 8) == r, digit * place)), F.lit(0)).alias(f"_rank{r}") for r in range(8)]
    # One bit a square: two pieces on one square are refused, as their digits would add up to another piece.
    taken = F.bit_count(F.bit_or(F.when(known, F.expr("shiftleft(1L, cast((7 - rank_idx) * 8 + file_idx as int))"))))
    summed = df.groupBy(board).agg(*lines, taken.alias("_squares"), F.count_if(known).alias("_pieces"))
    rank = lambda r: F.translate(F.lpad(F.hex(f"_rank{r}"), 8, "0"), "0123456789ABC", "." + SYMBOLS)
    rows = F.concat_ws("/", *[rank(r) for r in range(8)])
    twice = F.raise_error(F.lit("two pieces on one square")).cast("string")
    whole = F.when(F.col("_squares") < F.col("_pieces"), twice).otherwise(scores.run_length(rows))
    return compute_once(summed, {"placement": whole}).select(board, "placement")


def explode_placement(df: DataFrame, placement: str = "placement") -> DataFrame:
    """One row per square of a placement (64 per position); empty squares hold a dot."""
    cells = F.slice(F.split(scores.unfold_placement(F.col(placement)), ""), 1, 64)
    exploded = df.select("*", F.posexplode(cells).alias("_pos", "piece"))
    row = F.floor(F.col("_pos") / 8).cast("int")
    file = F.pmod("_pos", F.lit(8))
    return exploded.select(
        *df.columns,
        F.concat(file_letter(file), (F.lit(8) - row).cast("string")).alias("square"),
        "piece",
    )


def legality(df: DataFrame, placement: str = "placement") -> DataFrame:
    """Warnings, legality flag and error code of every placement."""
    unfolded = compute_once(df, {"_board": scores.unfold_placement(F.col(placement))})
    found = compute_once(unfolded, {"warnings": scores.legality_warnings(F.col(placement), F.col("_board"))})
    return (
        found.drop("_board")
        .withColumn("is_legal", F.size("warnings") == 0)
        .withColumn("error_code", scores.error_code(F.col("warnings")))
    )


def top_moves(evaluations: DataFrame, position: str, n: int, ties: list[str]) -> DataFrame:
    """Best ``n`` evaluations of every position, mates first."""
    strength = scores.move_strength(F.col("score_cp"), F.col("score_mate"))
    return top_per_group(evaluations, [position], [strength.desc(), *map(F.asc, ties)], n)
