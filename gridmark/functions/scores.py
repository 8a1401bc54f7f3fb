"""Engine evaluations, logits and board placements as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridmark.vocabulary import PIECE_TYPES, PIECE_VALUES, SYMBOLS, piece_square_tables

# Published error codes of the recognition pipeline.
ERROR_CODES = {
    "unknown": "E1000",
    "board_not_found": "E1001",
    "warp_failed": "E1002",
    "detection_timeout": "E1003",
    "illegal_board": "E1004",
    "engine_missing": "E2001",
    "engine_timeout": "E2002",
}


# -- engine evaluations ----------------------------------------------------


def eval_type(mate: Column) -> Column:
    return F.when(mate.isNotNull(), "mate").otherwise("cp")


def eval_value(cp: Column, mate: Column) -> Column:
    return F.coalesce(mate, cp, F.lit(0))


def is_terminal(best_move: Column) -> Column:
    return best_move == ""


def formatted_score(cp: Column, mate: Column) -> Column:
    """``M3`` for mates, signed pawns with two decimals otherwise.

    Centipawns are whole, so the text is put together from integers and is exact.
    """
    size = F.abs(cp)
    pawns = F.concat(
        F.when(cp < 0, "-").otherwise("+"),
        F.floor(size / 100).cast("bigint").cast("string"),
        F.lit("."),
        F.lpad(F.pmod(size, F.lit(100)).cast("string"), 2, "0"),
    )
    return F.when(mate.isNotNull(), F.concat(F.lit("M"), mate.cast("string"))).otherwise(
        F.coalesce(pawns, F.lit("0.00"))
    )


def move_strength(cp: Column, mate: Column) -> Column:
    """One sortable number: quick mates first, then centipawns, then being mated late."""
    return (
        F.when(mate > 0, F.lit(10_000_000) - mate)
        .when(mate <= 0, F.lit(-10_000_000) - mate)
        .otherwise(F.coalesce(cp, F.lit(0)))
    )


# -- classifier logits -------------------------------------------------------


def softmax_pair(z0: Column, z1: Column) -> tuple[Column, Column]:
    """Numerically stable two-way softmax."""
    top = F.greatest(z0, z1)
    e0, e1 = F.exp(z0 - top), F.exp(z1 - top)
    return e0 / (e0 + e1), e1 / (e0 + e1)


def domain_from_logits(z0: Column, z1: Column) -> tuple[Column, Column]:
    """(domain, confidence) of the two-class neural tier."""
    digital, physical = softmax_pair(z0, z1)
    is_physical = physical >= 0.5
    return (
        F.when(is_physical, "physical_3d").otherwise("digital_2d"),
        F.when(is_physical, physical).otherwise(digital),
    )


def domain_from_score(score: Column) -> tuple[Column, Column]:
    """(domain, confidence) of the statistical tier."""
    domain = F.when(score >= 0.5, "physical_3d").otherwise("digital_2d")
    return domain, F.least(F.lit(1.0), F.abs(score - 0.5) * 2.0)


def is_ambiguous(score: Column, low: float = 0.25, high: float = 0.75) -> Column:
    return score.between(low, high)


# -- board placements --------------------------------------------------------


def run_length(cells: Column) -> Column:
    """Replace runs of dots by their length, longest first."""
    for length in range(8, 0, -1):
        cells = F.replace(cells, F.lit("." * length), F.lit(str(length)))
    return cells


def unfold_placement(placement: Column) -> Column:
    """64 characters, rank 8 first, dots for empty squares."""
    return _unfold_digits(F.replace(placement, F.lit("/"), F.lit("")))


def _unfold_digits(text: Column) -> Column:
    for length in range(8, 0, -1):
        text = F.replace(text, F.lit(str(length)), F.lit("." * length))
    return text


def placement_of(fen: Column) -> Column:
    """First field of a position string."""
    return F.substring_index(F.trim(fen), " ", 1)


def is_well_formed(placement: Column) -> Column:
    """Eight ranks of exactly eight files, only known symbols, no two adjacent digits."""
    return (
        placement.rlike("^[1-8PNBRQKpnbrqk/]+$")
        & ~placement.rlike("[1-8][1-8]")
        & _unfold_digits(placement).rlike("^[^/]{8}(/[^/]{8}){7}\\z")
    )


def count_symbol(board: Column, symbol: str) -> Column:
    """Occurrences of one symbol in an unfolded board."""
    return F.length(board) - F.length(F.replace(board, F.lit(symbol), F.lit("")))


def legality_warnings(placement: Column, board: Column | None = None) -> Column:
    """Array of the count-based rules a placement breaks; empty means legal. ``board`` is the placement unfolded, if at hand."""
    board = unfold_placement(placement) if board is None else board
    edge_ranks = F.concat(F.substring(board, 1, 8), F.substring(board, 57, 8))
    rules = [
        (~is_well_formed(placement), "malformed_placement"),
        (count_symbol(board, "K") == 0, "missing_white_king"),
        (count_symbol(board, "k") == 0, "missing_black_king"),
        (count_symbol(board, "K") > 1, "duplicate_white_king"),
        (count_symbol(board, "k") > 1, "duplicate_black_king"),
        (count_symbol(board, "P") > 8, "too_many_white_pawns"),
        (count_symbol(board, "p") > 8, "too_many_black_pawns"),
        (edge_ranks.rlike("[Pp]"), "pawn_on_edge_rank"),
    ]
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for broken, name in rules]))


def error_code(warnings: Column) -> Column:
    """NULL for a legal position, else the published code."""
    return F.when(F.size(warnings) > 0, ERROR_CODES["illegal_board"])


def _signed_values(tables: dict[str, list[int]], values: tuple[int, ...]) -> list[int]:
    """Worth of every (symbol, board index), White positive, index 0 at the top left.

    The tables are listed rank 8 first. White reads them upside down (its rank 1
    meets the first row), Black reads them as listed; the start position scores 0.
    """
    out = []
    for symbol in SYMBOLS:
        piece = SYMBOLS.lower().index(symbol.lower())
        table = tables[PIECE_TYPES[piece]]
        for index in range(64):
            row, file = divmod(index, 8)
            if symbol.isupper():
                out.append(values[piece] + table[(7 - row) * 8 + file])
            else:
                out.append(-(values[piece] + table[index]))
    return out


def static_score(
    placement: Column,
    tables: dict[str, list[int]] | None = None,
    values: tuple[int, ...] = PIECE_VALUES,
) -> Column:
    """Material plus piece-square score in centipawns, White minus Black.

    A literal lookup array keeps the whole score inside one projection: no
    explode, no join and no shuffle per position.
    """
    worth = F.array(*[F.lit(v) for v in _signed_values(tables or piece_square_tables(), values)])
    board = unfold_placement(placement)
    cells = F.transform(
        F.slice(F.split(board, ""), 1, 64),
        lambda symbol, index: F.coalesce(
            F.get(worth, (F.instr(F.lit(SYMBOLS), symbol) - 1) * 64 + index), F.lit(0)
        ),
    )
    return F.aggregate(cells, F.lit(0), lambda total, v: total + v)
