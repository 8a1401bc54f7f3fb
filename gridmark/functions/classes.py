"""Arithmetic on class ids, symbols and square names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridmark.vocabulary import CLASS_NAMES, COLORS, FILES, PIECE_TYPES, SYMBOLS


def _pick(values, index: Column) -> Column:
    """Element of a literal array by zero-based index, NULL outside it."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def color_of(class_id: Column) -> Column:
    return F.when(class_id < 6, COLORS[0]).otherwise(COLORS[1])


def piece_type_of(class_id: Column) -> Column:
    return _pick(PIECE_TYPES, F.pmod(class_id, F.lit(6)))


def name_of(class_id: Column) -> Column:
    return _pick(CLASS_NAMES, class_id)


def symbol_of(class_id: Column) -> Column:
    return _pick(SYMBOLS, class_id)


def class_of_symbol(symbol: Column) -> Column:
    """Class id of a one-letter symbol, NULL when it is none of the twelve."""
    position = F.instr(F.lit(SYMBOLS), symbol)
    return F.when((F.length(symbol) == 1) & (position > 0), position - 1)


def class_of(piece_type: Column, color: Column) -> Column:
    """Class id from type and colour, NULL for unknown values."""
    place = F.array_position(F.array(*[F.lit(t) for t in PIECE_TYPES]), piece_type)
    shift = F.when(color == COLORS[0], 0).when(color == COLORS[1], 6)
    return F.when(place > 0, (place - 1 + shift).cast("int"))


def is_tall(class_id: Column) -> Column:
    """Every piece but the pawn counts as tall."""
    return F.pmod(class_id, F.lit(6)) != 0


def file_letter(file_idx: Column) -> Column:
    return _pick(FILES, file_idx)


def clean_square_name(name: Column) -> Column:
    """Trimmed lower-case square name, NULL when it is not a1..h8."""
    text = F.lower(F.trim(name))
    return F.when(text.rlike("^[a-h][1-8]$"), text)
