"""Tokenising label text and turning tokens into numbers without failing the job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space, as text and as a regex class.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
_CLASS = (
    r" \t\n\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

_DIGITS = r"[0-9](?:_?[0-9])*"
_NUMBER = rf"^[+-]?(?:(?:{_DIGITS})?\.{_DIGITS}|{_DIGITS}\.?)(?:[eE][+-]?{_DIGITS})?$"
_INTEGER = rf"^[+-]?{_DIGITS}$"


def strip(text: Column) -> Column:
    """Drop leading and trailing white space of any kind; only the ends are scanned."""
    return F.btrim(text, F.lit(BLANKS))


def words(line: Column) -> Column:
    """White-space separated tokens of a line.

    All blanks become plain spaces first, so the split needs only a trivial pattern.
    """
    return F.split(F.trim(F.translate(line, BLANKS, " " * len(BLANKS))), " +")


def is_content(line: Column) -> Column:
    """False for blank and comment lines; only the first visible character is looked at."""
    return line.rlike(f"^[{_CLASS}]*[^{_CLASS}#]")


def to_double(token: Column) -> Column:
    """DOUBLE, or NULL for anything that is not a number; nan and inf spellings are numbers."""
    return (
        F.when(token.rlike(_NUMBER), F.replace(token, F.lit("_"), F.lit("")).try_cast("double"))
        .when(token.rlike("(?i)^[+-]?nan$"), F.lit(float("nan")))
        .when(token.rlike("(?i)^[+]?inf(inity)?$"), F.lit(float("inf")))
        .when(token.rlike("(?i)^-inf(inity)?$"), F.lit(float("-inf")))
    )


def to_int(token: Column) -> Column:
    """BIGINT of a signed integer spelling, else NULL; values beyond 64 bits are NULL too."""
    return F.when(
        token.rlike(_INTEGER), F.replace(token, F.lit("_"), F.lit("")).try_cast("bigint")
    )


def looks_like_index(token: Column) -> Column:
    """True for the plain digit strings (with an optional minus) that count as class indices."""
    return token.rlike("^-?[0-9]+$")


def is_finite(value: Column) -> Column:
    """True for a present, non-NaN, non-infinite double."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))
