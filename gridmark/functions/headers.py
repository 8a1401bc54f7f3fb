"""Sizes of encoded pictures from their headers, without decoding.

Expressions over a binary column. Of PNG, JPEG, BMP and WEBP pictures they read width, height, channels and whether the
end is there. All values are NULL for anything else, and for a header that is cut off.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENTS = 1024  # of a JPEG before its size; a file has no more in practice, and one that has is not understood
# JPEG markers of frames (with the size), and of segments without a length.
FRAMES = tuple(m for m in range(0xC0, 0xD0) if m not in (0xC4, 0xC8, 0xCC))
BARE = (0x01, *range(0xD0, 0xD9))


def _number(data: Column, at: Column | int, size: int, little: bool = False) -> Column:
    """Unsigned integer of some bytes, counted from 0; NULL beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    text = F.hex(F.substr(data, at + 1, F.lit(size)))
    if little:
        text = F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.when(F.length(text) == 2 * size, F.conv(text, 16, 10).cast("bigint"))


def _starts(data: Column, at: int, text: str) -> Column:
    return F.hex(F.substring(data, at + 1, len(text) // 2)) == text


def _ends(data: Column, text: str) -> Column:
    n = len(text) // 2
    return F.hex(F.substr(data, F.greatest(F.octet_length(data) - n + 1, F.lit(1)), F.lit(n))) == text


def _shape(kind: str, width: Column, height: Column, channels: Column, complete: Column) -> Column:
    whole = width.isNotNull() & height.isNotNull() & channels.isNotNull()
    return F.when(whole, F.struct(
        F.lit(kind).alias("format"), width.cast("bigint").alias("width"), height.cast("bigint").alias("height"),
        channels.cast("int").alias("channels"), F.coalesce(complete, F.lit(False)).alias("complete"),
    ))


def _png(data: Column) -> Column:
    # Channels by colour type.
    channels = F.try_element_at(F.create_map(*[F.lit(x) for kv in {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}.items() for x in kv]), _number(data, 25, 1).cast("int"))
    header = _starts(data, 12, "49484452")
    return F.when(header, _shape("png", _number(data, 16, 4), _number(data, 20, 4), channels, _ends(data, "0000000049454E44AE426082")))


def _bmp(data: Column) -> Column:
    height = _number(data, 22, 4, little=True)
    height = F.when(height >= 1 << 31, (1 << 32) - height).otherwise(height)  # negative: rows from the top
    bits = _number(data, 28, 2, little=True)
    channels = F.when(bits == 32, 4).when(bits.isNotNull(), 3)
    return _shape("bmp", _number(data, 18, 4, little=True), height, channels, F.octet_length(data) >= _number(data, 2, 4, little=True))


def _webp(data: Column) -> Column:
    complete = F.octet_length(data) >= _number(data, 4, 4, little=True) + 8
    low = lambda at: _number(data, at, 2, little=True).bitwiseAND(0x3FFF)
    lossy = _shape("webp", low(26), low(28), F.lit(3), complete)
    bits = _number(data, 21, 4, little=True)
    lossless = _shape("webp", bits.bitwiseAND(0x3FFF) + 1, F.shiftright(bits, 14).bitwiseAND(0x3FFF) + 1,
                      F.when(F.shiftright(bits, 28).bitwiseAND(1) == 1, 4).otherwise(3), complete)
    alpha = F.when(_number(data, 20, 1).bitwiseAND(0x10) > 0, 4).otherwise(3)
    extended = _shape("webp", _number(data, 24, 3, little=True) + 1, _number(data, 27, 3, little=True) + 1, alpha, complete)
    return (
        F.when(_starts(data, 12, "56503820") & _starts(data, 23, "9D012A"), lossy)
        .when(_starts(data, 12, "5650384C") & _starts(data, 20, "2F"), lossless)
        .when(_starts(data, 12, "56503858"), extended)
    )


def _jpeg(data: Column) -> Column:
    """Segments are followed from marker to marker up to that of the frame; `at` is NULL where they end in nothing."""
    nothing = F.lit(None).cast("bigint")

    def follow(acc: Column, _: Column) -> Column:
        at = acc["at"]
        marker = F.when(_number(data, at, 1) == 0xFF, _number(data, at + 1, 1))
        step = (
            F.when(marker == 0xFF, at + 1).when(marker.isin(*BARE), at + 2)
            .when(marker.isNotNull() & ~marker.isin(0x00, 0xD9, 0xDA), at + 2 + _number(data, at + 2, 2))
        )
        here = marker.isin(*FRAMES)
        moved = F.struct(F.when(here, nothing).otherwise(step).alias("at"), F.when(here, at).alias("frame"))
        return F.when(at.isNull(), acc).otherwise(moved)

    begin = F.struct(F.lit(2).cast("bigint").alias("at"), nothing.alias("frame"))
    frame = F.aggregate(F.sequence(F.lit(1), F.lit(SEGMENTS)), begin, follow)["frame"]
    return _shape("jpeg", _number(data, frame + 7, 2), _number(data, frame + 5, 2), _number(data, frame + 9, 1), _ends(data, "FFD9"))


def picture_header(data: Column) -> Column:
    """Struct of format, width, height, channels and complete (the end is there); NULL if there is no header."""
    return (
        F.when(_starts(data, 0, "89504E470D0A1A0A"), _png(data)).when(_starts(data, 0, "FFD8FF"), _jpeg(data))
        .when(_starts(data, 0, "424D"), _bmp(data)).when(_starts(data, 0, "52494646") & _starts(data, 8, "57454250"), _webp(data))
    )


def has_size(header: Column) -> Column:
    """Whether a header names a picture of at least one pixel."""
    return F.coalesce((header["width"] > 0) & (header["height"] > 0), F.lit(False))
