"""Eight-bit colour arithmetic on pixel columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridmark.functions.numeric import clip


def gray(b: Column, g: Column, r: Column) -> Column:
    """Luma of an 8-bit pixel in 15-bit fixed point."""
    return F.shiftright(b * 3735 + g * 19235 + r * 9798 + 16384, 15)


def hsv(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """8-bit hue (0..179), saturation and value in 12-bit fixed point."""
    top, low = F.greatest(b, g, r), F.least(b, g, r)
    span = top - low
    sat_scale = F.when(top > 0, F.rint(F.lit(255.0 * 4096) / top)).otherwise(0.0).cast("int")
    hue_scale = F.when(span > 0, F.rint(F.lit(180.0 * 4096 / 6) / span)).otherwise(0.0).cast("int")
    turn = F.when(top == r, g - b).when(top == g, b - r + span * 2).otherwise(r - g + span * 4)
    hue = F.shiftright(turn * hue_scale + 2048, 12)
    hue = F.when(hue < 0, hue + 180).otherwise(hue)
    return hue, F.shiftright(span * sat_scale + 2048, 12), top


def palette_bin(b: Column, g: Column, r: Column) -> Column:
    """One of 64 colour bins: 8 hues, 4 saturations, 2 values."""
    h, s, v = hsv(b, g, r)

    def level(channel: Column, step: int, top: int) -> Column:
        return F.least(F.lit(top), F.floor(channel / step).cast("int"))

    return level(h, 23, 7) * 8 + level(s, 64, 3) * 2 + level(v, 128, 1)


def ramp(value: Column, start: float, width: float) -> Column:
    """0 below start, 1 above start + width, linear between."""
    return clip((value - start) / width, 0.0, 1.0)
