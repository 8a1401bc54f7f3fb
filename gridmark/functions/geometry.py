"""Board geometry: projective maps, grid cells and letterbox arithmetic as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmark.functions.boxes import Box
from gridmark.functions.classes import file_letter
from gridmark.functions.numeric import clip
from gridmark.functions.once import compute_once

# Fixed value: largest coordinate that still belongs to the last cell.
LAST = 0.999999


Number = Column | float


def _nonzero(value: Number) -> Number:
    """The value, or NULL (NaN for a plain number) when it is zero."""
    if isinstance(value, Column):
        return F.when(value != 0.0, value)
    return value or float("nan")


def _linear(row: tuple[Number, ...], x: Column, y: Column) -> Column:
    """a*x + b*y + c without the terms that are plainly zero."""
    a, b, c = row
    terms = [value * cell for value, cell in ((x, a), (y, b)) if _is_term(cell)]
    if _is_term(c) or not terms:
        terms.append(c if isinstance(c, Column) else F.lit(float(c)))
    return sum(terms[1:], terms[0])


def _is_term(cell: Number) -> bool:
    return isinstance(cell, Column) or cell != 0.0


@dataclass(frozen=True)
class Homography:
    """A 3x3 projective map, row by row; cells are columns or plain numbers."""

    cells: tuple[Number, ...]

    @classmethod
    def from_columns(cls, prefix: str = "h") -> "Homography":
        """Columns ``h11`` to ``h33``."""
        return cls(tuple(F.col(n) for n in cell_names(prefix)))

    def named(self, prefix: str = "h") -> dict[str, Column]:
        cells = [c if isinstance(c, Column) else F.lit(float(c)) for c in self.cells]
        return dict(zip(cell_names(prefix), cells))

    def apply(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Image of a point; NULL when it lies on the vanishing line."""
        top, middle, bottom = (self.cells[r:r + 3] for r in (0, 3, 6))
        w = _nonzero(_linear(bottom, x, y))
        return _linear(top, x, y) / w, _linear(middle, x, y) / w

    def inverse(self) -> "Homography":
        """Adjugate matrix: the inverse up to scale, which is all a projective map needs."""
        a, b, c, d, e, f, g, h, i = self.cells
        return Homography((
            e * i - f * h, c * h - b * i, b * f - c * e,
            f * g - d * i, a * i - c * g, c * d - a * f,
            d * h - e * g, b * g - a * h, a * e - b * d,
        ))

    def rectifying(self, size: float = 1.0) -> "Homography":
        """Inverse map, scaled so that the unit square becomes one of the given side."""
        cells = self.inverse().cells
        return Homography((*[c * size for c in cells[:6]], *cells[6:]))


def cell_names(prefix: str) -> list[str]:
    return [f"{prefix}{r}{c}" for r in (1, 2, 3) for c in (1, 2, 3)]


def unit_square_to_quad(tl, tr, br, bl) -> Homography:
    """Closed-form map of the unit square onto a quadrilateral (corners as (x, y))."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = tl, tr, br, bl
    dx1, dx2, sx = x1 - x2, x3 - x2, x0 - x1 + x2 - x3
    dy1, dy2, sy = y1 - y2, y3 - y2, y0 - y1 + y2 - y3
    det = _nonzero(dx1 * dy2 - dx2 * dy1)
    g = (sx * dy2 - dx2 * sy) / det
    h = (dx1 * sy - sx * dy1) / det
    return Homography((
        x1 - x0 + g * x1, x3 - x0 + h * x3, x0,
        y1 - y0 + g * y1, y3 - y0 + h * y3, y0,
        g, h, 1.0,
    ))


def quad_to_square(tl, tr, br, bl, size: float = 1.0) -> Homography:
    """Rectifying map: the four corners go to a square of the given side."""
    return unit_square_to_quad(tl, tr, br, bl).rectifying(size)


def attach_quad(df: DataFrame, tl, tr, br, bl, prefix: str = "h") -> tuple[DataFrame, Homography]:
    """Store the warp onto each row's quadrilateral in nine columns.

    The two perspective terms are finished before the other cells read them, and
    all cells before the caller reads those, so nothing is evaluated twice.
    """
    raw = unit_square_to_quad(tl, tr, br, bl).cells
    terms = {f"_{prefix}_g": raw[6], f"_{prefix}_h": raw[7]}
    df = compute_once(df, terms)
    g, h = (F.col(name) for name in terms)
    (x0, y0), (x1, y1), _, (x3, y3) = tl, tr, br, bl
    warp = Homography((
        x1 - x0 + g * x1, x3 - x0 + h * x3, x0,
        y1 - y0 + g * y1, y3 - y0 + h * y3, y0,
        g, h, 1.0,
    ))
    return compute_once(df, warp.named(prefix)).drop(*terms), Homography.from_columns(prefix)


def elevation_quad(degrees: float, width: int = 640, height: int = 640):
    """Corners of the board as seen from a camera elevation between 30 and 90 degrees.

    Insets are whole pixels of the given frame and come back normalised to it.
    """
    tilt = (90.0 - degrees) / 60.0
    inset = int(width * 0.15 * tilt) / width
    drop = int(height * 0.25 * tilt) / height
    return (inset, drop), (1.0 - inset, drop), (1.0, 1.0), (0.0, 1.0)


def tilt_box(box: Box, warp: Homography) -> tuple[Box, Column]:
    """Move a box with its contact point and shrink it with distance; also the in-frame test."""
    base_x, base_y = warp.apply(*box.contact_anchor)
    scale = 1.0 - 0.3 * (1.0 - base_y)
    moved = Box(base_x, base_y - box.h * scale / 2.0, box.w * scale, box.h * scale)
    return moved, in_frame(moved.xc, moved.yc)


def perspective_scale(box: Box, warp: Homography) -> tuple[Box, Column]:
    """Warp the centre and scale the size by the original row; also the in-frame test."""
    x, y = warp.apply(box.xc, box.yc)
    scale = 0.8 + 0.4 * box.yc
    return Box(x, y, box.w * scale, box.h * scale), in_frame(x, y)


def in_frame(x: Column, y: Column) -> Column:
    return F.coalesce(x.between(0.0, 1.0) & y.between(0.0, 1.0), F.lit(False))


def grid_cell(x: Column, y: Column) -> tuple[Column, Column]:
    """(file index, rank index counted from the top) of a normalised point, NULL without one."""
    def cell(v: Column) -> Column:
        # least and greatest skip NULLs, so absence is tested first.
        return F.when(v.isNotNull(), F.floor(clip(v, 0.0, LAST) * 8.0).cast("int"))

    return cell(x), cell(y)


def square_name(file_idx: Column, rank_idx_top: Column) -> Column:
    return F.concat(file_letter(file_idx), (F.lit(8) - rank_idx_top).cast("string"))


def rectified_cell(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    """(file index, rank index counted from the bottom) of a point on a rectified board."""
    file_idx = F.floor(x / F.lit(size / 8.0)).cast("int")
    rank_idx = (F.lit(7) - F.floor(y / F.lit(size / 8.0))).cast("int")
    return file_idx, rank_idx


def anchor_for(domain: Column, box: Box) -> tuple[Column, Column]:
    """Contact point for photographs, centroid for screenshots."""
    return box.xc, F.when(domain == "physical_3d", box.y_max).otherwise(box.yc)


def letterbox(width: Column, height: Column, target: int = 128) -> dict[str, Column]:
    """Scale, resized extent and centred offsets of an aspect-preserving fit."""
    scale = F.lit(float(target)) / F.greatest(width, height)
    nw, nh = F.rint(width * scale).cast("int"), F.rint(height * scale).cast("int")
    half = lambda extent: F.floor((F.lit(target) - extent) / 2).cast("int")
    return {"scale": scale, "new_w": nw, "new_h": nh, "left": half(nw), "top": half(nh)}
