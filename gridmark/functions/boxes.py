"""Bounding boxes as bundles of four double columns (centre and size, normalised)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridmark.config import SanitizeConfig
from gridmark.functions.numeric import at_least, clip
from gridmark.functions.tokens import is_finite


@dataclass(frozen=True)
class Box:
    """Four column expressions and the edges derived from them."""

    xc: Column
    yc: Column
    w: Column
    h: Column

    @property
    def x_min(self) -> Column:
        return self.xc - self.w / 2.0

    @property
    def y_min(self) -> Column:
        return self.yc - self.h / 2.0

    @property
    def x_max(self) -> Column:
        return self.xc + self.w / 2.0

    @property
    def y_max(self) -> Column:
        return self.yc + self.h / 2.0

    @property
    def edges(self) -> tuple[Column, Column, Column, Column]:
        return self.x_min, self.y_min, self.x_max, self.y_max

    @property
    def area(self) -> Column:
        return at_least(0.0, self.w) * at_least(0.0, self.h)

    @property
    def centroid(self) -> tuple[Column, Column]:
        return self.xc, self.yc

    @property
    def contact_anchor(self) -> tuple[Column, Column]:
        """Bottom centre: the point where the object touches the board plane."""
        return self.xc, self.y_max

    @property
    def is_finite(self) -> Column:
        return is_finite(self.xc) & is_finite(self.yc) & is_finite(self.w) & is_finite(self.h)

    def columns(self, prefix: str = "") -> list[Column]:
        names = ("xc", "yc", "w", "h")
        return [getattr(self, n).alias(prefix + n) for n in names]

    def to_pixels(self, img_w: Column, img_h: Column) -> tuple[Column, Column, Column, Column]:
        """Pixel corners."""
        return self.x_min * img_w, self.y_min * img_h, self.x_max * img_w, self.y_max * img_h


def from_yolo(xc: str = "xc", yc: str = "yc", w: str = "w", h: str = "h") -> Box:
    return Box(*(F.col(c).cast("double") for c in (xc, yc, w, h)))


def from_corners(x_min: Column, y_min: Column, x_max: Column, y_max: Column) -> Box:
    """Normalised corners; a negative extent becomes zero."""
    w = at_least(0.0, x_max - x_min)
    h = at_least(0.0, y_max - y_min)
    return Box(x_min + w / 2.0, y_min + h / 2.0, w, h)


def _per_pixel(value: Column, extent: Column) -> Column:
    """Normalise by an image extent; an impossible extent gives NULL."""
    return value.cast("double") / F.when(extent > 0, extent.cast("double"))


def from_pixel_corners(
    x_min: Column, y_min: Column, x_max: Column, y_max: Column, img_w: Column, img_h: Column
) -> Box:
    """Pixel corners; all four parts are NULL when an image dimension is not positive."""
    both = (img_w > 0) & (img_h > 0)
    w, h = F.when(both, img_w), F.when(both, img_h)
    return from_corners(
        _per_pixel(x_min, w), _per_pixel(y_min, h), _per_pixel(x_max, w), _per_pixel(y_max, h)
    )


def from_coco(
    x_min: Column, y_min: Column, width: Column, height: Column, img_w: Column, img_h: Column
) -> Box:
    """COCO pixel boxes; sizes keep their sign."""
    both = (img_w > 0) & (img_h > 0)
    iw, ih = F.when(both, img_w), F.when(both, img_h)
    w, h = _per_pixel(width, iw), _per_pixel(height, ih)
    return Box(_per_pixel(x_min, iw) + w / 2.0, _per_pixel(y_min, ih) + h / 2.0, w, h)


def has_image_size(img_w: Column, img_h: Column) -> Column:
    return F.coalesce((img_w > 0) & (img_h > 0), F.lit(False))


@dataclass(frozen=True)
class Clamped:
    """Outcome of the clamp: the cut box, whether enough of it is visible, whether it moved."""

    box: Box
    visible: Column
    moved: Column


def clamp(box: Box, cfg: SanitizeConfig = SanitizeConfig()) -> Clamped:
    """Cut a box to the unit frame; it stays visible when enough of its area is inside.

    Non-finite boxes are never visible: NaN sorts above every number in Spark, so
    they are excluded before any comparison.
    """
    edges = box.edges
    cut = [clip(e, 0.0, 1.0) for e in edges]
    full_area = at_least(1e-12, (edges[2] - edges[0]) * (edges[3] - edges[1]))
    visible_area = (cut[2] - cut[0]) * (cut[3] - cut[1])
    eps = cfg.epsilon
    outside = (
        (edges[2] <= -eps) | (edges[0] >= 1.0 + eps) | (edges[3] <= -eps) | (edges[1] >= 1.0 + eps)
    )
    visible = box.is_finite & ~outside & (visible_area / full_area >= cfg.min_visibility_ratio)
    moved = (edges[0] < 0.0) | (edges[1] < 0.0) | (edges[2] > 1.0) | (edges[3] > 1.0)
    for before, after in zip(edges, cut):
        moved = moved | (F.abs(after - before) > 1e-9)
    return Clamped(from_corners(*cut), visible, visible & moved)


def is_valid(box: Box, cfg: SanitizeConfig = SanitizeConfig()) -> Column:
    """Finite, large enough and inside the unit frame."""
    inside = F.lit(True)
    for edge in box.edges:
        inside = inside & edge.between(0.0, 1.0)
    nan = F.isnan(box.xc) | F.isnan(box.yc) | F.isnan(box.w) | F.isnan(box.h)
    big = (box.w >= cfg.min_dimension) & (box.h >= cfg.min_dimension) & (box.area >= cfg.min_area)
    return ~nan & big & inside


def overlap_ratio(a: Box, b: Box) -> Column:
    """Intersection over union of two boxes, zero when they do not touch."""
    ax0, ay0, ax1, ay1 = a.edges
    bx0, by0, bx1, by1 = b.edges
    shared = at_least(0.0, F.least(ax1, bx1) - F.greatest(ax0, bx0)) * at_least(
        0.0, F.least(ay1, by1) - F.greatest(ay0, by0)
    )
    union = a.area + b.area - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def axis_aligned_center(x_min: Column, y_min: Column, x_max: Column, y_max: Column):
    """(centre x, centre y, bottom-centre x, bottom-centre y) of pixel corners."""
    cx = (x_min + x_max) / 2.0
    return cx, (y_min + y_max) / 2.0, cx, y_max
