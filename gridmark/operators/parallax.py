"""How far box centroids and contact points disagree about the occupied square."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmark.functions import geometry
from gridmark.functions.boxes import Box, from_yolo
from gridmark.functions.classes import is_tall
from gridmark.functions.once import compute_once
from gridmark.operators.audit import percent

# Camera elevations of the sweep, in degrees.
LISTED_PIECES = 12  # fixed value: pieces of an image that a report lists
SWEEP_DEGREES = (30.0, 45.0, 60.0, 75.0)


def assign_squares(
    df: DataFrame, box: Box | None = None, rectify: geometry.Homography | None = None,
    img_w: Column | int = 640, img_h: Column | int = 640,
) -> DataFrame:
    """Squares of the centroid and of the contact point, and how they differ."""
    box = box or from_yolo()
    cells = {}
    for anchor, (x, y) in (("centroid", box.centroid), ("contact", box.contact_anchor)):
        if rectify is not None:
            x, y = rectify.apply(x, y)
        cells[f"_{anchor}_file"], cells[f"_{anchor}_rank"] = geometry.grid_cell(x, y)
    dx = box.contact_anchor[0] - box.centroid[0]
    dy = box.contact_anchor[1] - box.centroid[1]
    placed = compute_once(
        df, {**cells, "pixel_displacement": F.hypot(dx * F.lit(img_w), dy * F.lit(img_h))}
    )
    file = {a: F.col(f"_{a}_file") for a in ("centroid", "contact")}
    rank = {a: F.col(f"_{a}_rank") for a in ("centroid", "contact")}
    return placed.select(
        *df.columns,
        is_tall(F.col("class_id")).alias("is_tall"),
        *[geometry.square_name(file[a], rank[a]).alias(f"{a}_square") for a in file],
        file["contact"].alias("file_idx"),
        rank["contact"].alias("rank_idx_top"),
        F.abs(rank["centroid"] - rank["contact"]).alias("rank_error"),
        ((file["centroid"] != file["contact"]) | (rank["centroid"] != rank["contact"])).alias(
            "is_misassigned"
        ),
        "pixel_displacement",
    )


def per_image(assigned: DataFrame, *by: str) -> DataFrame:
    """Accuracy and rank error per image.

    The contact point defines the true square, so its accuracy is always 100.
    """
    keys = by or ("image_id",)
    total = F.count("*")
    tall = F.count_if("is_tall")
    right = F.count_if(~F.col("is_misassigned"))
    tall_right = F.count_if(F.col("is_tall") & ~F.col("is_misassigned"))
    return assigned.groupBy(*keys).agg(
        total.alias("total_pieces"),
        tall.alias("tall_pieces_count"),
        right.alias("centroid_correct_count"),
        F.count_if("is_misassigned").alias("centroid_misassigned_count"),
        total.alias("contact_correct_count"),
        percent(right, total).alias("centroid_accuracy_pct"),
        F.lit(100.0).alias("contact_accuracy_pct"),
        percent(tall_right, tall).alias("tall_piece_centroid_accuracy_pct"),
        F.avg("rank_error").alias("average_rank_error"),
        F.max("rank_error").alias("max_rank_error"),
    )


def macro_average(images: DataFrame, *by: str) -> DataFrame:
    """Mean of the per-image figures (every image weighs the same)."""
    return images.groupBy(*by).agg(
        F.count("*").alias("images"),
        F.sum("total_pieces").alias("total_pieces"),
        F.sum("tall_pieces_count").alias("tall_pieces"),
        F.avg("centroid_accuracy_pct").alias("centroid_accuracy_pct"),
        F.avg("contact_accuracy_pct").alias("contact_accuracy_pct"),
        F.avg("tall_piece_centroid_accuracy_pct").alias("tall_centroid_accuracy_pct"),
        F.avg("average_rank_error").alias("average_rank_error"),
    )


def _per_view(views: list[geometry.Homography], index: Column) -> geometry.Homography:
    """One matrix whose cells are picked from literal arrays by view number."""
    return geometry.Homography(tuple(
        cells[0] if len(set(cells)) == 1 else F.get(F.array(*[F.lit(c) for c in cells]), index)
        for cells in zip(*(view.cells for view in views))
    ))


def tilted_boxes(
    annotations: DataFrame, degrees: tuple[float, ...] = SWEEP_DEGREES,
    frame: tuple[int, int] = (640, 640),
) -> DataFrame:
    """Boxes as seen from several camera elevations, one row per box and angle.

    The matrices are plain numbers known before the job starts, so a row only
    carries the number of its view: nothing is joined or shuffled. Boxes whose
    centre leaves the frame are dropped. The warp works on normalised coordinates.
    """
    views = [geometry.unit_square_to_quad(*geometry.elevation_quad(d, *frame)) for d in degrees]
    angles = F.array(*[F.lit(float(d)) for d in degrees])
    swept = annotations.select("*", F.posexplode(angles).alias("view", "elevation_deg"))
    moved, inside = geometry.tilt_box(from_yolo(), _per_view(views, F.col("view")))
    return _replace_boxes(swept, moved, inside)


def angle_sweep(
    annotations: DataFrame, degrees: tuple[float, ...] = SWEEP_DEGREES,
    frame: tuple[int, int] = (640, 640),
) -> DataFrame:
    """Squares assigned from every camera elevation, after rectifying the view again."""
    views = [geometry.unit_square_to_quad(*geometry.elevation_quad(d, *frame)) for d in degrees]
    back = _per_view([view.inverse() for view in views], F.col("view"))
    tilted = tilted_boxes(annotations, degrees, frame)
    return assign_squares(tilted, rectify=back, img_w=frame[0], img_h=frame[1]).drop("view")


def perspective_boxes(annotations: DataFrame, inset: Column, size: float = 640.0) -> DataFrame:
    """Boxes after a mild perspective of the whole picture; boxes off the frame are dropped."""
    x = inset.cast("double") / size
    y = F.floor(inset / 2).cast("double") / size
    quad = (x, y), (1.0 - x, y), (F.lit(1.0), F.lit(1.0)), (F.lit(0.0), F.lit(1.0))
    warped, matrix = geometry.attach_quad(annotations, *quad, prefix="_w")
    moved, inside = geometry.perspective_scale(from_yolo(), matrix)
    return _replace_boxes(warped, moved, inside).drop(*geometry.cell_names("_w"))


def _replace_boxes(df: DataFrame, moved: Box, inside: Column) -> DataFrame:
    """Swap the box columns for moved ones and keep the rows inside the frame."""
    parts = ("xc", "yc", "w", "h")
    placed = compute_once(
        df, {"_in": inside, **{f"_m{p}": getattr(moved, p) for p in parts}}
    )
    rest = [c for c in df.columns if c not in parts]
    return placed.filter("_in").select(*rest, *[F.col(f"_m{p}").alias(p) for p in parts])
