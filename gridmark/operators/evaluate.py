"""Classifier, latency, training-log and detector evaluation."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmark.functions.boxes import Box
from gridmark.operators import matching
from gridmark.operators.audit import percent
from gridmark.operators.ranking import cumulative_counts, order_statistics
from gridmark.session import materialize

# IoU thresholds of the averaged metric, 0.50 to 0.95.
IOU_STEPS = tuple(round(0.50 + 0.05 * i, 2) for i in range(10))
PARTS = ("xc", "yc", "w", "h")
CROWDED = 512  # truths of a picture that still travel as one array; no result depends on it
DENSE = 1 << 17  # detections of a crowded picture that are matched in one go, about; no result depends on it
WIDE = 64  # cells of a truth that are counted out; no result depends on it


def _cells(target: Column, pred: Column) -> dict[str, Column]:
    return {
        "tp": F.count_if(target & pred),
        "fp": F.count_if(~target & pred),
        "fn": F.count_if(target & ~pred),
        "tn": F.count_if(~target & ~pred),
    }


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / F.when(whole > 0, whole)).otherwise(0.0)


def confusion_matrix(df: DataFrame, target: str = "target", pred: str = "pred") -> DataFrame:
    """Two rows with counts and row percentages."""
    counts = df.groupBy(target).agg(
        F.count_if(~F.col(pred)).alias("pred_negative"), F.count_if(pred).alias("pred_positive")
    )
    whole = F.col("pred_negative") + F.col("pred_positive")
    return counts.select(
        F.col(target).alias("target"),
        "pred_negative",
        "pred_positive",
        percent(F.col("pred_negative"), whole).alias("pct_negative"),
        percent(F.col("pred_positive"), whole).alias("pct_positive"),
    )


def binary_metrics(df: DataFrame, *by: str, target: str = "target", pred: str = "pred") -> DataFrame:
    """Accuracy, precision, recall and F1, each zero on an empty denominator."""
    cells = _cells(F.col(target), F.col(pred))
    counted = df.groupBy(*by).agg(*[c.alias(n) for n, c in cells.items()])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return counted.select(
        *by,
        *cells,
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(2.0 * precision * recall, precision + recall).alias("f1"),
    )


def per_class_accuracy(df: DataFrame, *by: str, target: str = "target", pred: str = "pred") -> DataFrame:
    """Overall accuracy and the accuracy within each true class."""
    right = F.col(target) == F.col(pred)
    positive = F.col(target)
    return df.groupBy(*by).agg(
        _ratio(F.count_if(right), F.count("*")).alias("accuracy"),
        _ratio(F.count_if(right & ~positive), F.count_if(~positive)).alias("negative_accuracy"),
        _ratio(F.count_if(right & positive), F.count_if(positive)).alias("positive_accuracy"),
    )


def weighted_means(batches: DataFrame, *by: str, loss: str = "loss", correct: str = "correct",
                   size: str = "n") -> DataFrame:
    """Mean loss weighted by batch size, and accuracy over all batches."""
    return batches.groupBy(*by).agg(
        F.sum(size).alias("samples"),
        (F.sum(F.col(loss) * F.col(size)) / F.sum(size)).alias("mean_loss"),
        (F.sum(correct) / F.sum(size)).alias("accuracy"),
    )


def epoch_throughput(log: DataFrame, n_train: int, n_val: int) -> DataFrame:
    """Samples per second and remaining time of every epoch of a metrics log."""
    return log.select(
        "*",
        (F.lit(n_train + n_val) / F.greatest(F.lit(0.001), F.col("duration_sec"))).alias(
            "throughput"
        ),
        (F.col("duration_sec") * (F.col("total_epochs") - F.col("epoch"))).alias("remaining_sec"),
    )


def latency_summary(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Mean, index-picked p50 and p95, range and rate, exact for any group size."""
    n = F.col("all_n")
    v, times = F.col(value), F.col("n")
    mean = F.sum(v * times) / F.sum(times)
    return order_statistics(
        df,
        group,
        value,
        {
            "p50": F.floor(n / 2),
            "p95": F.floor(n * F.lit(0.95)),
        },
        [
            F.sum(times).alias("n_queries"),
            mean.alias("mean"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.when(mean > 0, 1000.0 / mean).alias("queries_per_sec"),
        ],
    )


def interpolated_percentiles(df: DataFrame, group: list[str], value: str,
                             shares: dict[str, float]) -> DataFrame:
    """Linearly interpolated percentiles, exact for any group size."""
    place = {name: (F.col("all_n") - 1) * F.lit(q) for name, q in shares.items()}
    positions = {}
    for name, at in place.items():
        positions[f"_lo_{name}"] = F.floor(at)
        positions[f"_hi_{name}"] = F.ceil(at)
    found = order_statistics(df, group, value, positions, [F.max("all_n").alias("all_n")])
    picks = []
    for name, at in place.items():
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        picks.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return found.select(*group, *picks)


def claim_truths(
    detections: DataFrame, truths: DataFrame, image: str, det_id: str, truth_id: str,
    by_class: bool = True, crowded: int = CROWDED, dense: int = DENSE,
) -> DataFrame:
    """The truth every detection points at, and how well stronger detections fit it.

    A detection points at the truth of its image (and class, unless told
    otherwise) with the largest IoU, of equal ones at that of the smallest id. It is right at a threshold when its own
    ``iou`` reaches it and ``beaten_iou``, the best overlap of more confident
    detections on the same truth, does not. All boxes take part; ``det_id`` and ``truth_id`` are unique in an image.

    The truths of an ordinary picture travel as one array, and detections and truths are never paired up as
    rows. Pictures of more than ``crowded`` truths go through grids instead (``crowded_claims``), whose cells spread
    over tasks. Whether there are any is looked up first; both ways give the same rows.
    """
    sizes = truths.groupBy(image).agg(F.count("*").alias("_n"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= crowded:
        pointed = _packed_claims(detections, truths, by_class, image, det_id, truth_id)
    else:
        full = materialize(sizes.filter(F.col("_n") > crowded).select(image))
        few = [side.join(full, image, "left_anti") for side in (detections, truths)]
        many = [side.join(full, image) for side in (detections, truths)]
        pointed = _packed_claims(*few, by_class, image, det_id, truth_id).unionByName(
            crowded_claims(*many, [image, "class_id"] if by_class else [image], image, det_id, truth_id, dense)
        )
    # The detections of one image that share a truth are one window group; one without a truth is alone.
    stronger = (
        Window.partitionBy(image, "_neg", F.when(F.col("_neg").isNull(), F.col(det_id)))
        .orderBy(F.desc("conf"), F.asc(det_id))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return pointed.select(
        image, det_id, "class_id", "conf",
        (-F.col("_neg")).alias("claimed"), F.col("_kind").alias("claimed_class"),
        F.coalesce(F.col("_iou"), F.lit(0.0)).alias("iou"),
        F.coalesce(F.max("_iou").over(stronger), F.lit(0.0)).alias("beaten_iou"),
    )


def _packed_claims(
    detections: DataFrame, truths: DataFrame, by_class: bool, image: str, det_id: str, truth_id: str
) -> DataFrame:
    """Detections with IoU, negative id and class of the best truth, NULL without any overlap.

    Both sides meet by picture, also where classes have to agree, so rows that lie by picture already are not shuffled.
    """
    packed = truths.groupBy(image).agg(F.collect_list(F.struct(
        (-F.col(truth_id)).alias("neg"), F.col("class_id").alias("kind"), *[c.alias(n) for n, c in _edges("t").items()])).alias("_truths"))
    shared = lambda t: F.greatest(F.lit(0.0), F.least("_dx1", t["_tx1"]) - F.greatest("_dx0", t["_tx0"])) * F.greatest(
        F.lit(0.0), F.least("_dy1", t["_ty1"]) - F.greatest("_dy0", t["_ty0"]))
    met = F.transform(
        F.filter("_truths", lambda t: t["kind"] == F.col("class_id")) if by_class else F.col("_truths"),
        lambda t: F.struct(shared(t).alias("shared"), t.alias("t")),
    )
    ratio = lambda m: F.struct(
        (m["shared"] / (F.col("_darea") + m["t"]["_tarea"] - m["shared"])).alias("iou"), m["t"]["neg"].alias("neg"), m["t"]["kind"].alias("kind"))
    touching = F.filter(met, lambda m: (m["shared"] > 0) & (F.col("_darea") + m["t"]["_tarea"] - m["shared"] > 0))
    best = F.array_max(F.filter(F.transform(touching, ratio), lambda c: c["iou"] > 0))
    own = detections.withColumns(_edges("d")).join(packed, image, "left")
    return own.select(image, det_id, "class_id", "conf", best.alias("_best")).select(
        image, det_id, "class_id", "conf", *[F.col(f"_best.{c}").alias(f"_{c}") for c in ("iou", "neg", "kind")])


def crowded_claims(
    detections: DataFrame, truths: DataFrame, keys: list[str], image: str, det_id: str, truth_id: str, dense: int = DENSE
) -> DataFrame:
    """``_packed_claims`` of crowded pictures: boxes travel once, and pairs never leave the arrays in which they meet.

    A detection lies in one cell: that of its first corner on a grid whose cells are no smaller than it, and large enough to hold
    about ``dense`` detections of its picture. A truth is copied to the cells whose detections may reach it. A cell of many more
    detections is dealt over parts that get all of its truths each. Rows are sorted by cell and matched there (``matching``).
    """
    own = [image, det_id, "class_id", "conf"]
    usable = _has_area()
    for key in keys:
        usable = usable & F.col(key).isNotNull()
    usable = F.coalesce(usable, F.lit(False))
    on = [*keys, "_level", "_cx", "_cy"]
    seen = _placed(detections.filter(usable), keys, dense)
    cells = materialize(seen.groupBy(*on).agg(
        F.count("*").alias("_n"), F.max("_reach_x").alias("_reach_x"), F.max("_reach_y").alias("_reach_y"), F.max("_size").alias("_size")))
    copies = _copies(truths.filter(usable), cells, keys)
    parts = cells.filter(F.col("_n") > 2 * dense).select(*on, F.ceil(F.col("_n") / F.lit(float(dense))).alias("_parts"))
    part: Column = F.lit(0)
    if not parts.isEmpty():
        seen, copies = (side.join(parts, on, "left") for side in (seen, copies))
        seen = seen.withColumn("_part", F.pmod(F.hash(det_id), F.coalesce("_parts", F.lit(1))))
        copies = copies.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)).cast("int") - 1)))
        part = F.col("_part").cast("int")
    # Two cells of one picture that share a hash are matched together, which changes no result.
    cell = F.hash("_level", "_cx", "_cy", part).alias("_cell")
    kinds, conf = truths.schema["class_id"].dataType, detections.schema["conf"].dataType
    rows = seen.select(cell, *own, F.lit(None).cast("bigint").alias("_truth"), *PARTS).unionByName(copies.select(
        cell, image, F.lit(None).cast(detections.schema[det_id].dataType).alias(det_id), "class_id", F.lit(None).cast(conf).alias("conf"),
        F.col(truth_id).cast("bigint").alias("_truth"), *PARTS))
    rows = rows.repartition("_cell", *keys).sortWithinPartitions("_cell", *keys, "_truth")
    schema = T.StructType([
        *[T.StructField(f.name, f.dataType) for f in rows.select(*own).schema], T.StructField("_iou", T.DoubleType()), T.StructField("_neg", T.LongType()), T.StructField("_kind", kinds),
    ])
    found = rows.mapInArrow(partial(matching.claims, cell=["_cell", *keys], own=own, truth_id="_truth"), schema)
    number = truths.select(-F.col(truth_id)).schema[0].dataType
    alone = detections.filter(~usable).select(*own, *[F.lit(None).cast(t).alias(c) for c, t in (("_iou", "double"), ("_neg", number), ("_kind", kinds))])
    return found.withColumn("_neg", F.col("_neg").cast(number)).unionByName(alone)


def _has_area() -> Column:
    x0, y0, x1, y1 = Box(*(F.col(c) for c in PARTS)).edges
    return (F.col("w") > 0) & (F.col("h") > 0) & ~F.isnan(x0 + y0 + x1 + y1) & (F.abs(x0 + y0) + F.abs(x1 + y1) < F.lit(float("inf")))


def _edges(side: str) -> dict[str, Column]:
    """Edges and area of boxes, reckoned before they are paired up."""
    box = Box(*(F.col(c) for c in PARTS))
    return dict(zip((f"_{side}{e}" for e in ("x0", "y0", "x1", "y1", "area")), (*box.edges, box.area)))


def _notch(at: Column, size: Column) -> Column:
    """Sixteenths of cells before a place; places beyond all reason fall together, still in their order."""
    far = F.lit(2.0 ** 48)
    return F.floor(F.least(F.greatest(at / size * 16.0, -far), far))


def _placed(boxes: DataFrame, keys: list[str], dense: int) -> DataFrame:
    """Detections with the level, size and place of their cell, and how many notches they reach beyond their first corner."""
    x0, y0, x1, y1 = Box(*(F.col(c) for c in PARTS)).edges
    # What nearly all of a picture's boxes spread over; where cells fall steers balance only.
    spread = lambda at: F.percentile_approx(at, F.lit([0.05, 0.95]), 100)
    sizes = materialize(boxes.groupBy(*keys).agg(F.count("*").alias("_n"), spread(x0).alias("_x"), spread(y0).alias("_y")))
    across = F.greatest(F.col("_x")[1] - F.col("_x")[0], F.col("_y")[1] - F.col("_y")[0]) / 0.9
    unit = across / F.ceil(F.sqrt(F.col("_n") / F.lit(float(dense))))
    units = sizes.select(*keys, F.when((unit > 0) & (unit < float("inf")), unit).otherwise(1.0).alias("_unit"))
    side = F.greatest("w", "h")
    cell = boxes.join(units, keys).withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2(side / F.col("_unit")))).cast("int"))
    cell = cell.withColumn("_size", F.col("_unit") * F.pow(F.lit(2.0), F.col("_level"))).drop("_unit")
    notch = lambda at: _notch(at, F.col("_size"))
    return cell.withColumns({
        "_cx": F.shiftright(notch(x0), 4), "_cy": F.shiftright(notch(y0), 4), "_reach_x": notch(x1) - notch(x0), "_reach_y": notch(y1) - notch(y0)})


def _copies(truths: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Truths once for each cell in use that has a detection which may reach them."""
    x0, y0, x1, y1 = Box(*(F.col(c) for c in PARTS)).edges
    grids = cells.groupBy(*keys, "_level", "_size").agg(
        F.max("_reach_x").alias("_reach_x"), F.max("_reach_y").alias("_reach_y"), F.min("_cx").alias("_lx"), F.max("_cx").alias("_hx"),
        F.min("_cy").alias("_ly"), F.max("_cy").alias("_hy"))
    grids = grids.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in grids.columns if c not in keys])).alias("_grids"))
    notch = lambda at: _notch(at, F.col("_size"))
    met = truths.join(grids, keys).select(*truths.columns, F.inline("_grids")).select(
        *truths.columns, "_level",
        F.greatest("_lx", F.shiftright(notch(x0) - F.col("_reach_x"), 4)).alias("_lx"), F.least("_hx", F.shiftright(notch(x1), 4)).alias("_hx"),
        F.greatest("_ly", F.shiftright(notch(y0) - F.col("_reach_y"), 4)).alias("_ly"), F.least("_hy", F.shiftright(notch(y1), 4)).alias("_hy"),
    ).filter("_lx <= _hx AND _ly <= _hy")
    # Truths of very many cells are copied to those that have any detection.
    few = (F.col("_hx") - F.col("_lx") + 1.0) * (F.col("_hy") - F.col("_ly") + 1.0) <= WIDE
    near = met.filter(few).withColumn("_cx", F.explode(F.sequence("_lx", "_hx"))).withColumn("_cy", F.explode(F.sequence("_ly", "_hy")))
    used = cells.select(*keys, "_level", "_cx", "_cy")
    wide = met.filter(~few).join(used, [*keys, "_level"]).filter("_cx BETWEEN _lx AND _hx AND _cy BETWEEN _ly AND _hy")
    return near.unionByName(wide).drop("_lx", "_hx", "_ly", "_hy")


def is_right(threshold: float | Column) -> Column:
    """True positive test of a claim at an IoU threshold."""
    return (F.col("iou") >= threshold) & (F.col("beaten_iou") < threshold)


def match_detections(claims: DataFrame, thresholds: tuple[float, ...] = IOU_STEPS) -> DataFrame:
    """One row per detection and threshold with its verdict."""
    steps = F.explode(F.array(*[F.lit(t) for t in thresholds]))
    return claims.withColumn("threshold", steps).withColumn("is_tp", is_right(F.col("threshold")))


def average_precision(
    claims: DataFrame, truths: DataFrame, thresholds: tuple[float, ...] = IOU_STEPS
) -> DataFrame:
    """Average precision per class and threshold, zero for a class never detected.

    The precision after each distinct confidence is weighted by the recall it
    adds. Detections of equal confidence form one step, so the result does not
    depend on any row order. All thresholds share one pass: each has its own
    counter, and rows are never repeated per threshold. Confidences lie in
    [0, 1], so fixed-width buckets keep the running totals of a large class
    spread over many tasks.
    """
    hits = {f"tp{i}": F.count_if(is_right(t)) for i, t in enumerate(thresholds)}
    curve = cumulative_counts(
        claims, ["class_id"], "conf", {"n": F.count("*"), **hits},
        F.floor(F.col("conf") * 65536.0).cast("int"), descending=True,
    )
    # The curve has one row per distinct confidence and class; the rest is per class.
    per_class = curve.groupBy("class_id").agg(
        F.max("all_n").alias("detections"),
        *[F.max(f"all_{h}").alias(h) for h in hits],
        *[F.sum(F.col(h) * (F.col(f"cum_{h}") / F.col("cum_n"))).alias(f"area_{h}") for h in hits],
    )
    expected = truths.groupBy("class_id").agg(F.count("*").alias("truths"))
    zero = F.lit(0)
    rows = F.array(*[
        F.struct(
            F.lit(t).alias("threshold"),
            F.coalesce(h, zero).alias("true_positives"),
            (F.coalesce(f"area_{h}", F.lit(0.0)) / F.col("truths")).alias("average_precision"),
        )
        for h, t in zip(hits, thresholds)
    ])
    return expected.join(per_class, "class_id", "left").select(
        "class_id", "truths", F.coalesce("detections", zero).alias("detections"), F.inline(rows)
    )


def mean_average_precision(per_class: DataFrame) -> DataFrame:
    """Mean over classes at 0.50, and over classes and thresholds."""
    at_half = F.when(F.col("threshold") == 0.5, F.col("average_precision"))
    return per_class.agg(
        F.avg(at_half).alias("map_50"), F.avg("average_precision").alias("map_50_95")
    )


def class_confusion(
    claims: DataFrame, truths: DataFrame, image: str, truth_id: str, threshold: float = 0.5
) -> DataFrame:
    """True against predicted class of all boxes, NULL being the background.

    ``claims`` come from ``claim_truths`` without regard to class. A detection
    that is right about the place counts with the class of its truth, any other
    as seen in the background; a truth that no detection is right about is missed.
    """
    hit = is_right(F.lit(threshold))
    seen = claims.select(
        F.when(hit, F.col("claimed_class")).alias("true_class"), F.col("class_id").alias("predicted_class")
    )
    found = claims.filter(hit).select(image, F.col("claimed").alias(truth_id))
    missed = truths.join(found, [image, truth_id], "left_anti").select(
        F.col("class_id").alias("true_class"), F.lit(None).cast("int").alias("predicted_class")
    )
    return seen.unionByName(missed).groupBy("true_class", "predicted_class").agg(F.count("*").alias("n"))
