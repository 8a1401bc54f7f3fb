"""Audit, standardisation, box and class queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from gridmark.functions import boxes, classes, paths, tokens
from gridmark.operators import audit, pairing, standardize
from gridmark.operators.classes import map_classes, with_class_info
from gridmark.vocabulary import Vocabulary

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


RULES = """CASE {malformed}
    WHEN class_id IS NULL OR class_id NOT BETWEEN 0 AND 11 THEN 'invalid_class_id'
    WHEN xc IS NULL OR yc IS NULL OR w IS NULL OR h IS NULL OR isnan(xc) OR isnan(yc) OR isnan(w) OR isnan(h)
      OR isinf(xc) OR isinf(yc) OR isinf(w) OR isinf(h) THEN 'nan_or_inf_value'
    WHEN w <= 0 OR h <= 0 THEN 'non_positive_dimension'
    WHEN xc NOT BETWEEN -0.00001 AND 1.00001 OR yc NOT BETWEEN -0.00001 AND 1.00001 OR w > 1.00001 OR h > 1.00001
      OR xc - w / 2.0 < -0.00001 OR yc - h / 2.0 < -0.00001 OR xc + w / 2.0 > 1.00001 OR yc + h / 2.0 > 1.00001
      THEN 'out_of_bounds_coord'
    WHEN w < 0.005 OR h < 0.005 OR w * h < 0.000025 THEN 'degenerate_box' END"""

LINES = f"""{v.LABEL_TEXT},
v_audit AS (
  SELECT *, {RULES.format(malformed="WHEN n_tokens < 5 THEN 'malformed_line'")} AS violation_type FROM v_parsed),
v_violations AS (
  SELECT *, CASE WHEN violation_type = 'degenerate_box' THEN 'WARNING' ELSE 'ERROR' END AS severity
  FROM v_audit WHERE violation_type IS NOT NULL)"""

BOXES = f"""{v.ANNOTATIONS},
v_audit AS (
  SELECT *, {RULES.format(malformed="WHEN FALSE THEN ''").replace("class_id IS NULL OR class_id", "cls")} AS violation_type
  FROM v_ann),
v_flags AS (
  SELECT *, violation_type IS NOT NULL AND violation_type <> 'degenerate_box' AS bad,
    (violation_type IS NULL OR violation_type = 'degenerate_box') AND (xc - w / 2.0 < 0 OR yc - h / 2.0 < 0
      OR xc + w / 2.0 > 1 OR yc + h / 2.0 > 1 OR xc < 0 OR yc < 0 OR xc > 1 OR yc > 1) AS clamps
  FROM v_audit)"""


def audited_lines(spark, sf_dir):
    content = v.label_text(spark, sf_dir).filter(tokens.is_content(F.col("line")))
    return audit.audit_lines(content)


def audited_boxes(spark, sf_dir):
    return audit.audit_boxes(v.annotations(spark, sf_dir))


# -- audit -------------------------------------------------------------------


@query(f"""WITH {LINES} SELECT violation_type, severity, count(*) AS n FROM v_violations GROUP BY 1, 2""")
def audit_violations(spark, sf_dir):
    return audit.violation_counts(audit.line_violations(audited_lines(spark, sf_dir)))


@query(f"""WITH {BOXES} SELECT count(*) AS total_boxes_scanned, count(*) FILTER (NOT bad) AS valid_boxes_count,
  count(*) FILTER (bad) AS corrupted_boxes_count,
  count(*) FILTER (violation_type = 'degenerate_box') AS degenerate_boxes_count,
  count(*) FILTER (clamps) AS clamped_boxes_count,
  round(100.0 * count(*) FILTER (violation_type = 'degenerate_box') / count(*)::DOUBLE, 6) AS degenerate_box_rejection_rate
FROM v_flags""")
def audit_box_counters(spark, sf_dir):
    rate = "degenerate_box_rejection_rate"
    return audit.box_counters(audited_boxes(spark, sf_dir)).withColumn(rate, v.r6(F.col(rate)))


@query(f"""WITH {BOXES}, c AS (SELECT cls, count(*) AS n FROM v_flags WHERE NOT bad GROUP BY 1),
d AS (SELECT i AS class_id, coalesce(n, 0) AS n FROM range(12) r(i) LEFT JOIN c ON c.cls = r.i)
SELECT CAST(class_id AS INTEGER) AS class_id,
  (['white', 'black'])[class_id // 6 + 1] || '_' || (['pawn','knight','bishop','rook','queen','king'])[class_id % 6 + 1] AS class_name,
  (['white', 'black'])[class_id // 6 + 1] AS color,
  (['pawn','knight','bishop','rook','queen','king'])[class_id % 6 + 1] AS piece_type,
  n AS box_count,
  round(n / CAST(greatest(sum(n) OVER (), 1) AS DOUBLE) * 100, 6) AS share_pct,
  CAST(round_even(n / CAST(greatest(max(n) OVER (), 1) AS DOUBLE) * 24, 0) AS INTEGER) AS bar_length
FROM d""")
def audit_class_histogram(spark, sf_dir):
    histogram = audit.class_histogram(audited_boxes(spark, sf_dir))
    return histogram.withColumn("share_pct", v.r6(F.col("share_pct")))


@query(f"""WITH {BOXES}, g AS (
  SELECT CASE WHEN cls < 6 THEN 'white' ELSE 'black' END AS color,
    (['pawn','knight','bishop','rook','queen','king'])[cls % 6 + 1] AS kind FROM v_flags WHERE NOT bad)
SELECT 'color' AS facet, color AS value, count(*) AS n FROM g GROUP BY 2
UNION ALL SELECT 'piece_type', kind, count(*) FROM g GROUP BY 2""")
def audit_color_type_balance(spark, sf_dir):
    return audit.color_type_balance(audited_boxes(spark, sf_dir))


@query(f"""WITH {LINES} SELECT count(*) FILTER (severity = 'ERROR') AS error_count,
  count(*) FILTER (severity = 'WARNING') AS warning_count,
  count(*) FILTER (severity = 'ERROR') = 0 AS passed FROM v_violations""")
def audit_verdict(spark, sf_dir):
    return audit.verdict(audit.line_violations(audited_lines(spark, sf_dir)))


@query(f"""WITH {LINES} SELECT file_path, line_number, violation_type, severity, line AS raw_content,
  (SELECT count(*) FROM v_violations) - 50 AS n_more
FROM v_violations ORDER BY file_path, line_number, l_partkey, l_suppkey LIMIT 50""")
def audit_preview(spark, sf_dir):
    bad = audited_lines(spark, sf_dir).filter(F.col("violation_type").isNotNull())
    order = ("file_path", "line_number", "l_partkey", "l_suppkey")
    shown = audit.preview(bad, 50, *order)
    return shown.select(
        "file_path", "line_number", "violation_type", "severity",
        F.col("line").alias("raw_content"), "n_more",
    )


# -- pairing -----------------------------------------------------------------


def pairs(spark, sf_dir):
    """Pairs with the sizes of both files attached."""
    files = v.files(spark, sf_dir)
    sizes = files.select(F.col("rel_path").alias("_p"), F.col("length").alias("_n"))
    found = pairing.discover_pairs(files)
    for side in ("image", "label"):
        path = F.coalesce(F.col(f"{side}_path"), F.concat(F.lit("?"), F.col("pair_key")))
        found = (
            found.join(sizes, path == F.col("_p"), "left")
            .withColumn(f"{side}_length", F.col("_n"))
            .drop("_p", "_n")
        )
    return found.withColumn("label_is_empty", F.col("label_length") == 0).withColumn(
        "image_error", F.when(F.col("image_length") == 0, "Image file is 0 bytes")
    )


@query(f"""WITH {v.FILES} SELECT count(image_path) AS total_images_scanned, count(label_path) AS total_labels_scanned,
  count(*) FILTER (image_path IS NOT NULL AND label_path IS NOT NULL) AS matched_pairs_count,
  count(*) FILTER (label_path IS NULL) AS orphaned_images_count,
  count(*) FILTER (image_path IS NULL) AS orphaned_labels_count,
  count(*) FILTER (image_path IS NOT NULL AND label_length = 0) AS negative_samples_count,
  count(*) FILTER (label_path IS NOT NULL AND image_length = 0) AS corrupted_images_count,
  round(100.0 * count(*) FILTER (image_path IS NOT NULL AND label_length = 0)
    / CAST(count(*) FILTER (image_path IS NOT NULL AND label_path IS NOT NULL) AS DOUBLE), 6) AS negative_sample_ratio
FROM v_pairs""")
def audit_pairing(spark, sf_dir):
    counters = pairing.pairing_counters(pairs(spark, sf_dir))
    return counters.withColumn("negative_sample_ratio", v.r6(F.col("negative_sample_ratio")))


@query(f"""WITH {v.FILES} SELECT file_path, violation_type, 'ERROR' AS severity FROM (
  SELECT label_path AS file_path, 'orphan_label' AS violation_type FROM v_pairs WHERE image_path IS NULL
  UNION ALL SELECT image_path, 'orphan_image' FROM v_pairs WHERE label_path IS NULL
  UNION ALL SELECT image_path, 'corrupted_image' FROM v_pairs WHERE label_path IS NOT NULL AND image_length = 0) q""")
def pair_violations(spark, sf_dir):
    return pairing.pair_violations(pairs(spark, sf_dir)).select(
        "file_path", "violation_type", "severity"
    )


@query(f"WITH {v.FILES} SELECT pair_key, label_path FROM v_pairs WHERE image_path IS NULL")
def orphan_labels(spark, sf_dir):
    found = pairing.discover_pairs(v.files(spark, sf_dir))
    return pairing.orphan_labels(found).select("pair_key", "label_path")


@query(f"WITH {v.FILES} SELECT pair_key, image_path FROM v_pairs WHERE label_path IS NULL")
def orphan_images(spark, sf_dir):
    found = pairing.discover_pairs(v.files(spark, sf_dir))
    return pairing.orphan_images(found).select("pair_key", "image_path")


@query(f"WITH {v.FILES} SELECT rel_path, stem AS pair_key FROM v_files")
def logical_stem(spark, sf_dir):
    path = F.col("rel_path")
    return v.files(spark, sf_dir).select(path, paths.logical_stem(path).alias("pair_key"))


@query(f"""WITH {v.FILES}, x AS (
  SELECT *, regexp_replace(regexp_replace(rel_path, '^images/', 'labels/'), '\\.[a-zA-Z]+$', '.txt') AS want,
    starts_with(rel_path, 'images/') AS mirrored FROM v_files WHERE kind = 'image' AND rel_path LIKE '%.jpg')
SELECT x.rel_path AS image_path, l.rel_path AS label_path FROM x
JOIN v_files l ON l.kind = 'label' AND l.length > 0
  AND l.rel_path = CASE WHEN mirrored THEN want ELSE replace(want, '/images/', '/labels/') END""")
def annotated_pairs(spark, sf_dir):
    return pairing.annotated_pairs(v.files(spark, sf_dir))


@query(f"""WITH {v.FILES} SELECT x.rel_path AS image_path, l.rel_path AS label_path
FROM v_files x LEFT JOIN v_files l ON l.kind = 'label' AND NOT starts_with(x.rel_path, 'images/')
  AND l.rel_path = regexp_replace(replace(x.rel_path, '/images/', '/labels/'), '\\.[a-zA-Z]+$', '.txt')
WHERE x.kind = 'image'""")
def image_label_join(spark, sf_dir):
    files = v.files(spark, sf_dir).withColumnRenamed("rel_path", "path")
    images = files.filter(paths.is_image(F.col("path"))).select("path")
    labels = files.filter(paths.is_label(F.col("path"))).select("path")
    joined = pairing.attach_labels(images, labels)
    return joined.select(F.col("path").alias("image_path"), "label_path")


# -- standardise -------------------------------------------------------------

STANDARD = f"{v.RAW_LABELS}, {v.clamp_cte('v_mapped')}, v_std AS (SELECT *, {v.OUTCOME} AS outcome FROM v_cut)"


def standardized(spark, sf_dir):
    return standardize.standardize(v.raw_labels(spark, sf_dir), dataset="dataset")


@query(f"""WITH {STANDARD} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, class_id, outcome, was_clamped,
  round(oxc, 6) AS out_xc, round(oyc, 6) AS out_yc, round(ow, 6) AS out_w, round(oh, 6) AS out_h FROM v_std""")
def standardize_outcomes(spark, sf_dir):
    return standardized(spark, sf_dir).select(
        "l_orderkey", *v.ROW_KEY, "class_id", "outcome", "was_clamped",
        *[v.r6(F.col(c), c) for c in ("out_xc", "out_yc", "out_w", "out_h")],
    )


@query(f"""WITH {STANDARD} SELECT dataset, count(*) AS total_annotations,
  count(*) FILTER (outcome = 'valid') AS valid_annotations,
  count(*) FILTER (outcome = 'valid' AND was_clamped) AS clamped_annotations,
  count(*) FILTER (outcome = 'degenerate') AS discarded_degenerate,
  count(*) FILTER (outcome = 'out_of_bounds') AS discarded_out_of_bounds,
  count(*) FILTER (outcome = 'unknown_class') AS discarded_unknown_class
FROM v_std GROUP BY dataset""")
def standardize_stats(spark, sf_dir):
    return standardize.sanitization_stats(standardized(spark, sf_dir), "dataset")


@query(f"""WITH {STANDARD}, x AS (SELECT class_id, count(*) AS n FROM v_std WHERE outcome = 'valid' GROUP BY 1),
y AS (SELECT CAST(l_partkey % 12 AS INTEGER) AS class_id, count(*) AS n FROM lineitem GROUP BY 1)
SELECT class_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM x UNION ALL SELECT * FROM y) q GROUP BY class_id""")
def map_merge(spark, sf_dir):
    first = standardize.class_counts(standardize.valid_annotations(standardized(spark, sf_dir)))
    second = standardize.class_counts(v.pieces(spark, sf_dir))
    return standardize.merge_counts(first, second)


@query(f"""WITH {v.PIECES}, c AS (SELECT image_id, class_id, count(*) AS n FROM v_pieces GROUP BY 1, 2)
SELECT image_id, string_agg(class_id || ':' || n, ',' ORDER BY class_id) AS class_counts FROM c GROUP BY 1""")
def class_counts_map(spark, sf_dir):
    counts = standardize.class_counts(v.pieces(spark, sf_dir), "image_id")
    maps = standardize.counts_to_map(counts, "image_id")
    text = F.transform(
        F.map_entries("class_counts"),
        lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string")),
    )
    return maps.select("image_id", F.array_join(text, ",").alias("class_counts"))


@query(f"""WITH {v.LABEL_TEXT} SELECT file_path, line_number, l_partkey, l_suppkey, tok[1] AS raw_label,
  n_tokens >= 5 AND xc IS NOT NULL AND yc IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL AS parsed,
  CASE WHEN isnan(xc) THEN -1 ELSE xc END AS xc, yc, w, h,
  CASE WHEN n_tokens > 5 THEN CAST(tok[6] AS DOUBLE) ELSE 1.0 END AS conf FROM v_parsed""")
def parse_label_lines(spark, sf_dir):
    content = v.label_text(spark, sf_dir).filter(tokens.is_content(F.col("line")))
    parsed = standardize.parse_tokens(content.withColumn("tokens", tokens.words(F.col("line"))))
    return parsed.select(
        "file_path", "line_number", "l_partkey", "l_suppkey", "raw_label", "parsed",
        F.when(F.isnan("xc"), -1.0).otherwise(F.col("xc")).alias("xc"), "yc", "w", "h", "conf",
    )


@query(f"""WITH {v.PIECES} SELECT image_id, l_linenumber, l_partkey, l_suppkey,
  class_id || printf(' %.6f %.6f %.6f %.6f', xc, yc, w, h) AS line FROM v_pieces""")
def label_lines(spark, sf_dir):
    return v.pieces(spark, sf_dir).select(
        "image_id", *v.ROW_KEY, standardize.label_line("").alias("line")
    )


# -- boxes -------------------------------------------------------------------


@query(f"""WITH {v.ANNOTATIONS}, {v.clamp_cte('v_ann')}
SELECT image_id, l_linenumber, l_partkey, l_suppkey, visible, was_clamped, round(oxc, 6) AS xc, round(oyc, 6) AS yc,
  round(ow, 6) AS w, round(oh, 6) AS h FROM v_cut""")
def clamp_boxes(spark, sf_dir):
    cut = boxes.clamp(boxes.from_yolo())
    return v.annotations(spark, sf_dir).select(
        "image_id", *v.ROW_KEY, cut.visible.alias("visible"), cut.moved.alias("was_clamped"),
        *[v.r6(getattr(cut.box, c), c) for c in ("xc", "yc", "w", "h")],
    )


def rounded_box(box):
    return [v.r6(getattr(box, c), c) for c in ("xc", "yc", "w", "h")]


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(a + w / 2.0, 6) AS xc, round(b + h / 2.0, 6) AS yc,
  round(w, 6) AS w, round(h, 6) AS h FROM (
  SELECT *, l_quantity / 50.0 AS a, l_tax * 10.0 AS b, greatest(0.0, l_discount * 5.0 - l_quantity / 50.0) AS w,
    greatest(0.0, CAST(l_partkey % 1000 AS DOUBLE) / 1000.0 - l_tax * 10.0) AS h FROM lineitem) q""")
def box_from_corners(spark, sf_dir):
    df = v.table(spark, sf_dir, "lineitem")
    box = boxes.from_corners(
        F.col("l_quantity") / 50.0, F.col("l_tax") * 10.0, F.col("l_discount") * 5.0,
        (F.col("l_partkey") % 1000) / F.lit(1000.0),
    )
    return df.select("l_orderkey", *v.ROW_KEY, *rounded_box(box))


PIXEL_BOX = """FROM (SELECT *, CASE WHEN l_linenumber > 1 THEN CAST((l_linenumber - 1) * 200 AS DOUBLE) END AS iw,
  CASE WHEN l_linenumber > 1 THEN CAST(600 AS DOUBLE) END AS ih FROM lineitem) q"""


def image_size():
    return (F.col("l_linenumber") - 1) * 200, F.lit(600)


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(a + w / 2.0, 6) AS xc, round(b + h / 2.0, 6) AS yc,
  round(w, 6) AS w, round(h, 6) AS h FROM (SELECT *, l_suppkey / iw AS a, l_quantity / ih AS b,
    CASE WHEN iw IS NOT NULL THEN greatest(0.0, (l_partkey % 200) / iw - l_suppkey / iw) END AS w,
    CASE WHEN iw IS NOT NULL THEN greatest(0.0, (l_quantity + 60.0) / ih - l_quantity / ih) END AS h {PIXEL_BOX}) z""")
def box_from_pixels(spark, sf_dir):
    box = boxes.from_pixel_corners(
        F.col("l_suppkey"), F.col("l_quantity"), F.col("l_partkey") % 200,
        F.col("l_quantity") + 60.0, *image_size(),
    )
    ok = boxes.has_image_size(*image_size())
    columns = [F.when(ok, c).alias(n) for c, n in zip(rounded_box(box), ("xc", "yc", "w", "h"))]
    return v.table(spark, sf_dir, "lineitem").select("l_orderkey", *v.ROW_KEY, *columns)


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_suppkey / iw + w / 2.0, 6) AS xc,
  round(l_quantity / ih + h / 2.0, 6) AS yc, round(w, 6) AS w, round(h, 6) AS h
FROM (SELECT *, (l_partkey % 40 - 5) / iw AS w, (l_quantity - 10.0) / ih AS h {PIXEL_BOX}) z""")
def box_from_coco(spark, sf_dir):
    box = boxes.from_coco(
        F.col("l_suppkey"), F.col("l_quantity"), F.col("l_partkey") % 40 - 5,
        F.col("l_quantity") - 10.0, *image_size(),
    )
    return v.table(spark, sf_dir, "lineitem").select("l_orderkey", *v.ROW_KEY, *rounded_box(box))


@query(f"""WITH {v.ANNOTATIONS} SELECT image_id, l_linenumber, l_partkey, l_suppkey, round(xc, 6) AS contact_x,
  round(yc + h / 2.0, 6) AS contact_y, round(xc, 6) AS centroid_x, round(yc, 6) AS centroid_y,
  round(greatest(0.0, w) * greatest(0.0, h), 6) AS area,
  round((xc - w / 2.0) * 640, 6) AS px_x_min, round((yc - h / 2.0) * 480, 6) AS px_y_min,
  round((xc + w / 2.0) * 640, 6) AS px_x_max, round((yc + h / 2.0) * 480, 6) AS px_y_max,
  w >= 0.005 AND h >= 0.005 AND greatest(0.0, w) * greatest(0.0, h) >= 0.000025 AND xc - w / 2.0 BETWEEN 0 AND 1
   AND xc + w / 2.0 BETWEEN 0 AND 1 AND yc - h / 2.0 BETWEEN 0 AND 1 AND yc + h / 2.0 BETWEEN 0 AND 1 AS is_valid
FROM v_ann""")
def contact_anchor(spark, sf_dir):
    box = boxes.from_yolo()
    pixel = box.to_pixels(F.lit(640), F.lit(480))
    return v.annotations(spark, sf_dir).select(
        "image_id", *v.ROW_KEY,
        v.r6(box.contact_anchor[0], "contact_x"), v.r6(box.contact_anchor[1], "contact_y"),
        v.r6(box.centroid[0], "centroid_x"), v.r6(box.centroid[1], "centroid_y"),
        v.r6(box.area, "area"),
        *[v.r6(c, f"px_{n}") for c, n in zip(pixel, ("x_min", "y_min", "x_max", "y_max"))],
        boxes.is_valid(box).alias("is_valid"),
    )


@query("""SELECT o_orderkey, round((x0 + x1) / 2.0, 6) AS center_x, round((y0 + y1) / 2.0, 6) AS center_y,
  round((x0 + x1) / 2.0, 6) AS bottom_x, round(y1, 6) AS bottom_y FROM (
  SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS x0, CAST(o_orderkey % 480 AS DOUBLE) AS y0,
    o_custkey + 25.0 AS x1, CAST(o_orderkey % 480 AS DOUBLE) + 40.0 AS y1 FROM orders) q""")
def pixel_box_center(spark, sf_dir):
    x, y = F.col("o_custkey").cast("double"), (F.col("o_orderkey") % 480).cast("double")
    parts = boxes.axis_aligned_center(x, y, x + 25.0, y + 40.0)
    names = ("center_x", "center_y", "bottom_x", "bottom_y")
    return v.table(spark, sf_dir, "orders").select(
        "o_orderkey", *[v.r6(c, n) for c, n in zip(parts, names)]
    )


# -- classes -----------------------------------------------------------------


@query(f"""WITH {v.RAW_LABELS} SELECT raw_label, dataset, class_id, count(*) AS n FROM v_mapped GROUP BY ALL""")
def class_cascade(spark, sf_dir):
    mapped = map_classes(v.raw_labels(spark, sf_dir), Vocabulary(), dataset="dataset")
    return mapped.groupBy("raw_label", "dataset", "class_id").agg(F.count("*").alias("n"))


@query(f"""WITH {v.PIECES} SELECT class_id, CASE WHEN class_id < 6 THEN 'white' ELSE 'black' END AS color,
  (['pawn','knight','bishop','rook','queen','king'])[class_id % 6 + 1] AS piece_type,
  ('PNBRQKpnbrqk')[class_id + 1] AS fen_char, class_id AS back_from_type, class_id AS back_from_char,
  class_id % 6 <> 0 AS is_tall, count(*) AS n FROM v_pieces GROUP BY ALL""")
def class_decompose(spark, sf_dir):
    joined = with_class_info(v.pieces(spark, sf_dir))
    return joined.groupBy(
        "class_id", "color", "piece_type", "fen_char",
        classes.class_of(F.col("piece_type"), F.col("color")).alias("back_from_type"),
        classes.class_of_symbol(F.col("fen_char")).cast("int").alias("back_from_char"),
        classes.is_tall(F.col("class_id")).alias("is_tall"),
    ).agg(F.count("*").alias("n"))
