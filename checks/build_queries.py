"""Dedup, split, manifest, inventory and source-format queries with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import views as v
from gridmark.functions import paths
from gridmark.operators import dedup, files, split, standardize, summary
from gridmark.session import delete_at_end, shared_folder
from gridmark.sources import coco, voc

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


BY_ID = ("sample_id",)


def unique(spark, sf_dir):
    return dedup.deduplicate(v.samples(spark, sf_dir), order=BY_ID)


# -- dedup -------------------------------------------------------------------


@query(f"WITH {v.SAMPLES} SELECT sample_id, sha256, domain, source_name, is_negative FROM v_unique")
def dedup_exact(spark, sf_dir):
    return unique(spark, sf_dir).select(
        "sample_id", "sha256", "domain", "source_name", "is_negative"
    )


@query(f"""WITH {v.SAMPLES} SELECT count(*) AS total_scanned, count(DISTINCT sha256) AS unique_retained,
  count(*) - count(DISTINCT sha256) AS duplicates_removed FROM v_samples""")
def dedup_report(spark, sf_dir):
    return dedup.dedup_report(v.samples(spark, sf_dir))


@query(f"""WITH {v.SAMPLES} SELECT s.sha256, u.sample_id AS kept, s.sample_id AS removed,
  count(*) OVER (PARTITION BY s.sha256) + 1 AS copies
FROM v_samples s JOIN v_unique u ON s.sha256 = u.sha256 WHERE s.sample_id <> u.sample_id""")
def dedup_mapping(spark, sf_dir):
    return dedup.duplicate_mapping(v.samples(spark, sf_dir), order=BY_ID, ident="sample_id")


# -- split and manifest --------------------------------------------------------

SPLIT = f"""{v.SAMPLES}, {v.split_cte('v_unique', 'domain, is_negative', "sha256('42|' || sha256), sample_id")}"""


def built(spark, sf_dir):
    return split.stratified_split(unique(spark, sf_dir), "sha256", tie="sample_id")


@query(f"WITH {SPLIT} SELECT sample_id, domain, is_negative, split FROM v_split")
def stratified_split(spark, sf_dir):
    return built(spark, sf_dir).select("sample_id", "domain", "is_negative", "split")


FLOOR = v.split_cte("v_files_by_lang", "lang", "sha256('42|' || doc_id), doc_id",
                    "floor({0})").replace(
    "least(n, floor(CAST(n AS DOUBLE) * 0.7) + floor(CAST(n AS DOUBLE) * 0.15))",
    "floor(CAST(n AS DOUBLE) * 0.7) + floor(CAST(n AS DOUBLE) * 0.15)")


@query(f"WITH v_files_by_lang AS (SELECT doc_id, lang FROM documents), {FLOOR} SELECT doc_id, lang, split FROM v_split")
def floor_split(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return split.floor_split(docs, "lang", "doc_id")


NO_LANG = "SELECT doc_id, nullif(lang, 'fr') AS lang FROM documents"


@query(f"WITH v_files_by_lang AS ({NO_LANG}), {FLOOR} SELECT doc_id, lang, split FROM v_split")
def floor_split_gaps(spark, sf_dir):
    """Files without a class form a class of their own."""
    docs = v.table(spark, sf_dir, "documents").select("doc_id", F.nullif("lang", F.lit("fr")).alias("lang"))
    return split.floor_split(docs, "lang", "doc_id")


@query(f"""WITH q AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42|' || doc_id), doc_id) AS k
  FROM ({NO_LANG}) d) SELECT doc_id, lang FROM q WHERE k <= 20""")
def keep_first_gaps(spark, sf_dir):
    """At most 20 rows of each group, NULL included; without the limit on the number of groups."""
    docs = v.table(spark, sf_dir, "documents").select("doc_id", F.nullif("lang", F.lit("fr")).alias("lang"))
    return split.keep_first(docs, "lang", "doc_id", 20, max_groups=None)


@query(f"""WITH {SPLIT} SELECT split, count(*) AS total_images, count(*) FILTER (domain = 'physical_3d') AS physical_count,
  count(*) FILTER (domain = 'digital_2d') AS digital_count, count(*) FILTER (is_negative) AS negative_count,
  CAST(sum(n_pieces) AS BIGINT) AS total_pieces FROM v_split GROUP BY split""")
def split_summary(spark, sf_dir):
    return summary.split_summary(built(spark, sf_dir))


@query(f"""WITH {SPLIT} SELECT 'split' AS facet, split AS value, count(*) AS images, CAST(sum(n_pieces) AS BIGINT) AS pieces
FROM v_split GROUP BY 2 UNION ALL SELECT 'domain', domain, count(*), CAST(sum(n_pieces) AS BIGINT) FROM v_split GROUP BY 2
UNION ALL SELECT 'all', 'all', count(*), CAST(sum(n_pieces) AS BIGINT) FROM v_split""")
def domain_totals(spark, sf_dir):
    return summary.domain_totals(built(spark, sf_dir))


CLASS_SPLIT = v.split_cte("v_images", "domain", "sha256('42|' || image_id), image_id")
CLASS_COUNTS = f"""{v.PIECES}, v_images AS (SELECT DISTINCT o_orderkey AS image_id,
  CASE WHEN o_orderstatus = 'F' THEN 'physical_3d' ELSE 'digital_2d' END AS domain FROM orders), {CLASS_SPLIT},
v_counts AS (SELECT split, class_id, count(*) AS n FROM v_pieces JOIN v_split USING (image_id) GROUP BY 1, 2)"""


def class_counters(spark, sf_dir):
    """Long class counters of the split images."""
    images = v.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("image_id"),
        F.when(F.col("o_orderstatus") == "F", "physical_3d").otherwise("digital_2d").alias("domain"),
    )
    assigned = split.assign_splits(images, ["domain"], "image_id")
    counts = standardize.class_counts(v.pieces(spark, sf_dir), "image_id")
    return counts.join(assigned, "image_id").select("split", "class_id", "n")


@query(f"""WITH {CLASS_COUNTS} SELECT split, class_id, CAST(sum(n) AS BIGINT) AS n FROM v_counts GROUP BY 1, 2""")
def split_class_distribution(spark, sf_dir):
    return summary.class_distribution(class_counters(spark, sf_dir))


@query(f"""WITH {CLASS_COUNTS} SELECT CAST(i AS INTEGER) AS class_id,
  (['white', 'black'])[i // 6 + 1] || '_' || (['pawn','knight','bishop','rook','queen','king'])[i % 6 + 1] AS class_name,
  CAST(coalesce(sum(n) FILTER (split = 'train'), 0) AS BIGINT) AS train,
  CAST(coalesce(sum(n) FILTER (split = 'val'), 0) AS BIGINT) AS val,
  CAST(coalesce(sum(n) FILTER (split = 'test'), 0) AS BIGINT) AS test,
  CAST(coalesce(sum(n), 0) AS BIGINT) AS total
FROM range(12) r(i) LEFT JOIN v_counts c ON c.class_id = r.i GROUP BY i""")
def split_class_crosstab(spark, sf_dir):
    return summary.class_crosstab(class_counters(spark, sf_dir))


@query(f"""WITH {SPLIT} SELECT count(*) AS contents, count(*) FILTER (k > 1) AS leaked FROM (
  SELECT sha256, count(DISTINCT split) AS k FROM v_split GROUP BY 1) q""")
def split_leakage(spark, sf_dir):
    assigned = built(spark, sf_dir)
    leaks = split.split_leakage(assigned)
    contents = assigned.agg(F.count_distinct("sha256").alias("contents"))
    return contents.select("contents", leaks.agg(F.count("*")).scalar().alias("leaked"))


@query("""WITH d AS (SELECT sha256(text) AS content, CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM documents)
SELECT content, count(DISTINCT split) AS n_splits, count(*) AS n FROM d GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def split_leakage_found(spark, sf_dir):
    """Copies that a split by number puts on both sides."""
    docs = v.table(spark, sf_dir, "documents").select(
        F.sha2("text", 256).alias("content"),
        F.when(F.col("doc_id") % 3 == 0, "test").otherwise("train").alias("split"),
    )
    return split.split_leakage(docs, "content")


@query(f"""WITH {SPLIT}, q AS (SELECT split, sample_id,
  row_number() OVER (PARTITION BY split ORDER BY sha256('42|' || sample_id), sample_id) AS k FROM v_split)
SELECT split, sample_id FROM q WHERE k <= 20""")
def sample_per_split(spark, sf_dir):
    picked = split.sample_per_split(built(spark, sf_dir), "sample_id", 20)
    return picked.select("split", "sample_id")


@query(f"""WITH {SPLIT}, q AS (SELECT split, sample_id,
  row_number() OVER (PARTITION BY split ORDER BY sha256('42|split|' || sample_id), sample_id) AS k FROM v_split)
SELECT split, sample_id FROM q""")
def shuffled_split(spark, sf_dir):
    return split.shuffled(built(spark, sf_dir), "sample_id").select("split", "sample_id")


@query(f"""WITH {SPLIT} SELECT split, sample_id, CAST(row_number() OVER (
  PARTITION BY split ORDER BY sha256('42|' || split || '|' || sample_id), sample_id) AS INTEGER) AS position FROM v_split""")
def shuffled_positions(spark, sf_dir):
    """The order that rows come in, read from their places in the sorted partitions."""
    placed = split.shuffled(built(spark, sf_dir), "sample_id").withColumn("_at", F.monotonically_increasing_id())
    rank = F.row_number().over(Window.partitionBy("split").orderBy("_at"))
    return placed.select("split", "sample_id", rank.alias("position"))


POOLS = {"physical": "physical_3d", "digital": "digital_2d", "negative": "physical_3d"}


@query("""WITH p AS (SELECT doc_id AS sample_id, CASE WHEN l.doc_id IS NULL THEN 'negative'
    WHEN lang IN ('en', 'fr') THEN 'physical' ELSE 'digital' END AS pool
  FROM documents d LEFT JOIN (SELECT doc_id FROM labels) l USING (doc_id)),
q AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY sha256('42|' || sample_id), sample_id) AS k FROM p)
SELECT sample_id, pool, CASE WHEN pool = 'digital' THEN 'digital_2d' ELSE 'physical_3d' END AS domain
FROM q WHERE pool = 'negative' OR k <= 60""".replace(
    "SELECT doc_id AS sample_id, CASE WHEN l.doc_id",
    "SELECT d.doc_id AS sample_id, CASE WHEN l.doc_id").replace("USING (doc_id)", "ON d.doc_id = l.doc_id"))
def pool_union_cap(spark, sf_dir):
    rows = v.samples(spark, sf_dir).select("sample_id", "domain", "is_negative")
    labelled = rows.filter(~F.col("is_negative"))
    pools = {
        "physical": labelled.filter(F.col("domain") == "physical_3d").select("sample_id"),
        "digital": labelled.filter(F.col("domain") == "digital_2d").select("sample_id"),
        "negative": rows.filter("is_negative").select("sample_id"),
    }
    return split.pool_union(pools, POOLS, cap=60, key="sample_id")


# -- inventories -----------------------------------------------------------------


@query("""SELECT coalesce(l.doc_id, 0) AS file_id, CASE WHEN d.doc_id IS NULL THEN 'missing'
  WHEN want IS NULL THEN 'unchecked' WHEN lower(want) = md5(d.text) THEN 'verified' ELSE 'mismatch' END AS status
FROM (SELECT x.doc_id + 7 * x.toxic * 1000000 AS doc_id,
    CASE WHEN x.doc_id % 5 = 0 THEN NULL WHEN x.quality = 1 THEN upper(md5(y.text)) ELSE md5('other') END AS want
  FROM labels x JOIN documents y ON x.doc_id = y.doc_id) l
LEFT JOIN documents d ON l.doc_id = d.doc_id""")
def checksum_verify(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents").select(
        F.col("doc_id"), F.md5(F.encode("text", "UTF-8")).alias("actual_md5")
    )
    labels = v.table(spark, sf_dir, "labels").join(docs, "doc_id")
    want = (
        F.when(F.col("doc_id") % 5 == 0, None)
        .when(F.col("quality") == 1, F.upper("actual_md5"))
        .otherwise(F.md5(F.lit("other").cast("binary")))
    )
    expected = labels.select(
        (F.col("doc_id") + F.col("toxic") * 7_000_000).alias("file_id"), want.alias("expected_md5")
    )
    present = docs.withColumnRenamed("doc_id", "file_id")
    return files.verify_checksums(expected, present, "file_id").select("file_id", "status")


@query(f"""WITH {v.FILES}, e AS (SELECT *, split_part(rel_path, '/', 1) AS folder,
  lower(regexp_extract(rel_path, '(\\.[^.]+)$', 1)) AS ext FROM v_files)
SELECT folder, count(*) FILTER (ext IN ('.jpg', '.jpeg', '.png', '.bmp', '.webp')) AS images,
  count(*) FILTER (ext IN ('.json', '.xml', '.txt')) AS annotations, count(*) AS total_files FROM e GROUP BY 1""")
def file_inventory(spark, sf_dir):
    tree = v.files(spark, sf_dir).withColumn("folder", F.split_part("rel_path", F.lit("/"), F.lit(1)))
    return files.inventory(tree, "folder", path="rel_path")


@query(f"""WITH {SPLIT}, e AS (SELECT split,
  substr(domain, 1, 3) || '_' || source_name || '_s' || (sample_id % 50) || '.jpg' AS export_name FROM v_split)
SELECT split, export_name, count(*) AS n FROM e GROUP BY 1, 2 HAVING count(*) > 1""")
def export_collisions(spark, sf_dir):
    path = F.concat(F.lit("x/s"), (F.col("sample_id") % 50).cast("string"), F.lit(".jpg"))
    named = built(spark, sf_dir).withColumn(
        "export_name", paths.export_name(F.col("domain"), F.col("source_name"), path)
    )
    return files.name_collisions(named)


# -- source formats ----------------------------------------------------------------

PIXELS = f"""v_px AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_partkey % 15 AS INTEGER) AS cat,
    CAST(l_suppkey * 6 AS DOUBLE) AS x0, CAST(l_quantity * 12 AS DOUBLE) AS y0,
    CAST(l_partkey % 60 AS DOUBLE) AS pw, CAST(l_partkey % 45 AS DOUBLE) AS ph FROM lineitem)"""


def pixel_boxes(spark, sf_dir):
    """Pixel boxes in an 800 by 600 frame, integer valued."""
    return v.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", *v.ROW_KEY, (F.col("l_partkey") % 15).cast("int").alias("cat"),
        (F.col("l_suppkey") * 6).cast("double").alias("x0"),
        (F.col("l_quantity") * 12).cast("double").alias("y0"),
        (F.col("l_partkey") % 60).cast("double").alias("pw"),
        (F.col("l_partkey") % 45).cast("double").alias("ph"),
    )


OUT_COLUMNS = """class_id, outcome, round(oxc, 6) AS out_xc, round(oyc, 6) AS out_yc,
  round(ow, 6) AS out_w, round(oh, 6) AS out_h"""


def outcome_columns():
    return ["class_id", "outcome", *[v.r6(F.col(c), c) for c in standardize.OUT_BOX]]


@query(f"""WITH {PIXELS}, v_box AS (SELECT *, x0 / 800.0 + pw / 800.0 / 2.0 AS xc, y0 / 600.0 + ph / 600.0 / 2.0 AS yc,
  pw / 800.0 AS w, ph / 600.0 AS h, CASE WHEN cat BETWEEN 1 AND 12 THEN cat - 1 WHEN cat = 0 THEN 0 END AS class_id
  FROM v_px), {v.clamp_cte('v_box')}, v_std AS (SELECT *, {v.OUTCOME} AS outcome FROM v_cut)
SELECT l_orderkey || '.jpg' AS file_name, {OUT_COLUMNS} FROM v_std""")
def coco_json(spark, sf_dir):
    """One JSON document per annotation row, so no document grows with the data."""
    document = F.to_json(F.struct(
        F.array(F.struct(
            F.col("l_orderkey").alias("id"),
            F.concat(F.col("l_orderkey").cast("string"), F.lit(".jpg")).alias("file_name"),
            F.lit(800).alias("width"), F.lit(600).alias("height"),
        )).alias("images"),
        F.struct(F.array(F.struct(
            F.col("l_orderkey").alias("image_id"), F.col("cat").alias("category_id"),
            F.array("x0", "y0", "pw", "ph").alias("bbox"),
        )).alias("pieces")).alias("annotations"),
    ))
    documents = pixel_boxes(spark, sf_dir).select(*v.ROW_KEY, "l_orderkey", document.alias("value"))
    flat = coco.annotations(coco.parse_text(documents), (*v.ROW_KEY, "l_orderkey"))
    return standardize.standardize(flat.withColumn("dataset", F.lit("chessred")), dataset="dataset").select(
        "file_name", *outcome_columns()
    )


def supplier_documents(spark, sf_dir):
    """One document of many images and boxes for each supplier; image ids repeat between documents.

    Images whose number divides by 7 are not listed. TPC-style tables hold about 600 rows a supplier at any scale.
    """
    px = pixel_boxes(spark, sf_dir).withColumn("image", F.col("l_orderkey") % 50)
    name = F.concat(F.lit("i"), F.col("image").cast("string"), F.lit(".jpg"))
    width = F.when(F.col("l_suppkey") % 2 == 0, 800).otherwise(400)
    image = F.struct(F.col("image").alias("id"), name.alias("file_name"), width.alias("width"), F.lit(600).alias("height"))
    piece = F.struct(
        F.col("image").alias("image_id"), F.col("cat").alias("category_id"),
        F.array("x0", "y0", "pw", "ph").alias("bbox"),
    )
    lists = px.groupBy("l_suppkey").agg(
        F.collect_set(F.when(F.col("image") % 7 > 0, image)).alias("images"), F.collect_list(piece).alias("pieces")
    )
    text = F.to_json(F.struct("images", F.struct("pieces").alias("annotations")))
    return coco.parse_text(lists.select(F.col("l_suppkey").alias("path"), text.alias("value")))


@query(f"""WITH {PIXELS}, b AS (SELECT l_suppkey AS path, l_orderkey % 50 AS image_id, CAST(cat AS VARCHAR) AS raw_label,
    CASE WHEN l_suppkey % 2 = 0 THEN 800.0 ELSE 400.0 END AS iw, x0, y0, pw, ph, l_orderkey % 50 % 7 > 0 AS listed FROM v_px)
SELECT path, image_id, raw_label, listed AS image_listed,
  CASE WHEN listed THEN round(x0 / iw + pw / iw / 2.0, 6) END AS xc, CASE WHEN listed THEN round(y0 / 600.0 + ph / 600.0 / 2.0, 6) END AS yc,
  CASE WHEN listed THEN round(pw / iw, 6) END AS w, CASE WHEN listed THEN round(ph / 600.0, 6) END AS h FROM b""")
def coco_join(spark, sf_dir):
    """Boxes meet the image of their own document; those of unlisted images stay, without a box."""
    found = coco.annotations(supplier_documents(spark, sf_dir))
    return found.select(
        "path", "image_id", "raw_label", "image_listed", *[v.r6(F.col(c), c) for c in ("xc", "yc", "w", "h")]
    )


@query(f"""WITH {PIXELS}, b AS (SELECT CASE WHEN l_orderkey % 50 % 7 > 0 THEN 's' || l_suppkey || '/i' || (l_orderkey % 50) || '.jpg' END AS file_name,
    l_orderkey % 50 AS image_id, CAST(cat AS VARCHAR) AS raw_label,
    CASE WHEN l_suppkey % 2 = 0 THEN 800.0 ELSE 400.0 END AS iw, x0, y0, pw, ph, l_orderkey % 50 % 7 > 0 AS listed FROM v_px)
SELECT file_name, image_id, raw_label, listed AS image_listed,
  CASE WHEN listed THEN round(x0 / iw + pw / iw / 2.0, 6) END AS xc, CASE WHEN listed THEN round(y0 / 600.0 + ph / 600.0 / 2.0, 6) END AS yc,
  CASE WHEN listed THEN round(pw / iw, 6) END AS w, CASE WHEN listed THEN round(ph / 600.0, 6) END AS h FROM b""")
def coco_elements(spark, sf_dir):
    """Documents stored as text and read back by byte ranges that cut them anywhere."""
    docs = supplier_documents(spark, sf_dir)
    named = F.transform("images", lambda i: i.withField("file_name", F.concat(F.lit("s"), F.col("path").cast("string"), F.lit("/"), i["file_name"])))
    text = docs.select(F.to_json(F.struct(named.alias("images"), "annotations")).alias("value"))
    folder = f"{shared_folder(spark).rstrip('/')}/coco-{uuid.uuid4().hex}"
    text.write.text(folder)
    delete_at_end(spark, folder)
    found = coco.element_annotations(coco.read_elements(spark, folder, size=1 << 18))
    return found.select("file_name", "image_id", "raw_label", "image_listed", *[v.r6(F.col(c), c) for c in ("xc", "yc", "w", "h")])


@query("""SELECT l_suppkey AS path, CAST(count(DISTINCT l_orderkey % 50) FILTER (l_orderkey % 50 % 7 > 0) AS INTEGER) AS images,
  CAST(count(*) AS INTEGER) AS boxes, 0 AS categories FROM lineitem GROUP BY 1""")
def coco_counts(spark, sf_dir):
    return coco.document_counts(supplier_documents(spark, sf_dir))


@query(f"""WITH {PIXELS}, v_box AS (SELECT *, x0 / 800.0 + (CAST((x0 + pw) AS DOUBLE) / 800.0 - x0 / 800.0) / 2.0 AS xc,
  y0 / 600.0 + ((y0 + ph) / 600.0 - y0 / 600.0) / 2.0 AS yc,
  (x0 + pw) / 800.0 - x0 / 800.0 AS w, (y0 + ph) / 600.0 - y0 / 600.0 AS h,
  CASE WHEN cat BETWEEN 0 AND 11 THEN cat END AS class_id
  FROM v_px), {v.clamp_cte('v_box')}, v_std AS (SELECT *, {v.OUTCOME} AS outcome FROM v_cut)
SELECT l_orderkey || '.xml' AS file_name, {OUT_COLUMNS} FROM v_std""")
def voc_xml(spark, sf_dir):
    """One XML document per row, parsed back and standardised."""
    names = F.coalesce(
        F.get(F.array(*[F.lit(n) for n in ("white-pawn", "white-knight", "white-bishop", "white-rook",
              "white-queen", "white-king", "black-pawn", "black-knight", "black-bishop", "black-rook",
              "black-queen", "black-king")]), F.col("cat")), F.lit("board_corner"))
    corner = lambda value: value.cast("bigint").cast("string")
    text = F.concat(
        F.lit("<annotation><size><width>800</width><height>600</height></size><object><name>"), names,
        F.lit("</name><bndbox><xmin>"), corner(F.col("x0")), F.lit("</xmin><ymin>"), corner(F.col("y0")),
        F.lit("</ymin><xmax>"), corner(F.col("x0") + F.col("pw")), F.lit("</xmax><ymax>"),
        corner(F.col("y0") + F.col("ph")), F.lit("</ymax></bndbox></object></annotation>"),
    )
    documents = pixel_boxes(spark, sf_dir).select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit(".xml")).alias("path"), text.alias("value")
    )
    flat = voc.objects(voc.parse_text(documents))
    return standardize.standardize(
        flat.withColumn("dataset", F.lit("kaggle_tripod")), dataset="dataset", digits_are_ids=False
    ).select(F.col("path").alias("file_name"), *outcome_columns())
