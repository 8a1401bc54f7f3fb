"""Annotation-shaped views over the given tables, for Spark and as SQL text.

Every view is a projection of whole tables; the SQL twin is inlined as a CTE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.functions.once import compute_once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(column, name: str | None = None):
    """Six-decimal comparison form of a double."""
    rounded = F.round(column, 6)
    # Adding zero turns -0.0 into 0.0.
    return (rounded + 0.0).alias(name) if name else rounded + 0.0


ROW_KEY = ["l_linenumber", "l_partkey", "l_suppkey"]


def annotations(spark, sf_dir) -> DataFrame:
    """Numeric annotations with some bad classes, sizes and positions."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), *ROW_KEY, "l_returnflag",
        (F.col("l_partkey") % 14).cast("int").alias("cls"),
        (F.col("l_quantity") / 50.0).alias("xc"),
        ((F.col("l_partkey") % 1000) / F.lit(1000.0)).alias("yc"),
        (F.col("l_discount") * 0.4).alias("w"),
        F.col("l_tax").alias("h"),
        F.least(F.lit(1.0), F.col("l_extendedprice") / 104997.88).alias("conf"),
    )


ANNOTATIONS = """v_ann AS (
  SELECT l_orderkey AS image_id, l_linenumber, l_partkey, l_suppkey, l_returnflag,
    CAST(l_partkey % 14 AS INTEGER) AS cls,
    l_quantity / CAST(50 AS DOUBLE) AS xc,
    CAST(l_partkey % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS yc,
    l_discount * CAST(0.4 AS DOUBLE) AS w, l_tax AS h,
    least(CAST(1 AS DOUBLE), l_extendedprice / CAST(104997.88 AS DOUBLE)) AS conf
  FROM lineitem)"""


def pieces(spark, sf_dir) -> DataFrame:
    """Clean piece boxes: every row has one of the twelve classes and a visible size."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), *ROW_KEY,
        F.when(F.col("l_returnflag") == "R", "physical_3d").otherwise("digital_2d").alias("domain"),
        (F.col("l_partkey") % 12).cast("int").alias("class_id"),
        (F.col("l_quantity") / 50.0).alias("xc"),
        ((F.col("l_partkey") % 1000) / F.lit(1000.0)).alias("yc"),
        (F.col("l_discount") * 0.4 + 0.05).alias("w"),
        (F.col("l_tax") * 4.0 + 0.05).alias("h"),
        F.least(F.lit(1.0), F.col("l_extendedprice") / 104997.88).alias("conf"),
    )


PIECES = """v_pieces AS (
  SELECT l_orderkey AS image_id, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN l_returnflag = 'R' THEN 'physical_3d' ELSE 'digital_2d' END AS domain,
    CAST(l_partkey % 12 AS INTEGER) AS class_id,
    l_quantity / CAST(50 AS DOUBLE) AS xc,
    CAST(l_partkey % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS yc,
    l_discount * CAST(0.4 AS DOUBLE) + CAST(0.05 AS DOUBLE) AS w,
    l_tax * CAST(4 AS DOUBLE) + CAST(0.05 AS DOUBLE) AS h,
    least(CAST(1 AS DOUBLE), l_extendedprice / CAST(104997.88 AS DOUBLE)) AS conf
  FROM lineitem)"""


def label_text(spark, sf_dir) -> DataFrame:
    """Label lines as text, with comments, blanks and broken tokens among them."""
    return as_label_text(table(spark, sf_dir, "lineitem"))


def as_label_text(lineitem: DataFrame) -> DataFrame:
    """The same view of an already opened (or streaming) table."""
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    part, supp, order = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    case = F.pmod(supp, F.lit(20))
    good = F.concat(
        (part % 14).cast("string"), F.lit(" 0."), pad(order % 1000, 3), F.lit(" 0."),
        pad(part % 1000, 3), F.lit(" 0."), pad(supp % 100, 3), F.lit(" 0."), pad(part % 90, 3),
    )
    line = (
        F.when(case == 0, "# note").when(case == 1, "").when(case == 2, "3 0.5 0.5")
        .when(case == 3, "1.0 0.5 0.5 0.1 0.1").when(case == 4, "1 nan 0.5 0.1 0.1")
        .when(case == 5, "2 0.5 text 0.1 0.1").when(case == 6, F.concat(F.lit(" "), good, F.lit(" 0.9 ")))
        .otherwise(good)
    )
    # The text is put together once, as if it had been read, before any filter looks at it.
    return compute_once(lineitem, {"line": line}).select(
        F.concat(F.lit("labels/"), order.cast("string"), F.lit(".txt")).alias("file_path"),
        F.col("l_linenumber").alias("line_number"), *ROW_KEY, "line",
    )


LABEL_TEXT = r"""v_lines AS (
  SELECT 'labels/' || l_orderkey || '.txt' AS file_path, l_linenumber AS line_number,
    l_linenumber, l_partkey, l_suppkey,
    CASE l_suppkey % 20 WHEN 0 THEN '# note' WHEN 1 THEN '' WHEN 2 THEN '3 0.5 0.5'
      WHEN 3 THEN '1.0 0.5 0.5 0.1 0.1' WHEN 4 THEN '1 nan 0.5 0.1 0.1'
      WHEN 5 THEN '2 0.5 text 0.1 0.1' WHEN 6 THEN ' ' || good || ' 0.9 ' ELSE good END AS line
  FROM (SELECT *, concat(CAST(l_partkey % 14 AS VARCHAR),
      ' 0.', lpad(CAST(l_orderkey % 1000 AS VARCHAR), 3, '0'),
      ' 0.', lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0'),
      ' 0.', lpad(CAST(l_suppkey % 100 AS VARCHAR), 3, '0'),
      ' 0.', lpad(CAST(l_partkey % 90 AS VARCHAR), 3, '0')) AS good FROM lineitem) q),
v_tokens AS (
  SELECT *, string_split_regex(trim(line), '\s+') AS tok FROM v_lines
  WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')),
v_parsed AS (
  SELECT *, len(tok) AS n_tokens,
    CASE WHEN regexp_matches(tok[1], '^[+-]?[0-9]+$') THEN CAST(tok[1] AS BIGINT) END AS class_id,
    TRY_CAST(tok[2] AS DOUBLE) AS xc, TRY_CAST(tok[3] AS DOUBLE) AS yc,
    TRY_CAST(tok[4] AS DOUBLE) AS w, TRY_CAST(tok[5] AS DOUBLE) AS h FROM v_tokens)"""


def raw_labels(spark, sf_dir) -> DataFrame:
    """Boxes with raw class labels in several spellings and from two sources."""
    number = (F.col("l_partkey") % 14).cast("string")
    case = F.pmod("l_suppkey", F.lit(8))
    label = number
    for place, text in enumerate(("wP", "black-rook", "B", "b", "WhiteKing", "board_corner")):
        label = F.when(case == place, text).otherwise(label)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", *ROW_KEY, label.alias("raw_label"),
        F.when(F.col("l_returnflag") == "R", "chessred")
        .when(F.col("l_returnflag") == "A", "roboflow_staunton").alias("dataset"),
        (F.col("l_quantity") / 50.0).alias("xc"),
        ((F.col("l_partkey") % 1000) / F.lit(1000.0)).alias("yc"),
        (F.col("l_discount") * 0.4).alias("w"),
        F.col("l_tax").alias("h"),
    )


RAW_LABELS = """v_raw AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE l_suppkey % 8 WHEN 0 THEN 'wP' WHEN 1 THEN 'black-rook' WHEN 2 THEN 'B' WHEN 3 THEN 'b'
      WHEN 4 THEN 'WhiteKing' WHEN 5 THEN 'board_corner'
      ELSE CAST(l_partkey % 14 AS VARCHAR) END AS raw_label,
    CASE l_returnflag WHEN 'R' THEN 'chessred' WHEN 'A' THEN 'roboflow_staunton' END AS dataset,
    l_quantity / CAST(50 AS DOUBLE) AS xc,
    CAST(l_partkey % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS yc,
    l_discount * CAST(0.4 AS DOUBLE) AS w, l_tax AS h
  FROM lineitem),
v_mapped AS (
  SELECT *, CASE raw_label WHEN 'wP' THEN 0 WHEN 'black-rook' THEN 9 WHEN 'B' THEN 2 WHEN 'b' THEN 8
      WHEN 'WhiteKing' THEN 5 WHEN 'board_corner' THEN NULL
      ELSE CASE
        WHEN dataset = 'chessred' AND n BETWEEN 1 AND 12 THEN n - 1
        WHEN dataset = 'roboflow_staunton' AND n BETWEEN 0 AND 11
          THEN ([8, 11, 7, 6, 10, 9, 2, 5, 1, 0, 4, 3])[n + 1]
        WHEN n BETWEEN 0 AND 11 THEN n END
      END AS class_id
  FROM (SELECT *, TRY_CAST(raw_label AS INTEGER) AS n FROM v_raw) q)"""

# Shared clamp arithmetic: edges, cut edges, visibility and outcome flags of a view.
def clamp_cte(source: str, name: str = "v_cut") -> str:
    return f"""{name}_e AS (
  SELECT *, xc - w / 2.0 AS ex0, yc - h / 2.0 AS ey0, xc + w / 2.0 AS ex1, yc + h / 2.0 AS ey1
  FROM {source}),
{name}_c AS (
  SELECT *, greatest(0.0, least(1.0, ex0)) AS cx0, greatest(0.0, least(1.0, ey0)) AS cy0,
    greatest(0.0, least(1.0, ex1)) AS cx1, greatest(0.0, least(1.0, ey1)) AS cy1 FROM {name}_e),
{name}_v AS (
  SELECT *, NOT (ex1 <= -0.00001 OR ex0 >= 1.00001 OR ey1 <= -0.00001 OR ey0 >= 1.00001)
      AND ((cx1 - cx0) * (cy1 - cy0)) / greatest(CAST(1e-12 AS DOUBLE), (ex1 - ex0) * (ey1 - ey0)) >= 0.40
      AS visible,
    greatest(0.0, cx1 - cx0) AS ow, greatest(0.0, cy1 - cy0) AS oh FROM {name}_c),
{name} AS (
  SELECT *, cx0 + ow / 2.0 AS oxc, cy0 + oh / 2.0 AS oyc,
    visible AND (ex0 < 0 OR ey0 < 0 OR ex1 > 1 OR ey1 > 1 OR abs(cx0 - ex0) > 1e-9
      OR abs(cy0 - ey0) > 1e-9 OR abs(cx1 - ex1) > 1e-9 OR abs(cy1 - ey1) > 1e-9) AS was_clamped
  FROM {name}_v)"""


OUTCOME = """CASE WHEN class_id IS NULL THEN 'unknown_class' WHEN NOT visible THEN 'out_of_bounds'
  WHEN ow < 0.005 OR oh < 0.005 OR ow * oh < 0.000025 OR oxc - ow / 2.0 NOT BETWEEN 0 AND 1
    OR oxc + ow / 2.0 NOT BETWEEN 0 AND 1 OR oyc - oh / 2.0 NOT BETWEEN 0 AND 1
    OR oyc + oh / 2.0 NOT BETWEEN 0 AND 1 THEN 'degenerate' ELSE 'valid' END"""


def samples(spark, sf_dir) -> DataFrame:
    """Documents as image samples; a document without a label row is a negative."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("_labelled"), "quality", "toxic"
    )
    return docs.join(labels, F.col("doc_id") == F.col("_labelled"), "left").select(
        F.col("doc_id").alias("sample_id"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"),
        F.when(F.col("lang").isin("en", "fr"), "physical_3d").otherwise("digital_2d").alias("domain"),
        F.col("source").alias("source_name"),
        F.col("_labelled").isNull().alias("is_negative"),
        F.when(F.col("_labelled").isNotNull(), F.col("n_chars") % 33).otherwise(0).alias("n_pieces"),
    )


SAMPLES = """v_samples AS (
  SELECT d.doc_id AS sample_id, sha256(d.text) AS sha256,
    CASE WHEN d.lang IN ('en', 'fr') THEN 'physical_3d' ELSE 'digital_2d' END AS domain,
    d.source AS source_name, l.doc_id IS NULL AS is_negative,
    CASE WHEN l.doc_id IS NOT NULL THEN d.n_chars % 33 ELSE 0 END AS n_pieces
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
v_unique AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY sample_id) AS rn FROM v_samples) q
  WHERE rn = 1)"""


def split_cte(source: str, strata: str, order: str, rounding: str = "round_even({0}, 0)",
              name: str = "v_split") -> str:
    """Exact split by hash order: ranks against rounded cut sizes."""
    size = lambda share: rounding.format(f"CAST(n AS DOUBLE) * {share}")
    return f"""{name}_r AS (
  SELECT *, row_number() OVER (PARTITION BY {strata} ORDER BY {order}) AS rk,
    count(*) OVER (PARTITION BY {strata}) AS n FROM {source}),
{name} AS (
  SELECT *, CASE WHEN rk <= least(n, {size('0.7')}) THEN 'train'
    WHEN rk <= least(n, {size('0.7')} + {size('0.15')}) THEN 'val' ELSE 'test' END AS split
  FROM {name}_r)"""


def files(spark, sf_dir) -> DataFrame:
    """A dataset tree: images from documents and pages, label files from labels."""
    def tree(key, kind_image: bool, ext: str):
        split = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (key % 3 + 1).cast("int"))
        kind = F.lit("images" if kind_image else "labels")
        name = F.concat(F.lit("s"), key.cast("string"), F.lit(ext))
        return F.when(key % 2 == 0, F.concat_ws("/", kind, split, name)).otherwise(
            F.concat_ws("/", split, kind, name)
        )

    docs = table(spark, sf_dir, "documents").select(
        tree(F.col("doc_id"), True, ".jpg").alias("rel_path"),
        F.when(F.col("n_chars") >= 100, F.col("n_chars")).otherwise(0).alias("length"),
    )
    shots = table(spark, sf_dir, "pages").select(
        tree(F.col("page_id"), True, ".PNG").alias("rel_path"),
        F.length("html").cast("bigint").alias("length"),
    )
    labels = table(spark, sf_dir, "labels").select(
        tree(F.col("doc_id") + 5, False, ".txt").alias("rel_path"),
        F.when(F.col("quality") == 1, 40).otherwise(0).cast("bigint").alias("length"),
    )
    return docs.unionByName(shots).unionByName(labels)


def _tree_sql(key: str, kind: str, ext: str) -> str:
    split = f"(['train','val','test'])[{key} % 3 + 1]"
    return (
        f"CASE WHEN {key} % 2 = 0 THEN '{kind}/' || {split} || '/s' || {key} || '{ext}' "
        f"ELSE {split} || '/{kind}/s' || {key} || '{ext}' END"
    )


FILES = f"""v_files AS (
  SELECT {_tree_sql('doc_id', 'images', '.jpg')} AS rel_path,
    CASE WHEN n_chars >= 100 THEN n_chars ELSE 0 END AS length,
    (['train','val','test'])[doc_id % 3 + 1] || '/s' || doc_id AS stem, 'image' AS kind, 0 AS rnk
  FROM documents UNION ALL
  SELECT {_tree_sql('page_id', 'images', '.PNG')}, length(html),
    (['train','val','test'])[page_id % 3 + 1] || '/s' || page_id, 'image', 8 FROM pages UNION ALL
  SELECT {_tree_sql('(doc_id + 5)', 'labels', '.txt')}, CASE WHEN quality = 1 THEN 40 ELSE 0 END,
    (['train','val','test'])[(doc_id + 5) % 3 + 1] || '/s' || (doc_id + 5), 'label', 0 FROM labels),
v_pairs AS (
  SELECT coalesce(i.stem, l.stem) AS pair_key, i.rel_path AS image_path, i.length AS image_length,
    l.rel_path AS label_path, l.length AS label_length
  FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY rnk DESC, rel_path DESC) AS rn
          FROM v_files WHERE kind = 'image') q WHERE rn = 1) i
  FULL OUTER JOIN (SELECT * FROM v_files WHERE kind = 'label') l ON i.stem = l.stem)"""


def pixels(spark, sf_dir) -> DataFrame:
    """Pixels of one picture per supplier, 16 wide and 64 high."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("image_id"),
        (F.col("l_orderkey") % 64).cast("int").alias("y"),
        (F.col("l_partkey") % 16).cast("int").alias("x"),
        (F.col("l_partkey") % 256).cast("int").alias("b"),
        (F.col("l_orderkey") % 256).cast("int").alias("g"),
        ((F.col("l_partkey") + F.col("l_orderkey")) % 256).cast("int").alias("r"),
    )


PIXELS = """v_pixels AS (
  SELECT l_suppkey AS image_id, CAST(l_orderkey % 64 AS INTEGER) AS y, CAST(l_partkey % 16 AS INTEGER) AS x,
    CAST(l_partkey % 256 AS INTEGER) AS b, CAST(l_orderkey % 256 AS INTEGER) AS g,
    CAST((l_partkey + l_orderkey) % 256 AS INTEGER) AS r FROM lineitem),
v_gray AS (
  SELECT *, CAST((b * 3735 + g * 19235 + r * 9798 + 16384) >> 15 AS DOUBLE) AS luma FROM v_pixels)"""


def evaluations(spark, sf_dir) -> DataFrame:
    """Stored engine evaluations, several per position."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("fen_id"), *ROW_KEY,
        F.when(F.col("l_linenumber") != 7, F.floor(F.col("l_extendedprice") / 100.0).cast("int") - 500)
        .alias("score_cp"),
        F.when(F.col("l_linenumber") == 7, (F.col("l_suppkey") % 9 - 4).cast("int")).alias("score_mate"),
        F.col("l_quantity").cast("int").alias("depth"),
    )


EVALUATIONS = """v_evals AS (
  SELECT l_orderkey AS fen_id, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN l_linenumber <> 7 THEN CAST(floor(l_extendedprice / CAST(100 AS DOUBLE)) AS INTEGER) - 500 END AS score_cp,
    CASE WHEN l_linenumber = 7 THEN CAST(l_suppkey % 9 - 4 AS INTEGER) END AS score_mate,
    CAST(l_quantity AS INTEGER) AS depth
  FROM lineitem)"""


def predictions(spark, sf_dir) -> DataFrame:
    """Binary targets and predictions with an epoch number."""
    return table(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % 25 + 1).cast("int").alias("epoch"),
        F.col("event_type").isin("purchase", "signup").alias("target"),
        (F.col("value") >= 30).alias("pred"),
    )


PREDICTIONS = """v_preds AS (
  SELECT event_id, CAST(user_id % 25 + 1 AS INTEGER) AS epoch,
    event_type IN ('purchase', 'signup') AS target, value >= 30 AS pred FROM events)"""
