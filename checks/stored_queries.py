"""Sinks and sources together: what is derived from the given tables is stored, read back and compared with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import audit_queries as audit
from checks import board_queries as board
from checks import build_queries as build
from checks import views as v
from gridmark import sinks
from gridmark.config import SplitRatio
from gridmark.file_sink import write_files
from gridmark.operators import dedup, pairing, parallax, ranking, summary
from gridmark.session import materialize, shared_folder
from gridmark.sources import labels, listing, tables
from gridmark.vocabulary import Vocabulary

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(fn):
        QUERIES[fn.__name__], SQL[fn.__name__] = fn, sql
        return fn

    return register


def folder(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(f"""WITH {v.PIECES} SELECT 'labels/s' || l_suppkey || '.txt' AS rel_path, l_suppkey % 9 = 0 AS is_negative,
  count(*) FILTER (l_suppkey % 9 > 0) AS n_lines, CAST(coalesce(sum(class_id) FILTER (l_suppkey % 9 > 0), 0) AS BIGINT) AS class_sum,
  count(*) FILTER (l_suppkey % 9 > 0) * (count(*) + 1) // 2 AS number_sum,
  coalesce(CAST(round(sum(CAST(round(xc * 50.0) AS BIGINT)) FILTER (l_suppkey % 9 > 0)) AS BIGINT), 0) AS x_sum
FROM v_pieces GROUP BY l_suppkey""")
def label_export(spark, sf_dir):
    """Label files of every supplier through the committing sink, empty for negatives, and all their lines read back."""
    pieces = v.pieces(spark, sf_dir)
    named = pieces.withColumn("rel_path", F.concat(F.lit("labels/s"), F.col("l_suppkey").cast("string"), F.lit(".txt")))
    boxes = named.filter("l_suppkey % 9 > 0").withColumn("line_number", F.col("l_linenumber"))
    target = folder(spark, "labels")
    write_files(sinks.label_files(boxes, named.select("rel_path").distinct()), target)
    # Small files are opened once, whatever is asked of their texts.
    contents = materialize(labels.read_label_text(spark, target))
    # The text source leaves out empty files; the listing has them.
    files = listing.list_files(spark, target).select("rel_path", (F.col("length") == 0).alias("empty"))
    blank = contents.select("rel_path", labels.is_blank().alias("blank"))
    lines = labels.parse_labels(labels.label_lines(contents)).groupBy("rel_path").agg(
        F.count("*").alias("n_lines"), F.sum(F.col("raw_label").try_cast("bigint")).alias("class_sum"), F.sum("line_number").alias("number_sum"),
        F.sum(F.round(F.col("xc") * 50.0).cast("bigint")).alias("x_sum"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return files.join(blank, "rel_path", "left").join(lines, "rel_path", "left").select(
        "rel_path", (F.col("empty") | F.coalesce("blank", F.lit(False))).alias("is_negative"), *[zero(c) for c in ("n_lines", "class_sum", "number_sum", "x_sum")]
    )


@query(f"""WITH {v.PIECES} SELECT l_suppkey, image_id, l_linenumber, l_partkey, class_id,
  CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY image_id, l_linenumber, l_partkey) AS INTEGER) AS rank
FROM v_pieces QUALIFY rank <= 12""")
def first_pieces(spark, sf_dir):
    """The first pieces of every picture, as a report lists them."""
    order = [F.col(c) for c in ("image_id", "l_linenumber", "l_partkey")]
    found = ranking.top_per_group(v.pieces(spark, sf_dir), ["l_suppkey"], order, parallax.LISTED_PIECES)
    return found.select("l_suppkey", "image_id", "l_linenumber", "l_partkey", "class_id", "rank")


@query(f"SELECT * FROM ({audit.SQL['annotated_pairs']}) q ORDER BY image_path LIMIT 20")
def first_pairs(spark, sf_dir):
    return pairing.first_pairs(pairing.annotated_pairs(v.files(spark, sf_dir)), 20)


@query(f"WITH {v.EVALUATIONS} SELECT CAST(fen_id AS VARCHAR) AS fen, score_cp, score_mate, depth FROM v_evals WHERE depth >= 45")
def stored_evaluations(spark, sf_dir):
    """Evaluations kept as a table of the contract's schema; the filter reaches the scan."""
    rows = v.evaluations(spark, sf_dir).select(F.col("fen_id").cast("string").alias("fen"), "score_cp", "score_mate", "depth")
    path = folder(spark, "evaluations")
    sinks.write_table(rows, path)
    return tables.read_evaluations(spark, path).filter("depth >= 45").select("fen", "score_cp", "score_mate", "depth")


@query("""SELECT CAST(user_id AS INTEGER) AS epoch, count(*) AS n, max(value) AS best, min(value) AS worst FROM events GROUP BY 1""")
def metrics_log(spark, sf_dir):
    """Epochs appended to a log in two runs."""
    epochs = v.table(spark, sf_dir, "events").select(F.col("user_id").cast("int").alias("epoch"), F.col("value").alias("val_acc"), "event_type")
    path = folder(spark, "metrics")
    for run in (F.col("event_type") == "click", F.col("event_type") != "click"):
        sinks.append_metrics(epochs.filter(run).drop("event_type"), path)
    return tables.read_metrics(spark, path).groupBy("epoch").agg(F.count("*").alias("n"), F.max("val_acc").alias("best"), F.min("val_acc").alias("worst"))


@query(board.SQL["parallax_macro"])
def parallax_summary(spark, sf_dir):
    """The summary row of a stored diagnostic report."""
    path = folder(spark, "parallax")
    sinks.write_parallax_report(parallax.per_image(board.assigned(spark, sf_dir)), path, "lineitem")
    row = spark.read.json(f"{path}/summary")
    whole = ("images", "total_pieces", "tall_pieces")
    rounded = ("centroid_accuracy_pct", "contact_accuracy_pct", "tall_centroid_accuracy_pct", "average_rank_error")
    return row.select(*[F.col(c).cast("bigint") for c in whole], *[v.r6(F.col(c), c) for c in rounded])


@query(f"""WITH {build.SPLIT}, d AS (SELECT count(*) AS total_images, count(DISTINCT sha256) AS total_unique_images FROM v_samples)
SELECT total_images, total_unique_images, total_images - total_unique_images AS total_duplicates_removed, split, count(*) AS images,
  CAST(sum(n_pieces) AS BIGINT) AS pieces, count(*) FILTER (is_negative) AS negatives FROM v_split, d GROUP BY ALL""")
def build_manifest(spark, sf_dir):
    """The manifest of a build, stored as one JSON row and read back, one row a split."""
    samples = build.built(spark, sf_dir)
    row = sinks.manifest_row(
        dedup.dedup_report(v.samples(spark, sf_dir)), summary.split_summary(samples),
        summary.class_distribution(build.class_counters(spark, sf_dir)), summary.domain_totals(samples), SplitRatio(), Vocabulary(),
    )
    path = folder(spark, "manifest")
    sinks.write_json(row, path)
    split = "STRUCT<total_images: BIGINT, total_pieces: BIGINT, negative_count: BIGINT>"
    counts = ("total_images", "total_unique_images", "total_duplicates_removed")
    stored = spark.read.schema(", ".join(f"{c} BIGINT" for c in counts) + f", splits MAP<STRING, {split}>").json(path)
    return stored.select(*counts, F.explode("splits").alias("split", "s")).select(
        *counts, "split", F.col("s.total_images").alias("images"),
        F.col("s.total_pieces").alias("pieces"), F.col("s.negative_count").alias("negatives"),
    )
