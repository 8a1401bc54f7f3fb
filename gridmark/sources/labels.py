"""Label text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.config import NON_LABEL_FILES
from gridmark.functions.paths import base_name
from gridmark.functions.tokens import LINE_BREAK, is_content, strip, words
from gridmark.operators.standardize import class_counts, parse_tokens
from gridmark.sources.listing import qualified, relative_path


def read_label_text(spark: SparkSession, root: str) -> DataFrame:
    """One row per non-empty label file: rel_path and content.

    A label file describes one picture, so its text is small; many files share
    a task.
    """
    root = qualified(spark, root)
    text = spark.read.text(
        root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt"
    )
    path = relative_path(F.col("_metadata.file_path"), root)
    named = text.select(path.alias("rel_path"), F.col("value").alias("content"))
    return named.filter(~base_name(F.col("rel_path")).isin(*NON_LABEL_FILES))


def label_lines(contents: DataFrame) -> DataFrame:
    """Annotation lines with their one-based number; blanks and comments are dropped."""
    exploded = contents.select(
        *[c for c in contents.columns if c != "content"],
        F.posexplode(F.split("content", LINE_BREAK)).alias("_pos", "line"),
    )
    return (
        exploded.withColumn("line_number", F.col("_pos") + 1)
        .drop("_pos")
        .filter(is_content(F.col("line")))
    )


def is_blank(content: str = "content"):
    """True when a file holds nothing but white space."""
    return strip(F.col(content)) == ""


def parse_labels(lines: DataFrame) -> DataFrame:
    """Typed columns of annotation lines; unusable lines are dropped uncounted."""
    return parse_tokens(lines.withColumn("tokens", words(F.col("line")))).filter("parsed").drop(
        "tokens", "parsed"
    )


def label_class_counts(contents: DataFrame) -> DataFrame:
    """(rel_path, class_id, n): first tokens that are plain digits, of any value.

    Comment lines are not special here; their first token is no number.
    """
    lines = contents.select("rel_path", F.explode(F.split("content", LINE_BREAK)).alias("line"))
    token = F.get(words(F.col("line")), F.lit(0))
    digits = lines.select("rel_path", token.alias("token")).filter(F.col("token").rlike("^[0-9]+$"))
    return class_counts(
        digits.withColumn("class_id", F.col("token").try_cast("int")), "rel_path"
    )
