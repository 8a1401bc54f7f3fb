"""Resolving raw labels to class ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmark.functions.tokens import looks_like_index, strip
from gridmark.vocabulary import Vocabulary, fold_label

# Dimension rows come from driver-side dictionaries, so their number is known
# before the job starts; larger ones are left to the optimiser's own choice.
BROADCAST_ROWS = 100_000


def _dimension(spark, rows: list, schema: str) -> DataFrame:
    frame = spark.createDataFrame(rows, schema)
    return F.broadcast(frame) if len(rows) <= BROADCAST_ROWS else frame


def map_classes(
    df: DataFrame,
    vocab: Vocabulary | None = None,
    label: str = "raw_label",
    dataset: str | None = None,
    out: str = "class_id",
    digits_are_ids: bool = True,
) -> DataFrame:
    """Add the class id of a raw label, NULL when no rule knows it.

    The rules, first hit wins: the map of the row's dataset; for integers, the
    canonical range; for other labels, symbol, alias and name as written, then
    the folded name, alias and two-letter code. An integer missing from its
    dataset map falls back to the canonical range.

    With ``digits_are_ids=False`` a label made of digits is an ordinary name, as
    in XML object names. The vocabulary is folded into at most three dimension tables on the driver,
    so a row costs three hash probes and no shuffle.
    """
    vocab = vocab or Vocabulary()
    spark = df.sparkSession
    text, index = f"_{label}_text", f"_{label}_index"
    is_index = looks_like_index(F.col(text)) if digits_are_ids else F.lit(False)
    keyed = df.withColumn(text, strip(F.col(label))).withColumn(
        index, F.when(is_index, F.col(text).try_cast("bigint"))
    )

    hits = []
    if dataset is not None and vocab.dataset_labels():
        # Integers match integer keys by value ("07" is 7), other labels match as
        # written; a text key that is all digits still matches an integer label.
        entries = vocab.dataset_labels()
        if not digits_are_ids:
            entries = [e for e in entries if not e[2]]
        # Integer keys come last, so they win over equal text keys.
        unique = {(d, k): c for d, k, _, c in sorted(entries, key=lambda e: e[2])}
        dim = _dimension(
            spark,
            [(d, k, c) for (d, k), c in unique.items()],
            "_map_dataset STRING, _map_label STRING, _map_class INT",
        )
        probe = F.coalesce(F.col(index).cast("string"), F.col(label))
        keyed = keyed.join(
            dim,
            (F.col(dataset) == F.col("_map_dataset")) & (probe == F.col("_map_label")),
            "left",
        )
        hits.append(F.col("_map_class"))

    exact = _dimension(
        spark, list(vocab.exact_labels().items()), "_exact_label STRING, _exact_class INT"
    )
    folded = _dimension(
        spark, list(vocab.folded_labels().items()), "_folded_label STRING, _folded_class INT"
    )
    keyed = keyed.join(exact, F.col(text) == F.col("_exact_label"), "left").join(
        folded, fold_label(F.col(text)) == F.col("_folded_label"), "left"
    )
    last = len(vocab.names) - 1
    canonical = F.when(F.col(index).between(0, last), F.col(index).cast("int"))
    named = F.coalesce(F.col("_exact_class"), F.col("_folded_class"))
    hits.append(F.when(is_index, canonical).otherwise(named))
    return keyed.select(*df.columns, F.coalesce(*hits).alias(out))


def with_class_info(df: DataFrame, vocab: Vocabulary | None = None) -> DataFrame:
    """Join name, type, colour and symbol of each class id (twelve broadcast rows)."""
    vocab = vocab or Vocabulary()
    return df.join(F.broadcast(vocab.class_dim(df.sparkSession)), "class_id")
