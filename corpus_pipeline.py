"""The corpus pipeline: five stages over `documents`, each writing what the next one reads.

Stages before the last return the columns of documents. Each is written as Parquet in the shared folder
and read again, so a lost executor costs tasks of one stage only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.llm import mixing, near_duplicates, packing, personal_data, quality
from gridmark.llm.tables import table
from gridmark.session import materialize

SEQUENCE_TOKENS, END_ID, EPOCHS, SEED = 2048, 0, 2.0, 17


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the risk-controlled rules reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one whose doc_id names the group. Null ids stay."""
    return near_duplicates.one_of_each(docs)


def personal_data_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts replaced by its kind; n_chars, if there, counts the new text."""
    clean = personal_data.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return clean


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of smaller sources up to twice, in the flattest mix that allows."""
    return mixing.mixed_documents(docs, seed=SEED, epochs=EPOCHS)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(docs, path, end_id=END_ID, capacity=SEQUENCE_TOKENS)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicate_groups),
    ("personal_data", personal_data_redaction),
    ("source_mixing", source_mixing),
    ("best_fit_packing", sequence_packing),
]

# No stage list as a whole is SQL: binomial bounds, tokenizers and packing are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
