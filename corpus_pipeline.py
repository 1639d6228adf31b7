"""From raw documents to packed training sequences, one operator a stage.

Each stage takes what its predecessor kept, all rows and whole texts, and all but
the last return the columns of documents.  In every stage: a null text is a text
without words, lines or secrets, and stays; repeated rows are documents each; null
ids are ids like others; an empty table gives an empty one; columns beyond those
of documents, whatever their names, pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.llm import jaccard, lines, packing, secrets, toxicity
from ruleweave.llm.common import cut, drop_since, fresh, read, written

VOCABULARY, END_ID, CAPACITY = "byte_bpe_50k.json", 1, 2048


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; the model is learned from ``labels``."""
    return toxicity.reject(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a later copy of a three-line window covers go.

    A document of which no word is left then goes too: all of it stands in earlier
    documents.  One that was empty before stays.
    """
    made = (fresh(docs.columns, "_lines"), fresh(docs.columns, "_removed"))
    out = lines.dedup_lines(docs, made=made)
    return recounted(out.where((F.col(made[1]) == 0) | F.col("text").rlike(r"\S")).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id stays; those without words link with nothing."""
    return jaccard.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; every document stays."""
    return recounted(secrets.redact(docs).select(*docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of CAPACITY; a text without ids is one piece, the end id."""
    encoder = packing.bpe_encoder(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return packing.pack(docs, encoder, END_ID, CAPACITY)


def recounted(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars as its texts are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: A fitted toxicity model and byte-pair ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    mark = written()
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        drop_since(spark, mark)  # only the newest stage's table is read from here on
    return STAGES[-1][1](spark, docs, sf_dir)
