"""From raw documents to packed sequences: toxic documents, exact and near copies go, live secrets are masked, the rest is packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import toxicity as tox
from plumbline.llm.best_fit_packing import best_fit_packing
from plumbline.llm.common import shared_table, table
from plumbline.llm.exact_dedup import drop_copies
from plumbline.llm.secret_scan import mask_secrets
from plumbline.llm.simhash_dedup import drop_near_copies


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold; labels of held-out documents are not learnt from."""
    labels = table(spark, sf_dir, "labels").where(~tox.held_out(F.col("doc_id")))
    return tox.drop_toxic(docs, tox.fit(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id."""
    return drop_copies(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents connected by fingerprints of four-word shingles at four or fewer differing bits the row with the smallest id."""
    return drop_near_copies(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking secrets masked; ``n_chars``, where there is one, follows the text."""
    masked = mask_secrets(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids and their places in as few sequences as best fit finds."""
    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity), ("exact_dedup", exact_dedup), ("simhash_dedup", simhash_dedup), ("secret_scan", secret_scan), ("best_fit_packing", best_fit),
]

#: The scoring model, fingerprints and tokenizer are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return shared_table(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
