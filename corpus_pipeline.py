"""A training corpus from `documents`: quality, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kinfolk.llm import jaccard, mixing, packing, quality, secrets
from kinfolk.llm.common import documents, labels, save
from kinfolk.session import ship_package, small_batches


def prepare(spark: SparkSession) -> None:
    ship_package(spark)
    small_batches(spark)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    prepare(spark)
    return quality.accepted(docs, quality.fit(docs, labels(spark, sf_dir)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the document with the smallest id stays."""
    prepare(spark)
    return jaccard.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are taken out of the texts."""
    prepare(spark)
    return secrets.redacted(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in training order: the order of the files written from this, and of the rows in them."""
    prepare(spark)
    return mixing.curriculum(docs).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their token ids and places in sequences. `train_order`, from 0 to 1, is the document's place in the training order (copies of one have
    their own), and pieces of like length are dealt to sequences in this order."""
    prepare(spark)
    return packing.pack(mixing.in_order(docs, "train_order"), public_tokenizers.path("word_bpe_49k.json"), with_ids=True, order="train_order")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Models, compression and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = save(docs)
    return docs
