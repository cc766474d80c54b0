"""The stages of the corpus pipeline: each applies one operator of this subpackage to documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packing, pii, quality, simhash, substring
from .common import DOCUMENT_COLUMNS, table


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, with the number of characters of the text as it is now; that of a null text is null."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as good; the others go."""
    return quality.scored(docs, table(spark, sf_dir, "labels"), keep=True).select(*DOCUMENT_COLUMNS)


def deduplicate_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id."""
    return simhash.deduplicated(docs).select(*DOCUMENT_COLUMNS)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that a document of a smaller doc_id holds too."""
    return _documents(substring.cut(docs))


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return _documents(pii.masked(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
