"""The corpus pipeline: each stage works on all documents that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.common import materialise, table
from tesserae.llm.stages import deduplicate_near, filter_quality, mask_private, pack_sequences, remove_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", filter_quality),
    ("near_duplicates", deduplicate_near),
    ("repeated_passages", remove_repeats),
    ("private_data", mask_private),
    ("packing", pack_sequences),
]
#: No stage but the third is expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
