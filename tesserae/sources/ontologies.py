"""Ontologies in JSON as tables of entity types, properties, relations and axioms, and digest snapshots of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMON = "id: string, name: string, confidence: double, source: string"
SCHEMA = (
    f"entity_types array<struct<{_COMMON}, is_entity_type: boolean, aliases: array<string>, description: string>>,"
    f" properties array<struct<{_COMMON}, domain_concept_id: string, value_type: string, enum_values: array<string>>>,"
    f" relations array<struct<{_COMMON}, domain_concept_id: string, range_concept_id: string, cardinality: string>>,"
    " axioms array<struct<axiom_type: string, subject: string, object: string, confidence: double>>"
)


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The four parts of the ontologies at path, a table each; missing parts are empty, malformed files fail."""
    whole = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return {part: whole.select(F.explode(part).alias("x")).select("x.*") for part in whole.columns}


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of a JSON object from paths to digests."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("path", "sha256"))


def write_snapshot(files: DataFrame, path: str) -> None:
    """The digests of files (path, content), as rows; a snapshot of very many files is never one object."""
    files.select("path", F.sha2("content", 256).alias("sha256")).write.mode("overwrite").parquet(path)
