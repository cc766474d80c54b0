from __future__ import annotations

import pandas as pd
import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture()
def docs(spark):
    """Makes documents of texts or (doc_id, text) pairs, with extra columns whose names operators might use themselves."""

    def make(texts, extra: bool = True):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], DOCUMENTS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("key", "_key", "_cuts", "fp", "rep", "n", "h", "score", "pos", "part", "component", "_label"):
                df = df.withColumn(name, F.lit("x"))
        return df.repartition(3)

    return make


@pytest.fixture(scope="session")
def sample():
    """doc_id and text of the smallest test table."""
    return pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]]
