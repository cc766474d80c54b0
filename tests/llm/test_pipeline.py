"""The pipeline's stages against the plain forms of their decisions."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tesserae.llm import pii, queries
from tesserae.llm.common import DOCUMENT_COLUMNS, table

from .conftest import DOCUMENTS, SF
from .test_pair_operators import plain_components, plain_fingerprint, plain_removed, words_of


def test_stages(spark):
    docs = table(spark, SF, "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF).cache()
        kept.append((name, docs, after))
        docs = after
    assert [k[0] for k in kept] == ["quality", "near_duplicates", "repeated_passages", "private_data", "packing"]
    assert all(k[2].columns == DOCUMENT_COLUMNS for k in kept[:-1])
    good = {r.doc_id for r in queries.op5_quality(spark, SF).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept[0][2].collect()} == good
    before = {r.doc_id: r.text for r in kept[1][1].collect()}
    groups = plain_components({i: plain_fingerprint(t) for i, t in before.items()})
    assert {r.doc_id for r in kept[1][2].collect()} == set(groups.values())
    before = {r.doc_id: r.text for r in kept[2][1].collect()}
    cut = {r.doc_id: r.text for r in kept[2][2].collect()}
    for i, (n, gone, _) in plain_removed(list(before.items())).items():
        assert len(words_of(cut[i])) == n - gone and (gone or cut[i] == before[i])
    masked = {r.doc_id: r.text for r in kept[3][2].collect()}
    assert masked == {i: pii.mask(t) for i, t in cut.items()}
    assert {r.doc_id for r in kept[4][2].collect()} == set(masked)
    assert corpus_pipeline.run(spark, SF).count() == kept[4][2].count()


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 2 + [(1, None, None, None, 0), (1, "", "en", "s", 0), (2, "w " * 40_000, None, None, None)]])
def test_odd_documents_pass_every_stage(spark, rows):
    docs = spark.createDataFrame(rows, DOCUMENTS)
    for name in ("key", "_key", "_cuts", "fp", "score", "_label", "component_id"):
        docs = docs.withColumn(name, F.lit(1))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() >= 0
