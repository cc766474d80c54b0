"""The queries opN_<name> of this subpackage over whole tables, with production parameters, and their SQL.

The repeated passages of op8 and the negatives of op12 have SQL. For the others the SQL engine has neither the hashes, tokenizers and image format
that the contracts name nor a form of the method; each of these is tested against brute force instead.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, hard_negatives, html_template, hyper_language, media, packing, pii, piece_codec, quality, simhash, substring, token_alignment, warc
from .common import table


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(table(spark, sf_dir, "pages"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both derivatives of a response record for each page, with digest and length of the record itself."""
    made = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return made.withColumn("n_bytes", F.length("record").cast("long")).withColumn("record_sha256", F.sha2("record", 256)).drop("record")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removed(table(spark, sf_dir, "documents"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("key") % 50 == 0)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row's label is moved on by one first, so that near vectors of another label exist."""
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.select("vec_id", "embedding", moved.alias("label")), F.col("key") % 50 == 0)


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyper_language.predicted(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_html, op2_pii, op3_pieces, op4_simhash, op5_quality, op6_warc, op7_packing, op8_substring, op9_ann, op10_media, op11_alignment, op12_negatives, op13_language)}

#: Windows of 50 words are put together by doubling (1, 2, 4, ... words from each position on), with their words as text.
OP8_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
word AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM doc),
w2 AS (SELECT *, w || ' ' || lead(w, 1) OVER (PARTITION BY doc_id ORDER BY pos) AS a FROM word),
w4 AS (SELECT doc_id, pos, w, a, a || ' ' || lead(a, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM w2),
w8 AS (SELECT doc_id, pos, w, a, b || ' ' || lead(b, 4) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM w4),
w16 AS (SELECT doc_id, pos, w, a, b || ' ' || lead(b, 8) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM w8),
w48 AS (SELECT doc_id, pos, w, a, b || ' ' || lead(b, 16) OVER (PARTITION BY doc_id ORDER BY pos) || ' ' || lead(b, 32) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM w16),
w50 AS (SELECT doc_id, pos, w, b || ' ' || lead(a, 48) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM w48),
least_key AS (SELECT p, min(doc_id) AS d FROM w50 WHERE p IS NOT NULL GROUP BY p),
cut AS (SELECT doc_id, pos, w, CASE WHEN d < doc_id THEN pos END AS c FROM w50 LEFT JOIN least_key USING (p)),
marked AS (SELECT doc_id, pos, w, max(c) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM cut),
kept AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS m, string_agg(w, ' ' ORDER BY pos) FILTER (NOT gone) AS k FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(m, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)
"""
#: Sums of products of whole numbers are exact in double precision.
OP12_SQL = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS e FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.e, v.e)::BIGINT AS s FROM v a, v WHERE a.vec_id % 50 = 0 AND v.vec_id <> a.vec_id),
pos AS (SELECT anchor_id, vec_id AS positive_id, s AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id) <= 5),
neg AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, s AS negative_score
 FROM pos JOIN pairs USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s AND 100 * s <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3
"""
ORACLE_SQL: dict[str, str] = {"op8_substring": OP8_SQL, "op12_negatives": OP12_SQL}
