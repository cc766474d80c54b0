"""Queries that write files and read them back, and of operators that others only use inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph, table
from ..operators import shapes, tables, vectors
from ..shared import new_path
from ..sources import files, ontologies, rules
from ..streaming import events as stream
from .graph_queries import CALLS_SQL, _calls, query


@query("SELECT lang, sum(len(string_split(coalesce(text,''), chr(10))))::BIGINT n_lines, count(*) FILTER (doc_id % 3 = 0) n_marks FROM documents GROUP BY 1", graph=False)
def src_01_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files in folders of their language, of two kinds and one folder to skip, scanned again."""
    root = new_path(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("value"))
    parts = {"all": d, "build": d, "marks": d.where("doc_id % 3 = 0").withColumn("value", F.lit("x"))}
    for name, rows in parts.items():
        rows.drop("doc_id").write.option("maxRecordsPerFile", 500).partitionBy("lang").text(f"{root}/{name}")
    found = files.scan(spark, root, (".txt",)).select(F.regexp_extract("path", "lang=([^/]*)", 1).alias("lang"), F.regexp_extract("path", "/(all|marks|build)/", 1).alias("kind"), F.regexp_count(F.decode("content", "UTF-8"), F.lit("\n")).cast("long").alias("n"))
    n = lambda kind, name: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).alias(name)
    return found.groupBy("lang").agg(n("all", "n_lines"), n("marks", "n_marks"))


@query("SELECT 'concept_'||n_nationkey id, n_name AS name, n_nationkey/25.0::DOUBLE confidence, n_nationkey%5<>0 is_entity_type FROM nation", graph=False)
def src_10_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as the entity types of an ontology in one JSON file, read again; an ontology is no data and small."""
    path = new_path(spark)
    n = table(spark, sf_dir, "nation").selectExpr("concat('concept_', n_nationkey) id", "n_name name", "n_nationkey / 25.0D confidence", "n_nationkey % 5 <> 0 is_entity_type")
    n.agg(F.to_json(F.struct(F.collect_list(F.struct("*")).alias("entity_types"))).alias("value")).write.text(path)
    return ontologies.read(spark, path)["entity_types"].select("id", "name", "confidence", "is_entity_type")


@query("SELECT doc_id||'.md' path, sha256(coalesce(text,'')) sha256 FROM documents", graph=False)
def snk_15_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of documents as files, saved as a snapshot and read again."""
    path = new_path(spark)
    ontologies.write_snapshot(table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content")), path)
    return spark.read.parquet(path)


@query("SELECT q.vec_id query_id, v.vec_id id FROM embeddings q JOIN embeddings v ON v.vec_id<>q.vec_id WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY 1-list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), v.vec_id) = 1", graph=False)
def srt_05_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vectors.search(v, v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")), 1).select("query_id", "id")


@query("SELECT role AS action, conv_id AS target FROM conversations ORDER BY conv_id*1000+turn DESC LIMIT 1", graph=False)
def srt_08_last_audit_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = table(spark, sf_dir, "conversations").selectExpr("conv_id * 1000 + turn ord", "role action", "conv_id target")
    return tables.last_row(audit).select("action", "target")


@query("SELECT event_type AS handler, count(*) FILTER (value >= 10) n_ok, count(*) FILTER (value < 10) n_failed FROM events GROUP BY 1", graph=False)
def agg_16_handler_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.handler_counts(_handled(spark, sf_dir))


@query("SELECT CASE WHEN value >= 10 THEN 'handler.completed' ELSE 'handler.failed' END event_type, 'engine' AS source, event_id AS of, event_type AS handler FROM events", graph=False)
def str_05_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One completed or failed event for every handled one."""
    return stream.completions(_handled(spark, sf_dir))


def _handled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("value is not null").select("event_id", F.col("event_type").alias("handler"), (F.col("value") >= 10).alias("ok"))


@query(CALLS_SQL + " SELECT DISTINCT 'c:'||callee AS id FROM walk JOIN customer ON c_custkey=caller WHERE c_mktsegment='BUILDING' AND hops <= 5", graph=False)
def shp_11_upstream_entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that entry points call over up to five calls: a path against the edges' direction."""
    g = _calls(spark, sf_dir)
    nodes = g.nodes.withColumn("label", F.lit("CodeEntity"))
    return shapes.triggered(Graph(nodes, g.edges), shapes.Shape("upstream", "^CALLS{1,5} -> CodeEntity", "entry_category", "in", ("http_api", "rpc_service"), "warn", 6, max_depth=5))


@query(CALLS_SQL + """ SELECT 'c:'||c_custkey id, 'shape:sensitive_data' shape_id, 'block' severity, 10::BIGINT priority FROM customer WHERE c_nationkey%4 < 2 UNION ALL SELECT 'c:'||c_custkey, 'shape:compliance_check', 'block', 8 FROM customer WHERE c_custkey%5 < 2 AND c_custkey%5 IN (SELECT r_regionkey FROM region)
 UNION ALL SELECT 'c:'||c_custkey, 'shape:http_entry_point', 'warn', 5 FROM customer WHERE c_mktsegment='BUILDING' UNION ALL SELECT 'c:'||c_custkey, 'shape:refactor_large_code_unit', 'warn', 3 FROM customer WHERE c_custkey%200 > 100
 UNION ALL SELECT DISTINCT 'c:'||callee, 'shape:upstream_call_chain_risk', 'warn', 6 FROM walk JOIN customer k ON k.c_custkey=caller JOIN customer t ON t.c_custkey=callee WHERE k.c_mktsegment='BUILDING' AND hops <= 5""", graph=False)
def shp_11_built_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five built-in rules: customers as code that works on nations as data, is subject to regions as rules, and calls one another."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    null = {"id": "", "label": "", "name": "null", "entry_category": "null", "sensitivity": "null", "severity": "null", "lines": "cast(null as int)"}
    node = lambda df, **known: df.selectExpr(*[f"cast({v} as {'int' if k == 'lines' else 'string'}) {k}" for k, v in (null | known).items()])
    nodes = node(c, id="concat('c:', c_custkey)", label="'CodeEntity'", name="c_name", entry_category="if(c_mktsegment = 'BUILDING', 'http_api', null)", lines="c_custkey % 200")
    nodes = nodes.unionByName(node(n, id="concat('n:', n_nationkey)", label="'DataAsset'", sensitivity="element_at(array('restricted', 'confidential', 'internal', 'public'), cast(n_nationkey % 4 + 1 as int))"))
    nodes = nodes.unionByName(node(r, id="concat('r:', r_regionkey)", label="'ComplianceItem'", severity="element_at(array('critical', 'high', 'medium', 'low', 'low'), cast(r_regionkey + 1 as int))"))
    edge = lambda b, kind: c.selectExpr("concat('c:', c_custkey) src", f"{b} dst", f"'{kind}' rel_type", "1.0D weight")
    edges = edge("concat('n:', c_nationkey)", "processes_data").unionByName(edge("concat('r:', c_custkey % 5)", "subject_to")).unionByName(_calls(spark, sf_dir).edges)
    return shapes.results(Graph(nodes, edges), rules.built_in()).select("id", "shape_id", "severity", F.col("priority").cast("long").alias("priority"))


@query("""WITH f AS (SELECT c_mktsegment AS name, min(c_custkey) k FROM customer GROUP BY 1), a AS (SELECT 'nation '||c_nationkey AS name, max(c_custkey) k FROM customer GROUP BY 1)
 SELECT name, 'c'||k concept_id, 'exact' AS method FROM f UNION ALL SELECT name, 'c'||k, 'alias' FROM a""", graph=False)
def vec_10_concept_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of concepts with equal names the first counts, of equal aliases, in any case, the last."""
    c = table(spark, sf_dir, "customer")
    concepts = c.selectExpr("concat('c', c_custkey) concept_id", "c_mktsegment name", "array(concat('Nation ', c_nationkey)) aliases", "c_custkey ord")
    names = c.selectExpr("c_mktsegment name").unionByName(c.selectExpr("concat('nation ', c_nationkey) name"))
    return vectors.align(names, concepts).select("name", "concept_id", "method")
