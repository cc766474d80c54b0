"""Queries of rules and their fusion, ontologies, merges of impacts, embeddings and decoded files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..graph import stored_graph, table
from ..operators import impact, patterns, shapes, tables, vectors
from ..sources import java
from ..streaming import events as stream
from .graph_queries import query


@query("SELECT event_id, unnest(['sensitive_data','region_rules','http_entry_point','large_unit','upstream_chain','open_suppliers']) shape_id FROM events WHERE event_id%2=0 AND event_id%3<2", graph=False)
def shp_05_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shapes of each request's label and operation; shapes are a list of rules."""
    asked = table(spark, sf_dir, "events").selectExpr("event_id", "if(event_id % 2 = 0, 'CodeEntity', 'DocEntity') label", "if(event_id % 3 < 2, 'UPDATE', 'READ') operation")
    return asked.join(F.broadcast(shapes.as_table(spark, shapes.SHAPES)), ["label", "operation"]).select("event_id", "shape_id")


FUSED_SQL = "SELECT n_nationkey::VARCHAR id, CASE n_nationkey%6 WHEN 0 THEN 'allow' WHEN 1 THEN 'warn' WHEN 2 THEN 'block' WHEN 3 THEN 'escalate' WHEN 4 THEN 'escalate' ELSE 'block' END decision, CASE n_nationkey%6 WHEN 0 THEN 0 WHEN 3 THEN 2 WHEN 5 THEN 2 ELSE 1 END::BIGINT n_triggered"


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by their key: no shape, a warning, a block, an escalation, a rule without priority, two equal blocks."""
    found = [(1, "w", "warn", 5, ""), (2, "b", "block", 10, "x"), (3, "e", "escalate", 2, ""), (3, "w", "warn", 5, ""), (4, "b", "block", 0, ""), (5, "b1", "block", 10, "a\nb "), (5, "b2", "block", 10, "b\nc")]
    rules = F.broadcast(spark.createDataFrame(found, "k long, shape_id string, severity string, priority int, suggestion string"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.pmod("n_nationkey", F.lit(6)).cast("long").alias("k"))
    return shapes.fused(n.select("id"), n.join(rules, "k").drop("k"))


@query(FUSED_SQL + " FROM nation", graph=False)
def shp_08_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("id", "decision", F.col("n_triggered").cast("long").alias("n_triggered"))


@query("SELECT n_nationkey::VARCHAR id, 'a'||chr(10)||'b'||chr(10)||'c' suggestion FROM nation WHERE n_nationkey%6=5", graph=False)
def shp_09_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal blocks unite the distinct lines of their suggestions."""
    return _fused(spark, sf_dir).where("decision = 'block' and n_triggered = 2").select("id", "suggestion")


def _ontology(spark: SparkSession, sf_dir: str, part: str) -> DataFrame:
    r, n, p = (table(spark, sf_dir, t) for t in ("region", "nation", "part"))
    types = n.selectExpr("cast(n_nationkey as string) id", "n_name name", "if(n_nationkey % 4 = 0, null, n_nationkey / 20.0D) confidence", "n_nationkey % 5 <> 0 is_entity_type")
    values = p.groupBy(F.col("p_brand").alias("id")).agg(F.array_sort(F.collect_set(F.when(F.col("p_size") > 40, F.col("p_type")))).alias("enum_values"))
    enums = values.select("id", F.col("id").alias("name"), "enum_values", F.lit(None).cast("double").alias("confidence"))
    relations = n.selectExpr("cast(n_nationkey as string) id", "if(n_nationkey % 2 = 0, 'calls', 'extends') relation_type", "'ResourceEntity' range_label", "n_nationkey / 20.0D confidence")
    given = {"type": types, "enum": enums, "rel": relations}
    none = [given[k] if k == part else given[k].where("false") for k in given]
    return shapes.from_ontology(*none)


@query("SELECT 'type_'||n_nationkey id, 'SELF' path, n_name AS value, least(1.0::DOUBLE, CASE WHEN n_nationkey%4=0 THEN 0.5 ELSE n_nationkey/20.0::DOUBLE END) confidence FROM nation WHERE n_nationkey%5<>0", graph=False)
def ont_01_entity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ontology(spark, sf_dir, "type").select("id", "path", "value", "confidence")


@query("SELECT 'enum_'||p_brand id, p_brand AS field, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS value, 'block' severity, 1.0::DOUBLE confidence FROM part WHERE p_size>40 GROUP BY p_brand", graph=False)
def ont_03_enumerations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ontology(spark, sf_dir, "enum").select("id", "field", "value", "severity", "confidence")


@query("SELECT 'rel_'||n_nationkey id, CASE WHEN n_nationkey%2=0 THEN 'CALLS' ELSE 'EXTENDS' END||' -> ResourceEntity' path, CASE WHEN n_nationkey/20.0::DOUBLE<0.7 THEN 'allow' ELSE 'warn' END severity FROM nation", graph=False)
def ont_04_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ontology(spark, sf_dir, "rel").select("id", "path", "severity")


@query("SELECT count(*) n FROM (SELECT (n_nationkey%10)/10.0+0.05 c FROM nation) WHERE c>=0.7", graph=False)
def fil_22_axiom_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axioms under a confidence of 0.7 give no shape."""
    concepts = table(spark, sf_dir, "region").selectExpr("cast(r_regionkey as string) concept_id", "r_name name")
    axioms = table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as string) axiom_id", "'DOMAIN' axiom_type", "cast(n_regionkey as string) subject", "'x' object", "cast((n_nationkey % 10) / 10.0 + 0.05 as double) confidence")
    return shapes.from_axioms(axioms, concepts).agg(F.count("*").alias("n"))


@query("SELECT node_id, direction, round(s,6) impact_score, d::INT AS depth, src source_node_id, rel relation_path FROM (SELECT 'p:'||l_partkey node_id, CASE WHEN l_suppkey%2=0 THEN 'forward' ELSE 'backward' END direction, l_quantity/100.0::DOUBLE s, l_linenumber%3+1 d, 's:'||l_suppkey src, lower(l_returnflag) rel, row_number() OVER (PARTITION BY l_partkey, l_suppkey%2=0 ORDER BY l_quantity DESC, l_linenumber%3, 's:'||l_suppkey, lower(l_returnflag)) r FROM lineitem) WHERE r=1", graph=False)
def gr_08_merged_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best impact of each node and direction over all sources, with the source and path that it came by."""
    found = table(spark, sf_dir, "lineitem").selectExpr("concat('p:', l_partkey) node_id", "if(l_suppkey % 2 = 0, 'forward', 'backward') direction", "l_quantity / 100.0D score", "l_linenumber % 3 + 1 depth", "concat('s:', l_suppkey) source_node_id", "array(lower(l_returnflag)) relation_path")
    best = impact.merged(found, stored_graph(spark, sf_dir).nodes.where("id like 'p:%'"))
    return best.select("node_id", "direction", "impact_score", "depth", "source_node_id", F.array_join("relation_path", ">").alias("relation_path"))


@query(""", w(rel, a, b) AS (VALUES ('calls',0.7::DOUBLE,0.9::DOUBLE),('implements',0.5,0.8),('extends',0.6,0.9),('imports',0.3,0.5),('semantic_impact',0.4,0.5)),
 steps AS (SELECT dst x, src y, rel_type, 'FORWARD' dir FROM edges UNION ALL SELECT src, dst, rel_type, 'BACKWARD' FROM edges),
 l AS (SELECT y node_id, dir, max(a) s FROM steps JOIN w ON rel=rel_type WHERE x LIKE 's:%' GROUP BY 1, 2 UNION ALL SELECT y, dir, max(b) FROM steps JOIN w ON rel=rel_type WHERE x LIKE 'n:%' GROUP BY 1, 2)
 SELECT node_id, dir AS direction, round(max(s), 6) score, count(*) n FROM l GROUP BY 1, 2""")
def set_02_united_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of impacts, of changed bodies of services and of changed signatures of modules, put together."""
    g = stored_graph(spark, sf_dir)
    lists = [impact.impact(g.edges, g.labelled(label).select("id", F.lit(change).alias("change")), 1) for label, change in (("ServiceEntity", "BODY"), ("ModuleEntity", "SIGNATURE"))]
    return lists[0].unionByName(lists[1]).groupBy("node_id", "direction").agg(F.round(F.max("score"), 6).alias("score"), F.count("*").alias("n"))


@query("SELECT arg_max(o_orderkey, (o_orderdate, o_orderkey)) latest FROM orders", graph=False)
def srt_10_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row by time, without a sort."""
    return table(spark, sf_dir, "orders").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("WITH h AS (SELECT event_type||':'||coalesce(json_extract_string(props,'$.k'),'unknown') signature, count(*)-1 hits FROM events GROUP BY 1), c AS (SELECT signature, hits, round(least(1.0, 0.5::DOUBLE+hits*0.1::DOUBLE),6) confidence FROM h) SELECT signature, confidence, row_number() OVER (ORDER BY confidence DESC, signature) place FROM c QUALIFY place <= 20", graph=False)
def srt_07_skills_by_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.skills_in_order(stream.reflection(table(spark, sf_dir, "events")), 20)
    return found.select("signature", "confidence", F.col("place").cast("long").alias("place"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey%3=0 THEN n.n_nationkey::VARCHAR END concept_id FROM orders JOIN customer ON c_custkey=o_custkey JOIN nation n ON n.n_nationkey=c_nationkey", graph=False)
def join_14_aligned_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations' concept names as the ids that they align with: each name is aligned once."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    concepts = n.selectExpr("cast(n_nationkey as string) concept_id", "n_name name", "array() aliases", "n_nationkey ord").withColumn("aliases", F.array().cast("array<string>"))
    relations = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("o_orderkey", "if(o_orderkey % 3 = 0, n_name, concat('no ', n_name)) name")
    return relations.join(vectors.align(relations.select("name"), concepts), "name", "left").select("o_orderkey", "concept_id")


@query("SELECT src id, n.name region, 'critical' severity FROM edges JOIN nodes n ON n.id=dst WHERE rel_type='semantic_impact' AND n.name IN ('ASIA','EUROPE')")
def act_08_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities subject to items of high severity."""
    g = stored_graph(spark, sf_dir)
    items = g.labelled("RepositoryEntity").where("name in ('ASIA', 'EUROPE')").select(F.col("id").alias("node"), F.col("name").alias("region"))
    return patterns.paths(g.typed("semantic_impact"), g.nodes, 1, 1).join(items, "node").select(F.col("start").alias("id"), "region", F.lit("critical").alias("severity"))


@query("WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) w FROM benchmark), s AS (SELECT item_id, ('0x'||substr(md5(w),1,8))::BIGINT%32 s, count(*) n FROM w GROUP BY 1,2), g AS (SELECT item_id, unnest(range(32)) s FROM benchmark) SELECT g.item_id, string_agg(coalesce(n,0)::INT::VARCHAR, ',' ORDER BY g.s) AS vector FROM g LEFT JOIN s USING (item_id, s) GROUP BY 1", graph=False)
def vec_04_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed counts of words, the embedding that needs no model."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.transform(vectors.hashed(F.col("text"), 32), lambda x: x.cast("int").cast("string")), ",").alias("vector"))


@query("SELECT concept_id, n_name AS name FROM (SELECT n_nationkey::VARCHAR concept_id, n_name FROM nation)", graph=False)
def vec_12_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("concept_id"), F.col("n_name").alias("name"))




JAVA = """package s{n};
import base.{{Root}}{n};
/* class Gone { */
@Service("x")
public class S{k} extends Root{n} implements Api, Other<T> {
    public S{k}(Repo r) { this.r = r; }
    public int find(final Map<String, Integer> m) {
        helper{n}(new Item("}"));
        restTemplate.getForObject("http://svc{n}/a");
        kafkaTemplate.send("topic.{n}", m);
        return m.size();
    }
}
""".replace("{{Root}}", "Root")
_JAVA_SQL = "WITH c AS (SELECT s_suppkey k, s_nationkey n, 'src/S'||s_suppkey||'.java' file_path FROM supplier)"


def _java(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Java file for each supplier, as entities and relations."""
    body = F.lit(JAVA)
    for mark, c in (("{k}", "s_suppkey"), ("{n}", "s_nationkey")):
        body = F.replace(body, F.lit(mark), F.col(c).cast("string"))
    return java.java_entities(table(spark, sf_dir, "supplier").select(F.format_string("src/S%d.java", F.col("s_suppkey")).alias("path"), body.cast("binary").alias("content")))


@query(_JAVA_SQL + " SELECT file_path, 'module' kind, 's'||n AS name, 0 start_line, 13 end_line FROM c UNION ALL SELECT file_path, 'class', 'S'||k, 4, 12 FROM c UNION ALL SELECT file_path, 'constructor', 'S'||k||'.<init>(Repo)', 5, 5 FROM c UNION ALL SELECT file_path, 'method', 'S'||k||'.find(Map)', 6, 11 FROM c", graph=False)
def prs_06_java_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _java(spark, sf_dir).where("kind in ('module', 'class', 'constructor', 'method')").select("file_path", "kind", "name", "start_line", "end_line")


@query(_JAVA_SQL + ", r AS (SELECT file_path, k, n, unnest(['extends','implements','implements','imports','calls','calls','calls','uses']) kind, unnest(['Root'||n,'Api','Other','Root'||n,'helper'||n,'getForObject','send','Item']) target FROM c) SELECT file_path, kind, target FROM r", graph=False)
def prs_07_java_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What types extend, implement and import, and methods call and use, without the platform's own names."""
    return _java(spark, sf_dir).where("kind in ('extends', 'implements', 'imports', 'calls', 'uses')").select("file_path", "kind", "target")


@query(_JAVA_SQL + " SELECT file_path, 'calls_service' kind, 'svc'||n target FROM c UNION ALL SELECT file_path, 'publishes_to', 'topic.'||n FROM c", graph=False)
def prs_11_java_external_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _java(spark, sf_dir).where("kind in ('calls_service', 'publishes_to')").select("file_path", "kind", "target")
