"""Queries that run streams to their end, and of a graph that changes by commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import EDGE_COLUMNS, NODE_COLUMNS, Graph, stored_graph, table
from ..graph_log import GraphLog
from ..operators import entity_actions
from ..shared import new_path
from ..sources import parsing
from ..streaming import cascade, skills, updates, watcher
from ..streaming import events as stream
from .graph_queries import query
from .link_queries import UPDATE_SQL


def _fail(rows: DataFrame, batch_id: int) -> None:
    raise RuntimeError("no index")


def _cascaded(spark: SparkSession, sf_dir: str) -> str:
    """All events through handlers of all, of clicks and of views, the last of which fails; the folder of what they made."""
    folder = new_path(spark)
    kept = lambda name: lambda rows, i: rows.write.mode("overwrite").parquet(f"{folder}/{name}/{i}")
    handlers = [cascade.Handler("audit", ("*",), kept("audit")), cascade.Handler("build", ("click", "signup"), kept("build"), deadline=600), cascade.Handler("index", ("view",), _fail, retries=1)]
    # A pattern of one name, as a stream's path must be a folder or a pattern.
    cascade.cascade(stream.read(spark, f"{sf_dir}/event[s].parquet"), handlers, folder)
    return folder


HANDLED_SQL = "WITH h AS (SELECT event_type, json_extract_string(props,'$.k') k, unnest(CASE event_type WHEN 'click' THEN ['audit','build'] WHEN 'signup' THEN ['audit','build'] WHEN 'view' THEN ['audit','index'] ELSE ['audit'] END) AS handler FROM events)"


@query(HANDLED_SQL + " SELECT handler, CASE WHEN handler='index' THEN 'handler.failed' ELSE 'handler.completed' END AS event_type, event_type AS original_event_type, CASE WHEN handler='index' THEN 2 ELSE 1 END AS attempts, CASE WHEN handler='index' THEN 'no index' END AS error, count(*) n FROM h GROUP BY ALL", graph=False)
def str_04_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events dispatched to handlers with retries, and the completions that follow, counted."""
    done = spark.read.schema(cascade.COMPLETIONS).option("recursiveFileLookup", "true").parquet(f"{_cascaded(spark, sf_dir)}/done")
    return done.groupBy("handler", "event_type", "original_event_type", "attempts", "error").agg(F.count("*").alias("n"))


@query(HANDLED_SQL + ", s AS (SELECT coalesce(event_type,'unknown')||':'||coalesce(k,'unknown') signature, count(*)-1 hits FROM h WHERE handler<>'index' GROUP BY 1) SELECT signature, hits, round(least(1.0, 0.5::DOUBLE+hits*0.1::DOUBLE),6) confidence, CASE WHEN least(1.0,0.5::DOUBLE+hits*0.1::DOUBLE)>=0.8::DOUBLE THEN 'active' ELSE 'candidate' END layer, (hits>=3)::INT::BIGINT n_promotions FROM s", graph=False)
def str_07_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second level of the cascade: completions as sights of keyed state, and how often each skill was promoted."""
    folder = _cascaded(spark, sf_dir)
    completed = cascade.completed(spark, f"{folder}/done").where("ok")
    skills.run(completed.select(skills.signature(F.col("original_event_type"), F.col("props")).alias("signature"), F.lit(None).cast("timestamp").alias("seen")), f"{folder}/skills", f"{folder}/state")
    found = spark.read.schema(skills.CHANGES).parquet(f"{folder}/skills")
    promoted = found.groupBy("signature").agg(F.count_if(F.col("kind") == "promoted").alias("n_promotions"))
    return skills.current(found).join(promoted, "signature")


def _as_graph(files: DataFrame) -> Graph:
    """Files named by a number, each a node that describes that of half its number."""
    n = F.split("path", r"\.")[0].cast("long")
    known = {"id": F.concat(F.lit("d:"), n), "label": F.lit("DocEntity"), "name": n.cast("string"), "entity_type": F.lit("document"), "file_path": F.col("path")}
    nodes = files.select(*[known.get(c, F.lit(None)).cast("int" if c == "lines" else "string").alias(c) for c in NODE_COLUMNS])
    edges = files.where(n > 0).select(F.concat(F.lit("d:"), n).alias("src"), F.concat(F.lit("d:"), F.expr("cast(split(path, '[.]')[0] as long) div 2")).alias("dst"), F.lit("describes").alias("rel_type"), F.lit(1.0).alias("weight"))
    return Graph(nodes, edges.select(EDGE_COLUMNS))


@query(UPDATE_SQL + """, kept AS (SELECT a, b FROM e WHERE a NOT IN (SELECT id FROM c) AND b NOT IN (SELECT id FROM c)), made AS (SELECT f.id a, f.id // 2 b FROM f JOIN af ON af.id = f.id // 2 WHERE f.id > 0)
 SELECT since, ref, changes_detected, nodes_added, nodes_updated, nodes_deleted, relations_rebuilt, impacted_nodes, docs_flagged, n_nodes, n_edges, n_cached FROM (SELECT 'v0' since, 'v1' AS ref, (SELECT count(*) FROM c) changes_detected, (SELECT count(*) FROM c WHERE k='ADDED') nodes_added, (SELECT count(*) FROM c WHERE k='BODY') nodes_updated, (SELECT count(*) FROM c WHERE k='DELETED') nodes_deleted,
 (SELECT count(*) FROM made) relations_rebuilt, (SELECT count(*) FROM i) impacted_nodes, (SELECT count(DISTINCT y) FROM i) docs_flagged, (SELECT count(*) FROM af) n_nodes, (SELECT count(*) FROM (SELECT * FROM kept UNION SELECT * FROM made)) n_edges, (SELECT count(*) FROM f) n_cached)""", graph=False)
def inc_05_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of documents: the watcher sees the second one, and the update is one commit of a graph log."""
    path = new_path(spark)
    d = table(spark, sf_dir, "documents")
    snapshots = [d.where("doc_id % 10 <> 0").selectExpr("concat(doc_id, '.md') path", "text content"), d.where("doc_id % 7 <> 0").selectExpr("concat(doc_id, '.md') path", "if(doc_id % 3 = 0, concat(text, '!'), text) content")]
    read = lambda ref: spark.read.schema("path string, content string").parquet(f"{path}/snapshots/{ref}")
    log = None
    for k, files in enumerate(snapshots):
        files.write.parquet(f"{path}/snapshots/v{k}")
        if log is None:
            g = _as_graph(read("v0"))
            ids = g.nodes.select(F.col("id").alias("dst"))
            log = GraphLog(spark, f"{path}/log").create(Graph(g.nodes, g.edges.join(ids, "dst", "left_semi").select(EDGE_COLUMNS)))
        # The first poll is silent.
        updates.run(watcher.watch(spark, f"{path}/snapshots"), log, read, _as_graph, f"{path}/checkpoint")
    n = lambda name: log.table(name).agg(F.count("*").alias(f"n_{name}"))
    # One row each.
    made = log.table("changesets").drop("changeset_id", "concepts_flagged").crossJoin(n("nodes")).crossJoin(n("edges")).crossJoin(n("cache"))
    return made.withColumnRenamed("n_cache", "n_cached")


@query("""SELECT label, count(*) n, count(*) FILTER (name LIKE '%!') n_renamed, sum(coalesce(lines, 0))::BIGINT n_lines FROM
 (SELECT id, label, CASE WHEN label='ServiceEntity' AND substr(id, 3)::INT % 2 = 0 THEN name||'!' ELSE name END AS name, CASE WHEN label='ServiceEntity' AND substr(id, 3)::INT % 2 = 0 THEN 7 ELSE lines END AS lines FROM nodes WHERE NOT (label='ModuleEntity' AND substr(id, 3)::INT % 5 = 0)
  UNION ALL SELECT 'k:'||substr(id, 3), 'ConceptEntity', name, NULL FROM nodes WHERE label='RepositoryEntity') GROUP BY 1""")
def snk_01_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored graph with services renamed, concepts added and modules gone, by commits on top of its files, then compacted."""
    log = GraphLog(spark, new_path(spark)).create(stored_graph(spark, sf_dir))
    n = log.table("nodes")
    number = F.substring("id", 3, 20).cast("int")
    log.upsert("nodes", n.where((F.col("label") == "ServiceEntity") & (number % 2 == 0)).select("id", "label", F.concat("name", F.lit("!")).alias("name"), F.lit(7).alias("lines")), txn="renamed")
    log.upsert("nodes", n.where("label = 'RepositoryEntity'").select(F.concat(F.lit("k:"), F.substring("id", 3, 20)).alias("id"), F.lit("ConceptEntity").alias("label"), "name"))
    log.delete_nodes(log.table("nodes").where((F.col("label") == "ModuleEntity") & (number % 5 == 0)).select("id"))
    log.compact()
    return log.table("nodes").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.endswith("name", F.lit("!"))).alias("n_renamed"), F.sum(F.coalesce("lines", F.lit(0))).alias("n_lines"))


#: Orders as requests: updates of services, new concepts, relations of concepts to services, queries, notices, and bad ones.
REQUESTS_SQL = """, q AS (SELECT o_orderkey k, CASE o_orderkey%6 WHEN 0 THEN 'update' WHEN 1 THEN 'create' WHEN 2 THEN 'relate' WHEN 3 THEN 'query' WHEN 4 THEN 'notify' ELSE 'fly' END AS action FROM orders WHERE o_orderkey < 2000),
 j AS (SELECT k, action, CASE action WHEN 'update' THEN CASE WHEN k%5=0 THEN 'no properties' END WHEN 'create' THEN CASE WHEN k%5=0 THEN 'no such label: Thing' END WHEN 'relate' THEN CASE WHEN k%5=0 THEN 'no relation or end' END WHEN 'query' THEN CASE WHEN 's:'||k NOT IN (SELECT id FROM nodes) THEN 'no such entity' END WHEN 'notify' THEN CASE WHEN k%5=0 THEN 'no recipients' END ELSE 'no such action: fly' END AS error FROM q)"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    null = {c: f"cast(null as {'int' if c == 'lines' else 'string'})" for c in NODE_COLUMNS[2:]}
    known = {
        "request_id": "o_orderkey", "action": "element_at(array('update', 'create', 'relate', 'query', 'notify', 'fly'), cast(o_orderkey % 6 + 1 as int))",
        "entity_id": "case when o_orderkey % 6 in (1, 2) then concat('k:', o_orderkey div 6) else concat('s:', o_orderkey) end", "label": "case when o_orderkey % 6 <> 1 then null when o_orderkey % 5 = 0 then 'Thing' else 'ConceptEntity' end",
        "rel_type": "if(o_orderkey % 5 = 0, null, 'derived_from')", "to_id": "concat('s:', o_orderkey)", "recipients": "if(o_orderkey % 5 = 0, cast(array() as array<string>), array('team'))",
    } | null | {"name": "if(o_orderkey % 6 <= 1 and o_orderkey % 5 <> 0, concat('order ', o_orderkey), null)"}
    return table(spark, sf_dir, "orders").where("o_orderkey < 2000").selectExpr(*[f"{v} {k}" for k, v in known.items()])


@query(REQUESTS_SQL + " SELECT k request_id, action, error IS NULL AS success, error FROM j")
def act_04_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_actions.judged(_requests(spark, sf_dir), stored_graph(spark, sf_dir).nodes).select("request_id", "action", "success", "error")


@query(REQUESTS_SQL + """, ok AS (SELECT * FROM j WHERE error IS NULL), made AS (SELECT 's:'||k id, 'order '||k AS name, 'CodeEntity' label FROM ok WHERE action='update' UNION ALL SELECT 'k:'||(k//6), 'order '||k, 'ConceptEntity' FROM ok WHERE action='create')
 SELECT coalesce(n.id, m.id) id, coalesce(n.label, m.label) label, coalesce(m.name, n.name) AS name, (SELECT count(DISTINCT 's:'||k) FROM ok WHERE action='relate' AND 'k:'||(k//6)=coalesce(n.id, m.id) AND ('s:'||k IN (SELECT id FROM nodes) OR 's:'||k IN (SELECT id FROM made))) n_relations FROM (SELECT * FROM nodes WHERE label='ServiceEntity') n FULL JOIN made m ON m.id=n.id""")
def act_04_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services and concepts after the requests are applied, twice to no other effect."""
    log = GraphLog(spark, new_path(spark)).create(stored_graph(spark, sf_dir))
    for _ in range(2):
        entity_actions.applied(log, _requests(spark, sf_dir), "requests")
    g = log.graph()
    nodes = g.nodes.where("label in ('ServiceEntity', 'ConceptEntity') or (label = 'CodeEntity' and id like 's:%')")
    n = g.typed("derived_from").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return nodes.join(n, "id", "left").select("id", "label", "name", F.coalesce("n", F.lit(0)).alias("n_relations"))


@query("""WITH d AS (SELECT doc_id i, doc_id%2 odd, doc_id%5=0 bad FROM documents) SELECT kind, count(*) n FROM (SELECT 'module' kind FROM d UNION ALL SELECT 'parse_error' FROM d WHERE bad AND odd=0 UNION ALL SELECT unnest(['class','function','calls']) FROM d WHERE NOT bad AND odd=0 UNION ALL SELECT unnest(['class','method','calls','uses']) FROM d WHERE NOT bad AND odd=1) GROUP BY 1""", graph=False)
def prs_01_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of two languages, with their first word in a string; every fifth is broken, and its root row stays."""
    text = "regexp_extract(coalesce(text, ''), '([A-Za-z]+)', 1)"
    python = f"if(doc_id % 5 = 0, 'class (:', concat('class D', doc_id, ':\n    def go(self):\n        helper', doc_id % 3, '(\"', {text}, '\")\n'))"
    plain = f"if(doc_id % 5 = 0, 'nothing here', concat('package p; class D', doc_id, ' {{ void go(int a) {{ helper', doc_id % 3, '(\"', {text}, '\"); Item', doc_id % 7, ' x = new Item', doc_id % 7, '(); }} }}'))"
    sources = table(spark, sf_dir, "documents").selectExpr("concat('src/d', doc_id, if(doc_id % 2 = 0, '.py', '.java')) path", f"encode(if(doc_id % 2 = 0, {python}, {plain}), 'UTF-8') content")
    return parsing.entities(sources).groupBy("kind").agg(F.count("*").alias("n"))
