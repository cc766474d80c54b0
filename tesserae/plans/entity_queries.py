"""Queries over entities: contexts, linking, capabilities, actions, skills, caches, migrations and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import entry_points
from ..functions import scalars as S
from ..graph import Graph, stored_graph, table
from ..operators import actions, capabilities, changes, impact, linking, patterns, shapes, store, tables, vectors
from ..streaming import events as stream
from .graph_queries import query
from .table_queries import CHANGES_SQL, SHAPES_SQL, SIGN_SQL, _changes

SAMPLE = 50


@query(f", s AS (SELECT id FROM nodes WHERE label IN ('ModuleEntity','RepositoryEntity','ServiceEntity') ORDER BY id LIMIT {SAMPLE}) SELECT src, dst, rel_type FROM edges WHERE src IN (FROM s) AND dst IN (FROM s)")
def gr_05_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first nodes of some labels by id, a stated number, and the edges among them."""
    g = stored_graph(spark, sf_dir)
    nodes = g.nodes.where(F.col("label").isin("ModuleEntity", "RepositoryEntity", "ServiceEntity")).orderBy("id").limit(SAMPLE)
    return patterns.induced(g.edges, nodes).select("src", "dst", "rel_type")


@query(", u AS (SELECT src h, dst t, least(src,dst)||rel_type||greatest(src,dst) e FROM edges UNION ALL SELECT dst, src, least(src,dst)||rel_type||greatest(src,dst) FROM edges) SELECT t node, 1 hops FROM u WHERE h='r:1' UNION ALL SELECT b.t, 2 FROM u a JOIN u b ON b.h=a.t AND a.e<>b.e WHERE a.h='r:1'")
def gr_06_undirected_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = stored_graph(spark, sf_dir)
    return patterns.paths(g.edges, g.nodes.where("id = 'r:1'"), 1, 2, "both").select("node", "hops")


@query("SELECT p_partkey, CASE WHEN p_size>=40 THEN 'CRITICAL' WHEN p_size>=25 THEN 'HIGH' WHEN p_size>=10 THEN 'MEDIUM' ELSE 'LOW' END severity FROM part", graph=False)
def gr_10_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", impact.severity(F.col("p_size") / 50.0).alias("severity"))


@query("SELECT e.src id, 'out' direction, rel_type, dst other, n.name FROM edges e JOIN nodes n ON n.id=dst WHERE src IN ('n:3','p:7') UNION ALL SELECT dst, 'in', rel_type, src, n.name FROM edges JOIN nodes n ON n.id=src WHERE dst IN ('n:3','p:7')")
def gr_20_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("n:3",), ("p:7",)], "id string")
    return patterns.context(stored_graph(spark, sf_dir), wanted)


@query("SELECT count(*) n FROM (SELECT id FROM nodes WHERE label='CodeEntity' AND id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges) LIMIT 100)")
def gr_21_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many code entities are isolated, counted up to 100 as a report does."""
    return patterns.isolated(stored_graph(spark, sf_dir), "CodeEntity").limit(100).agg(F.count("*").alias("n"))


@query("SELECT id, name, 'suggestion' how FROM (SELECT id, name FROM nodes WHERE label='CodeEntity' AND name LIKE '%ring%' ORDER BY name, id LIMIT 5)")
def gr_23_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.lookup(stored_graph(spark, sf_dir).labelled("CodeEntity"), "ring")


@query("SELECT c.dst customer, p.dst part, count(*) n FROM edges c JOIN edges p ON p.src=c.src WHERE c.rel_type='calls' AND p.rel_type='imports' GROUP BY 1,2")
def join_03_shared_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two patterns that share their start: customers and parts that meet in orders."""
    g = stored_graph(spark, sf_dir)
    c, p = g.typed("calls").select("src", F.col("dst").alias("customer")), g.typed("imports").select("src", F.col("dst").alias("part"))
    return c.join(p, "src").groupBy("customer", "part").agg(F.count("*").alias("n"))


@query("SELECT substr(sha256('module|'||o_orderpriority),1,32) id, o_orderpriority AS name, count(*) n_imports FROM orders WHERE o_orderpriority NOT IN (SELECT 'HIGH' UNION SELECT '1-URGENT') GROUP BY o_orderpriority", graph=False)
def join_08_external_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("HIGH",), ("1-URGENT",)], "name string")
    return linking.external_modules(table(spark, sf_dir, "orders").selectExpr("o_orderpriority target_name"), known)


WANTED_SQL = "WITH e AS (SELECT p_partkey id, p_type t, p_brand f, p_name n FROM part), w AS (SELECT p_partkey wid, p_type t, CASE WHEN p_partkey%3=0 THEN p_brand WHEN p_partkey%3=1 THEN 'elsewhere' ELSE p_brand END f, CASE WHEN p_partkey%5=0 THEN 'none' ELSE p_name END n FROM part), x AS (SELECT t,f,n,min(id) id FROM e GROUP BY ALL), l AS (SELECT t,n,min(id) id FROM e GROUP BY ALL)"


def _resolved(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    p = table(spark, sf_dir, "part")
    entities = p.selectExpr("p_partkey id", "p_type entity_type", "p_brand file_path", "p_name name", "p_partkey ord")
    wanted = p.selectExpr("p_partkey wid", "p_type entity_type", "case when p_partkey % 3 = 1 then 'elsewhere' else p_brand end file_path", "case when p_partkey % 5 = 0 then 'none' else p_name end name")
    return linking.resolve_typed(wanted, entities, strict).select("wid", "id", "how")


@query(WANTED_SQL + " SELECT wid, coalesce(x.id,l.id) id, CASE WHEN x.id IS NOT NULL THEN 'exact' WHEN l.id IS NOT NULL THEN 'loose' END how FROM w LEFT JOIN x USING (t,f,n) LEFT JOIN l ON l.t=w.t AND l.n=w.n", graph=False)
def join_09_resolve_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir, False)


@query(WANTED_SQL + " SELECT wid, x.id, CASE WHEN x.id IS NOT NULL THEN 'exact' END how FROM w LEFT JOIN x USING (t,f,n)", graph=False)
def join_10_resolve_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir, True)


TOPICS_SQL = "WITH l AS (SELECT event_type topic, 'publishes_to' rel_type, 'u'||(user_id%10) entity FROM events UNION ALL SELECT json_extract_string(props,'$.k'), 'consumed_by', 'e'||(event_id%100) FROM events WHERE event_type='click')"


@query(TOPICS_SQL + " SELECT DISTINCT topic, substr(sha256('message_topic|'||topic),1,32) id, rel_type, entity FROM l WHERE topic<>''", graph=False)
def prs_15_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    published = e.selectExpr("concat('u', user_id % 10) source", "event_type topic")
    consumers = e.where("event_type = 'click'").selectExpr("concat('e', event_id % 100) id", "'mq_consumer' entry_category", "replace(props, '\"k\"', '\"topic\"') entry_metadata")
    return capabilities.topics(published, consumers)


@query("SELECT id, count(*) n FROM (SELECT e.id FROM nodes e WHERE label='CodeEntity' AND file_path IN ('lib/Brand#1.java','src/n3.py')) GROUP BY id")
def join_18_changed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One join for all changed files."""
    changed = spark.createDataFrame([("lib/Brand#1.java", "BODY"), ("src/n3.py", "BODY")], "path string, change_type string")
    return changes.work(changed, stored_graph(spark, sf_dir).labelled("CodeEntity")).groupBy("id").agg(F.count("*").alias("n"))


@query("SELECT 'edit '||p_partkey AS \"function\", shape_id FROM part, (VALUES ('sensitive_data'),('region_rules'),('http_entry_point'),('large_unit'),('upstream_chain'),('open_suppliers')) v(shape_id) WHERE p_size > 30", graph=False)
def join_19_consulted_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as functions: large ones can update code, in either case of the word, others read it or create documents."""
    functions = table(spark, sf_dir, "part").selectExpr("concat('edit ', p_partkey) function", "case when p_size > 40 then array('CodeEntity:UPDATE', 'CodeEntity:update') when p_size > 30 then array('DocEntity:CREATE', 'CodeEntity:update') when p_size > 10 then array('CodeEntity:READ') else array('CodeEntity:READ', 'DocEntity:CREATE') end capabilities")
    return actions.consulted(functions, shapes.as_table(spark, shapes.SHAPES))


CAPABILITY_SQL = """WITH e AS (SELECT o_orderkey, o_orderkey::VARCHAR id, CASE o_orderkey%4 WHEN 0 THEN 'validate_'||lower(o_orderstatus)||'_card' WHEN 1 THEN 'order_list' WHEN 2 THEN 'ping' ELSE 'get_total' END n,
 CASE o_orderkey%5 WHEN 0 THEN NULL WHEN 1 THEN '/api/orders/x' WHEN 2 THEN 'src/app/pay.py' WHEN 3 THEN '/' ELSE '/api' END f, CASE WHEN o_orderkey%3=0 THEN NULL ELSE 'First a line of '||o_orderpriority||chr(10)||'more' END doc FROM orders WHERE o_orderkey%2=0)
 SELECT id AS realized_by, substr(sha256('capability|'||id),1,32) id, n AS name, CASE WHEN o_orderkey%5=0 THEN CASE o_orderkey%4 WHEN 0 THEN split_part(n,'_',2) WHEN 2 THEN 'unknown' END WHEN o_orderkey%5=1 THEN 'orders' WHEN o_orderkey%5=2 THEN 'pay' WHEN o_orderkey%5=3 THEN 'root' ELSE 'api' END business_domain,
 coalesce(split_part(doc, chr(10), 1), 'Capability: '||n) AS description, array_to_string(CASE WHEN doc IS NULL THEN string_split(n,'_') ELSE list_concat(string_split(n,'_'), ['first','line','of']) END, ' ') kw, CASE WHEN o_orderkey%7=0 THEN 'int' ELSE 'any' END returns_type, 'str' a_type FROM e"""


@query(CAPABILITY_SQL, graph=False)
def prs_13_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capabilities of the even orders as if they were routes."""
    o = table(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey as string) id", "case o_orderkey % 4 when 0 then concat('validate_', lower(o_orderstatus), '_card') when 1 then 'order_list' when 2 then 'ping' else 'get_total' end name",
        "case o_orderkey % 5 when 0 then null when 1 then '/api/orders/x' when 2 then 'src/app/pay.py' when 3 then '/' else '/api' end file_path", "case when o_orderkey % 2 = 0 then 'http_api' else 'scheduled' end entry_category",
        "'[\"a: Optional[str]\", \"b\"]' parameters", "case when o_orderkey % 7 = 0 then 'def f(a) -> int | None:' else 'def f(a):' end source", "case when o_orderkey % 3 = 0 then null else concat('First a line of ', o_orderpriority, chr(10), 'more') end docstring",
    )
    found = capabilities.extracted(o)
    return found.select("realized_by", "id", "name", "business_domain", "description", F.array_join("keywords", " ").alias("kw"), F.col("returns").alias("returns_type"), F.col("input_contract")["a"].alias("a_type"))


@query("SELECT p_partkey, CASE p_partkey%8 WHEN 0 THEN 'http_api' WHEN 1 THEN 'http_api' WHEN 2 THEN 'scheduled' WHEN 3 THEN 'mq_consumer' WHEN 4 THEN 'event_handler' END python, CASE p_partkey%8 WHEN 0 THEN 'http_api' WHEN 1 THEN 'scheduled' WHEN 2 THEN 'mq_consumer' WHEN 3 THEN 'event_handler' WHEN 4 THEN 'rpc_service' END java FROM part", graph=False)
def fn_22_entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    python = ["@app.post('/x')", "router.get", "@celery.task", "@rabbitmq.consumer(queue='q')", "@event_handler", "@property", "@app.teardown", "@task.group"]
    java = ["@GetMapping(\"/x\")", "Scheduled", "@org.kafka.KafkaListener", "@EventListener", "@WebService", "@Override", "@Deprecated", "@Get"]
    k = F.pmod("p_partkey", F.lit(8)).cast("int") + 1
    of = lambda xs: F.element_at(F.array(*map(F.lit, xs)), k)
    return table(spark, sf_dir, "part").select("p_partkey", entry_points.python_category(of(python)).alias("python"), entry_points.java_category(of(java)).alias("java"))


@query("SELECT id, lines::INT lines, b branches, round(least(1.0::DOUBLE, lines/100.0::DOUBLE*0.5+b/20.0::DOUBLE*0.5),2) complexity, concat_ws(',', CASE WHEN b>10 THEN '_validate_inputs:'||least(30, lines//3) END, '_process_core:'||least(40, lines//3), CASE WHEN lines>200 THEN '_handle_errors:'||least(25, lines//5) END) parts FROM (SELECT id, lines, (lines//5)%16 b FROM nodes WHERE lines>100)")
def act_05_refactor(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = stored_graph(spark, sf_dir).nodes.select("id", "lines", F.expr("(lines div 5) % 16").cast("int").alias("branches"))
    return actions.eligible(n).select("id", "lines", "branches", "complexity", F.array_join("splits", ",").alias("parts"))


@query("SELECT id, '## `'||name||'`'||chr(10)||chr(10)||'**Type**: `function`'||chr(10)||chr(10)||'**Parameters**:'||chr(10)||chr(10)||'- `a`'||chr(10)||'- `b`'||chr(10)||chr(10)||'**Returns**: `Any`'||chr(10) markdown FROM nodes WHERE id LIKE 'p:%'")
def act_06_api_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = stored_graph(spark, sf_dir).nodes.where("id like 'p:%'")
    return actions.api_docs(n.select("id", "name", "entity_type", F.array(F.lit("a"), F.lit("b")).alias("params"), F.lit(None).cast("string").alias("returns"), F.lit(None).cast("string").alias("docstring")))


@query("SELECT p_brand AS owner, 'I'||p_brand interface, string_agg(DISTINCT 'def '||split_part(p_name,' ',1)||'(self, *args, **kwargs)', ';' ORDER BY 'def '||split_part(p_name,' ',1)||'(self, *args, **kwargs)') methods FROM part GROUP BY p_brand", graph=False)
def act_07_interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("owner"), F.explode(F.array(F.substring_index("p_name", " ", 1), F.concat(F.lit("_"), "p_name"))).alias("method"))
    return actions.interfaces(p).select("owner", "interface", F.array_join("methods", ";").alias("methods"))


DECISION_SQL = SHAPES_SQL + ", top AS (SELECT id, max(rk) rk FROM hits GROUP BY id)"


@query(DECISION_SQL + " SELECT CASE coalesce(rk,0) WHEN 3 THEN 'denied' WHEN 0 THEN 'approved' ELSE 'pending' END AS level, count(*) n FROM code LEFT JOIN top USING (id) GROUP BY 1")
def act_13_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approval of a harmless function on every code entity: blocks are denied, whatever else triggers waits."""
    g = stored_graph(spark, sf_dir)
    decided = shapes.fused(g.labelled("CodeEntity"), shapes.results(g, shapes.SHAPES))
    asked = actions.checked(decided).select("*", F.lit(False).alias("requires_approval"), F.lit("query_entity").alias("function"))
    return actions.approvals(asked, on_block="auto_reject").groupBy("level").agg(F.count("*").alias("n"))


@query(DECISION_SQL + " SELECT coalesce(rk,0)=3 AS blocked, CASE coalesce(rk,0) WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END::BIGINT n_warnings, count(*) n FROM code LEFT JOIN top USING (id) GROUP BY 1,2")
def shp_10_action_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = stored_graph(spark, sf_dir)
    decided = shapes.fused(g.labelled("CodeEntity"), shapes.results(g, shapes.SHAPES))
    return actions.checked(decided).groupBy(F.col("block_reason").isNotNull().alias("blocked"), F.size("warnings").cast("long").alias("n_warnings")).agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT conv_id, conv_id%7=0 used, (SELECT max(conv_id) FROM conversations)-30 lo FROM conversations GROUP BY 1), o AS (SELECT conv_id FROM p WHERE NOT used AND conv_id>=lo ORDER BY conv_id LIMIT 10) SELECT conv_id::VARCHAR token, CASE WHEN used THEN 'used' WHEN conv_id<lo THEN 'expired' WHEN conv_id IN (FROM o) THEN 'open' ELSE 'denied' END state FROM p", graph=False)
def act_14_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    now = pending.agg(F.max("conv_id")).first()[0] or 0
    rows = pending.select(F.col("conv_id").cast("string").alias("token"), F.col("conv_id").cast("double").alias("at"), (F.col("conv_id") % 7 == 0).alias("used"))
    return actions.gate(rows, float(now), ttl=30.0)


@query("SELECT id, label, name, CASE WHEN id='p:7' THEN 'restricted' ELSE sensitivity END sensitivity FROM nodes WHERE label='CodeEntity'")
def snk_08_set_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = stored_graph(spark, sf_dir).labelled("CodeEntity")
    return store.set_property(n, "p:7", "sensitivity", F.lit("restricted")).select("id", "label", "name", "sensitivity")


@query("SELECT label, count(*) n FROM nodes WHERE id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges) GROUP BY label")
def snk_09_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.orphans(stored_graph(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS id, sha256(CASE WHEN doc_id%5=0 AND doc_id%2=0 THEN 'new' ELSE text END) sha FROM documents WHERE doc_id%3<>0 OR (doc_id%5=0 AND doc_id%2=0)", graph=False)
def snk_11_upsert_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").selectExpr("doc_id id", "text")
    new = d.where("id % 5 = 0").select("id", F.when(F.col("id") % 2 == 0, "new").otherwise("  ").alias("text"))
    return store.upsert_vectors(d.where("id % 3 <> 0"), new).select("id", F.sha2("text", 256).alias("sha"))


@query("WITH gone AS (SELECT doc_id id FROM labels WHERE toxic=1) SELECT label::VARCHAR label, count(*) n FROM embeddings WHERE label <> 3 AND vec_id NOT IN (SELECT id FROM gone) GROUP BY 1 UNION ALL SELECT 'deleted', count(*) FROM embeddings WHERE label = 3 OR vec_id IN (SELECT id FROM gone)", graph=False)
def snk_12_delete_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after a delete by ids and by metadata, and how many rows it took."""
    v = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    left, gone = vectors.delete(v, table(spark, sf_dir, "labels").where("toxic = 1").selectExpr("doc_id id"), F.col("label") == 3)
    return left.groupBy(F.col("label").cast("string").alias("label")).agg(F.count("*").alias("n")).unionByName(gone.select(F.lit("deleted").alias("label"), "n"))


@query("SELECT coalesce(label, 'none') || '/2' label, count(*) n FROM nodes WHERE label <> 'DocEntity' GROUP BY 1")
def ddl_05_migrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three registered steps lie between the versions; they are one plan."""
    steps: list[store.Step] = [
        ("1.10.0", lambda g: Graph(g.nodes.where("label <> 'DocEntity'"), g.edges)),
        ("1.9.0", lambda g: Graph(g.nodes.withColumn("label", F.concat("label", F.lit("/2"))).withColumn("label", F.regexp_replace("label", "^DocEntity/2$", "DocEntity")), g.edges)),
        ("2.0.0", lambda g: Graph(g.nodes.limit(0), g.edges)),
    ]
    moved, _ = store.migrated(stored_graph(spark, sf_dir), steps, "1.2.0", "1.10.0")
    return moved.nodes.groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT count(*) n, count(*) - count(DISTINCT id) repeated FROM nodes")
def ddl_01_unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = stored_graph(spark, sf_dir).nodes.groupBy("id").agg(F.count("*").alias("k"))
    return per.agg(F.sum("k").alias("n"), F.sum(F.col("k") - 1).alias("repeated"))


@query(CHANGES_SQL + " SELECT coalesce(d.path, o.doc_id::VARCHAR) path, coalesce(d.new_sha, sha256(o.text)) sha FROM (SELECT * FROM d WHERE change_type IS NOT NULL) d FULL JOIN o ON o.doc_id::VARCHAR=d.path WHERE coalesce(change_type,'')<>'DELETED'", graph=False)
def inc_04_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "documents").where("doc_id % 10 <> 0").select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    return changes.cached(old, _changes(spark, sf_dir))


@query("SELECT p_partkey::VARCHAR path, CASE p_partkey%4 WHEN 0 THEN 'SIGNATURE' WHEN 1 THEN 'DOC_ONLY' ELSE 'BODY' END change_type FROM part", graph=False)
def inc_03_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    diffs = ["--- a/x\n+++ b/x\n-def f(a):\n+def f(a, b):\n x = 1", "-# old\n+# new\n ctx", "-x = 1\n+x = 2"]
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.lit("BODY").alias("change_type"), (F.col("p_partkey") % 4).cast("int").alias("k"))
    given = p.where("k < 3").select("path", F.element_at(F.array(*map(F.lit, diffs)), F.col("k") + 1).alias("diff"))
    return changes.classified(p.select("path", "change_type"), given)


@query("SELECT label, count(*) FILTER (id IN (SELECT 's:'||l_suppkey FROM lineitem WHERE l_partkey=7)) n_stale, count(*) n FROM nodes WHERE label IN ('ServiceEntity','DocEntity') GROUP BY label")
def inc_07_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = stored_graph(spark, sf_dir)
    hit = g.typed("implements").where("src = 'p:7'").select(F.col("dst").alias("node_id"))
    nodes = g.nodes.where(F.col("label").isin("ServiceEntity", "DocEntity"))
    return changes.flagged(nodes, hit).groupBy("label").agg(F.count_if("stale").alias("n_stale"), F.count("*").alias("n"))


@query(CHANGES_SQL + " SELECT count(*) n_files, count(*) FILTER (change_type='ADDED') n_added, count(*) FILTER (change_type='DELETED') n_deleted, count(*) FILTER (change_type='BODY') n_modified FROM d WHERE change_type IS NOT NULL", graph=False)
def inc_08_changeset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.changeset(_changes(spark, sf_dir)).drop("changeset_id")


@query(SIGN_SQL + " SELECT signature, hits, CASE WHEN signature LIKE 'error:%' THEN 'retired' WHEN hits>=3 THEN 'active' ELSE 'candidate' END layer FROM h", graph=False)
def tab_01_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills after the soft deletion of those of errors."""
    known = stream.reflection(table(spark, sf_dir, "events"))
    return tables.skills_after(known, known.where("signature like 'error:%'")).select("signature", "hits", "layer")


@query("WITH r AS (SELECT o_custkey u, o_orderpriority p, CASE WHEN o_orderkey%4<>0 THEN o_orderstatus END ro, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) k FROM orders) SELECT u::VARCHAR \"user\", p repo, ro AS role FROM r WHERE k=1 AND ro IS NOT NULL", graph=False)
def tab_04_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "orders").selectExpr("cast(o_custkey as string) user", "o_orderpriority repo", "case when o_orderkey % 4 <> 0 then o_orderstatus end role", "o_orderkey ord")
    return tables.roles(log)


@query("SELECT p_partkey FROM part WHERE p_size/40.0 > 1", graph=False)
def tab_05_out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.out_of_range(table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 40.0).alias("confidence"))).select("p_partkey")


@query("""WITH a AS (SELECT n_nationkey k, n_nationkey%5 t, n_regionkey s, (n_nationkey%10)/10.0+0.05 c FROM nation), m AS (SELECT k, ['DOMAIN','RANGE','DISJOINT_WITH','EQUIVALENT_CLASS','OTHER'][t+1] t, r.r_name sn, 'free'||k o, c FROM a JOIN region r ON r.r_regionkey=s WHERE t<4 AND c>=0.7),
 w AS (SELECT k, t, c, CASE WHEN t IN ('DOMAIN','RANGE') THEN 'single' ELSE 'forward' END direction, sn, o FROM m UNION ALL SELECT k, t, c, 'reverse', o, sn FROM m WHERE t IN ('DISJOINT_WITH','EQUIVALENT_CLASS'))
 SELECT k::VARCHAR axiom_id, direction, sn ontology_ref, t||':'||o AS value, CASE t WHEN 'DISJOINT_WITH' THEN CASE WHEN c<0.9 THEN 'warn' ELSE 'block' END WHEN 'EQUIVALENT_CLASS' THEN CASE WHEN c<0.9 THEN 'block' ELSE 'escalate' END ELSE CASE WHEN c<0.9 THEN 'allow' ELSE 'warn' END END severity, c::DOUBLE confidence FROM w""", graph=False)
def ont_02_axioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = table(spark, sf_dir, "region").selectExpr("cast(r_regionkey as string) concept_id", "r_name name")
    axioms = table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as string) axiom_id", "element_at(array('DOMAIN', 'RANGE', 'DISJOINT_WITH', 'EQUIVALENT_CLASS', 'OTHER'), cast(n_nationkey % 5 as int) + 1) axiom_type", "cast(n_regionkey as string) subject", "concat('free', n_nationkey) object", "cast((n_nationkey % 10) / 10.0 + 0.05 as double) confidence")
    return shapes.from_axioms(axioms, concepts)


@query("SELECT handler, count(*) FILTER (ok) n_ok, count(*) FILTER (NOT ok) n_failed FROM (SELECT unnest(CASE event_type WHEN 'click' THEN ['audit','build'] ELSE ['audit'] END) AS handler, value >= 5 ok FROM events) GROUP BY 1", graph=False)
def str_08_handler_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = stream.routed(table(spark, sf_dir, "events"), {"*": ["audit"], "click": ["build"]})
    return stream.handler_counts(routed.withColumn("ok", F.col("value") >= 5))


@query("SELECT 'click' event_type, count(*) n FROM events WHERE event_type='click' AND user_id%3=0", graph=False)
def str_06_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("source", F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("git_watcher:"), "user_id")).otherwise("engine"))
    return stream.gated(e.where("event_type = 'click'"), "git_watcher").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN grouping(toxic)=1 THEN 'all' ELSE toxic::VARCHAR END AS level, round(avg(score),6) mean, round(avg((score>=0.7)::INT),6) accuracy, count(*) n FROM (SELECT toxic, CASE WHEN quality=1 THEN 0.9::DOUBLE ELSE 0.3::DOUBLE END score FROM labels) GROUP BY ROLLUP(toxic)", graph=False)
def agg_13_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score and share of scores of 0.7 or more, by level and over all, in one aggregate."""
    rows = table(spark, sf_dir, "labels").select(F.col("toxic").cast("string").alias("level"), F.when(F.col("quality") == 1, 0.9).otherwise(0.3).alias("score"))
    got = rows.rollup("level").agg(F.grouping("level").alias("g"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.avg((F.col("score") >= 0.7).cast("double")), 6).alias("accuracy"), F.count("*").alias("n"))
    return got.select(F.when(F.col("g") == 1, "all").otherwise(F.col("level")).alias("level"), "mean", "accuracy", "n")


@query("SELECT count(*) n, count(*) FILTER (id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)) isolated, round(100.0*count(*) FILTER (id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges))/count(*),4)::DOUBLE percent FROM nodes WHERE label='CodeEntity'")
def agg_15_isolated_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = stored_graph(spark, sf_dir)
    whole, alone = g.labelled("CodeEntity").agg(F.count("*").alias("n")), patterns.isolated(g, "CodeEntity").agg(F.count("*").alias("isolated"))
    return whole.join(alone, F.lit(True)).select("n", "isolated", F.round(100.0 * F.col("isolated") / F.col("n"), 4).alias("percent"))


@query("SELECT entity_type, file_path, count(*) n, min(id) first, max(id) last FROM nodes WHERE label='CodeEntity' GROUP BY 1,2")
def agg_12_ids_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_graph(spark, sf_dir).labelled("CodeEntity").groupBy("entity_type", "file_path").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


BOUNDS = (0.5, 1.0, 2.5, 5.0, 10.0)


@query("SELECT event_type, le, count(*) FILTER (value <= le) n FROM events, (VALUES (0.5::DOUBLE),(1.0),(2.5),(5.0),(10.0)) v(le) GROUP BY 1,2", graph=False)
def agg_20_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative buckets: one conditional count per bound, so events are read and combined once."""
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(*[F.count_if(F.col("value") <= b).alias(f"b{k}") for k, b in enumerate(BOUNDS)])
    return counts.select("event_type", F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(BOUNDS)])).alias("x")).select("event_type", "x.le", "x.n")


@query("SELECT id, name, priority::INT priority FROM (SELECT id, name, lines priority FROM nodes WHERE lines IS NOT NULL ORDER BY lines DESC, id LIMIT 10)")
def srt_01_top_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_graph(spark, sf_dir).nodes.where("lines is not null").orderBy(F.desc("lines"), "id").limit(10).select("id", "name", F.col("lines").alias("priority"))


@query("SELECT l_orderkey, string_agg(DISTINCT x, ',' ORDER BY x) covered FROM (SELECT l_orderkey, l_returnflag x FROM lineitem WHERE l_returnflag IN ('A','R')) GROUP BY 1", graph=False)
def set_08_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("used"))
    covered = F.array_sort(F.array_intersect("used", F.array(F.lit("A"), F.lit("R"), F.lit("X"))))
    return used.select("l_orderkey", F.array_join(covered, ",").alias("covered")).where("covered <> ''")


@query("SELECT r_name AS name, NULL::VARCHAR segment FROM region UNION ALL SELECT NULL, c_mktsegment FROM customer", graph=False)
def set_07_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of rows with different keys: the union of their columns, null where a row has none."""
    return table(spark, sf_dir, "region").selectExpr("r_name name").unionByName(table(spark, sf_dir, "customer").selectExpr("c_mktsegment segment"), allowMissingColumns=True)


@query("SELECT p_partkey, lower(p_type)||array_to_string(list_transform(string_split(lower(p_name),' '), lambda x: upper(x[1])||x[2:]), '') camel, upper(replace(p_name,' ','_')) snake, CASE WHEN p_partkey%2=0 THEN 'CONTAINS' ELSE 'OWNS_PART' END relation FROM part", graph=False)
def fn_02_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    joined = F.concat_ws("_", F.lower("p_type"), F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))))
    title = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    return p.select("p_partkey", S.snake_to_camel(joined).alias("camel"), S.upper_snake(title).alias("snake"), S.relation_name(F.when(F.col("p_partkey") % 2 == 0, "hasPart").otherwise("ownsPart")).alias("relation"))


@query("SELECT id, regexp_extract(file_path, '[^/]*$') base, regexp_replace(regexp_extract(file_path, '[^/]*$'), '\\.[^.]+$', '') stem, regexp_extract(file_path, '\\.[^./]+$') suffix, CASE WHEN file_path LIKE 'src/%' THEN substr(file_path, 5) ELSE file_path END relative, CASE WHEN file_path LIKE 'docs/%' THEN 'module_doc' ELSE 'comment' END kind FROM nodes WHERE file_path IS NOT NULL")
def fn_08_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("file_path")
    return stored_graph(spark, sf_dir).nodes.where("file_path is not null").select("id", S.basename(p).alias("base"), S.stem(p).alias("stem"), S.suffix(p).alias("suffix"), S.normal_path(p, "src").alias("relative"), S.doc_type(p).alias("kind"))


@query("SELECT p_partkey, p_name LIKE 'red %' OR p_name LIKE '% red %' OR p_name LIKE '% red' OR p_name='red' bounded FROM part", graph=False)
def fn_09_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.bounded(F.col("p_name"), F.lit("red")).alias("bounded"))


@query("SELECT doc_id, CASE WHEN doc_id%2=0 THEN substr(text,1,800) ELSE 'document '||source||' in docs/'||lang END AS embedded FROM documents WHERE length(text)>0", graph=False)
def fn_12_embeddable(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("length(text) > 0")
    return d.select("doc_id", S.embeddable(F.when(F.col("doc_id") % 2 == 0, F.col("text")), F.lit("document"), F.col("source"), F.concat(F.lit("docs/"), "lang")).alias("embedded"))


@query("SELECT event_id, CASE event_id%4 WHEN 0 THEN '.txt' WHEN 1 THEN '.py' WHEN 2 THEN '.git' ELSE 'unknown' END AS ext FROM events", graph=False)
def fn_35_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = ['{"file_extension": ".txt", "file_path": "a.py"}', '{"file_path": "x/a.py"}', '{"file_path": "", "repo_path": "/r/core.git"}', "no json"]
    return table(spark, sf_dir, "events").select("event_id", S.event_extension(F.element_at(F.array(*map(F.lit, given)), (F.col("event_id") % 4).cast("int") + 1)).alias("ext"))


@query("SELECT c_custkey, CASE WHEN c_custkey%3=0 THEN 'default' ELSE 'repo'||c_custkey END repo, 'https://'||CASE WHEN c_custkey%2=0 THEN '***@' ELSE '' END||'host/team/repo'||c_custkey||'.git' masked FROM customer", graph=False)
def fn_36_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://"), F.when(F.col("c_custkey") % 2 == 0, "token:x@").otherwise(""), F.lit("host/team/repo"), F.col("c_custkey").cast("string"), F.lit(".git"))
    return table(spark, sf_dir, "customer").select("c_custkey", S.repo_id(F.when(F.col("c_custkey") % 3 != 0, url)).alias("repo"), S.masked_url(url).alias("masked"))


@query("SELECT conv_id, turn, CASE WHEN (conv_id+turn)%3=0 THEN '{\"a\": 1}' WHEN (conv_id+turn)%3=1 THEN '{\"b\": 2}' ELSE '{}' END AS reply FROM conversations", graph=False)
def fn_40_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = ['<think>\nhm ```json x```</think>\n```json\n{"a": 1}\n```\nend', 'so:\n```\n{"b": 2}\n```', " {} "]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.reply_json(F.element_at(F.array(*map(F.lit, given)), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3)).cast("int") + 1)).alias("reply"))


@query("SELECT p_partkey, round((CASE WHEN p_name ILIKE '%red%' THEN 0.5::DOUBLE ELSE 0::DOUBLE END + CASE WHEN p_name ILIKE '%ring%' THEN 0.5::DOUBLE ELSE 0::DOUBLE END)*(1-w)+w,6) score FROM (SELECT p_partkey, p_name, CASE p_partkey%3 WHEN 1 THEN 0.3::DOUBLE WHEN 2 THEN 0.4::DOUBLE ELSE 0.5::DOUBLE END w FROM part)", graph=False)
def fn_42_level_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = S.found_share(F.array(F.lit("RED"), F.lit("ring")), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(S.level_score(F.col("p_partkey") % 3, F.lit(1.0), answer), 6).alias("score"))


@query("SELECT o_orderkey, r AS rank FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) r FROM orders) WHERE r=1", graph=False)
def srt_03_first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("rank")).where("rank = 1")
