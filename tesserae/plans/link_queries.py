"""Queries of links by text, whole updates, rules as text, approvals by step, listings of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import EDGE_COLUMNS, NODE_COLUMNS, Graph, stored_graph, table, with_graph
from ..operators import actions, changes, linking, shapes
from ..sources import rules
from .graph_queries import query
from .table_queries import SHAPES_SQL

ALIASES = [("A", ["old", "WIDGET", "old w"]), ("B", ["ring", "small", "5"]), ("C", ["w", "w", "w"]), ("D", ["no such name"])]


@query("WITH a(asset_id, ord, alias) AS (VALUES " + ", ".join(f"('{x}',{k + 1},'{y.lower()}')" for x, ys in ALIASES for k, y in enumerate(ys)) + """),
 m AS (SELECT asset_id, ord, p_partkey id FROM a JOIN part ON contains(lower(p_name), alias)), p1 AS (SELECT asset_id, min(id) id FROM m WHERE ord=1 GROUP BY 1),
 p2 AS (SELECT m.asset_id, min(m.id) id FROM m LEFT JOIN p1 USING (asset_id) WHERE ord=2 AND m.id IS DISTINCT FROM p1.id GROUP BY 1),
 p3 AS (SELECT m.asset_id, min(m.id) id FROM m LEFT JOIN p1 USING (asset_id) LEFT JOIN p2 USING (asset_id) WHERE ord=3 AND m.id IS DISTINCT FROM p1.id AND m.id IS DISTINCT FROM p2.id GROUP BY 1)
 SELECT id, asset_id FROM p1 UNION ALL SELECT id, asset_id FROM p2 UNION ALL SELECT id, asset_id FROM p3""", graph=False)
def join_11_alias_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each alias takes the first part whose name holds it and that its asset has not taken."""
    assets = spark.createDataFrame(ALIASES, "asset_id string, aliases array<string>")
    return linking.alias_links(table(spark, sf_dir, "part").selectExpr("p_partkey id", "p_name name", "p_partkey ord"), assets)


#: Documents that name a file by its path, by its last part, inside a longer word, or a function in a code block.
REFERRING = """CASE doc_id % 5 WHEN 0 THEN coalesce(text,'')||' see src/n'||(doc_id % 29)||'.py now' WHEN 1 THEN coalesce(text,'')||' in n'||(doc_id % 29)||'.py' WHEN 2 THEN 'xsrc/n3.py '||coalesce(text,'')
 WHEN 3 THEN coalesce(text,'')||chr(10)||'```python'||chr(10)||'customer_'||doc_id||'(customer_1, ab)'||chr(10)||'```' ELSE text END"""


@query("WITH d AS (SELECT doc_id, " + REFERRING + r""" AS text FROM documents),
 e AS (SELECT c_custkey id, 'src/n'||c_nationkey||'.py' path, 'n'||c_nationkey||'.py' base, 'customer_'||c_custkey AS name FROM customer),
 s AS (SELECT doc_id, path, base, strpos(text, path) p, strpos(text, base) b, text FROM d, (SELECT DISTINCT path, base FROM e) WHERE contains(text, base)),
 r AS (SELECT doc_id, path, CASE WHEN p > 0 AND (p = 1 OR substr(text,p-1,1) IN (' ','.','/',chr(92),'-','_')) AND substr(text,p+length(path),1) IN ('',' ','.','/',chr(92),'-','_') THEN 1
  WHEN (b = 1 OR substr(text,b-1,1) IN (' ','.','/',chr(92),'-','_')) AND substr(text,b+length(base),1) IN ('',' ','.','/',chr(92),'-','_') THEN 2 END AS rule FROM s),
 c AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(array_to_string(regexp_extract_all(text, '```python\s*\n((?:.|\n)*?)```', 1), ' '), '\b[A-Za-z_][A-Za-z0-9_]{2,}\b')) AS name FROM d WHERE contains(text, '```python')),
 f AS (SELECT doc_id, id, rule FROM r JOIN e USING (path) WHERE rule IS NOT NULL UNION ALL SELECT doc_id, id, 3 FROM c JOIN e USING (name) WHERE length(name) > 3),
 o AS (SELECT doc_id, id, min(rule) AS rule FROM f GROUP BY 1, 2)
 SELECT doc_id, id, rule::BIGINT AS rule, row_number() OVER (PARTITION BY doc_id ORDER BY id) rank FROM o QUALIFY rank <= 50""", graph=False)
def join_12_document_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked to customers as functions by path, last part of the path, or name in code, at most 50 each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(REFERRING).alias("text"))
    index = table(spark, sf_dir, "customer").selectExpr("c_custkey id", "concat('src/n', c_nationkey, '.py') file_path", "concat('customer_', c_custkey) name", "c_custkey ord")
    return linking.document_links(docs, index).select("doc_id", "id", F.col("rule").cast("long").alias("rule"), F.col("rank").cast("long").alias("rank"))


NAMES_SQL = "WITH n AS (SELECT item_id id, substr(text, (item_id % 5)*7+1, 1 + item_id % 6) AS name FROM benchmark), t AS (SELECT conv_id*1000+turn id, text FROM conversations)"


def _held(spark: SparkSession, sf_dir: str, relation: str) -> DataFrame:
    names = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.expr("substr(text, (item_id % 5) * 7 + 1, 1 + item_id % 6)").alias("name"))
    code = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("source"))
    return linking.cross_type(code, names, relation)


@query(NAMES_SQL + " SELECT n.id source, t.id target, 'describes' relation_type, 0.7::DOUBLE confidence FROM n JOIN t ON contains(t.text, n.name) WHERE length(n.name) > 0", graph=False)
def join_13_name_in_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short pieces of benchmark items as names, one to six characters long, in the turns of conversations."""
    return _held(spark, sf_dir, "describes")


@query(NAMES_SQL + " SELECT t.id source, n.id target, 'derived_from' relation_type, 0.7::DOUBLE confidence FROM n JOIN t ON contains(t.text, n.name) WHERE length(n.name) > 0", graph=False)
def join_13_derived_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, sf_dir, "derived_from")


UPDATE_SQL = """WITH o AS (SELECT doc_id, text FROM documents WHERE doc_id%10<>0), n AS (SELECT doc_id, CASE WHEN doc_id%3=0 THEN text||'!' ELSE text END text FROM documents WHERE doc_id%7<>0),
 d AS (SELECT coalesce(n.doc_id,o.doc_id) id, CASE WHEN o.doc_id IS NULL THEN 'ADDED' WHEN n.doc_id IS NULL THEN 'DELETED' WHEN sha256(coalesce(o.text,''))<>sha256(coalesce(n.text,'')) THEN 'BODY' END k FROM o FULL JOIN n ON n.doc_id=o.doc_id),
 c AS (SELECT * FROM d WHERE k IS NOT NULL), e AS (SELECT o.doc_id a, o.doc_id // 2 b FROM o JOIN o p ON p.doc_id = o.doc_id // 2 WHERE o.doc_id > 0),
 s AS (SELECT id FROM c JOIN o ON o.doc_id = id), st AS (SELECT b x, a y, 'F' dir FROM e UNION ALL SELECT a, b, 'B' FROM e),
 l1 AS (SELECT DISTINCT s.id src, dir, y FROM s JOIN st ON x = s.id), l2 AS (SELECT DISTINCT src, l1.dir, st.y FROM l1 JOIN st ON st.x = l1.y AND st.dir = l1.dir), l3 AS (SELECT DISTINCT src, l2.dir, st.y FROM l2 JOIN st ON st.x = l2.y AND st.dir = l2.dir),
 i AS (SELECT DISTINCT dir, y FROM (SELECT * FROM l1 UNION SELECT * FROM l2 UNION SELECT * FROM l3) WHERE y <> src),
 af AS (SELECT doc_id id FROM o WHERE doc_id NOT IN (SELECT id FROM c) UNION SELECT id FROM c WHERE k <> 'DELETED'), f AS (SELECT id FROM c WHERE k <> 'DELETED')"""


def _update(spark: SparkSession, sf_dir: str) -> changes.Update:
    """Documents as files, each a node that describes that of half its number."""
    d = table(spark, sf_dir, "documents")
    new = d.where("doc_id % 7 <> 0").selectExpr("doc_id", "if(doc_id % 3 = 0, concat(text, '!'), text) text")

    def graph(docs: DataFrame) -> Graph:
        known = {"id": "concat('d:', doc_id)", "label": "'DocEntity'", "name": "cast(doc_id as string)", "entity_type": "'document'", "file_path": "concat(doc_id, '.md')"}
        nodes = docs.selectExpr(*[f"{known.get(c, 'cast(null as ' + ('int' if c == 'lines' else 'string') + ')')} {c}" for c in NODE_COLUMNS])
        half = docs.select(F.expr("doc_id").alias("b"))
        edges = docs.where("doc_id > 0").select("doc_id", F.expr("doc_id div 2").alias("b")).join(half, "b", "left_semi")
        return Graph(nodes, edges.selectExpr("concat('d:', doc_id) src", "concat('d:', b) dst", "'describes' rel_type", "1.0D weight").select(EDGE_COLUMNS))

    files = lambda docs: docs.selectExpr("concat(doc_id, '.md') path", "text content")
    old = d.where("doc_id % 10 <> 0")
    return changes.update(graph(old), files(old), files(new), graph(new))


@query(UPDATE_SQL + """ SELECT (SELECT count(*) FROM c) changes_detected, (SELECT count(*) FROM c WHERE k='ADDED') nodes_added, (SELECT count(*) FROM c WHERE k='BODY') nodes_updated, (SELECT count(*) FROM c WHERE k='DELETED') nodes_deleted,
 (SELECT count(*) FROM f JOIN af ON af.id = f.id // 2 JOIN n ON n.doc_id = f.id // 2 WHERE f.id > 0) relations_rebuilt, (SELECT count(*) FROM f) vectors_updated, (SELECT count(*) FROM i) impacted_nodes, (SELECT count(DISTINCT y) FROM i) docs_flagged""", graph=False)
def inc_05_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detect, follow, apply and record in one: the counts of the report."""
    return _update(spark, sf_dir).report.drop("changeset_id", "concepts_flagged")


@query(UPDATE_SQL + """, kept AS (SELECT a, b FROM e WHERE a NOT IN (SELECT id FROM c) AND b NOT IN (SELECT id FROM c)), made AS (SELECT f.id a, f.id // 2 b FROM f JOIN af ON af.id = f.id // 2 JOIN n ON n.doc_id = f.id // 2 WHERE f.id > 0)
 SELECT 'd:'||id AS id, (SELECT count(*) FROM (SELECT * FROM kept UNION SELECT * FROM made) x WHERE x.a = af.id) n_edges FROM af""", graph=False)
def inc_05_graph_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes after the update and how many edges each has outwards."""
    g = _update(spark, sf_dir).graph
    out = g.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return g.nodes.select("id").join(out, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_edges"))


@query("SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey%15 > 10 THEN '_validate_inputs:'||least(30, (p_size*5)//3) END, CASE WHEN p_size*5 > 100 THEN '_process_core:'||least(40, (p_size*5)//3) END, CASE WHEN p_size*5 > 200 THEN '_handle_errors:'||least(25, p_size) END) AS parts FROM part", graph=False)
def fn_31_split_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, branches = (F.col("p_size") * 5).cast("int"), (F.col("p_partkey") % 15).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(actions.splits(lines, branches), ",").alias("parts"))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as steps of a plan, decided by their size."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("step"), F.when(F.col("p_size") > 40, "block").when(F.col("p_size") > 25, "escalate").when(F.col("p_size") > 10, "warn").otherwise("allow").alias("decision"))
    return actions.step_approvals(p, "target", "session", "nonce")


STEPS_SQL = "WITH p AS (SELECT p_partkey::VARCHAR step, CASE WHEN p_size>40 THEN 'block' WHEN p_size>25 THEN 'escalate' WHEN p_size>10 THEN 'warn' ELSE 'allow' END decision FROM part), t AS (SELECT *, CASE WHEN decision='escalate' THEN substr(sha256('dag:'||step||':target:session:nonce'),1,12) END AS token FROM p)"


@query(STEPS_SQL + " SELECT step, decision, token, decision IN ('allow','warn') may_proceed FROM t", graph=False)
def act_15_step_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir)


@query(STEPS_SQL + """, k AS (SELECT *, step::BIGINT n FROM t WHERE token IS NOT NULL) SELECT token, CASE WHEN n%7=0 THEN 'expired' WHEN n%2=0 THEN 'resolved' ELSE 'rejected' END AS action, n%2=0 approved, n%2=0 AND n%7<>0 may_proceed FROM k
 UNION ALL SELECT token, 'used', true, false FROM k WHERE n%3=0 UNION ALL SELECT 'none'||step, 'unknown', true, false FROM t WHERE decision='block'""", graph=False)
def act_16_approval_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to the tokens of steps: some too late, some twice, some to tokens that were never asked for."""
    steps = _steps(spark, sf_dir)
    n = F.col("step").cast("long")
    asked = steps.where("token is not null").select("token", n.alias("n"))
    pending = asked.select("token", F.lit(1000.0).alias("at"))
    answer = lambda df, token, approved, at: df.select(token.alias("token"), approved.alias("approved"), at.cast("double").alias("at"))
    first = answer(asked, F.col("token"), F.col("n") % 2 == 0, F.when(F.col("n") % 7 == 0, 1700).otherwise(1100))
    again = answer(asked.where("n % 3 = 0"), F.col("token"), F.lit(True), F.lit(1800))
    other = answer(steps.where("decision = 'block'"), F.concat(F.lit("none"), "step"), F.lit(True), F.lit(1200))
    return actions.resolved(pending, first.unionByName(again).unionByName(other), 2000.0)


@query("SELECT CASE o_orderkey%4 WHEN 0 THEN 'A' WHEN 1 THEN 'M' WHEN 2 THEN 'R' ELSE 'D' END status, 'src/'||o_orderkey||'.py' path FROM orders", graph=False)
def src_12_changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a name-status listing, with renames of two paths and lines that are none."""
    lines = table(spark, sf_dir, "orders").selectExpr("explode(array(case o_orderkey % 4 when 0 then concat('A\\tsrc/', o_orderkey, '.py') when 1 then concat('M\\tsrc/', o_orderkey, '.py') when 2 then concat('R100\\told.py\\tsrc/', o_orderkey, '.py') else concat('D\\tsrc/', o_orderkey, '.py') end, 'no listing', '')) value")
    return changes.listed(lines)


@query(with_graph(SHAPES_SQL + " SELECT id, shape_id, severity, priority::BIGINT priority FROM hits"), graph=False)
def src_09_rules_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All shapes, written as text and read again, over all entities."""
    read = rules.parse_shapes(rules.written(shapes.SHAPES))
    return shapes.results(stored_graph(spark, sf_dir), read).select("id", "shape_id", "severity", F.col("priority").cast("long").alias("priority"))


@query(with_graph(SHAPES_SQL + ", k(id, label, severity) AS (VALUES ('sensitive_data','CodeEntity','block'),('region_rules','CodeEntity','block'),('http_entry_point','CodeEntity','warn'),('large_unit','CodeEntity','warn'),('upstream_chain','CodeEntity','warn'),('open_suppliers','CodeEntity','escalate')) SELECT k.id, label, k.severity, count(h.id) n, (SELECT count(*) FROM code) n_entities FROM k LEFT JOIN hits h ON h.shape_id=k.id GROUP BY ALL"), graph=False)
def shp_12_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enabled rules as a listing, with how many entities each concerns and applies to."""
    g = stored_graph(spark, sf_dir)
    hits = shapes.results(g, shapes.SHAPES).groupBy(F.col("shape_id").alias("id")).agg(F.count("*").alias("n"))
    sizes = g.nodes.groupBy("label").agg(F.count("*").alias("n_entities"))
    return rules.catalogue(spark, shapes.SHAPES).join(hits, "id", "left").join(sizes, "label").select("id", "label", "severity", F.coalesce("n", F.lit(0)).alias("n"), "n_entities")


@query("WITH t AS (SELECT doc_id, len(string_split(coalesce(text,''), chr(10))) k FROM documents) SELECT doc_id, 1::BIGINT AS section, 'Title '||doc_id AS title, 1+k AS n_lines FROM t UNION ALL SELECT doc_id, 2, 'End', 2 FROM t WHERE doc_id%2=0", graph=False)
def prs_08_rst_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under a title with a line below it, every other one with a second section."""
    text = F.concat(F.lit("Title "), F.col("doc_id").cast("string"), F.lit("\n=====\n"), F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 2 == 0, "\nEnd\n---\ntail").otherwise(""))
    return linking.sections(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), "rst")
