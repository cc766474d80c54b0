"""Queries of single operators of the inventory: predicates, scalar functions, orders, sets, merges, source files.

Functions of text are in text_queries; all have SQL over the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import entry_points
from ..functions import scalars as S
from ..graph import Graph, stored_graph, table
from ..operators import actions, changes, clustering, linking, patterns, shapes, store, vectors
from ..sources import files
from .graph_queries import query
from .table_queries import SHAPES_SQL


# Predicates


@query("SELECT id, name FROM nodes WHERE label='CodeEntity' AND entity_type='class' AND entry_category='http_api'")
def fil_01_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_graph(spark, sf_dir).labelled("CodeEntity").where("entity_type = 'class' and entry_category = 'http_api'").select("id", "name")


@query("SELECT id, file_path FROM nodes WHERE starts_with(file_path, 'src/n1')")
def fil_03_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_graph(spark, sf_dir).nodes.where(F.startswith("file_path", F.lit("src/n1"))).select("id", "file_path")


@query("SELECT id, sensitivity FROM nodes WHERE sensitivity IS NOT NULL")
def fil_05_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_graph(spark, sf_dir).nodes.where("sensitivity is not null").select("id", "sensitivity")


@query("SELECT label IS NOT NULL AS labelled, count(*) n FROM nodes GROUP BY 1")
def fil_07_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_graph(spark, sf_dir).nodes.groupBy(F.col("label").isNotNull().alias("labelled")).agg(F.count("*").alias("n"))


@query("SELECT 'none' given, count(*) n FROM edges UNION ALL SELECT 'two', count(*) FROM edges WHERE rel_type IN ('calls','extends')")
def fil_08_optional_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of types that filters only if it holds any."""
    g = stored_graph(spark, sf_dir)
    count = lambda df, name: df.agg(F.lit(name).alias("given"), F.count("*").alias("n"))
    return count(g.typed(), "none").unionByName(count(g.typed("calls", "extends"), "two"))


COSINE_SQL = "list_dot_product(a.embedding::DOUBLE[],b.embedding::DOUBLE[])/(sqrt(list_dot_product(a.embedding::DOUBLE[],a.embedding::DOUBLE[]))*sqrt(list_dot_product(b.embedding::DOUBLE[],b.embedding::DOUBLE[])))"


def _of_label(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 20 = 0").selectExpr("vec_id query_id", "embedding vector")
    return vectors.search(e.selectExpr("vec_id id", "embedding", "label"), asked, k, F.col("label") == 1).select("query_id", "id")


OF_LABEL_SQL = f"SELECT query_id, id FROM (SELECT a.vec_id query_id, b.vec_id id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(1-{COSINE_SQL},9), b.vec_id) r FROM embeddings a JOIN embeddings b ON a.vec_id<>b.vec_id AND b.label=1 WHERE a.vec_id % 20 = 0) WHERE r<="


@query(OF_LABEL_SQL + "5", graph=False)
def fil_09_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata filters the vectors before their distances are computed; every row whose id is divisible by 20 asks."""
    return _of_label(spark, sf_dir, 5)


@query(OF_LABEL_SQL + "10", graph=False)
def fil_09_metadata_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with ten neighbours each."""
    return _of_label(spark, sf_dir, 10)


PREDICATES = [("in", ("restricted", "public")), ("equals", "restricted"), ("exists", None), ("not_in", ("public", "internal")), ("not_equals", "public"), ("like", "x")]


@query(", f AS (SELECT src id, bool_or(sensitivity IN ('restricted','public')) i, bool_or(sensitivity='restricted') e, bool_and(sensitivity NOT IN ('public','internal')) ni, bool_and(sensitivity<>'public') ne, count(sensitivity)>0 x FROM edges JOIN nodes n ON n.id=dst WHERE rel_type='imports' GROUP BY 1) SELECT 'in' \"operator\", count(*) FILTER (i) n FROM f UNION ALL SELECT 'equals', count(*) FILTER (e) FROM f UNION ALL SELECT 'exists', count(*) FILTER (x) FROM f UNION ALL SELECT 'not_in', count(*) FILTER (x AND ni) FROM f UNION ALL SELECT 'not_equals', count(*) FILTER (x AND ne) FROM f UNION ALL SELECT 'like', 0")
def fil_10_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entities each predicate over the values at their paths' ends holds for; unknown ones hold for none."""
    g, out = stored_graph(spark, sf_dir), None
    for operator, value in PREDICATES:
        one = shapes.triggered(g, shapes.Shape(operator, "IMPORTS -> CodeEntity", "sensitivity", operator, value, "warn")).agg(F.lit(operator).alias("operator"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT p_partkey, p_size==10 eq, p_size>10 gt, p_size>=10 ge, p_size<10 lt, p_size!=10 ne FROM part", graph=False)
def fil_12_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"==": "eq", ">": "gt", ">=": "ge", "<": "lt", "!=": "ne"}
    return table(spark, sf_dir, "part").select("p_partkey", *[actions.condition(F.col("p_size"), op, F.lit(10)).alias(n) for op, n in names.items()])


@query("SELECT id AS node_id, name AS title, lines::BIGINT AS size_lines FROM nodes WHERE label='CodeEntity'")
def fil_13_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_graph(spark, sf_dir).labelled("CodeEntity").select(F.col("id").alias("node_id"), F.col("name").alias("title"), F.col("lines").cast("long").alias("size_lines"))


@query('SELECT id, file_path AS "filePath", entry_category AS "entryCategory" FROM nodes WHERE label=\'CodeEntity\'')
def fil_15_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns in snake case as camel case, for readers that expect it."""
    df = stored_graph(spark, sf_dir).labelled("CodeEntity").select("id", "file_path", "entry_category")
    camel = lambda c: c.split("_")[0] + "".join(x.title() for x in c.split("_")[1:])
    return df.withColumnsRenamed({c: camel(c) for c in df.columns})




@query("SELECT c_custkey, 'type_'||r_regionkey shape_id FROM customer JOIN nation ON n_nationkey=c_nationkey JOIN region ON r_regionkey=n_regionkey WHERE r_regionkey<>2", graph=False)
def fil_18_ontology_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes apply where their reference is an entity's name: an equi-join with the rules, which are a list."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    types = r.selectExpr("cast(r_regionkey as string) id", "r_name name", "cast(null as double) confidence", "r_regionkey <> 2 is_entity_type")
    none = r.where("false")
    rules = shapes.from_ontology(types, none.selectExpr("r_name id", "r_name name", "array(r_name) enum_values", "1D confidence"), none.selectExpr("r_name id", "r_name relation_type", "r_name range_label", "1D confidence"))
    entities = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "r_name")
    return entities.join(rules.select(F.col("id").alias("shape_id"), F.col("value").alias("r_name")), "r_name").select("c_custkey", "shape_id")


@query("SELECT id FROM nodes WHERE label='CodeEntity' AND lines>100 AND name NOT IN (SELECT p_name FROM part WHERE p_brand='Brand#13')")
def fil_19_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed entities, as a table of labels and names, never trigger."""
    allowed = table(spark, sf_dir, "part").where("p_brand = 'Brand#13'").select(F.lit("CodeEntity").alias("label"), F.col("p_name").alias("name"))
    g = stored_graph(spark, sf_dir)
    return shapes.not_allowed(g, shapes.triggered(g, shapes.Shape("large", "SELF", "lines", ">", 100, "warn", 1)), allowed)


@query("SELECT 'on' shape_id, count(*) n FROM nodes WHERE label='CodeEntity' AND lines>100")
def fil_20_enabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [shapes.Shape(n, "SELF", "lines", ">", 100, "warn", 1, enabled=n == "on") for n in ("on", "off")]
    return shapes.results(stored_graph(spark, sf_dir), rules).groupBy("shape_id").agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE event_type IN ('click','view') AND value/100.0>=0.5", graph=False)
def fil_21_semantic_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed relations of a known type whose confidence is 0.5 or more."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "event_type relation_type", "value / 100.0D confidence")
    return linking.trusted(e, ("click", "view")).select("event_id")


# Scalar functions



@query("SELECT n_nationkey, n_nationkey%4 k, ['allow','warn','block','escalate'][greatest(1, n_nationkey%4+1-n_nationkey%3)] lowered FROM nation", graph=False)
def fn_04_lowered(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.array(*map(F.lit, S.DEMOTION))
    k = F.pmod("n_nationkey", F.lit(4))
    return table(spark, sf_dir, "nation").select("n_nationkey", k.alias("k"), S.lowered(F.element_at(order, k + 1), F.pmod("n_nationkey", F.lit(3))).alias("lowered"))


@query("SELECT event_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(CASE WHEN event_id%3>0 THEN value/10.0-1 END, 0.8))) confidence FROM events", graph=False)
def fn_06_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.confidence(F.when(F.col("event_id") % 3 > 0, F.col("value") / 10.0 - 1)).alias("confidence"))


@query("SELECT doc_id, substr(text,1,200) short, substr(text,1,500) root, substr(text,1,800) embedded FROM documents", graph=False)
def fn_11_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[F.substring("text", 1, n).alias(a) for a, n in (("short", 200), ("root", 500), ("embedded", 800))])


@query("SELECT p_partkey, p_name||' | '||p_type||CASE WHEN p_partkey%2=0 THEN ' | '||p_brand ELSE '' END searchable FROM part", graph=False)
def fn_13_searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.searchable(F.col("p_name"), F.col("p_type"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("")).alias("searchable"))


@query("SELECT doc_id, sha256(text) digest FROM documents", graph=False)
def fn_28_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT p_partkey, round(1/(1+p_size/10.0::DOUBLE),4) confidence, round(1/(1+p_size/10.0::DOUBLE),4)>=0.7 near FROM part", graph=False)
def fn_29_distance_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    sure = S.distance_confidence(F.col("p_size") / 10.0)
    return table(spark, sf_dir, "part").select("p_partkey", sure.alias("confidence"), (sure >= 0.7).alias("near"))


@query("SELECT p_partkey, round(least(1.0::DOUBLE, p_size*5/100.0::DOUBLE*0.5+(p_size%16)/20.0::DOUBLE*0.5),2) complexity FROM part", graph=False)
def fn_30_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.complexity(F.col("p_size") * 5, F.col("p_size") % 16).alias("complexity"))


@query("SELECT user_id, n, least(1.0::DOUBLE, 0.5+n*0.1::DOUBLE) confidence, least(1.0::DOUBLE, 0.5+n*0.1::DOUBLE)>=0.8 active FROM (SELECT user_id, count(*) n FROM events GROUP BY 1)", graph=False)
def fn_32_skill_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    sure = S.skill_confidence(F.col("n"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", "n", sure.alias("confidence"), (sure >= 0.8).alias("active"))


@query("SELECT event_id FROM events WHERE json_extract_string(props,'$.k')='3'", graph=False)
def fn_34_pattern_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.get_json_object("props", "$.k") == "3").select("event_id")


@query("SELECT event_id, substr(sha256(event_type||':'||user_id||':s:'||event_id),1,12) token FROM events", graph=False)
def fn_38_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with the event id as their nonce."""
    return table(spark, sf_dir, "events").select("event_id", S.approval_token(F.col("event_type"), F.col("user_id"), F.lit("s"), F.col("event_id")).alias("token"))


# Aggregates, orders and sets


@query(", c AS (SELECT label, count(*) n FROM nodes GROUP BY 1) SELECT sum(n)::BIGINT total FROM c")
def agg_04_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_graph(spark, sf_dir).nodes.groupBy("label").count().agg(F.sum("count").alias("total"))


@query("SELECT l_partkey, max(l_quantity) best, arg_max(l_suppkey, (l_quantity, -l_orderkey, -l_linenumber)) supplier FROM lineitem GROUP BY 1", graph=False)
def agg_07_best_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max("l_quantity").alias("best"), F.max_by("l_suppkey", F.struct("l_quantity", -F.col("l_orderkey"), -F.col("l_linenumber"))).alias("supplier"))


@query("SELECT l_orderkey, bool_or(l_quantity>45) some_large, bool_and(l_quantity>10) all_large FROM lineitem GROUP BY 1", graph=False)
def agg_08_some_and_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_quantity") > 45).alias("some_large"), F.bool_and(F.col("l_quantity") > 10).alias("all_large"))


@query("SELECT event_type topic, min(event_id) first_event FROM events GROUP BY 1", graph=False)
def agg_11_first_per_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("topic")).agg(F.min("event_id").alias("first_event"))


@query("SELECT change_type, count(*) n FROM (SELECT CASE WHEN doc_id%3=0 THEN 'DELETED' WHEN doc_id%3=1 THEN 'ADDED' ELSE 'BODY' END change_type FROM documents WHERE doc_id%3<>2 OR doc_id%2=0) GROUP BY 1", graph=False)
def agg_17_changes_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old has documents of rests 0 and 2, new those of 1 and 2, of which the even ones differ."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("content"), F.pmod("doc_id", F.lit(3)).alias("k"), (F.pmod("doc_id", F.lit(2)) == 0).alias("even"))
    new = d.where("k > 0").select("path", F.when((F.col("k") == 2) & F.col("even"), F.concat("content", F.lit("+"))).otherwise(F.col("content")).alias("content"))
    return changes.detect(d.where("k <> 1").select("path", "content"), new).groupBy("change_type").agg(F.count("*").alias("n"))


@query("SELECT dst node, 1 hops, row_number() OVER (ORDER BY dst) place FROM edges WHERE src='n:3'")
def srt_02_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patterns.paths(stored_graph(spark, sf_dir).edges, stored_graph(spark, sf_dir).nodes.where("id = 'n:3'"), 1, 1)
    return found.select("node", "hops", F.row_number().over(Window.partitionBy("hops").orderBy("node")).alias("place"))


@query("SELECT id, name FROM nodes WHERE label='CodeEntity' ORDER BY name, id LIMIT 100")
def srt_04_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred by name: a limit after a total order, so each task keeps a hundred rows."""
    return stored_graph(spark, sf_dir).labelled("CodeEntity").select("id", "name").orderBy("name", "id").limit(100)


@query(SHAPES_SQL + ", one AS (SELECT id, shape_id, priority::BIGINT priority, row_number() OVER (PARTITION BY id ORDER BY priority DESC, shape_id) place FROM hits) SELECT * FROM one")
def srt_06_shapes_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triggered shapes of each entity in order of priority."""
    hits = shapes.results(stored_graph(spark, sf_dir), shapes.SHAPES).select("id", "shape_id", F.col("priority").cast("long").alias("priority"))
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("priority"), "shape_id")).cast("long"))


@query("SELECT 'out' direction, dst other FROM edges WHERE src='p:7' UNION ALL SELECT 'in', src FROM edges WHERE dst='p:7'")
def set_01_both_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stored_graph(spark, sf_dir).edges
    return e.where("src = 'p:7'").select(F.lit("out").alias("direction"), F.col("dst").alias("other")).unionByName(e.where("dst = 'p:7'").select(F.lit("in").alias("direction"), F.col("src").alias("other")))


@query("WITH s AS (SELECT l_suppkey s, list_sort(list_distinct(list(p_brand))) b FROM lineitem JOIN part ON p_partkey=l_partkey GROUP BY 1), r AS (SELECT b FROM s WHERE s=1) SELECT s.s supplier, len(list_intersect(s.b,r.b)) n_both, len(list_distinct(list_concat(s.b,r.b))) n_any FROM s, r", graph=False)
def set_03_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's brands against those of the first one: one row is broadcast."""
    sets = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("supplier")).agg(F.collect_set("p_brand").alias("b"))
    first = sets.where("supplier = 1").select(F.col("b").alias("r"))
    return sets.join(F.broadcast(first)).select("supplier", F.size(F.array_intersect("b", "r")).cast("long").alias("n_both"), F.size(F.array_union("b", "r")).cast("long").alias("n_any"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment='BUILDING')", graph=False)
def set_05_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(known, "o_custkey", "left_anti").select("o_orderkey")


# Joins, vectors, writes


@query("SELECT src, dst FROM edges JOIN nodes a ON a.id=src JOIN nodes b ON b.id=dst WHERE rel_type='imports' AND b.sensitivity IS NOT NULL")
def join_05_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges both of whose ends exist, here with marked ends; the others dangle."""
    g = stored_graph(spark, sf_dir)
    ids = g.nodes.select("id")
    ends = g.nodes.where("sensitivity is not null").select(F.col("id").alias("dst"))
    return g.typed("imports").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ends, "dst", "left_semi").select("src", "dst")


@query("SELECT event_id, coalesce(r_regionkey::VARCHAR, event_type) target FROM events LEFT JOIN region ON r_name=CASE event_id%3 WHEN 0 THEN 'ASIA' WHEN 1 THEN 'EUROPE' ELSE event_type END", graph=False)
def join_15_raw_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names resolve to ids where they are known and stay as they are elsewhere."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "event_type", "case event_id % 3 when 0 then 'ASIA' when 1 then 'EUROPE' else event_type end r_name")
    return e.join(table(spark, sf_dir, "region"), "r_name", "left").select("event_id", F.coalesce(F.col("r_regionkey").cast("string"), "event_type").alias("target"))


CONCEPTS_SQL = "WITH c AS (SELECT n_nationkey::VARCHAR concept_id, CASE WHEN n_nationkey%5=0 THEN 'Twin' ELSE n_name END AS name, n_nationkey ord FROM nation)"


def _concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as string) concept_id", "case when n_nationkey % 5 = 0 then 'Twin' else n_name end name", "array(concat('alias', n_nationkey % 10)) aliases", "n_nationkey ord")


@query(CONCEPTS_SQL + " SELECT name, arg_min(concept_id, ord) concept_id FROM c GROUP BY 1", graph=False)
def vec_06_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal names the first concept wins."""
    c = _concepts(spark, sf_dir)
    return vectors.align(c.select("name"), c).where("method = 'exact'").select("name", "concept_id")


@query("SELECT 'ALIAS'||(n_nationkey%10) AS name, max(n_nationkey)::VARCHAR concept_id FROM nation GROUP BY 1", graph=False)
def vec_07_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In any case; of equal aliases the last concept wins."""
    c = _concepts(spark, sf_dir)
    return vectors.align(c.select(F.upper(c.aliases[0]).alias("name")), c).where("method = 'alias'").select("name", "concept_id")


@query("SELECT p_name||p_partkey AS name, CASE WHEN p_size<=4 THEN 'c'||(p_partkey%7) END concept_id, CASE WHEN p_size<=4 THEN round(1/(1+p_size/10.0::DOUBLE),4) ELSE 0 END confidence FROM part", graph=False)
def vec_08_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest concept counts from a confidence of 0.7 on."""
    p = table(spark, sf_dir, "part")
    near = p.selectExpr("concat(p_name, p_partkey) name", "concat('c', p_partkey % 7) concept_id", "p_size / 10.0D distance")
    return vectors.align(p.select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("name")), _concepts(spark, sf_dir), near).select("name", "concept_id", "confidence")


@query(", v AS (SELECT id, list(DISTINCT name) n FROM (SELECT src id, n.name FROM edges JOIN nodes n ON n.id=dst WHERE rel_type='extends') GROUP BY 1) SELECT id, n[1] AS value FROM v")
def shp_07_path_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values at the ends of each entity's path."""
    g = stored_graph(spark, sf_dir)
    return patterns.paths(g.typed("extends"), g.nodes, 1, 1).join(g.nodes.select(F.col("id").alias("node"), F.col("name").alias("value")), "node").select(F.col("start").alias("id"), "value")


def _swapped(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    g = stored_graph(spark, sf_dir)
    return g, table(spark, sf_dir, "part")


@query("SELECT id, coalesce(CASE WHEN id LIKE 'p:%' THEN 'new'||id END, name) AS name, label FROM nodes WHERE label<>'DocEntity' UNION ALL SELECT 'x:'||p_partkey, NULL, NULL FROM part WHERE p_size=1")
def snk_02_batch_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of nodes merged by id: given values overwrite, missing ones stay, new ids are added."""
    g, p = _swapped(spark, sf_dir)
    batch = p.selectExpr("concat('p:', p_partkey) id", "concat('newp:', p_partkey) name").unionByName(p.where("p_size = 1").selectExpr("concat('x:', p_partkey) id", "cast(null as string) name"))
    return store.upsert(g.nodes.where("label <> 'DocEntity'"), batch, ["id"]).select("id", "name", "label")


@query("SELECT src, dst, rel_type, CASE WHEN rel_type='extends' AND src LIKE 's:%' THEN 0.25 ELSE weight END weight FROM edges")
def snk_05_batch_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of edges merged by its key; those without an end in the graph are dropped."""
    g, s = stored_graph(spark, sf_dir), table(spark, sf_dir, "supplier")
    batch = s.selectExpr("concat('s:', s_suppkey) src", "concat('n:', s_nationkey) dst", "'extends' rel_type", "0.25D weight").unionByName(s.selectExpr("concat('s:', s_suppkey) src", "'nowhere' dst", "'extends' rel_type", "1D weight"))
    return store.upsert_edges(g, batch)


@query("SELECT 0::BIGINT n_nodes, 0::BIGINT n_edges")
def snk_10_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes deleted, and with them all edges."""
    g = stored_graph(spark, sf_dir)
    left = store.delete_nodes(g, g.nodes)
    return left.nodes.agg(F.count("*").alias("n_nodes")).join(F.broadcast(left.edges.agg(F.count("*").alias("n_edges"))))


@query("SELECT c_nationkey::VARCHAR community, string_agg(DISTINCT c_name, ',' ORDER BY c_name) classes, 0::BIGINT n_functions FROM customer GROUP BY 1", graph=False)
def gr_16_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = stored_graph(spark, sf_dir).nodes.where("entity_type = 'class'").select("id", "file_path", "entity_type", "name")
    members = table(spark, sf_dir, "customer").selectExpr("concat('c:', c_custkey) id", "cast(c_nationkey as string) community")
    return clustering.described(members, n).select("community", "classes", F.col("n_functions").cast("long").alias("n_functions"))


@query("SELECT substr(sha256('module|'||sum(('0x'||substr(md5('c:'||c_custkey),1,12))::BIGINT)::VARCHAR||'|'||count(*)),1,32) module_id, count(*) n FROM customer GROUP BY c_nationkey", graph=False)
def gr_17_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules are known by their members, so that equal names do not collide."""
    members = table(spark, sf_dir, "customer").selectExpr("concat('c:', c_custkey) id", "c_nationkey community")
    return clustering.modules(members).select("module_id", "n")


#: Customers of a nation are in one file, orders of a priority in one folder, suppliers in none; each group is a community.
MODULES_SQL = """WITH m AS (SELECT 'c:'||c_custkey id, 'c'||c_nationkey community, 'n'||c_nationkey||'.py' AS name, c_name class FROM customer UNION ALL SELECT 'o:'||o_orderkey, 'o'||(o_orderkey%3), 'orders', NULL FROM orders UNION ALL SELECT 's:'||s_suppkey, 's'||s_nationkey, NULL, NULL FROM supplier),
 k AS (SELECT community, 'module_'||(row_number() OVER (ORDER BY community)-1) AS name FROM (SELECT DISTINCT community FROM m WHERE name IS NULL)),
 g AS (SELECT community, coalesce(any_value(m.name), any_value(k.name)) AS name, count(*) n, string_agg(DISTINCT class, ', ' ORDER BY class) classes, count(*) FILTER (community LIKE 'o%') f,
  substr(sha256('module|'||sum(('0x'||substr(md5(id),1,12))::BIGINT)::VARCHAR||'|'||count(*)),1,32) module_id FROM m LEFT JOIN k USING (community) GROUP BY 1)"""


def _modules(spark: SparkSession, sf_dir: str) -> clustering.Modules:
    g = stored_graph(spark, sf_dir)
    c, o, s = (table(spark, sf_dir, t) for t in ("customer", "orders", "supplier"))
    members = c.selectExpr("concat('c:', c_custkey) id", "concat('c', c_nationkey) community").unionByName(o.selectExpr("concat('o:', o_orderkey) id", "concat('o', o_orderkey % 3) community")).unionByName(s.selectExpr("concat('s:', s_suppkey) id", "concat('s', s_nationkey) community"))
    edges = g.typed("calls").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return clustering.saved(edges, members, g.nodes.where("id like 'c:%' or id like 'o:%' or id like 's:%'"))


@query(MODULES_SQL + " SELECT module_id id, name, md5(concat_ws(' | ', 'Classes: '||classes, CASE WHEN f>0 THEN f||' function(s)' END)) description, n AS size FROM g", graph=False)
def gr_17_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules with their names, counted where there is none, and descriptions."""
    made = _modules(spark, sf_dir).nodes
    return made.select("id", "name", F.md5(F.coalesce("description", F.lit(""))).alias("description"), "size")


@query(MODULES_SQL + " SELECT module_id src, id dst, 'contains' rel_type FROM m JOIN g USING (community)", graph=False)
def gr_17_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _modules(spark, sf_dir).contains


@query(MODULES_SQL + ", t AS (SELECT name, max(community) community FROM g GROUP BY 1) SELECT t.name parent, id child, 0.0::DOUBLE cohesion, n entity_count FROM t JOIN g USING (community) JOIN m USING (community)", graph=False)
def gr_17_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent and child rows; of the three modules named orders the last counts. Calls leave each module, so none coheres."""
    return _modules(spark, sf_dir).tree


@query("SELECT o_orderkey, regexp_replace('repo/'||o_orderpriority, '^repo/', '/root/repo/') path FROM orders", graph=False)
def inc_09_absolute_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", changes.absolute(F.concat(F.lit("repo/"), "o_orderpriority"), "/root/repo").alias("path"))


# Source files

SOURCE = """import os.path as p
from json import loads
@app.get('/x')
class C{k}(Base):
    '''Doc.'''
    def m(self):
        requests.post('http://svc{n}/a')
        bus.send(f'topic{{x}}.{n}')
        return helper{n}(len(loads))
def f{k}():
    pass
"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file for each customer; some do not parse. Few bytes make long work, so their keys are dealt out first."""
    body = F.lit(SOURCE.replace("{{x}}", "{x}"))
    for mark, c in (("{k}", "c_custkey"), ("{n}", "c_nationkey")):
        body = F.replace(body, F.lit(mark), F.col(c).cast("string"))
    broken = F.when(F.col("c_custkey") % 10 == 0, F.lit("def (")).otherwise(body)
    keys = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return keys.select(F.format_string("src/f%d.py", F.col("c_custkey")).alias("path"), broken.cast("binary").alias("content"))


_FILES_SQL = "WITH c AS (SELECT c_custkey k, c_nationkey n, 'src/f'||c_custkey||'.py' file_path FROM customer), g AS (SELECT * FROM c WHERE k%10<>0)"


@query(_FILES_SQL + " SELECT file_path, 'module' kind, 'f'||k AS name, 0 start_line, NULL::VARCHAR doc FROM c UNION ALL SELECT file_path, 'class', 'C'||k, 3, 'Doc.' FROM g UNION ALL SELECT file_path, 'function', 'C'||k||'.m', 5, NULL FROM g UNION ALL SELECT file_path, 'function', 'f'||k, 9, NULL FROM g", graph=False)
def prs_02_python_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules, classes and functions; a file that does not parse keeps its module."""
    return files.python_entities(_sources(spark, sf_dir)).where("kind in ('module', 'class', 'function')").select("file_path", "kind", "name", "start_line", F.col("target").alias("doc"))


@query(_FILES_SQL + " SELECT file_path, unnest(['path','loads']) target FROM g", graph=False)
def prs_03_python_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.python_entities(_sources(spark, sf_dir)).where("kind = 'imports'").select("file_path", "target")


@query(_FILES_SQL + " SELECT file_path, 'C'||k||'.m' AS name, unnest(['post','send','helper'||n]) target FROM g", graph=False)
def prs_04_python_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls inside functions by their last name, without builtins; those of decorators are no calls of theirs."""
    return files.python_entities(_sources(spark, sf_dir)).where("kind = 'calls'").select("file_path", "name", "target")


@query(_FILES_SQL + " SELECT file_path, 'C'||k AS name, 'http_api' category FROM g", graph=False)
def prs_05_python_decorators(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.python_entities(_sources(spark, sf_dir), True).where("kind = 'decorated_by'")
    return found.select("file_path", "name", entry_points.python_category(F.col("target")).alias("category"))


@query(_FILES_SQL + " SELECT file_path, 'f'||k AS name, 'calls_service' kind, 'svc'||n target FROM g UNION ALL SELECT file_path, 'f'||k, 'publishes_to', 'topic.'||n FROM g", graph=False)
def prs_10_external_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services and topics that files reach; of f-strings only the static parts are known."""
    found = files.python_entities(_sources(spark, sf_dir)).where("kind in ('calls_service', 'publishes_to')")
    return found.select("file_path", "name", "kind", "target")
