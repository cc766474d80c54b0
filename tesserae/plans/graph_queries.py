"""Queries over the graph of the supplied tables: scans, filters, patterns, traversals, impact, clustering, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph, stored_graph, table, with_graph
from ..operators import clustering, impact, patterns, store

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None, graph: bool = True):
    """Registers a query under its function's name, with its SQL over the graph or, without graph, the plain tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_graph(sql) if graph else sql
        return f

    return add


@query("SELECT id, name FROM nodes WHERE label = 'ServiceEntity'")
def src_03_label_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_graph(spark, sf_dir).labelled("ServiceEntity").select("id", "name")


@query("SELECT src, dst, rel_type FROM edges JOIN nodes a ON a.id=src JOIN nodes b ON b.id=dst WHERE rel_type IN ('calls','imports') AND a.label='CodeEntity' AND b.label='CodeEntity'")
def src_04_edge_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("label") == "CodeEntity"
    return patterns.one_hop(stored_graph(spark, sf_dir), ["calls", "imports"], code, code)


@query("SELECT id, label, name, file_path, sensitivity, lines::BIGINT lines FROM nodes WHERE id = 'p:7'")
def src_06_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_graph(spark, sf_dir).nodes.where("id = 'p:7'").select("id", "label", "name", "file_path", "sensitivity", F.col("lines").cast("long").alias("lines"))


@query("SELECT src, dst, rel_type, weight FROM edges WHERE src='p:7' AND rel_type='implements'")
def src_07_edge_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_graph(spark, sf_dir).typed("implements").where("src = 'p:7'")


@query("SELECT id, name FROM nodes WHERE label='CodeEntity' AND contains(name, '12') AND entry_category IS NOT NULL AND starts_with(file_path, 'src/n1')")
def fil_02_contains_prefix_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_graph(spark, sf_dir).labelled("CodeEntity").where(F.col("name").contains("12") & F.col("entry_category").isNotNull() & F.col("file_path").startswith("src/n1")).select("id", "name")


@query("SELECT id, label FROM nodes WHERE label IN ('ModuleEntity','RepositoryEntity')")
def fil_04_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_graph(spark, sf_dir).nodes.where(F.col("label").isin("ModuleEntity", "RepositoryEntity")).select("id", "label")


@query("SELECT id FROM nodes n WHERE label='CodeEntity' AND id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)")
def fil_06_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.isolated(stored_graph(spark, sf_dir), "CodeEntity").select("id")


@query("SELECT id, concat_ws(',', CASE WHEN sensitivity IS NOT NULL THEN 'sensitivity' END, CASE WHEN lines IS NOT NULL THEN 'lines' END, CASE WHEN entry_category IS NOT NULL THEN 'entryCategory' END) AS fields FROM nodes WHERE label='CodeEntity'")
def fil_14_given_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = [F.when(F.col(c).isNotNull(), F.lit(n)) for c, n in (("sensitivity", "sensitivity"), ("lines", "lines"), ("entry_category", "entryCategory"))]
    return stored_graph(spark, sf_dir).labelled("CodeEntity").select("id", F.concat_ws(",", *given).alias("fields"))


@query("SELECT src, dst, rel_type FROM edges JOIN nodes a ON a.id=src JOIN nodes b ON b.id=dst WHERE rel_type='calls' AND b.entry_category='http_api'")
def join_01_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.one_hop(stored_graph(spark, sf_dir), ["calls"], F.col("label") == "CodeEntity", F.col("entry_category") == "http_api")


@query("SELECT DISTINCT e.src, f.dst, m.name AS via FROM edges e JOIN edges f ON f.src=e.dst JOIN nodes m ON m.id=e.dst WHERE e.rel_type='extends' AND f.rel_type='semantic_impact'")
def join_02_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = stored_graph(spark, sf_dir)
    e, f = g.typed("extends").select("src", F.col("dst").alias("mid")), g.typed("semantic_impact").select(F.col("src").alias("mid"), "dst")
    return e.join(f, "mid").join(g.nodes.select(F.col("id").alias("mid"), F.col("name").alias("via")), "mid").select("src", "dst", "via").distinct()


@query("SELECT src, dst, rel_type FROM edges WHERE rel_type IN ('extends','semantic_impact') AND src LIKE 'n:%' UNION ALL SELECT dst, src, rel_type FROM edges WHERE rel_type IN ('extends','semantic_impact') AND dst LIKE 'n:%'")
def join_04_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.one_hop(stored_graph(spark, sf_dir), ["extends", "semantic_impact"], F.col("label") == "ModuleEntity", F.lit(True), "both")


@query("SELECT e.* FROM edges e WHERE src IN (SELECT id FROM nodes WHERE label='ModuleEntity' OR label='RepositoryEntity') AND dst IN (SELECT id FROM nodes WHERE label='ModuleEntity' OR label='RepositoryEntity')")
def join_17_induced(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = stored_graph(spark, sf_dir)
    return patterns.induced(g.edges, g.nodes.where(F.col("label").isin("ModuleEntity", "RepositoryEntity")))


@query("SELECT p.src AS start, r.dst AS node, 3::BIGINT AS hops FROM edges p JOIN edges q ON q.src=p.dst AND q.rel_type='extends' JOIN edges r ON r.src=q.dst AND r.rel_type='semantic_impact' WHERE p.rel_type='calls' UNION ALL SELECT p.src, q.dst, 2 FROM edges p JOIN edges q ON q.src=p.dst AND q.rel_type='extends' WHERE p.rel_type='calls'")
def gr_01_bounded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = stored_graph(spark, sf_dir)
    orders = g.typed("calls").select(F.col("src").alias("id")).distinct()
    return patterns.paths(g.typed("calls", "extends", "semantic_impact"), orders, 2, 3).withColumn("hops", F.col("hops").cast("long"))


def _calls(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers as functions, each calling the one of a third of its number: chains as long as the logarithm of their number."""
    c = table(spark, sf_dir, "customer")
    nodes = c.select("c_custkey", F.col("c_name").alias("name"), F.when(F.col("c_mktsegment") == "BUILDING", "http_api").alias("entry_category"))
    edges = c.where("c_custkey > 0").selectExpr("concat('c:', c_custkey) src", "concat('c:', c_custkey div 3) dst", "'calls' rel_type", "1.0D weight")
    return Graph(nodes.withColumn("id", F.concat(F.lit("c:"), "c_custkey")).drop("c_custkey"), edges)


CALLS_SQL = "WITH RECURSIVE walk AS (SELECT c_custkey AS caller, c_custkey // 3 AS callee, 1 AS hops FROM customer WHERE c_custkey > 0 UNION ALL SELECT caller, callee // 3, hops + 1 FROM walk WHERE callee > 0 AND hops < 10)"


@query(CALLS_SQL + " SELECT 'c:'||caller AS start, 'c:'||callee AS node, hops::BIGINT AS hops FROM walk WHERE hops <= 3", graph=False)
def gr_02_call_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three calls onwards from every function, a row per path."""
    g = _calls(spark, sf_dir)
    return patterns.paths(g.edges, g.nodes.select("id"), 1, 3).withColumn("hops", F.col("hops").cast("long"))


@query(CALLS_SQL + " SELECT DISTINCT 'c:'||callee AS start, 'c:'||caller AS node, c_name AS name, hops::BIGINT AS distance FROM walk JOIN customer ON c_custkey=caller WHERE c_mktsegment='BUILDING'", graph=False)
def gr_03_business_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry points from which each function is called over up to ten calls, and at what distance."""
    g = _calls(spark, sf_dir)
    return patterns.business_impact(g, g.nodes.select("id")).withColumn("distance", F.col("distance").cast("long"))


@query(""", two AS (SELECT src a, dst b FROM edges UNION SELECT dst, src FROM edges),
 l1 AS (SELECT DISTINCT b FROM two WHERE a='n:3'), l2 AS (SELECT DISTINCT y.b FROM l1 JOIN two y ON y.a=l1.b),
 near AS (SELECT id FROM nodes WHERE id <> 'n:3' AND id IN (SELECT b FROM l1 UNION SELECT b FROM l2) ORDER BY id LIMIT 500)
 SELECT id, label, name FROM nodes WHERE id='n:3' OR id IN (SELECT id FROM near)""")
def gr_04_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.neighbourhood(stored_graph(spark, sf_dir), "n:3", 2, 500).nodes.select("id", "label", "name")


def _impacts(spark: SparkSession, sf_dir: str, prefix: str, change: str) -> tuple[Graph, DataFrame]:
    g = stored_graph(spark, sf_dir)
    changed = g.nodes.where(F.col("id").startswith(prefix)).select("id", F.lit(change).alias("change"))
    return g, impact.impact(g.edges, changed)


IMPACT_SQL = """, w(rel, wt) AS (VALUES ('calls',0.7::DOUBLE),('implements',0.5),('extends',0.6),('imports',0.3),('semantic_impact',0.4)),
 steps AS (SELECT dst a, src b, wt, 'FORWARD' dir FROM edges JOIN w ON rel=rel_type UNION ALL SELECT src, dst, wt, 'BACKWARD' FROM edges JOIN w ON rel=rel_type),
 s AS (SELECT id FROM nodes WHERE label='ServiceEntity'),
 l1 AS (SELECT s.id src, dir, b node, max(wt) score FROM s JOIN steps ON a=s.id WHERE b<>s.id AND wt>=0.05 GROUP BY ALL),
 l2 AS (SELECT * FROM (SELECT l1.src, l1.dir, st.b node, max(st.wt*0.6) score FROM l1 JOIN steps st ON st.a=l1.node AND st.dir=l1.dir WHERE st.b<>l1.src AND st.wt*0.6>=0.05 GROUP BY ALL) c WHERE NOT EXISTS (SELECT 1 FROM l1 x WHERE x.src=c.src AND x.dir=c.dir AND x.node=c.node AND x.score>=c.score)),
 l3 AS (SELECT l2.src, l2.dir, st.b node, max(st.wt*0.3) score FROM l2 JOIN steps st ON st.a=l2.node AND st.dir=l2.dir WHERE st.b<>l2.src AND st.wt*0.3>=0.05 GROUP BY ALL),
 every AS (SELECT *, 1 d FROM l1 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3),
 best AS (SELECT node, dir, score, d, row_number() OVER (PARTITION BY node, dir ORDER BY score DESC, d) r FROM every),
 kind(rel, digit) AS (VALUES ('calls','1'),('describes','2'),('extends','3'),('implements','4'),('imports','5'),('semantic_impact','6')),
 hop AS (SELECT dst a, src b, wt, digit, 'FORWARD' dir FROM edges JOIN w ON rel=rel_type JOIN kind k ON k.rel=rel_type UNION ALL SELECT src, dst, wt, digit, 'BACKWARD' FROM edges JOIN w ON rel=rel_type JOIN kind k ON k.rel=rel_type),
 w1 AS (SELECT DISTINCT s.id src, dir, a AS via, b node, wt score, digit AS path FROM s JOIN hop ON a=s.id WHERE wt>=0.05),
 w2 AS (SELECT DISTINCT x.src, x.dir, h.a via, h.b node, h.wt*0.6 score, x.path||h.digit AS path FROM w1 x JOIN hop h ON h.a=x.node AND h.dir=x.dir WHERE h.wt*0.6>=0.05),
 w3 AS (SELECT DISTINCT x.src, x.dir, h.a via, h.b node, h.wt*0.3 score, x.path||h.digit AS path FROM w2 x JOIN hop h ON h.a=x.node AND h.dir=x.dir WHERE h.wt*0.3>=0.05),
 walks AS (SELECT *, 1 d FROM w1 UNION ALL SELECT *, 2 FROM w2 UNION ALL SELECT *, 3 FROM w3),
 bound AS (SELECT *, bool_or(src<>node) OVER (PARTITION BY dir, node, via, d, right(path,1)) o FROM walks),
 near AS (SELECT b.* FROM bound b JOIN best m ON m.r=1 AND m.node=b.node AND m.dir=b.dir AND m.d=b.d AND round(m.score,6)=round(b.score,6) WHERE o),
 ends AS (SELECT dir, node, min(src||chr(1)||path) lo, max(src||chr(1)||path) hi FROM near GROUP BY ALL),
 witness AS (SELECT dir, node, CASE WHEN split_part(lo,chr(1),1)<>node THEN lo ELSE hi END x FROM ends),
 merged AS (SELECT n.id node_id, n.label, n.name, n.file_path, best.dir AS direction, round(score,6) impact_score, CASE WHEN score>=0.8 THEN 'CRITICAL' WHEN score>=0.5 THEN 'HIGH' WHEN score>=0.2 THEN 'MEDIUM' ELSE 'LOW' END severity, d::INT depth,
  split_part(x,chr(1),1) source_node_id, replace(replace(replace(replace(replace(replace(rtrim(regexp_replace(split_part(x,chr(1),2),'(.)','\\1>','g'),'>'),'1','calls'),'2','describes'),'3','extends'),'4','implements'),'5','imports'),'6','semantic_impact') relation_path
  FROM best JOIN nodes n ON n.id=best.node JOIN witness USING (dir, node) WHERE r=1)"""


@query(IMPACT_SQL + " SELECT * FROM merged")
def gr_07_impact_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact of a changed body of every service, in both directions, with the service and the relations that lead there."""
    g, found = _impacts(spark, sf_dir, "s:", "BODY")
    return impact.merged(found, g.nodes).withColumn("relation_path", F.array_join("relation_path", ">"))


@query(IMPACT_SQL + " SELECT severity, count(*) n, count(DISTINCT file_path) n_files FROM merged GROUP BY severity")
def gr_11_impact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, found = _impacts(spark, sf_dir, "s:", "BODY")
    return impact.report(impact.merged(found, g.nodes))


ALL_CHANGES_SQL = ", w(rel, change, wt) AS (VALUES " + ", ".join(f"('{r}','{c}',{w}::DOUBLE)" for r, ws in impact.WEIGHTS.items() for c, w in zip(impact.CHANGES, ws, strict=True)) + """),
 steps AS (SELECT dst a, src b, rel_type, 'FORWARD' dir FROM edges UNION ALL SELECT src, dst, rel_type, 'BACKWARD' FROM edges),
 s AS (SELECT DISTINCT id, change FROM nodes, w WHERE label='ModuleEntity'),
 l1 AS (SELECT s.id src, s.change, dir, b node, max(wt) score FROM s JOIN steps ON a=s.id JOIN w ON rel=rel_type AND w.change=s.change WHERE b<>s.id AND wt>=0.05 GROUP BY ALL),
 l2 AS (SELECT l1.src, l1.change, l1.dir, b node, max(wt*0.6) score FROM l1 JOIN steps st ON st.a=l1.node AND st.dir=l1.dir JOIN w ON rel=rel_type AND w.change=l1.change WHERE b<>l1.src AND wt*0.6>=0.05 GROUP BY ALL),
 l3 AS (SELECT l2.src, l2.change, l2.dir, b node, max(wt*0.3) score FROM l2 JOIN steps st ON st.a=l2.node AND st.dir=l2.dir JOIN w ON rel=rel_type AND w.change=l2.change WHERE b<>l2.src AND wt*0.3>=0.05 GROUP BY ALL),
 best AS (SELECT change, dir, node, max(score) score FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) GROUP BY ALL)"""


@query(ALL_CHANGES_SQL + " SELECT change, dir AS direction, count(*) n, round(max(score), 6) AS top, round(avg(score), 6) AS mean FROM best GROUP BY ALL")
def gr_09_impact_all_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impacts of all modules for each kind of change, grouped by kind."""
    g = stored_graph(spark, sf_dir)
    changed = g.labelled("ModuleEntity").select("id", F.explode(F.array(*map(F.lit, impact.CHANGES))).alias("change"))
    return impact.impact(g.edges, changed).groupBy("change", "direction").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("top"), F.round(F.avg("score"), 6).alias("mean"))


CLUSTER_SQL = """, own AS (SELECT * FROM nodes WHERE label IN ('ModuleEntity','RepositoryEntity','ServiceEntity')),
 pairs AS (SELECT DISTINCT least(src,dst) a, greatest(src,dst) b FROM edges WHERE rel_type IN ('extends','semantic_impact') AND src IN (SELECT id FROM own) AND dst IN (SELECT id FROM own))"""


def _cluster_edges(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    g = stored_graph(spark, sf_dir)
    own = g.nodes.where(F.col("label").isin("ModuleEntity", "RepositoryEntity", "ServiceEntity"))
    return g, clustering.clustering_edges(g.edges, own, ["extends", "semantic_impact"])


@query(CLUSTER_SQL + " SELECT a, b FROM pairs")
def gr_12_clustering_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cluster_edges(spark, sf_dir)[1]


@query(""", f AS (SELECT id, file_path FROM nodes WHERE id LIKE 'p:%'), s AS (SELECT file_path FROM f GROUP BY 1 HAVING count(*) BETWEEN 2 AND 30)
 SELECT x.id a, y.id b FROM f x JOIN f y USING (file_path) JOIN s USING (file_path) WHERE x.id<y.id""")
def gr_12_same_file_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = stored_graph(spark, sf_dir)
    return clustering.clustering_edges(g.edges, g.nodes.where("id like 'p:%'"), ["calls"])


#: In sorted order a module first meets its repository, so in the first sweep all take the repository's label and keep it.
@query("SELECT 'n:'||n_nationkey id, 'r:'||n_regionkey community FROM nation UNION ALL SELECT 'r:'||r_regionkey, 'r:'||r_regionkey FROM region UNION ALL SELECT 's:'||s_suppkey, 'r:'||n_regionkey FROM supplier JOIN nation ON s_nationkey=n_nationkey", graph=False)
def gr_13_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, edges = _cluster_edges(spark, sf_dir)
    return clustering.label_propagation(edges, g.nodes.where(F.col("label").isin("ModuleEntity", "RepositoryEntity", "ServiceEntity")))


#: In sorted order a conversation comes before its turns and takes the label of the first of them, which all of them then take.
@query("SELECT DISTINCT 'c:'||conv_id id, min('t:'||conv_id||':'||turn) OVER (PARTITION BY conv_id) community FROM conversations UNION ALL SELECT DISTINCT 't:'||conv_id||':'||turn, min('t:'||conv_id||':'||turn) OVER (PARTITION BY conv_id) FROM conversations", graph=False)
def gr_13_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations and their turns: a component each, however many turns it has."""
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c:"), F.col("conv_id").cast("string")).alias("a"), F.concat(F.lit("t:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("b")).distinct()
    return clustering.label_propagation(turns)


@query(CLUSTER_SQL + """, m AS (SELECT 'n:'||n_nationkey id, n_regionkey community FROM nation UNION ALL SELECT 'r:'||r_regionkey, r_regionkey FROM region UNION ALL SELECT 's:'||s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey=n_nationkey),
 i AS (SELECT x.community, count(*) k FROM pairs JOIN m x ON x.id=a JOIN m y ON y.id=b WHERE x.community=y.community GROUP BY 1), z AS (SELECT community, count(*) n FROM m GROUP BY 1)
 SELECT z.community, n, coalesce(k,0) n_inside, round(CASE WHEN n>1 THEN coalesce(k,0)/(n*(n-1)/2) ELSE 0 END, 6) cohesion FROM z LEFT JOIN i USING (community)""")
def gr_14_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = _cluster_edges(spark, sf_dir)
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    ids = [n.selectExpr("concat('n:', n_nationkey) id", "n_regionkey community"), r.selectExpr("concat('r:', r_regionkey)", "r_regionkey"), s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("concat('s:', s_suppkey)", "n_regionkey")]
    found = clustering.cohesion(edges, ids[0].union(ids[1]).union(ids[2]))
    return found.withColumn("cohesion", F.round("cohesion", 6))


@query(", m AS (SELECT id, file_path, name, entity_type, split_part(file_path,'/',1) community FROM nodes WHERE label='CodeEntity') SELECT community, community AS name, md5(string_agg(CASE WHEN entity_type='class' THEN name END, ',' ORDER BY name)) AS classes, count(*) FILTER (entity_type='function') n_functions FROM m GROUP BY community")
def gr_15_module_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = stored_graph(spark, sf_dir)
    members = g.labelled("CodeEntity").select("id", F.split("file_path", "/")[0].alias("community"))
    return clustering.described(members, g.nodes).withColumn("classes", F.md5(F.nullif("classes", F.lit(""))))


@query("""WITH d AS (SELECT DISTINCT l_partkey id, l_suppkey item FROM lineitem), g AS (SELECT id, string_agg(item, ',' ORDER BY item) items, count(*) n FROM d GROUP BY 1), rep AS (SELECT min(id) id, n FROM g GROUP BY items, n), r AS (SELECT d.* FROM d JOIN rep USING (id))
 SELECT a, b, round(k/(x.n+y.n-k),6) overlap FROM (SELECT p.id a, q.id b, count(*) k FROM r p JOIN r q USING (item) WHERE p.id<q.id GROUP BY 1,2) JOIN rep x ON x.id=a JOIN rep y ON y.id=b WHERE k/(x.n+y.n-k) > 0.3""", graph=False)
def gr_18_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with similar sets of suppliers; parts of equal sets count once, under their smallest key."""
    sets = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("item"))
    return clustering.jaccard(sets, 0.3).withColumn("overlap", F.round("overlap", 6))


@query("SELECT id, count(*) FILTER (o) AS out_degree, count(*) FILTER (NOT o) AS in_degree FROM (SELECT src id, true o FROM edges UNION ALL SELECT dst, false FROM edges) GROUP BY id")
def gr_19_node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.degrees(stored_graph(spark, sf_dir))


@query(""", q(wanted) AS (VALUES ('ASIA'), ('ATION_1'), ('no such name')), e AS (SELECT wanted, id FROM (SELECT wanted, id, row_number() OVER (PARTITION BY wanted ORDER BY coalesce(file_path,''), id) r FROM q JOIN nodes ON name=wanted) WHERE r=1),
 l AS (SELECT wanted, id FROM (SELECT wanted, id, row_number() OVER (PARTITION BY wanted ORDER BY coalesce(file_path,''), id) r FROM q JOIN nodes ON contains(name, wanted) WHERE wanted NOT IN (SELECT wanted FROM e)) WHERE r=1)
 SELECT wanted, id, 'exact' how FROM e UNION ALL SELECT wanted, id, 'contains' FROM l""")
def gr_22_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("ASIA",), ("ATION_1",), ("no such name",)], "wanted string")
    return patterns.resolve(stored_graph(spark, sf_dir).nodes, wanted)


@query("SELECT label, count(*) n FROM nodes GROUP BY label")
def agg_01_count_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_graph(spark, sf_dir).nodes.groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM nodes) n_nodes, (SELECT count(*) FROM edges) n_edges, (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)) n_isolated")
def agg_02_totals_and_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = stored_graph(spark, sf_dir)
    with_edges = g.nodes.join(patterns.degrees(g), "id", "left")
    edges = g.edges.agg(F.count("*").alias("n_edges"))
    return with_edges.agg(F.count("*").alias("n_nodes"), F.count_if(F.col("out_degree").isNull()).alias("n_isolated")).crossJoin(edges)


@query("SELECT dst AS id, list_aggregate(list_sort(list(DISTINCT entity_type)), 'string_agg', ',') AS kinds, count(DISTINCT src) n FROM edges JOIN nodes a ON a.id=src GROUP BY dst")
def agg_03_collect_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = stored_graph(spark, sf_dir)
    kinds = g.nodes.select(F.col("id").alias("src"), "entity_type")
    return g.edges.join(kinds, "src").groupBy(F.col("dst").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("entity_type")), ",").alias("kinds"), F.countDistinct("src").alias("n"))


@query("SELECT regexp_extract(file_path, '(\\.[a-z]+)$', 1) AS ext, count(DISTINCT file_path) n_files, count(*) n FROM nodes WHERE file_path IS NOT NULL GROUP BY 1")
def agg_10_files_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scalars import suffix

    return stored_graph(spark, sf_dir).nodes.where("file_path is not null").groupBy(suffix(F.col("file_path")).alias("ext")).agg(F.countDistinct("file_path").alias("n_files"), F.count("*").alias("n"))


NEW_SQL = ", new AS (SELECT 'p:'||p_partkey id, upper(p_name) AS name, CASE WHEN p_size>40 THEN 7 END lines FROM part WHERE p_size>30 UNION ALL SELECT 'x:1', 'added', 5)"


def _new(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where("p_size > 30").selectExpr("concat('p:', p_partkey) id", "upper(p_name) name", "case when p_size > 40 then 7 end lines")
    return part.unionByName(spark.createDataFrame([("x:1", "added", 5)], "id string, name string, lines int"))


@query(NEW_SQL + " SELECT coalesce(n.id, o.id) id, coalesce(n.name, o.name) AS name, o.label, coalesce(n.lines, o.lines)::BIGINT lines FROM nodes o FULL JOIN new n ON n.id=o.id")
def snk_01_upsert_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = stored_graph(spark, sf_dir)
    return store.upsert(g.nodes, _new(spark, sf_dir), ["id"]).select("id", "name", "label", F.col("lines").cast("long").alias("lines"))


@query("SELECT src, rel_type, dst, CASE WHEN rel_type='semantic_impact' THEN 0.9 ELSE weight END weight FROM edges UNION ALL SELECT 'n:1', 'affects', 'r:2', 0.3")
def snk_03_upsert_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = stored_graph(spark, sf_dir)
    new = g.typed("semantic_impact").withColumn("weight", F.lit(0.9)).unionByName(spark.createDataFrame([("n:1", "r:2", "affects", 0.3), ("n:1", "nowhere", "affects", 0.3)], "src string, dst string, rel_type string, weight double"))
    return store.upsert_edges(g, new).select("src", "rel_type", "dst", "weight")


@query(", gone AS (SELECT id FROM nodes WHERE id LIKE 'n:1%' OR sensitivity='restricted') SELECT rel_type, count(*) n FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) GROUP BY 1 UNION ALL SELECT label, count(*) FROM nodes WHERE id NOT IN (SELECT id FROM gone) GROUP BY 1")
def snk_06_delete_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = stored_graph(spark, sf_dir)
    left = store.delete_nodes(g, g.nodes.where("id like 'n:1%' or sensitivity = 'restricted'"))
    return left.edges.groupBy("rel_type").agg(F.count("*").alias("n")).union(left.nodes.groupBy("label").agg(F.count("*").alias("n")))


@query("SELECT src, rel_type, dst FROM edges WHERE rel_type IN ('extends','semantic_impact') AND NOT (rel_type='extends' AND src LIKE 's:%')")
def snk_07_delete_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = stored_graph(spark, sf_dir)
    few = Graph(g.nodes, g.typed("extends", "semantic_impact"))
    return store.delete_edges(few, few.edges.where("rel_type = 'extends' and src like 's:%'")).edges.select("src", "rel_type", "dst")


@query("""SELECT id, '"'||id||'" [label="'||name||'"];' AS line FROM nodes UNION ALL SELECT src||'|'||rel_type||'|'||dst, '"'||src||'" -> "'||dst||'" [label="'||rel_type||'"];' FROM edges JOIN nodes a ON a.id=src JOIN nodes b ON b.id=dst""")
def snk_14_export_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.exported(stored_graph(spark, sf_dir), "dot")


@query("""SELECT id, '{"data":{"id":"'||id||'","label":"'||label||'","name":"'||name||'"}}' AS line FROM nodes UNION ALL SELECT src||'|'||rel_type||'|'||dst, '{"data":{"source":"'||src||'","target":"'||dst||'","type":"'||rel_type||'"}}' FROM edges JOIN nodes a ON a.id=src JOIN nodes b ON b.id=dst""")
def snk_14_export_cytoscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.exported(stored_graph(spark, sf_dir), "cytoscape")


@query("SELECT id, concat_ws(' ', entity_type, name, CASE WHEN file_path IS NOT NULL THEN 'in '||file_path END) AS text FROM nodes WHERE label IN ('CodeEntity','ModuleEntity')")
def snk_16_vector_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = stored_graph(spark, sf_dir)
    return g.nodes.where(F.col("label").isin("CodeEntity", "ModuleEntity")).select("id", F.concat_ws(" ", "entity_type", "name", F.concat(F.lit("in "), F.col("file_path"))).alias("text"))


@query("SELECT rel_type, a.label AS src_label, b.label AS dst_label, count(*) n FROM edges JOIN nodes a ON a.id=src JOIN nodes b ON b.id=dst WHERE (rel_type, a.label, b.label) NOT IN (('calls','CodeEntity','CodeEntity'),('imports','CodeEntity','CodeEntity'),('implements','CodeEntity','CodeEntity'),('extends','CodeEntity','CodeEntity')) GROUP BY ALL")
def domain_range_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose ends do not have the labels that their relation allows."""
    g = stored_graph(spark, sf_dir)
    code = ("calls", "imports", "implements", "extends")
    ends = [g.nodes.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label")) for c in ("src", "dst")]
    met = g.edges.join(ends[0], "src").join(ends[1], "dst").groupBy("rel_type", "src_label", "dst_label").agg(F.count("*").alias("n"))
    return met.where(~(F.col("rel_type").isin(*code) & (F.col("src_label") == "CodeEntity") & (F.col("dst_label") == "CodeEntity")))
