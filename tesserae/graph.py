"""Property graphs as two DataFrames, and the graph that the supplied tables stand for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path

NODE_COLUMNS = ["id", "label", "name", "entity_type", "file_path", "entry_category", "sensitivity", "lines"]
EDGE_COLUMNS = ["src", "dst", "rel_type", "weight"]
NODE_SCHEMA = ", ".join(f"{c} {'int' if c == 'lines' else 'string'}" for c in NODE_COLUMNS)
EDGE_SCHEMA = "src string, dst string, rel_type string, weight double"


@dataclass
class Graph:
    """nodes are unique by id, edges by (src, rel_type, dst)."""

    nodes: DataFrame
    edges: DataFrame

    def labelled(self, label: str) -> DataFrame:
        return self.nodes.where(F.col("label") == label)

    def typed(self, *types: str) -> DataFrame:
        return self.edges.where(F.col("rel_type").isin(*types)) if types else self.edges

    def save(self, path: str) -> None:
        """Write the graph below path, nodes by label and edges by type, so that scans of one read only its files."""
        save_nodes(self.nodes, path)
        save_edges(self.edges, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Graph:
        return cls(load_nodes(spark, path), load_edges(spark, path))


# Rows are written where they are: a shuffle by label or type would move them all once more.
def save_nodes(nodes: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")


def save_edges(edges: DataFrame, path: str) -> None:
    edges.write.mode("overwrite").partitionBy("rel_type").parquet(f"{path}/edges")


# The schema is stated, so that no file is opened to plan, and so are the partitions' types.
def load_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes").select(NODE_COLUMNS)


def load_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EDGE_SCHEMA).parquet(f"{path}/edges").select(EDGE_COLUMNS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nodes(df: DataFrame, prefix: str, key: str, label: str, name: str, entity_type: str, **more: Column) -> DataFrame:
    known = {"id": F.concat(F.lit(prefix), F.col(key).cast("string")), "label": F.lit(label), "name": F.col(name).cast("string"), "entity_type": F.lit(entity_type)} | more
    kinds = {"lines": "int"}
    return df.select(*[known.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in NODE_COLUMNS])


def _edges(df: DataFrame, src: tuple[str, str], dst: tuple[str, str], kind: str, weight: float = 1.0) -> DataFrame:
    ends = [F.concat(F.lit(p), F.col(k).cast("string")).alias(n) for (p, k), n in ((src, "src"), (dst, "dst"))]
    return df.select(*ends, F.lit(kind).alias("rel_type"), F.lit(weight).alias("weight"))


def graph_from_tables(spark: SparkSession, sf_dir: str) -> Graph:
    """A code graph laid over the star schema: a label filter prunes whole tables, since each branch has a literal label."""
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents")}
    size = F.col("p_size")
    bands = F.when(size <= 10, "public").when(size <= 25, "internal").when(size <= 40, "confidential").otherwise("restricted")
    nodes = [
        _nodes(t["region"], "r:", "r_regionkey", "RepositoryEntity", "r_name", "repository"),
        _nodes(t["nation"], "n:", "n_nationkey", "ModuleEntity", "n_name", "module"),
        _nodes(t["supplier"], "s:", "s_suppkey", "ServiceEntity", "s_name", "service"),
        _nodes(t["customer"], "c:", "c_custkey", "CodeEntity", "c_name", "class", file_path=F.concat(F.lit("src/n"), F.col("c_nationkey").cast("string"), F.lit(".py")), entry_category=F.when(F.col("c_mktsegment") == "BUILDING", "http_api")),
        _nodes(t["orders"], "o:", "o_orderkey", "CodeEntity", "o_orderkey", "function", file_path=F.concat(F.lit("src/orders/"), F.substring("o_orderpriority", 1, 1), F.lit(".py"))),
        _nodes(t["part"], "p:", "p_partkey", "CodeEntity", "p_name", "function", file_path=F.concat(F.lit("lib/"), F.col("p_brand"), F.lit(".java")), sensitivity=bands, lines=size * 5),
        _nodes(t["documents"], "d:", "doc_id", "DocEntity", "source", "document", file_path=F.concat(F.lit("docs/"), F.col("lang"), F.lit(".md"))),
    ]
    edges = [
        _edges(t["orders"], ("o:", "o_orderkey"), ("c:", "o_custkey"), "calls"),
        _edges(t["lineitem"].select("l_orderkey", "l_partkey").distinct(), ("o:", "l_orderkey"), ("p:", "l_partkey"), "imports", 0.5),
        _edges(t["lineitem"].select("l_partkey", "l_suppkey").distinct(), ("p:", "l_partkey"), ("s:", "l_suppkey"), "implements", 0.8),
        _edges(t["customer"], ("c:", "c_custkey"), ("n:", "c_nationkey"), "extends", 0.8),
        _edges(t["supplier"], ("s:", "s_suppkey"), ("n:", "s_nationkey"), "extends", 0.8),
        _edges(t["nation"], ("n:", "n_nationkey"), ("r:", "n_regionkey"), "semantic_impact", 0.4),
    ]
    union = lambda xs: xs[0] if len(xs) == 1 else xs[0].unionByName(union(xs[1:]))
    return Graph(union(nodes), union(edges))


_STORED: dict[tuple[str, str, str], tuple[int, str]] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents")


def _changed(spark: SparkSession, sf_dir: str) -> int:
    """The time of the latest change of the tables' files, and their number and sizes, as one number."""
    seen = []
    for name in TABLES:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        whole = fs.getContentSummary(at)
        seen += [fs.getFileStatus(at).getModificationTime(), whole.getLength(), whole.getFileCount()]
    return hash(tuple(seen))


class StoredGraph(Graph):
    """graph_from_tables() laid out by label and relation; nodes and edges are each written when they are first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._sf_dir = spark, sf_dir

    @property
    def nodes(self) -> DataFrame:
        return load_nodes(self._spark, self._path("nodes", lambda path: save_nodes(graph_from_tables(self._spark, self._sf_dir).nodes, path)))

    @property
    def edges(self) -> DataFrame:
        return load_edges(self._spark, self._path("edges", lambda path: save_edges(graph_from_tables(self._spark, self._sf_dir).edges, path)))

    def _path(self, part: str, save: Callable[[str], None]) -> str:
        key, now = (self._spark.sparkContext.applicationId, self._sf_dir, part), _changed(self._spark, self._sf_dir)
        if _STORED.get(key, (None,))[0] != now:
            path = new_path(self._spark)
            save(path)
            _STORED[key] = now, path
        return _STORED[key][1]


def stored_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of the tables, stored so that later plans scan what they need of it; once a session, and anew if the tables' files have changed."""
    return StoredGraph(spark, sf_dir)


#: The same graph in SQL, for the oracle.
NODES_SQL = """nodes AS (
 SELECT 'r:'||r_regionkey id, 'RepositoryEntity' label, r_name AS name, 'repository' entity_type, NULL::VARCHAR file_path, NULL::VARCHAR entry_category, NULL::VARCHAR sensitivity, NULL::INT lines FROM region
 UNION ALL SELECT 'n:'||n_nationkey, 'ModuleEntity', n_name, 'module', NULL, NULL, NULL, NULL FROM nation
 UNION ALL SELECT 's:'||s_suppkey, 'ServiceEntity', s_name, 'service', NULL, NULL, NULL, NULL FROM supplier
 UNION ALL SELECT 'c:'||c_custkey, 'CodeEntity', c_name, 'class', 'src/n'||c_nationkey||'.py', CASE WHEN c_mktsegment='BUILDING' THEN 'http_api' END, NULL, NULL FROM customer
 UNION ALL SELECT 'o:'||o_orderkey, 'CodeEntity', o_orderkey::VARCHAR, 'function', 'src/orders/'||substr(o_orderpriority,1,1)||'.py', NULL, NULL, NULL FROM orders
 UNION ALL SELECT 'p:'||p_partkey, 'CodeEntity', p_name, 'function', 'lib/'||p_brand||'.java', NULL, CASE WHEN p_size<=10 THEN 'public' WHEN p_size<=25 THEN 'internal' WHEN p_size<=40 THEN 'confidential' ELSE 'restricted' END, p_size*5 FROM part
 UNION ALL SELECT 'd:'||doc_id, 'DocEntity', source, 'document', 'docs/'||lang||'.md', NULL, NULL, NULL FROM documents)"""
EDGES_SQL = """edges AS (
 SELECT 'o:'||o_orderkey src, 'c:'||o_custkey dst, 'calls' rel_type, 1.0::DOUBLE weight FROM orders
 UNION ALL SELECT DISTINCT 'o:'||l_orderkey, 'p:'||l_partkey, 'imports', 0.5 FROM lineitem
 UNION ALL SELECT DISTINCT 'p:'||l_partkey, 's:'||l_suppkey, 'implements', 0.8 FROM lineitem
 UNION ALL SELECT 'c:'||c_custkey, 'n:'||c_nationkey, 'extends', 0.8 FROM customer
 UNION ALL SELECT 's:'||s_suppkey, 'n:'||s_nationkey, 'extends', 0.8 FROM supplier
 UNION ALL SELECT 'n:'||n_nationkey, 'r:'||n_regionkey, 'semantic_impact', 0.4 FROM nation)"""


def with_graph(sql: str) -> str:
    """sql over the graph's nodes and edges; it may begin with further named queries after a leading comma."""
    return f"WITH {NODES_SQL}, {EDGES_SQL}{sql}" if sql.lstrip().startswith(",") else f"WITH {NODES_SQL}, {EDGES_SQL} {sql}"
