"""Keyed merges and deletes as new DataFrames; write them where the old ones were, partition by partition."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old merged with new: columns of new that are not null overwrite, others stay. Null keys raise; of equal keys in
    new the greatest row wins, whatever the order of rows."""
    extra = [c for c in old.columns if c not in keys]
    given = [c for c in extra if c in new.columns]
    one = new.groupBy(keys).agg(F.max(F.struct(*given)).alias("_new")) if given else new.select(*keys).distinct().withColumn("_new", F.lit(None))
    checked = one.select(*[F.when(F.col(k).isNull(), F.raise_error(F.lit(f"{k} is missing"))).otherwise(F.col(k)).alias(k) for k in keys], "_new")
    both = old.join(checked, keys, "full")
    return both.select(*[c if c in keys else (F.coalesce(F.col("_new")[c], F.col(c)) if c in given else F.col(c)).alias(c) for c in old.columns])


def upsert_edges(graph: Graph, new: DataFrame) -> DataFrame:
    """Edges merged with new ones by (src, rel_type, dst); new edges without both ends in the graph are dropped."""
    ids = graph.nodes.select("id")
    whole = new.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return upsert(graph.edges, whole, ["src", "rel_type", "dst"])


def delete_nodes(graph: Graph, gone: DataFrame) -> Graph:
    """The graph without nodes gone (id) and the edges at them."""
    ids = gone.select("id").distinct()
    edges = graph.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return Graph(graph.nodes.join(ids, "id", "left_anti"), edges)


def delete_edges(graph: Graph, gone: DataFrame) -> Graph:
    return Graph(graph.nodes, graph.edges.join(gone.select("src", "rel_type", "dst"), ["src", "rel_type", "dst"], "left_anti"))


def exported(graph: Graph, form: str = "json") -> DataFrame:
    """(id, line): nodes and edges as lines of JSON, dot or cytoscape elements, one row each; dangling edges are left out."""
    ids = graph.nodes.select("id")
    edges = graph.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r'(["\\])', r"\\$1"), F.lit('"'))
    edge_id = F.concat_ws("|", "src", "rel_type", "dst")
    if form == "dot":
        n = graph.nodes.select("id", F.concat(quoted("id"), F.lit(" [label="), quoted("name"), F.lit("];")).alias("line"))
        e = edges.select(edge_id.alias("id"), F.concat(quoted("src"), F.lit(" -> "), quoted("dst"), F.lit(" [label="), quoted("rel_type"), F.lit("];")).alias("line"))
    else:
        node = F.struct("id", "label", "name")
        edge = F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("rel_type").alias("type"))
        wrap = (lambda s: F.to_json(F.struct(s.alias("data")))) if form == "cytoscape" else F.to_json
        n, e = graph.nodes.select("id", wrap(node).alias("line")), edges.select(edge_id.alias("id"), wrap(edge).alias("line"))
    return n.unionByName(e)


def version_state(versions: DataFrame, current: str) -> DataFrame:
    """(version, state): the latest applied version (version, applied_at) against current, compared part by part as numbers."""
    parts = lambda c: F.transform(F.split(c, r"\."), lambda x: x.cast("int"))
    last = versions.agg(F.max_by("version", "applied_at").alias("version"))
    now = parts(F.lit(current))
    return last.select("version", F.when(F.col("version").isNull(), "EMPTY").when(parts(F.col("version")) == now, "MATCH").when(parts(F.col("version")) < now, "BEHIND").otherwise("AHEAD").alias("state"))


def set_property(nodes: DataFrame, key: str, name: str, value: Column) -> DataFrame:
    """nodes with one property of the node `key` set; names that are no identifier of a column raise."""
    if not re.fullmatch(r"[A-Za-z_]\w*", name) or name not in nodes.columns or name == "id":
        raise ValueError(f"no such property: {name}")
    return nodes.withColumn(name, F.when(F.col("id") == key, value).otherwise(F.col(name)))


def orphans(graph: Graph) -> DataFrame:
    """Nodes without a label or without an edge."""
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return graph.nodes.where("label is null").unionByName(graph.nodes.where("label is not null").join(ends, "id", "left_anti"))


def upsert_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors (id, text, ...) merged by id; new ones with blank text are left out."""
    return upsert(old, new.where("trim(coalesce(text, '')) <> ''"), ["id"])


Step = tuple[str, Callable[[Graph], Graph]]


def _number(version: str) -> tuple[int, ...]:
    return tuple(int(x) for x in version.split("."))


def migrated(graph: Graph, steps: list[Step], now: str, wanted: str) -> tuple[Graph, list[str]]:
    """The graph after the steps (version, change) above `now` up to `wanted`, in order of their numbers, and their versions.

    Steps are DataFrame transforms, so all of them are one plan; repeated versions raise.
    """
    numbers = [_number(v) for v, _ in steps]
    if len(set(numbers)) < len(numbers):
        raise ValueError("a version is registered twice")
    path = sorted((s for s in steps if _number(now) < _number(s[0]) <= _number(wanted)), key=lambda s: _number(s[0]))
    for _, change in path:
        graph = change(graph)
    return graph, [v for v, _ in path]
