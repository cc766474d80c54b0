"""Pattern matching and bounded traversals over a graph's edges, as joins that Catalyst plans.

Steps are joins on edge ends, so a hub is spread by the join's skew handling. Set-valued traversals deduplicate after
each step, which bounds a level by the number of nodes; path-valued ones return one row per path, as asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..shared import materialised
from .linking import contained

MOST_HOPS = 10


def _turned(edges: DataFrame, direction: str) -> DataFrame:
    """(here, there, rel_type): edges as they are followed outwards, inwards or both ways."""
    out = edges.select(F.col("src").alias("here"), F.col("dst").alias("there"), "rel_type")
    back = edges.select(F.col("dst").alias("here"), F.col("src").alias("there"), "rel_type")
    return {"out": out, "in": back}.get(direction) or out.unionByName(back)


def one_hop(graph: Graph, types: list[str], source: Column, target: Column, direction: str = "out") -> DataFrame:
    """(src, dst, rel_type) of edges whose ends satisfy conditions over node columns."""
    a = graph.nodes.where(source).select(F.col("id").alias("here"))
    b = graph.nodes.where(target).select(F.col("id").alias("there"))
    return _turned(graph.typed(*types), direction).join(a, "here", "left_semi").join(b, "there", "left_semi").select(F.col("here").alias("src"), F.col("there").alias("dst"), "rel_type")


def paths(edges: DataFrame, starts: DataFrame, least: int, most: int, direction: str = "out") -> DataFrame:
    """(start, node, hops): a row per path of least to most edges from starts (id), no edge twice in one path."""
    if not 0 <= least <= most <= MOST_HOPS:
        raise ValueError(f"hops must be 0 to {MOST_HOPS}")
    steps = _turned(edges, direction).withColumn("edge", F.concat_ws("|", F.least("here", "there"), "rel_type", F.greatest("here", "there")) if direction == "both" else F.concat_ws("|", "here", "rel_type", "there"))
    front = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array().cast("array<string>").alias("used"))
    out = front.select("start", "node", F.lit(0).alias("hops")) if least == 0 else None
    for k in range(1, most + 1):
        front = front.join(steps, F.col("node") == F.col("here")).where(~F.array_contains("used", F.col("edge"))).select("start", F.col("there").alias("node"), F.array_append("used", F.col("edge")).alias("used"))
        if k >= least:
            level = front.select("start", "node", F.lit(k).alias("hops"))
            out = level if out is None else out.unionByName(level)
    return out


def reachable(edges: DataFrame, starts: DataFrame, least: int, most: int, direction: str = "out") -> DataFrame:
    """(start, node, hops) distinct: nodes at the end of a walk of so many edges; a level never exceeds starts x nodes."""
    steps = _turned(edges, direction).select("here", "there")
    front = starts.select(F.col("id").alias("start"), F.col("id").alias("node"))
    out = front.withColumn("hops", F.lit(0)) if least == 0 else None
    for k in range(1, most + 1):
        front = front.join(steps, F.col("node") == F.col("here")).select("start", F.col("there").alias("node")).distinct()
        if k >= least:
            level = front.withColumn("hops", F.lit(k))
            out = level if out is None else out.unionByName(level)
    return out


def distances(edges: DataFrame, starts: DataFrame, most: int = MOST_HOPS, direction: str = "out") -> DataFrame:
    """(start, node, hops) distinct: how long the paths of 1 to most edges from starts (id) to nodes are, no edge twice in one path.

    Rows are bounded by pairs of nodes and lengths, however many paths there are. A walk repeats an edge only if it goes
    round a cycle of so many edges or fewer, so of starts that reach none all walks are paths; whether a node is on
    one, walks from all nodes that the starts reach tell. Only from starts that reach one paths are followed one by one.
    Each level is written to the shared folder, so that no task holds the joins of those before it.
    """
    if not 1 <= most <= MOST_HOPS:
        raise ValueError(f"hops must be 1 to {MOST_HOPS}")
    steps = _turned(edges, direction).select("here", "there").distinct()
    ids = starts.select("id").where("id is not null").distinct()
    roots = ids
    if not steps.select(F.col("here").alias("id")).join(ids, "id", "left_anti").isEmpty():
        level = ids
        for _ in range(most):
            level = materialised(level.join(steps, F.col("id") == F.col("here")).select(F.col("there").alias("id")).distinct())
            roots = roots.unionByName(level)
        roots = materialised(roots.distinct())
    front, found = roots.select(F.col("id").alias("start"), F.col("id").alias("node")), None
    for k in range(1, most + 1):
        front = materialised(front.join(steps, F.col("node") == F.col("here")).select("start", F.col("there").alias("node")).distinct())
        level = front.withColumn("hops", F.lit(k))
        found = level if found is None else found.unionByName(level)
    own = found.join(ids.withColumnRenamed("id", "start"), "start", "left_semi")
    loops = found.where("start = node").select(F.col("start").alias("id")).distinct()
    if loops.isEmpty():
        return own
    touched = materialised(own.join(loops.withColumnRenamed("id", "node"), "node", "left_semi").select(F.col("start").alias("id")).unionByName(loops).distinct())
    trails = paths(edges, ids.join(touched, "id", "left_semi"), 1, most, direction).select("start", "node", "hops").distinct()
    return own.join(touched.withColumnRenamed("id", "start"), "start", "left_anti").select("start", "node", "hops").unionByName(trails)


def business_impact(graph: Graph, starts: DataFrame, most: int = MOST_HOPS) -> DataFrame:
    """(start, node, name, distance) distinct: entry points from which starts (id) are called over 1 to most calls, no call twice."""
    found = distances(graph.typed("calls"), starts, most, "in").withColumnRenamed("hops", "distance")
    return found.join(graph.nodes.where("entry_category is not null").select(F.col("id").alias("node"), "name"), "node").select("start", "node", "name", "distance")


def neighbourhood(graph: Graph, centre: str, depth: int, limit: int, labels: list[str] | None = None) -> Graph:
    """Nodes within depth (1 to 3) undirected hops, limit (1 to 500) of them by id besides the centre, and their edges."""
    depth, limit = max(1, min(3, depth)), max(1, min(500, limit))
    start = graph.nodes.where(F.col("id") == centre)
    around = reachable(graph.edges, start, 1, depth, "both").where("node <> start").select(F.col("node").alias("id")).distinct()
    near = graph.nodes.join(around, "id", "left_semi")
    if labels:
        near = near.where(F.col("label").isin(*labels))
    nodes = near.orderBy("id").limit(limit).unionByName(start)
    return Graph(nodes, induced(graph.edges, nodes))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def isolated(graph: Graph, label: str) -> DataFrame:
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return graph.labelled(label).join(ends, "id", "left_anti")


def degrees(graph: Graph) -> DataFrame:
    """(id, out_degree, in_degree) of nodes with edges: one aggregate over both ends, combined before it is shuffled."""
    ends = graph.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def resolve(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, id, how): by exact name, else by the first name, in order of file and id, that contains it."""
    best = F.min_by("id", F.struct(F.coalesce("file_path", F.lit("")), F.col("id"))).alias("id")
    exact = wanted.join(nodes, F.col("wanted") == F.col("name")).groupBy("wanted").agg(best).withColumn("how", F.lit("exact"))
    rest = wanted.join(exact, "wanted", "left_anti")
    held = contained(nodes.select(F.col("id").alias("text_id"), F.col("name").alias("text")), rest.select(F.col("wanted").alias("needle_id"), F.col("wanted").alias("needle")))
    loose = held.select(F.col("needle_id").alias("wanted"), F.col("text_id").alias("id")).join(nodes.select("id", "file_path"), "id").groupBy("wanted").agg(best).withColumn("how", F.lit("contains"))
    return exact.unionByName(loose)


def context(graph: Graph, wanted: DataFrame) -> DataFrame:
    """(id, direction, rel_type, other, name): both directions of the edges at nodes wanted (id), with the other end's name."""
    e = graph.edges
    out = e.join(wanted.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("id"), F.lit("out").alias("direction"), "rel_type", F.col("dst").alias("other"))
    back = e.join(wanted.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("id"), F.lit("in").alias("direction"), "rel_type", F.col("src").alias("other"))
    return out.unionByName(back).join(graph.nodes.select(F.col("id").alias("other"), "name"), "other").select("id", "direction", "rel_type", "other", "name")


def lookup(nodes: DataFrame, name: str, most: int = 5) -> DataFrame:
    """(id, name, how): nodes of exactly that name, else the first `most`, by name and id, that contain it, as suggestions."""
    exact = nodes.where(F.col("name") == name).select("id", "name", F.lit("exact").alias("how"))
    near = nodes.where(F.col("name").contains(name)).orderBy("name", "id").limit(most).select("id", "name", F.lit("suggestion").alias("how"))
    return exact.unionByName(near.join(exact.select(F.lit(1)).limit(1), F.lit(True), "left_anti"))
