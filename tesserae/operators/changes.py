"""Change detection between two snapshots of files, and what an incremental update has to do."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import diff_change, git_status, stable_id
from ..graph import Graph
from ..shared import materialised
from . import impact
from .store import delete_nodes


def detect(old: DataFrame, new: DataFrame, deletions: bool = True) -> DataFrame:
    """(path, change_type, old_sha, new_sha) between snapshots (path, content); equal contents give no row.

    Contents never leave their side of the join: only digests are shuffled. Null contents count as empty.
    """
    sha = F.sha2(F.coalesce(F.col("content").cast("string"), F.lit("")), 256)
    a, b = old.select("path", sha.alias("old_sha")), new.select("path", sha.alias("new_sha"))
    both = b.join(a, "path", "full" if deletions else "left")
    kind = F.when(F.col("old_sha").isNull(), "ADDED").when(F.col("new_sha").isNull(), "DELETED").when(F.col("old_sha") != F.col("new_sha"), "BODY")
    return both.withColumn("change_type", kind).where("change_type is not null").select("path", "change_type", "old_sha", "new_sha")


def classified(changes: DataFrame, diffs: DataFrame) -> DataFrame:
    """BODY changes refined by their diff (path, diff) to SIGNATURE, BODY or DOC_ONLY; without a diff they stay BODY."""
    joined = changes.join(diffs, "path", "left")
    return joined.withColumn("change_type", F.when((F.col("change_type") == "BODY") & F.col("diff").isNotNull(), diff_change(F.col("diff"))).otherwise(F.col("change_type"))).drop("diff")


def work(changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, change_type, action) for the nodes (id, file_path) of changed files: one join for all files."""
    action = F.when(F.col("change_type") == "DELETED", "delete").when(F.col("change_type") == "DOC_ONLY", "vectors").otherwise("rebuild")
    return nodes.join(changes.select(F.col("path").alias("file_path"), "change_type"), "file_path").select("id", "change_type", action.alias("action"))


def report(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change_type").agg(F.count("*").alias("n"))


def cached(cache: DataFrame, changes: DataFrame) -> DataFrame:
    """The cache (path, sha) after changes (path, change_type, new_sha): deleted paths go, others get their new digest."""
    new = changes.select("path", "change_type", "new_sha")
    both = cache.join(new, "path", "full").where("change_type is null or change_type <> 'DELETED'")
    return both.select("path", F.coalesce("new_sha", "sha").alias("sha"))


def flagged(nodes: DataFrame, impacts: DataFrame) -> DataFrame:
    """nodes (id, ...) with stale set where an impact (node_id) reaches them."""
    hit = impacts.select(F.col("node_id").alias("id"), F.lit(True).alias("_hit")).distinct()
    return nodes.join(hit, "id", "left").withColumn("stale", F.coalesce("_hit", F.lit(False))).drop("_hit")


def changeset(changes: DataFrame) -> DataFrame:
    """One row (changeset_id, n_files, n_added, n_deleted, n_modified); the id is cs- and 12 digits over all changes.

    The digests of the rows are added up as numbers, so the order of rows plays no part and no task sees them all.
    """
    total = F.sum(F.xxhash64("path", "change_type", "new_sha").cast("decimal(38,0)"))
    kind = F.col("change_type")
    n = lambda c, name: F.count_if(c).alias(name)
    got = changes.agg(total.alias("t"), F.count("*").alias("n_files"), n(kind == "ADDED", "n_added"), n(kind == "DELETED", "n_deleted"), n(~kind.isin("ADDED", "DELETED"), "n_modified"))
    return got.select(F.concat(F.lit("cs-"), F.substring(stable_id(F.col("t")), 1, 12)).alias("changeset_id"), "n_files", "n_added", "n_deleted", "n_modified")


def absolute(path: Column, root: str) -> Column:
    """path below root; a leading name of the root's own folder is cut, absolute paths and nulls stay."""
    root = root.rstrip("/")
    bare = F.regexp_replace(path, "^" + re.escape(root.rsplit("/", 1)[-1]) + "/", "")
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(root + "/"), bare))


def listed(lines: DataFrame) -> DataFrame:
    """(status, path) of a name-status listing (value): fields are cut at tabs, the last one is the path; other lines are left out."""
    parts = F.split("value", "\t")
    return lines.where(F.size(parts) >= 2).select(git_status(parts[0]).alias("status"), F.element_at(parts, -1).alias("path"))


@dataclass
class Update:
    """What an incremental update finds and makes: changes, impacts, the graph after it, nodes to look at again, one row of
    counts; and, for stores that take changes, the nodes (id) that go with their edges, and the nodes and edges that come."""

    changes: DataFrame
    impacts: DataFrame
    graph: Graph
    flagged: DataFrame
    report: DataFrame
    removed: DataFrame
    fresh: DataFrame
    relations: DataFrame


def update(graph: Graph, old: DataFrame, new: DataFrame, parsed: Graph | Callable[[DataFrame], Graph], diffs: DataFrame | None = None, depth: int = 3) -> Update:
    """Detect changes between snapshots (path, content), follow their impact, apply them to the graph, and record them.

    parsed holds the nodes and edges of the new files, or makes them of the files that changed. Nodes of deleted files go with their edges; those of files with a
    changed body or signature are replaced by the parsed ones, and those of added files are added, with the edges from
    them whose ends exist; files with changed documentation alone keep their nodes, and only their vectors are new.
    Concepts and documents that the change reaches are flagged. Nothing is collected: all parts are plans, and only the
    changes and impacts are written to the shared folder, since several parts read them.
    """
    found = detect(old, new)
    changes = materialised(classified(found, diffs) if diffs is not None else found)
    kinds = changes.select(F.col("path").alias("file_path"), "change_type")
    touched = graph.nodes.join(kinds, "file_path").select("id", F.col("change_type").alias("change"))
    impacts = materialised(impact.merged(impact.impact(graph.edges, touched, depth), graph.nodes))
    rebuilt = kinds.where("change_type not in ('DELETED', 'DOC_ONLY')")
    if not isinstance(parsed, Graph):
        parsed = parsed(new.join(rebuilt.select(F.col("file_path").alias("path")), "path", "left_semi"))
    fresh = parsed.nodes.join(rebuilt, "file_path").select(*graph.nodes.columns, "change_type")
    removed = touched.where("change <> 'DOC_ONLY'").select("id").distinct()
    left = delete_nodes(graph, removed)
    nodes = left.nodes.unionByName(fresh.drop("change_type"))
    ids = nodes.select("id")
    relations = parsed.edges.join(fresh.select(F.col("id").alias("src")), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    after = Graph(nodes, left.edges.unionByName(relations.select(graph.edges.columns)).distinct())
    flagged = impacts.where(F.col("label").isin("ConceptEntity", "DocEntity")).select("node_id", "label").distinct()
    count = lambda df, name, where="true": df.agg(F.count_if(F.expr(where)).alias(name))
    rows = [
        changeset(changes).select("changeset_id", F.col("n_files").alias("changes_detected")), count(fresh, "nodes_added", "change_type = 'ADDED'"), count(fresh, "nodes_updated", "change_type <> 'ADDED'"),
        count(touched, "nodes_deleted", "change = 'DELETED'"), count(relations, "relations_rebuilt"), count(touched, "vectors_of_documentation", "change = 'DOC_ONLY'"), count(impacts, "impacted_nodes"),
        flagged.agg(F.count_if(F.col("label") == "ConceptEntity").alias("concepts_flagged"), F.count_if(F.col("label") == "DocEntity").alias("docs_flagged")),
    ]
    report = rows[0]
    for r in rows[1:]:
        # One row each.
        report = report.crossJoin(r)
    vectors = F.col("nodes_added") + F.col("nodes_updated") + F.col("vectors_of_documentation")
    return Update(changes, impacts, after, flagged, report.withColumn("vectors_updated", vectors).drop("vectors_of_documentation"), removed, fresh.select(graph.nodes.columns), relations.select(graph.edges.columns).distinct())
