"""Incremental updates as a stream: each change that a watcher reports is applied to a graph log as one commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..graph_log import KINDS, GraphLog
from ..operators import changes

Parse = Callable[[DataFrame], Graph]
Read = Callable[[str], DataFrame]


def apply(log: GraphLog, old: DataFrame, new: DataFrame, parse: Parse, since: str, ref: str, depth: int = 3) -> bool:
    """Bring the log from snapshot old to new (path, content): nodes, edges, digest cache, flags and changeset in one version.

    False, and nothing is done, if the step from since to ref is recorded. Only changed files are parsed.
    """
    txn = f"{since}..{ref}"
    if log.recorded(txn):
        return False
    found = changes.update(log.graph(), old, new, parse, depth=depth)
    left = log.edges_at(found.removed)
    one = found.report.withColumns({"since": F.lit(since), "ref": F.lit(ref)})
    # A step that is made again later, with the same changes, is another changeset.
    one = one.withColumn("changeset_id", F.concat(F.lit("cs-"), F.substring(F.sha2(F.concat_ws("|", "changeset_id", "since", "ref"), 256), 1, 12)))
    name = one.select("changeset_id").first()[0]
    kept = found.changes.where("change_type <> 'DELETED'").select("path", F.col("new_sha").alias("sha"))
    flags = found.flagged.select(F.col("node_id").alias("id"), "label", F.lit(name).alias("changeset_id"))
    counts = [F.col(c).cast("long").alias(c) if t == "long" else F.col(c) for c, t in (x.split() for x in KINDS["changesets"].schema.split(", "))]
    rows = {"nodes": found.fresh, "edges": found.relations, "cache": kept, "flags": flags, "changesets": one.select(counts)}
    gone = {"nodes": found.removed, "edges": left, "cache": found.changes.where("change_type = 'DELETED'").select("path")}
    return log.commit(rows, gone, txn)


def run(stream: DataFrame, log: GraphLog, read: Read, parse: Parse, checkpoint: str, depth: int = 3) -> None:
    """Work off what is there of a watcher's changes (since, ref, ...); read gives the files (path, content) of a snapshot.

    A micro-batch that is run again after a crash finds its steps recorded and changes nothing.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        # A poll is one row, so a batch holds a row for each poll since the last one.
        for step in sorted(batch.select("since", "ref").collect()):
            new = read(step.ref)
            apply(log, read(step.since) if step.since else new.limit(0), new, parse, step.since, step.ref, depth)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
