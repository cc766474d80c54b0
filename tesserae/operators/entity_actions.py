"""General actions on entities as a table of requests: judged by one plan, applied to a graph log as one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import EDGE_COLUMNS, NODE_COLUMNS
from ..graph_log import GraphLog
from ..sources.rules import LABELS

PROPERTIES = [c for c in NODE_COLUMNS if c not in ("id", "label")]


def judged(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """requests with success and error, null where it succeeds.

    requests: (request_id, action, entity_id, label, rel_type, to_id, recipients, and properties of nodes). query needs an
    entity that is there; update an entity_id and a property; create an entity_id and a label of LABELS; relate a relation
    and both ends; notify a recipient. Other actions fail.
    """
    there = nodes.select(F.col("id").alias("entity_id"), F.lit(True).alias("_there"))
    some = F.coalesce(*[F.col(c).cast("string") for c in PROPERTIES]).isNotNull()
    a, none = F.col("action"), F.lit(None).cast("string")
    error = (
        F.when(a == "query", F.when(F.col("_there").isNull(), F.lit("no such entity")))
        .when(a == "update", F.when(F.col("entity_id").isNull(), F.lit("no entity")).when(~some, F.lit("no properties")))
        .when(a == "create", F.when(F.col("label").isNull(), F.lit("no label")).when(~F.col("label").isin(*LABELS), F.concat(F.lit("no such label: "), "label")).when(F.col("entity_id").isNull(), F.lit("no entity")))
        .when(a == "relate", F.when(F.col("rel_type").isNull() | F.col("entity_id").isNull() | F.col("to_id").isNull(), F.lit("no relation or end")))
        .when(a == "notify", F.when(F.coalesce(F.size("recipients"), F.lit(0)) < 1, F.lit("no recipients")))
        .otherwise(F.concat(F.lit("no such action: "), F.coalesce(a, F.lit(""))))
    )
    return requests.join(there, "entity_id", "left").withColumn("error", F.coalesce(error, none)).withColumn("success", F.col("error").isNull()).drop("_there")


def applied(log: GraphLog, requests: DataFrame, txn: str) -> DataFrame:
    """judged() requests after those that succeed are written: one commit, made once however often it is asked for.

    An update of an entity that is not there makes it, under CodeEntity if no label is given. Of several requests for one
    entity each property has the greatest value. Relations to entities that are not there then are left out.
    """
    g = log.graph()
    done = judged(requests, g.nodes)
    if log.recorded(txn):
        return done
    good = done.where("success")
    changed = good.where(F.col("action").isin("update", "create")).select(F.col("entity_id").alias("id"), "label", *PROPERTIES)
    new = changed.groupBy("id").agg(*[F.max(c).alias(c) for c in ("label", *PROPERTIES)])
    old = g.nodes.join(new.select("id"), "id", "left_semi")
    both = old.select("id", *[F.col(c).alias(f"_{c}") for c in NODE_COLUMNS[1:]]).join(new, "id", "right")
    merged = both.select("id", *[F.coalesce(c, f"_{c}", *([F.lit("CodeEntity")] if c == "label" else [])).alias(c) for c in NODE_COLUMNS[1:]])
    ids = g.nodes.select("id").unionByName(new.select("id")).distinct()
    asked = good.where("action = 'relate'").select(F.col("entity_id").alias("src"), F.col("to_id").alias("dst"), "rel_type").distinct()
    edges = asked.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").withColumn("weight", F.lit(1.0))
    log.commit({"nodes": merged, "edges": edges.select(EDGE_COLUMNS)}, txn=txn)
    return done
