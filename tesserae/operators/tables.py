"""Side tables: traces with eviction, repository permissions, skills and the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import role_allows, skill_confidence
from ..shared import materialised


def evicted(traces: DataFrame, now: float, ttl: float = 3600.0, most: int = 500, start: float = 0.0, at_once: int | None = None) -> DataFrame:
    """(trace_id, reason) to drop from (trace_id, at): older than ttl, then the oldest beyond `most`.

    Nothing goes before there are more than start * most traces. at_once bounds one clearing: so many of the oldest expired
    ones go, and so many of the oldest of the rest while it is beyond `most`; the next clearing goes on. All cuts are top-k
    selections that Spark merges from its tasks; no global sort.
    """
    traces = traces.select("trace_id", "at")
    n = traces.count()
    if n <= start * most:
        return traces.select("trace_id", F.lit("expired").alias("reason")).limit(0)
    old = traces.where(F.col("at") < now - ttl)
    if at_once is not None:
        old = materialised(old.orderBy("at", "trace_id").limit(at_once))
        rest = materialised(traces.join(old.select("trace_id"), "trace_id", "left_anti"))
        excess = rest.orderBy("at", "trace_id").limit(max(0, min(at_once, rest.count() - most)))
        return old.select("trace_id", F.lit("expired").alias("reason")).unionByName(excess.select("trace_id", F.lit("excess").alias("reason")))
    live = traces.where(F.col("at") >= now - ttl)
    kept = live.orderBy(F.desc("at"), "trace_id").limit(most).select("trace_id")
    return old.select("trace_id", F.lit("expired").alias("reason")).unionByName(live.join(kept, "trace_id", "left_anti").select("trace_id", F.lit("excess").alias("reason")))


def traces(log: DataFrame) -> DataFrame:
    """(trace_id, started, ended, n_steps, last_step) after a log (trace_id, ord, kind, at, step) of traces.

    kind is start, step, end or delete. A start begins a trace anew, a delete removes it until the next start; steps and
    ends of a trace that is not there have no effect. The log is folded by aggregates that are combined before the
    shuffle: only what follows a trace's last start counts, and its last delete.
    """
    ord_of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("ord")))
    last = log.groupBy("trace_id").agg(ord_of("start").alias("s"), ord_of("delete").alias("d")).where("s is not null and (d is null or d < s)").select("trace_id", "s")
    since = log.join(last, "trace_id").where("ord >= s")
    first = lambda kind, c: F.min(F.when(F.col("kind") == kind, F.col(c)))
    got = since.groupBy("trace_id").agg(first("start", "at").alias("started"), first("end", "at").alias("ended"), F.count_if(F.col("kind") == "step").alias("n_steps"), F.max_by(F.when(F.col("kind") == "step", F.col("step")), F.when(F.col("kind") == "step", F.col("ord"))).alias("last_step"))
    return got


def skills_in_order(skills: DataFrame, most: int) -> DataFrame:
    """The first `most` skills (signature, confidence, ...) by confidence, the surest first, ties by signature, with their place."""
    top = skills.orderBy(F.desc("confidence"), "signature").limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("confidence"), "signature")))


def percentiles(rows: DataFrame, by: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """(by, p50, ...): exact percentiles of value for each group, between two values in proportion; nulls do not count.

    Equal values are counted first and dealt by range of group and value; a value's rank is its rank within its range,
    plus all of the group in the ranges before. So a group with very many values is neither sorted nor held in one task.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c")).repartitionByRange(by, value)
    dealt = materialised(counted.withColumn("_part", F.spark_partition_id()))
    ranges = dealt.groupBy(by, "_part").agg(F.sum("c").alias("s"))
    # A row per group and range: their number does not grow with the rows.
    whole = Window.partitionBy(by)
    before = ranges.withColumn("n", F.sum("s").over(whole)).withColumn("before", F.sum("s").over(whole.orderBy("_part")) - F.col("s")).drop("s")
    ranked = dealt.join(before, [by, "_part"]).withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy(by, "_part").orderBy(value)))
    place = lambda p: (F.col("n") - 1) * F.lit(p)
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col(value)))
    ends = [at(g(place(p))).alias(f"{k}{x}") for k, p in enumerate(shares) for x, g in (("l", F.floor), ("h", F.ceil))]
    got = ranked.groupBy(by).agg(F.max("n").alias("n"), *ends)
    return got.select(by, *[(F.col(f"{k}l") + (F.col(f"{k}h") - F.col(f"{k}l")) * (place(p) - F.floor(place(p)))).alias(f"p{round(p * 100)}") for k, p in enumerate(shares)])


def permitted(resources: DataFrame, grants: DataFrame, user: str, needed: str = "reader") -> DataFrame:
    """resources (repo, ...) that the last grant (user, repo, role, ord) of the user to their repo allows."""
    mine = grants.where(F.col("user") == user).groupBy("repo").agg(F.max_by("role", "ord").alias("role")).where(role_allows(F.col("role"), needed))
    return resources.join(mine, "repo", "left_semi")


def skills(events: DataFrame) -> DataFrame:
    """(signature, hits, confidence, layer) from (signature): a first sight makes a candidate, each repeat is a hit."""
    hits = events.where("signature is not null").groupBy("signature").agg((F.count("*") - 1).alias("hits"))
    sure = skill_confidence(F.col("hits"))
    return hits.select("signature", "hits", F.round(sure, 6).alias("confidence"), F.when(sure >= 0.8, "active").otherwise("candidate").alias("layer"))


def layers(rows: DataFrame, known: list[str]) -> DataFrame:
    """(layer, n) with a row for every known layer, zero where it has none."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(k,) for k in known], "layer string")
    return every.join(rows.groupBy("layer").agg(F.count("*").alias("n")), "layer", "left").select("layer", F.coalesce("n", F.lit(0)).alias("n"))


def last_audit(audit: DataFrame) -> DataFrame:
    """The last row of (ord, action, target) per action."""
    return audit.withColumn("r", F.row_number().over(Window.partitionBy("action").orderBy(F.desc("ord")))).where("r = 1").drop("r")


def last_row(audit: DataFrame) -> DataFrame:
    """The last row of (ord, ...), found by an aggregate that is combined within tasks first."""
    return audit.agg(F.max_by(F.struct("*"), "ord").alias("r")).where("r is not null").select("r.*")


def roles(log: DataFrame) -> DataFrame:
    """(user, repo, role) in force after a log of grants and revocations (user, repo, role, ord); a null role revokes."""
    return log.groupBy("user", "repo").agg(F.max_by("role", "ord").alias("role")).where("role is not null")


def skills_after(skills: DataFrame, deleted: DataFrame) -> DataFrame:
    """skills (signature, layer, ...) after soft deletion: deleted (signature) get the layer retired and keep their row."""
    gone = deleted.select("signature", F.lit(True).alias("_gone")).distinct()
    return skills.join(gone, "signature", "left").withColumn("layer", F.when(F.col("_gone"), "retired").otherwise(F.col("layer"))).drop("_gone")


def out_of_range(rows: DataFrame, name: str = "confidence") -> DataFrame:
    """Rows whose confidence is null, not a number or outside 0..1."""
    c = F.col(name)
    return rows.where(c.isNull() | F.isnan(c) | ~c.between(0, 1))
