"""A stored graph that changes: base files by label and relation, and a log of changes that are merged on read.

A change writes whole rows and tombstones beside the base, however large that is, and becomes visible by one small file of
its version, which is created once or not at all; so nodes, edges and side tables change together, and a change that
names a transaction is made once. compact() rewrites the touched partitions of the base, and no others.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import EDGE_SCHEMA, NODE_SCHEMA, Graph
from .operators.store import upsert
from .shared import materialised, remove


@dataclass(frozen=True)
class Kind:
    """A table's columns, its key, and the column that its base is partitioned by."""

    schema: str
    keys: tuple[str, ...]
    part: str | None = None

    @property
    def columns(self) -> list[str]:
        return [c.split()[0] for c in self.schema.split(", ")]


KINDS = {
    "nodes": Kind(NODE_SCHEMA, ("id",), "label"),
    "edges": Kind(EDGE_SCHEMA, ("src", "rel_type", "dst"), "rel_type"),
    "cache": Kind("path string, sha string", ("path",)),
    "flags": Kind("id string, label string, changeset_id string", ("id",)),
    "changesets": Kind("changeset_id string, since string, ref string, changes_detected long, nodes_added long, nodes_updated long, nodes_deleted long, relations_rebuilt long, impacted_nodes long, concepts_flagged long, docs_flagged long", ("changeset_id",)),
}
#: Columns of a delta beside a table's own: a tombstone, the partition that the row was in, its version.
MARKS = "_gone boolean, _was string, _version long"


class Conflict(RuntimeError):
    """Another writer has made this version."""


class GraphLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}")
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def create(self, graph: Graph) -> GraphLog:
        """Lay a graph out as the base of a new log."""
        graph.nodes.repartition("label", "id").write.partitionBy("label").parquet(f"{self.path}/base/nodes")
        graph.edges.repartition("rel_type", "src").write.partitionBy("rel_type").parquet(f"{self.path}/base/edges")
        self._commit(0, {"base": {"nodes": "nodes", "edges": "edges"}})
        return self

    # Commits: small files, one a version.

    def commits(self) -> list[dict]:
        """All commits in order of their versions."""
        if not self._fs.exists(self._at("commits")):
            return []
        found = self.spark.read.schema("version long, txn string, base map<string, string>, deltas map<string, string>, parts map<string, array<string>>").json(f"{self.path}/commits")
        return sorted((r.asDict() for r in found.collect()), key=lambda c: c["version"])

    def _commit(self, version: int, what: dict) -> None:
        # The file is written beside its place and renamed, as a file that is being written can be read.
        made, at = self._at(f"commits/.{version}-{uuid.uuid4().hex}"), self._at(f"commits/{version}.json")
        out = self._fs.create(made, False)
        out.write(bytearray(json.dumps({"version": version} | what).encode()))
        out.close()
        if self._fs.exists(at) or not self._fs.rename(made, at):
            self._fs.delete(made, False)
            raise Conflict(f"version {version}")

    def _live(self) -> tuple[dict, list[dict], int]:
        """The tables' bases, the commits since, and the last version."""
        base, since, last = {}, [], -1
        for c in self.commits():
            last = c["version"]
            if c["base"]:
                base, since = base | c["base"], []
            else:
                since.append(c)
        return base, since, last

    def recorded(self, txn: str) -> bool:
        return any(c["txn"] == txn for c in self.commits())

    # Reading

    def _delta(self, name: str, since: list[dict]) -> DataFrame | None:
        """The last change of each changed key."""
        kind, paths = KINDS[name], [f"{self.path}/delta/{c['deltas'][name]}" for c in since if name in (c["deltas"] or {})]
        if not paths:
            return None
        rows = self.spark.read.schema(f"{kind.schema}, {MARKS}").parquet(*paths)
        if len(paths) == 1:
            return rows
        return rows.groupBy(*kind.keys).agg(F.max_by(F.struct("*"), "_version").alias("r")).select("r.*")

    def _merged(self, name: str, base: dict, since: list[dict]) -> DataFrame:
        kind = KINDS[name]
        delta = self._delta(name, since)
        parts = []
        if name in base:
            rows = self.spark.read.schema(kind.schema).parquet(f"{self.path}/base/{base[name]}").select(kind.columns)
            parts.append(rows if delta is None else rows.join(delta.select(*kind.keys), list(kind.keys), "left_anti").select(kind.columns))
        if delta is not None:
            parts.append(delta.where("not _gone").select(kind.columns))
        return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else self.spark.createDataFrame([], kind.schema)

    def table(self, name: str) -> DataFrame:
        """A table as of now; a filter on the partition column reaches the base's scan."""
        base, since, _ = self._live()
        return self._merged(name, base, since)

    def graph(self) -> Graph:
        base, since, _ = self._live()
        return Graph(self._merged("nodes", base, since), self._merged("edges", base, since))

    # Writing

    def commit(self, rows: dict[str, DataFrame], gone: dict[str, DataFrame] | None = None, txn: str | None = None) -> bool:
        """Make one version of whole rows by table and of keys that go; rows win over keys that go. False if txn is recorded."""
        _, since, last = self._live()
        if txn is not None and self.recorded(txn):
            return False
        version, deltas, parts = last + 1, {}, {}
        for name in {**rows, **(gone or {})}:
            kind = KINDS[name]
            keys, part = list(kind.keys), kind.part
            new = rows[name].select(kind.columns).withColumn("_gone", F.lit(False)) if name in rows else None
            if gone and name in gone:
                left = gone[name].select(keys).distinct()
                if new is not None:
                    left = left.join(new.select(keys), keys, "left_anti")
                left = left.select(*[F.col(c) if c in keys else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in kind.schema.split(", "))], F.lit(True).alias("_gone"))
                new = left if new is None else new.unionByName(left)
            was = F.lit(None).cast("string")
            if part is not None and part not in keys:
                # The partition that a changed row lies in must be compacted too.
                old = self.table(name).select(*keys, F.col(part).alias("_was"))
                new, was = new.join(old, keys, "left"), F.col("_was")
            elif part is not None:
                was = F.col(part)
            folder = f"{name}-{version}-{uuid.uuid4().hex}"
            new.select(*kind.columns, "_gone", was.alias("_was"), F.lit(version).cast("long").alias("_version")).write.parquet(f"{self.path}/delta/{folder}")
            deltas[name] = folder
            if part is not None:
                made = self.spark.read.schema(f"{kind.schema}, {MARKS}").parquet(f"{self.path}/delta/{folder}")
                parts[name] = sorted(r[0] for r in made.select(F.explode(F.array(part, "_was"))).where("col is not null").distinct().collect())
        self._commit(version, {"txn": txn, "deltas": deltas, "parts": parts})
        return True

    def upsert(self, name: str, new: DataFrame, txn: str | None = None) -> bool:
        """Merge rows by key: columns of new that are not null overwrite, others stay, as upsert() of whole tables does."""
        kind = KINDS[name]
        keys = list(kind.keys)
        if name == "edges":
            ids = self.table("nodes").select("id")
            new = new.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        old = self.table(name).join(new.select(*keys).distinct(), keys, "left_semi")
        return self.commit({name: upsert(old.select(kind.columns), new, keys)}, txn=txn)

    def delete_nodes(self, gone: DataFrame, txn: str | None = None) -> bool:
        """Nodes (id) and the edges at them go."""
        return self.commit({}, {"nodes": gone, "edges": self.edges_at(gone)}, txn)

    def edges_at(self, ids: DataFrame) -> DataFrame:
        """The keys of the edges at nodes (id)."""
        edges = self.table("edges").select(*KINDS["edges"].keys)
        ends = [edges.join(ids.select(F.col("id").alias(c)), c, "left_semi").select(edges.columns) for c in ("src", "dst")]
        return ends[0].unionByName(ends[1]).distinct()

    def compact(self) -> dict[str, list[str]]:
        """Merge the changes into the base; the partitions that were rewritten, by table.

        Until the version of the merge is there, changes are still merged on read, which then changes nothing; so a crash
        on the way leaves a right graph.
        """
        base, since, last = self._live()
        if not since:
            return {}
        touched: dict[str, set[str]] = {}
        for c in since:
            for name in c["deltas"] or {}:
                touched.setdefault(name, set()).update((c["parts"] or {}).get(name) or ())
        for name, parts in touched.items():
            kind, rows = KINDS[name], self._merged(name, base, since)
            if kind.part is None:
                base = base | {name: f"{name}-{last + 1}"}
                rows.write.mode("overwrite").parquet(f"{self.path}/base/{base[name]}")
                continue
            base = base | {name: base.get(name, name)}
            made = materialised(rows.where(F.col(kind.part).isin(*sorted(parts))))
            made.repartition(kind.part, kind.keys[0]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(kind.part).parquet(f"{self.path}/base/{base[name]}")
            # Dynamic overwriting leaves partitions as they are that have no rows any more.
            left = {r[0] for r in made.select(kind.part).distinct().collect()}
            for p in parts - left:
                self._fs.delete(self._at(f"base/{base[name]}/{kind.part}={p}"), True)
            remove(made)
        self._commit(last + 1, {"base": base})
        return {name: sorted(parts) for name, parts in touched.items()}
