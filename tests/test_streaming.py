"""Keyed state, cascades, the snapshot watcher, and incremental updates as streams, with crashes and restarts."""

from __future__ import annotations

import hashlib
import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tesserae.graph import Graph
from tesserae.graph_log import Conflict, GraphLog
from tesserae.operators import tables
from tesserae.streaming import cascade, skills, updates, watcher
from tesserae.streaming import events as stream

NODE = "id string, label string, name string, entity_type string, file_path string, entry_category string, sensitivity string, lines int"
EDGE = "src string, dst string, rel_type string, weight double"


def sights(spark, folder):
    return spark.readStream.schema("signature string, seen timestamp").option("maxFilesPerTrigger", 1).parquet(folder)


def add(spark, folder, rows):
    spark.createDataFrame([(s, t) for s, t in rows], "signature string, second long").select("signature", F.timestamp_seconds("second").alias("seen")).coalesce(1).write.mode("append").parquet(folder)


def test_state_over_batches_is_the_table_of_all(spark, tmp_path):
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    parts = [[("a", 1), ("b", 1), ("a", 2)], [("a", 3), (None, 3), ("c", 3)], [("a", 4), ("b", 5)], [("b", 6)] * 3 + [("a", 7)] * 9]
    for k, rows in enumerate(parts):
        add(spark, folder, rows)
        if k % 2:
            # A new query from the checkpoint each time, as after a crash.
            skills.run(sights(spark, folder), out, check)
    found = spark.read.schema(skills.CHANGES).parquet(out)
    want = tables.skills(spark.createDataFrame([(s,) for rows in parts for s, _ in rows], "signature string"))
    key = lambda df: sorted((r.signature, r.hits, r.confidence, r.layer) for r in df.collect())
    assert key(skills.current(found)) == key(want)
    rows = found.collect()
    assert Counter(r.signature for r in rows if r.kind == "promoted") == Counter(["a", "b"])
    assert Counter(r.signature for r in rows if r.kind == "created") == Counter("abc")
    skills.run(sights(spark, folder), out, check)
    assert found.count() == spark.read.schema(skills.CHANGES).parquet(out).count()


def test_idle_candidates_are_retired_and_active_ones_stay(spark, tmp_path):
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for rows in ([("slow", 10), *[("sure", 10)] * 5, ("slow", 50), ("late", 60)], [("x", 300)], [("slow", 310)]):
        add(spark, folder, rows)
        skills.run(sights(spark, folder), out, check, idle=100)
    rows = spark.read.schema(skills.CHANGES).parquet(out).collect()
    assert Counter((r.signature, r.hits) for r in rows if r.kind == "retired") == Counter([("slow", 1), ("late", 0)])
    now = {r.signature: (r.hits, r.layer) for r in skills.current(spark.read.schema(skills.CHANGES).parquet(out)).collect()}
    assert now["sure"] == (4, "active") and now["slow"][1] == "candidate"


def events(spark, folder, rows):
    spark.createDataFrame(rows, "event_id long, event_type string, props string").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("event_id long, event_type string, props string").option("maxFilesPerTrigger", 1).parquet(folder)


def below(spark, folder):
    return spark.read.schema(cascade.COMPLETIONS).option("recursiveFileLookup", "true").parquet(folder)


def test_cascade_with_failing_slow_and_good_handlers_after_a_crash(spark, tmp_path, monkeypatch):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    kept = lambda name: lambda rows, i: rows.write.mode("overwrite").parquet(f"{out}/{name}/{i}")
    calls = Counter()

    def bad(rows, i):
        calls["bad"] += 1
        raise RuntimeError("no")

    def slow(rows, i):
        calls["slow"] += 1
        time.sleep(30)

    followed = []
    handlers = [
        cascade.Handler("good", ("click", "view"), kept("good")), cascade.Handler("bad", ("click",), bad, retries=2), cascade.Handler("slow", ("view",), slow, deadline=0.5), cascade.Handler("all", ("*",), kept("all")),
        cascade.Handler("follow", ("handler.completed", "handler.failed"), lambda rows, i: followed.extend((r.of, r.handler) for r in rows.collect())),
    ]
    s = events(spark, folder, [(1, "click", "{}"), (2, "view", "{}"), (3, "other", "{}")])
    real, left = cascade.publish, [2]

    def dying(df, path):
        # The process goes after two of the four handlers of the first batch are recorded.
        if not left[0]:
            raise OSError("gone")
        left[0] -= 1
        real(df, path)

    monkeypatch.setattr(cascade, "publish", dying)
    with pytest.raises(Exception):  # noqa: B017
        cascade.cascade(s, handlers, out)
    done = set(os.listdir(f"{out}/done"))
    assert len(done) == 2
    monkeypatch.setattr(cascade, "publish", real)
    before = calls.copy()
    began = time.time()
    cascade.cascade(events(spark, folder, [(4, "click", "{}")]), handlers, out, most=2)
    assert time.time() - began < 25 and done < set(os.listdir(f"{out}/done"))
    got = Counter((r.of, r.handler, r.ok, r.attempts, r.error) for r in below(spark, f"{out}/done").collect())
    assert got == Counter([(1, "good", True, 1, None), (2, "good", True, 1, None), (4, "good", True, 1, None), *[(k, "bad", False, 3, "no") for k in (1, 4)], (2, "slow", False, 1, cascade.TIMEOUT), *[(k, "all", True, 1, None) for k in (1, 2, 3, 4)]])
    # Handlers that were recorded before the crash did not run again for that batch.
    assert (calls["bad"] - before["bad"], before["bad"]) in ((3, 3), (6, 0), (6, 3))
    assert Counter(followed) == Counter((of, h) for of, h, *_ in got.elements())
    assert below(spark, f"{out}/followed").select("handler", "ok").distinct().collect() == [("follow", True)]
    cascade.cascade(s, handlers, out)
    assert below(spark, f"{out}/done").count() == sum(got.values()) and len(followed) == sum(got.values())


def test_handlers_run_side_by_side_up_to_a_bound(spark, tmp_path):
    running, most = [0], []

    def wait(rows, i):
        running[0] += 1
        most.append(running[0])
        time.sleep(1.0)
        running[0] -= 1

    s = events(spark, str(tmp_path / "in"), [(1, "a", None)])
    cascade.dispatch(s, [cascade.Handler(f"h{k}", ("*",), wait) for k in range(6)], str(tmp_path / "done"), str(tmp_path / "check"), most=3)
    assert max(most) == 3 and len(most) == 6
    with pytest.raises(ValueError):
        cascade.dispatch(s, [cascade.Handler("h", ("*",), wait)] * 2, "x", "y")


@pytest.mark.parametrize("initial", [False, True])
def test_watcher_over_polls(spark, tmp_path, initial):
    folder, out, check = (str(tmp_path / x) for x in ("snaps", "out", "check"))

    def poll():
        watcher.watch(spark, folder, initial).writeStream.format("parquet").option("checkpointLocation", check).option("path", out).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.since, r.ref, r.full_scan) for r in spark.read.schema(watcher.EVENTS).parquet(out).collect()) if os.path.exists(out) else []

    os.makedirs(f"{folder}/v1")
    first = [("", "v1", True)] if initial else []
    assert poll() == first and poll() == first
    os.makedirs(f"{folder}/_v9")
    assert poll() == first
    os.makedirs(f"{folder}/v2")
    os.makedirs(f"{folder}/v3")
    assert poll() == sorted([*first, ("v1", "v3", False)])
    os.makedirs(f"{folder}/v4")
    assert poll() == sorted([*first, ("v1", "v3", False), ("v3", "v4", False)])


def a_graph(spark, n=200):
    nodes = [(f"{k % 4}-{k}", f"L{k % 4}", f"name {k}", "x", f"f{k}.py", None, None, k) for k in range(n)]
    edges = [(nodes[k][0], nodes[(k * 7 + 1) % n][0], f"T{k % 3}", 1.0) for k in range(n)]
    return Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE))


def files_of(path):
    return {p: sorted(f for f in os.listdir(f"{path}/{p}") if f.endswith(".parquet")) for p in os.listdir(path) if "=" in p}


def test_log_upserts_deletes_and_compacts_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "log")
    g = a_graph(spark)
    log = GraphLog(spark, path).create(g)
    want = {r.id: tuple(r) for r in g.nodes.collect()}
    before = files_of(f"{path}/base/nodes")
    new = spark.createDataFrame([("1-1", "L1", "renamed", None), ("1-new", "L1", "new", 5), ("1-5", "L9", None, None)], "id string, label string, name string, lines int")
    assert log.upsert("nodes", new, txn="one") and not log.upsert("nodes", new, txn="one")
    assert GraphLog(spark, path).recorded("one") and not log.recorded("two")
    want["1-1"] = ("1-1", "L1", "renamed", *want["1-1"][3:])
    want["1-new"] = ("1-new", "L1", "new", None, None, None, None, 5)
    want["1-5"] = ("1-5", "L9", *want["1-5"][2:])
    now = lambda: {r.id: tuple(r) for r in GraphLog(spark, path).table("nodes").collect()}
    assert now() == want and files_of(f"{path}/base/nodes") == before
    ends = lambda: {(r.src, r.dst) for r in log.table("edges").collect()}
    edges = ends()
    log.delete_nodes(spark.createDataFrame([("2-2",), ("none",)], "id string"))
    del want["2-2"]
    assert now() == want and ends() == {e for e in edges if "2-2" not in e}
    assert {r.label for r in log.graph().labelled("L9").collect()} == {"L9"} and "PartitionFilters: [isnotnull(label" in log.graph().labelled("L9")._jdf.queryExecution().toString()
    log.upsert("edges", spark.createDataFrame([("1-1", "3-3", "T9", 0.5), ("1-1", "nowhere", "T9", 0.5)], EDGE))
    assert ends() == {e for e in edges if "2-2" not in e} | {("1-1", "3-3")}
    edges = ends()
    touched = log.compact()
    assert touched["nodes"] == ["L1", "L2", "L9"] and "T9" in touched["edges"]
    after = files_of(f"{path}/base/nodes")
    # Only touched partitions have new files.
    assert {p for p in after if after.get(p) != before.get(p)} == {"label=L1", "label=L2", "label=L9"}
    assert now() == want and ends() == edges and log.compact() == {}
    log.delete_nodes(spark.createDataFrame([("1-5",)], "id string"))
    del want["1-5"]
    log.compact()
    assert now() == want and "label=L9" not in files_of(f"{path}/base/nodes")


def test_log_survives_crashes(spark, tmp_path, monkeypatch):
    log = GraphLog(spark, str(tmp_path / "log")).create(a_graph(spark, 40))
    want = sorted(log.table("nodes").collect(), key=str)

    def die(*_):
        raise RuntimeError("gone")

    monkeypatch.setattr(log, "_commit", die)
    with pytest.raises(RuntimeError):
        log.upsert("nodes", spark.createDataFrame([("x", "L1")], "id string, label string"))
    monkeypatch.undo()
    assert sorted(log.table("nodes").collect(), key=str) == want
    log.delete_nodes(spark.createDataFrame([("1-1",)], "id string"))
    want = [r for r in want if r.id != "1-1"]
    monkeypatch.setattr(log, "_commit", die)
    with pytest.raises(RuntimeError):
        log.compact()
    monkeypatch.undo()
    assert sorted(log.table("nodes").collect(), key=str) == want
    with pytest.raises(Conflict):
        log._commit(0, {})
    assert log.compact()["nodes"] == ["L1"] and sorted(log.table("nodes").collect(), key=str) == want


def parse(files):
    """A node a file, that calls the file named in its content."""
    nodes = files.select(F.concat(F.lit("n:"), "path").alias("id"), F.lit("CodeEntity").alias("label"), F.col("content").alias("name"), F.lit("file").alias("entity_type"), F.col("path").alias("file_path"), *[F.lit(None).cast(t).alias(c) for c, t in (("entry_category", "string"), ("sensitivity", "string"), ("lines", "int"))])
    edges = files.select(F.concat(F.lit("n:"), "path").alias("src"), F.concat(F.lit("n:"), F.regexp_extract("content", "calls (\\S+)", 1)).alias("dst"), F.lit("calls").alias("rel_type"), F.lit(1.0).alias("weight"))
    return Graph(nodes, edges.where("dst <> 'n:'"))


def test_updates_follow_the_watcher_and_replays_change_nothing(spark, tmp_path, monkeypatch):
    folder, check = str(tmp_path / "snaps"), str(tmp_path / "check")
    states = [{"a": "calls b", "b": "x", "c": "calls a"}, {"a": "calls b", "b": "y", "c": "calls a", "d": "calls b"}, {"a": "calls d", "b": "y", "d": "calls b"}]
    read = lambda ref: spark.read.schema("path string, content string").parquet(f"{folder}/{ref}")
    log = GraphLog(spark, str(tmp_path / "log")).create(Graph(spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE)))

    def state():
        return {r.id: r.name for r in log.table("nodes").collect()}, {(r.src, r.dst) for r in log.table("edges").collect()}, {r.path: r.sha for r in log.table("cache").collect()}, Counter((r.since, r.ref, r.nodes_added, r.nodes_updated, r.nodes_deleted) for r in log.table("changesets").collect())

    def wanted(files, sets):
        # A changed node goes with its edges; those of its own file come back.
        edges, before = set(), {}
        for now in states[: len(sets)]:
            same = {p for p in now if now[p] == before.get(p)}
            edges = {(x, y) for x, y in edges if {x[2:], y[2:]} <= same} | {(f"n:{p}", f"n:{t.split()[1]}") for p, t in now.items() if p not in same and t.startswith("calls") and t.split()[1] in now}
            before = now
        return {f"n:{p}": t for p, t in files.items()}, edges, {p: hashlib.sha256(t.encode()).hexdigest() for p, t in files.items()}, Counter(sets)

    sets = [("", "v0", 3, 0, 0), ("v0", "v1", 1, 1, 0), ("v1", "v2", 0, 1, 1)]
    for k, files in enumerate(states):
        spark.createDataFrame(list(files.items()), "path string, content string").write.parquet(f"{folder}/v{k}")
        if k == 1:
            # The commit is there, but the stream goes before it has noted the batch.
            real = GraphLog.commit
            monkeypatch.setattr(GraphLog, "commit", lambda *a: real(*a) and 1 / 0)
            with pytest.raises(Exception):  # noqa: B017
                updates.run(watcher.watch(spark, folder, True), log, read, parse, check)
            monkeypatch.undo()
            assert state() == wanted(files, sets[: k + 1])
        updates.run(watcher.watch(spark, folder, True), log, read, parse, check)
        assert state() == wanted(files, sets[: k + 1])
    assert not updates.apply(log, read("v1"), read("v2"), parse, "v1", "v2") and state() == wanted(states[2], sets)
    log.compact()
    assert state() == wanted(states[2], sets)


def test_signatures_of_events(spark):
    e = spark.createDataFrame([("a", '{"k": 1}'), (None, "{"), ("b", None)], "event_type string, props string")
    assert e.select(skills.signature(F.col("event_type"), F.col("props"))).collect() == [("a:1",), ("unknown:unknown",), ("b:unknown",)]
    assert stream.signatures(e).collect() == [("a:1",), ("unknown:unknown",), ("b:unknown",)]
