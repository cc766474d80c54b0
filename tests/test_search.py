"""Embedding with fallbacks, the neighbour-graph index, overlaps of two collections, and the aligner's graph step."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.graph import Graph
from tesserae.operators import clustering, neighbour_graph, vectors
from tesserae.operators.embedding import BATCH, PLACES, Embedder, EmbeddingError

NODE = "id string, label string, name string, entity_type string, file_path string, entry_category string, sensitivity string, lines int"
EDGE = "src string, dst string, rel_type string, weight double"


def a_model(texts):
    if len(texts) > BATCH:
        raise AssertionError("too many")
    if len(texts) > 1 and "refuse" in texts:
        raise ValueError("batch")
    if "never" in texts:
        raise ValueError("text")
    return [[float(len(t)), 1.0] for t in texts]


def embedded(spark, texts, embedder=None):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").coalesce(1)
    return {r.k: r.vector for r in (embedder or Embedder(a_model)).vectors(df, "k", "text").collect()}


def test_embedder_in_batches_with_fallbacks(spark):
    plain = ["a" * k for k in range(25)]
    assert embedded(spark, [*plain, None]) == {k: [float(k), 1.0] for k in range(25)} | {25: [0.0, 1.0]}
    got = embedded(spark, [*plain, "refuse", "never", "b"])
    assert got[25] == [6.0, 1.0] and got[26] == [0.0, 0.0] and got[27] == [1.0, 1.0] and len(got) == 28
    # Nothing has told the number of places yet.
    first = embedded(spark, ["never", "x"])
    assert first[0] == [0.0] * PLACES and first[1] == [1.0, 1.0]
    assert embedded(spark, ["never", "x"], Embedder(a_model, places=2))[0] == [0.0, 0.0]
    assert embedded(spark, []) == {}
    with pytest.raises(Exception, match="EmbeddingError"):
        embedded(spark, ["never", "never"])
    with pytest.raises(EmbeddingError):
        Embedder(lambda texts: [])._batch(["a"], 2)


def test_text_search_takes_an_embedder(spark):
    pool = spark.createDataFrame([("a", [3.0, 1.0]), ("b", [100.0, 1.0]), ("c", [0.0, 1.0])], "id string, embedding array<double>")
    asked = spark.createDataFrame([("q", "xxx"), ("r", " ")], "query_id string, text string")
    assert [(r.query_id, r.id) for r in vectors.text_search(pool, asked, Embedder(a_model), 1).collect()] == [("q", "a")]


@pytest.mark.parametrize("shard", [400, 5_000])
def test_index_finds_the_nearest(spark, tmp_path, shard):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.standard_normal((60, 48))[rng.integers(0, 60, 3_000)] + 0.5 * rng.standard_normal((3_000, 48)), np.zeros((1, 48))])
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(9_001, None), (9_002, [1.0]), (9_003, [float("nan")] * 48), (9_004, [None] * 48)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    index = neighbour_graph.build(df, str(tmp_path / "index"), shard)
    assert index.count() == 3_000 and index.groupBy("shard").count().count() == -(-3_000 // shard)
    asked = df.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    got: dict = {}
    for r in neighbour_graph.search(index, asked, 5, 24).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.distance))
        work = r.products
    unit = v[:3_000] / np.linalg.norm(v[:3_000], axis=1, keepdims=True)
    hits = 0
    for q, found in got.items():
        s = unit @ unit[q]
        s[q] = -9
        best = set(np.argsort(-s, kind="stable")[:5].tolist())
        hits += len(best & {i for i, _ in found})
        assert [i for i, _ in found] == [i for i, _ in sorted(found, key=lambda x: (x[1], x[0]))] and all(abs(1 - s[i] - d) < 1e-9 for i, d in found)
    assert len(got) == 150 and hits / 750 > 0.9
    assert shard < 3_000 or work < 300


@pytest.mark.parametrize("shard", [1_100, 5_000])
def test_checked_index_misses_nothing(spark, tmp_path, shard):
    """Vectors without structure and a short beam, copies of some under other ids, and a far group that no walk reaches."""
    rng = np.random.default_rng(9)
    v = rng.standard_normal((3_000, 32))
    v[100:400], v[2_980:] = v[0], v[2_980] + 1e-9 * rng.standard_normal((20, 32))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, embedding array<double>")
    asked = df.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    index = neighbour_graph.build(df, str(tmp_path / "index"), shard)
    got = {(r.query_id, r["rank"]): r.id for r in neighbour_graph.search(index, asked, 5, 8, exact=True).collect()}
    for q in range(0, 3_000, 20):
        d = neighbour_graph.distances(v, np.repeat(v[q : q + 1], 3_000, axis=0))
        d[q] = 9
        assert [got[q, k] for k in range(1, 6)] == np.argsort(d, kind="stable")[:5].tolist()


def test_distances_are_those_of_the_sql_engine():
    duckdb = pytest.importorskip("duckdb")
    v, q = np.random.default_rng(4).standard_normal((2, 500, 64)).astype(np.float32).astype(float)
    q[:9] = v[:9]
    rows = [duckdb.execute("SELECT 1-list_cosine_similarity(?::DOUBLE[], ?::DOUBLE[])", [a.tolist(), b.tolist()]).fetchone()[0] for a, b in zip(v, q, strict=True)]
    assert neighbour_graph.distances(v, q).tolist() == rows


def test_index_of_nothing_and_of_little(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1])], "id string, embedding array<double>")
    asked = df.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    assert [(r.query_id, r.id) for r in neighbour_graph.search(neighbour_graph.build(df, str(tmp_path / "a")), asked).orderBy("query_id").collect()] == [("a", "b"), ("b", "a")]
    empty = neighbour_graph.build(df.limit(0), str(tmp_path / "b"))
    assert empty.count() == 0 and neighbour_graph.search(empty, asked).count() == 0


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8])
def test_overlaps_of_two_collections(spark, least):
    rng = random.Random(int(least * 10))
    pool = [f"i{min(rng.randrange(12), rng.randrange(12))}" for _ in range(200)]
    make = lambda p, n: {f"{p}{k}": frozenset(rng.sample(pool, rng.randrange(1, 9))) for k in range(n)}
    left, right = make("a", 60), make("b", 60)
    frame = lambda sets: spark.createDataFrame([(k, i) for k, s in sets.items() for i in s] + [(None, "i1"), ("x", None)], "id string, item string")
    first: dict = {}
    for k, s in sorted(right.items()):
        first.setdefault(s, k)
    want = {(a, b): len(s & t) / len(s | t) for a, s in left.items() for t, b in first.items() if len(s & t) / len(s | t) > least}
    got = {(r.a, r.b): r.overlap for r in clustering.overlaps(frame(left), frame(right), least).collect()}
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_code_around_follows_no_relation_twice(spark):
    nodes = [(i, "DocEntity" if i == "d" else "CodeEntity", i, *[None] * 5) for i in "abcdexyz"]
    edges = [("a", "b", "calls"), ("b", "c", "calls"), ("c", "e", "calls"), ("a", "d", "describes"), ("d", "x", "describes"), ("y", "z", "calls"), ("z", "y", "calls")]
    g = Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame([(*e, 1.0) for e in edges], EDGE))
    names = spark.createDataFrame([("a",), ("y",), ("e",), ("none",)], "name string")
    got: dict = {}
    for r in vectors.code_around(g, names).collect():
        got.setdefault(r.name, set()).add(r.id)
    assert got == {"a": {"b", "c", "x"}, "y": {"z", "y"}, "e": {"c", "b"}}


def test_align_takes_the_graph_last(spark):
    nodes = [(f"o{k}", "CodeEntity", f"o{k}", *[None] * 5) for k in range(12)] + [("t", "CodeEntity", "term", *[None] * 5), ("k1", "ConceptEntity", "first", *[None] * 5), ("k2", "ConceptEntity", "second", *[None] * 5)]
    edges = [("t", f"o{k}", "calls", 1.0) for k in range(9)] + [(f"o{k}", "k1", "derived_from", 1.0) for k in range(10)] + [("k2", f"o{k}", "semantic_impact", 1.0) for k in range(12)]
    concepts = spark.createDataFrame([("c1", "first", [], 1), ("c2", "second", [], 2)], "concept_id string, name string, aliases array<string>, ord int")
    names = spark.createDataFrame([("term",), ("second",), ("o3",), (" ",), ("else",)], "name string")
    g = Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE))
    got = {r.name: (r.concept_id, r.method, r.confidence) for r in vectors.align(names, concepts, graph=g).collect()}
    assert got == {"term": ("c1", "graph_structure", 0.9), "second": ("c2", "exact", 1.0), "o3": ("c2", "graph_structure", 0.8462), " ": (None, "none", 0.0), "else": (None, "none", 0.0)}
    assert {r.name: r.method for r in vectors.align(names, concepts).collect()}["term"] == "none"


def test_a_readers_failure_ends_its_file_alone(spark):
    from tesserae.sources import files, java, parsing

    sources = [("a.py", b"def f():\n    g_call()\n"), ("b.py", b"def ("), ("c.java", b"package q; class C { }"), ("d.txt", b"x"), ("e.py", None), (None, b"x = 1")]
    df = spark.createDataFrame(sources, "path string, content binary")
    rows = [(r.file_path, r.kind, r.name) for r in parsing.entities(df).orderBy("file_path", "start_line", "kind").collect()]
    assert rows == [("a.py", "function", "f"), ("a.py", "module", "a"), ("a.py", "calls", "f"), ("b.py", "module", "b"), ("b.py", "parse_error", "SyntaxError"), ("c.java", "class", "C"), ("c.java", "module", "q")]
    plain = lambda d: sorted(map(tuple, d.collect()), key=str)
    good = df.where("path in ('a.py', 'c.java')")
    assert plain(parsing.entities(good)) == plain(files.python_entities(good.where("path = 'a.py'")).unionByName(java.java_entities(good.where("path = 'c.java'"))))

    def late(path, text, seen):
        raise KeyError("calls")

    broken = parsing.Reader(".py", files.root, files.tree, files.walked, late)
    assert [r[1] for r in parsing.read(broken, "a.py", "def f():\n    pass\n")] == ["module", "function", "parse_error"]


def test_actions_are_applied_once(spark, tmp_path):
    from tesserae.graph_log import GraphLog
    from tesserae.operators import entity_actions

    nodes = [("a", "CodeEntity", "a", *[None] * 5), ("b", "DocEntity", "b", *[None] * 5)]
    log = GraphLog(spark, str(tmp_path / "log")).create(Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame([], EDGE)))
    rows = [
        (1, "update", "a", None, "new", 7, None, None, None), (2, "update", None, None, "x", None, None, None, None), (3, "update", "a", None, None, None, None, None, None), (4, "create", "c", "ConceptEntity", "c", None, None, None, None),
        (5, "create", "d", "Other", "d", None, None, None, None), (6, "relate", "c", None, None, None, "describes", "b", None), (7, "relate", "c", None, None, None, "describes", "nowhere", None), (8, "relate", "c", None, None, None, None, "b", None),
        (9, "notify", None, None, None, None, None, None, ["x"]), (10, "notify", None, None, None, None, None, None, []), (11, "query", "b", None, None, None, None, None, None), (12, "query", "z", None, None, None, None, None, None), (13, None, "a", None, None, None, None, None, None),
    ]
    schema = "request_id long, action string, entity_id string, label string, name string, lines int, rel_type string, to_id string, recipients array<string>, entity_type string, file_path string, entry_category string, sensitivity string"
    asked = spark.createDataFrame([(*r, *[None] * 4) for r in rows], schema)
    for _ in range(2):
        done = {r.request_id: r.error for r in entity_actions.applied(log, asked, "t").collect()}
    assert {k for k, e in done.items() if e is None} >= {1, 4, 6, 7, 9, 11} and {k for k, e in done.items() if e} == {2, 3, 5, 8, 10, 13} | {12}
    g = log.graph()
    assert {(r.id, r.label, r.name, r.lines) for r in g.nodes.collect()} == {("a", "CodeEntity", "new", 7), ("b", "DocEntity", "b", None), ("c", "ConceptEntity", "c", None)}
    assert [(r.src, r.rel_type, r.dst) for r in g.edges.collect()] == [("c", "describes", "b")] and len(log.commits()) == 2
