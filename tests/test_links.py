"""Links by text, whole updates, rules as text, approvals, traces and percentiles against plain forms."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tesserae.graph import Graph
from tesserae.operators import actions, changes, linking, patterns, shapes, tables
from tesserae.sources import rules

NODE = "id string, label string, name string, entity_type string, file_path string, entry_category string, sensitivity string, lines int"
EDGE = "src string, dst string, rel_type string, weight double"


def test_substrings(spark):
    rng = random.Random(5)
    texts = {k: "".join(rng.choice("abcé ") for _ in range(rng.randrange(0, 14))) for k in range(60)} | {60: "", 61: None}
    needles = {k: "".join(rng.choice("abcé ") for _ in range(rng.randrange(0, 6))) for k in range(50)} | {50: None, 51: "zzzz"}
    given = [spark.createDataFrame(list(x.items()), f"{n}_id int, {n} string") for x, n in ((texts, "text"), (needles, "needle"))]
    want = {(t, n) for t, x in texts.items() for n, y in needles.items() if x is not None and y and y in x}
    got = [tuple(r) for r in linking.contained(*given).collect()]
    assert set(got) == want and len(got) == len(want)
    assert linking.contained(given[0].limit(0), given[1]).count() == linking.contained(given[0], given[1].limit(0)).count() == 0


def test_aliases_pass_over_taken_entities(spark):
    rng = random.Random(7)
    names = [(k, "".join(rng.choice("abAB") for _ in range(4)), k) for k in range(40)] + [(99, None, 99)]
    assets = [(f"s{k}", ["".join(rng.choice("abAB") for _ in range(rng.randrange(1, 3))) for _ in range(rng.randrange(0, 5))]) for k in range(12)] + [("none", None), ("twice", ["ab", "AB", "ab", ""])]
    want = set()
    for asset, aliases in assets:
        taken = []
        for alias in filter(None, aliases or []):
            free = [i for i, n, _ in names if n and alias.lower() in n.lower() and i not in taken]
            taken += free[:1]
        want |= {(i, asset) for i in taken}
    got = linking.alias_links(spark.createDataFrame(names, "id int, name string, ord int"), spark.createDataFrame(assets, "asset_id string, aliases array<string>"))
    assert {tuple(r) for r in got.collect()} == want
    # The first entity of both aliases goes to the first alias, the second alias takes the next one.
    two = linking.alias_links(spark.createDataFrame([(1, "blue red", 1), (2, "red", 2)], "id int, name string, ord int"), spark.createDataFrame([("x", ["blue", "red"])], "asset_id string, aliases array<string>"))
    assert {tuple(r) for r in two.collect()} == {(1, "x"), (2, "x")}


def test_documents_link_by_the_first_rule(spark):
    index = [(1, "src/a.py", "load_all", 1), (2, "src/a.py", "x", 2), (3, "lib/b.py", "run", 3), (4, None, "save_it", 4), (5, "c.md", "other", 5), (6, "", "noise", 6)]
    docs = [
        ("whole", "see src/a.py here"), ("start", "src/a.py"), ("last", "see a.py"), ("inside", "seexsrc/a.py"), ("comma", "(src/a.py)"), ("code", "text\n```python\nload_all(run, save_it)\n```"), ("plain", "load_all"),
        ("only", "see c.md"), ("first", "xb.py and b.py"), ("none", None), ("empty", ""),
    ]
    got = {(r.doc_id, r.id, r.rule) for r in linking.document_links(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(index, "id int, file_path string, name string, ord int")).collect()}
    assert got == {("whole", 1, 1), ("whole", 2, 1), ("start", 1, 1), ("start", 2, 1), ("last", 1, 2), ("last", 2, 2), ("inside", 1, 2), ("inside", 2, 2), ("code", 1, 3), ("code", 4, 3), ("only", 5, 1)}
    many = spark.createDataFrame([(k, "src/a.py", "n", k) for k in range(80)], "id int, file_path string, name string, ord int")
    capped = linking.document_links(spark.createDataFrame(docs[:1], "doc_id string, text string"), many).collect()
    assert sorted(r.id for r in capped) == list(range(50))


def test_update_of_files(spark):
    node = lambda i, f, label="CodeEntity": (i, label, i, "function", f, None, None, 1)
    files = lambda rows: spark.createDataFrame(rows, "path string, content string")
    before = Graph(spark.createDataFrame([node("a", "a.py"), node("b", "b.py"), node("c", "c.py"), node("d", "d.py"), node("n", None, "ConceptEntity")], NODE), spark.createDataFrame([("b", "a", "calls", 1.0), ("c", "b", "calls", 1.0), ("n", "b", "describes", 1.0), ("d", "c", "calls", 1.0)], EDGE))
    parsed = Graph(spark.createDataFrame([node("a", "a.py"), node("b2", "b.py"), node("e", "e.py")], NODE), spark.createDataFrame([("b2", "a", "calls", 1.0), ("e", "b2", "calls", 1.0), ("e", "gone", "calls", 1.0), ("a", "c", "calls", 1.0)], EDGE))
    old = files([("a.py", "1"), ("b.py", "1"), ("c.py", "1"), ("d.py", "1")])
    new = files([("a.py", "1"), ("b.py", "2"), ("d.py", "2"), ("e.py", "1")])
    diffs = spark.createDataFrame([("d.py", "+# note")], "path string, diff string")
    made = changes.update(before, old, new, parsed, diffs)
    assert {(r.path, r.change_type) for r in made.changes.collect()} == {("b.py", "BODY"), ("c.py", "DELETED"), ("d.py", "DOC_ONLY"), ("e.py", "ADDED")}
    assert {r.id for r in made.graph.nodes.collect()} == {"a", "b2", "d", "e", "n"}
    assert {(r.src, r.dst) for r in made.graph.edges.collect()} == {("b2", "a"), ("e", "b2")}
    r = made.report.first()
    assert (r.changes_detected, r.nodes_added, r.nodes_updated, r.nodes_deleted, r.relations_rebuilt, r.vectors_updated, r.concepts_flagged) == (4, 1, 1, 1, 2, 3, 1)
    same = changes.update(before, old, old, parsed)
    assert same.graph.nodes.count() == 5 and same.report.first().changes_detected == 0 and same.impacts.count() == 0


RULES = """
shapes:
  - {id: a, name: A, description: d, target: {resource_type: CodeEntity, operation: update}, path: SELF, constraint: {field: lines, operator: ">", value: 100}, priority: 3}
  - id: b
    name: B
    description: d
    target: {entry_type: CodeEntity, operation: UPDATE, field_filter: {name: "it's"}}
    path: CALLS{1,2} -> CodeEntity
    constraint: {field: sensitivity, value: [x, y], unless_field: name, unless_value: z}
    severity: block
    enabled: false
"""


def test_rules_as_text(spark, tmp_path):
    a, b = rules.parse_shapes(RULES)
    assert (a.label, a.operation, a.operator, a.severity, a.enabled, a.max_depth) == ("CodeEntity", "UPDATE", ">", "warn", True, 3)
    assert (b.value, b.unless, b.field_filter, b.enabled) == (("x", "y"), ("name", ("z",)), "name = 'it''s'", False)
    again = rules.parse_shapes(rules.written(shapes.SHAPES))
    assert [(s.id, s.path, s.field, s.operator, s.value, s.severity, s.priority, s.max_depth) for s in again] == [(s.id, s.path, s.field, s.operator, s.value, s.severity, s.priority, s.max_depth) for s in shapes.SHAPES]
    (tmp_path / "r.yaml").write_text(RULES)
    assert [s.id for s in rules.read_shapes(spark, str(tmp_path / "r.yaml"))] == ["a", "b"]
    assert rules.parse_shapes("") == [] and [r.id for r in rules.catalogue(spark, [a, b]).collect()] == ["a"]
    bad = RULES.replace("id: b", "id: a").replace("field: lines", "field: nothing") + "  - {id: c}\n"
    with pytest.raises(ValueError, match="(?s)2 bad rules.*nothing.*lacks name"):
        rules.parse_shapes(bad)
    with pytest.raises(ValueError, match="is there already"):
        rules.parse_shapes(RULES.replace("id: b", "id: a"))
    with pytest.raises(ValueError, match="unknown label Nowhere"):
        rules.parse_shapes(RULES.replace("-> CodeEntity", "-> Nowhere"))


def test_approvals_by_step(spark):
    steps = spark.createDataFrame([("1", "allow"), ("2", "escalate"), ("3", "block"), ("4", "escalate")], "step string, decision string")
    got = {r.step: (r.token, r.may_proceed) for r in actions.step_approvals(steps, "t", "s", "n").collect()}
    assert got["1"] == (None, True) and got["3"] == (None, False) and len({got["2"][0], got["4"][0]}) == 2 and not got["2"][1]
    answers = spark.createDataFrame([("a", True, 5.0), ("a", True, 6.0), ("b", False, 5.0), ("c", True, 700.0), ("d", True, 1.0), ("a", True, 9000.0)], "token string, approved boolean, at double")
    log = actions.resolved(spark.createDataFrame([("a", 0.0), ("b", 0.0), ("c", 0.0)], "token string, at double"), answers, 1000.0).collect()
    assert sorted((r.token, r.action, r.may_proceed) for r in log) == [("a", "resolved", True), ("a", "used", False), ("b", "rejected", False), ("c", "expired", False), ("d", "unknown", False)]


def test_traces_follow_their_log(spark):
    log = [("a", 1, "start", 10, None), ("a", 2, "step", 11, "x"), ("a", 3, "start", 12, None), ("a", 4, "step", 13, "y"), ("a", 5, "end", 14, None), ("b", 1, "start", 1, None), ("b", 2, "delete", 2, None), ("c", 1, "step", 1, "z"), ("d", 1, "delete", 0, None), ("d", 2, "start", 5, None)]
    got = tables.traces(spark.createDataFrame(log, "trace_id string, ord long, kind string, at long, step string"))
    assert sorted(map(tuple, got.select("trace_id", "started", "ended", "n_steps", "last_step").collect())) == [("a", 12, 14, 1, "y"), ("d", 5, None, 0, None)]


def test_percentiles_are_exact(spark):
    rng = random.Random(2)
    rows = [(g, float(rng.randrange(50)) if rng.random() < 0.9 else None) for g in "ab" for _ in range(300)] + [("c", 4.5), ("d", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5)
    want = frame.where("v is not null").groupBy("g").agg(*[F.percentile("v", p).alias(f"p{round(100 * p)}") for p in (0.5, 0.95)]).orderBy("g").collect()
    got = tables.percentiles(frame, "g", "v", (0.5, 0.95)).orderBy("g").collect()
    assert [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in got] == [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in want]


def test_upstream_entry_points(spark):
    """Paths use no call twice; a node may be reached at several distances."""
    nodes = spark.createDataFrame([("a", "n", "A", None, None, "http_api", None, 1), ("b", "n", "B", None, None, None, None, 1), ("c", "n", "C", None, None, "rpc_service", None, 1)], NODE)
    edges = spark.createDataFrame([("a", "b", "calls", 1.0), ("b", "c", "calls", 1.0), ("a", "c", "calls", 1.0), ("c", "b", "calls", 1.0), ("a", "c", "imports", 1.0)], EDGE)
    got = patterns.business_impact(Graph(nodes, edges), spark.createDataFrame([("c",)], "id string"))
    assert sorted((r.node, r.distance) for r in got.collect()) == [("a", 1), ("a", 2), ("a", 3), ("c", 2)]
