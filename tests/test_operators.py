"""Small literal cases with exact expected values."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tesserae.functions import scalars as S
from tesserae.graph import Graph
from tesserae.operators import actions, capabilities, changes, clustering, impact, patterns, shapes, store, tables, vectors
from tesserae.sources import files
from tesserae.streaming import events as stream

EDGE = "src string, dst string, rel_type string, weight double"
NODE = "id string, label string, name string, entity_type string, file_path string, entry_category string, sensitivity string, lines int"


def edges(spark, pairs, kind="calls"):
    return spark.createDataFrame([(a, b, kind, 1.0) for a, b in pairs], EDGE)


def forward(spark, pairs, depth=3):
    changed = spark.createDataFrame([("A", "SIGNATURE")], "id string, change string")
    rows = impact.impact(edges(spark, pairs), changed, depth).where("direction = 'FORWARD'").collect()
    return {r.node_id: (round(r.score, 6), r.depth) for r in rows}


def test_impact_of_a_chain_and_a_diamond(spark):
    assert forward(spark, [("B", "A"), ("C", "B"), ("D", "C"), ("E", "D")]) == {"B": (0.9, 1), "C": (0.54, 2), "D": (0.27, 3)}
    assert forward(spark, [("B", "A"), ("C", "A"), ("D", "B"), ("D", "C")])["D"] == (0.54, 2)
    assert forward(spark, [("A", "A"), ("B", "A"), ("A", "B")]) == {"B": (0.9, 1)}


def walk(steps, source, depth=3):
    """The search node by node: revisit only for a strictly better score."""
    best, front = {}, [source]
    for d in range(1, depth + 1):
        new = []
        for n in front:
            for kind, m in steps.get(n, []):
                s = impact.WEIGHTS.get(kind, (0,) * 5)[3] * impact.DECAY[d - 1]
                if m != source and s >= impact.LEAST and s > best.get(m, (0, 0))[0]:
                    best[m] = (s, d)
                    new.append(m)
        front = list(dict.fromkeys(new))
    return {m: round(s, 6) for m, (s, _) in best.items()}


def test_impact_of_random_graphs(spark):
    rng = random.Random(4)
    kinds = [*impact.WEIGHTS, "unknown"]
    rows = [(f"{g}:{rng.randrange(9)}", f"{g}:{rng.randrange(9)}", rng.choice(kinds), 1.0) for g in range(30) for _ in range(18)]
    changed = spark.createDataFrame([(f"{g}:0", "BODY") for g in range(30)], "id string, change string")
    got: dict = {}
    for r in impact.impact(spark.createDataFrame(rows, EDGE).distinct(), changed).where("direction = 'BACKWARD'").collect():
        got.setdefault(f"{r.node_id.split(':')[0]}:0", {})[r.node_id] = round(r.score, 6)
    for g in range(30):
        steps: dict = {}
        for a, b, k, _ in rows:
            steps.setdefault(a, []).append((k, b))
        assert got.get(f"{g}:0", {}) == walk(steps, f"{g}:0")


def test_impact_of_many_sources_is_the_best_of_each(spark):
    """Sources that reach one another, in cycles too: the merged search against one search a source."""
    rng = random.Random(6)
    rows = sorted({(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}", rng.choice([*impact.WEIGHTS, "unknown"]), 1.0) for _ in range(70)})
    sources = [f"n{k}" for k in range(0, 25, 4)]
    got = {r.node_id: (round(r.score, 6), r.depth) for r in impact.impact(spark.createDataFrame(rows, EDGE), spark.createDataFrame([(x, "BODY") for x in sources], "id string, change string")).where("direction = 'BACKWARD'").collect()}
    steps: dict = {}
    for a, b, k, _ in rows:
        steps.setdefault(a, []).append((k, b))
    want: dict = {}
    for source in sources:
        for m, s in walk(steps, source).items():
            want[m] = max(s, want.get(m, 0))
    assert {m: s for m, (s, _) in got.items()} == want


def witnesses(rows, sources, depth=3, column=3):
    """Every walk, one by one: the source and the relations of the best score, as impact() says."""
    best: dict = {}
    for direction in ("FORWARD", "BACKWARD"):
        walks = {(s, s, ()) for s in sources}
        for d in range(1, depth + 1):
            longer = set()
            for a, b, kind, _ in rows:
                at, to = (b, a) if direction == "FORWARD" else (a, b)
                score = impact.WEIGHTS.get(kind, (0,) * 5)[column] * impact.DECAY[d - 1]
                if score >= impact.LEAST:
                    longer |= {(s, to, (*path, kind), at, round(score, 6)) for s, n, path in walks if n == at}
            for to in {w[1] for w in longer}:
                here = [w for w in longer if w[1] == to]
                last = {(w[3], w[2][-1]) for w in here if w[0] != to}
                here = [w for w in here if (w[3], w[2][-1]) in last]
                if here and max(w[4] for w in here) > best.get((direction, to), (0,))[0]:
                    top = max(w[4] for w in here)
                    s, path = min((w[0], w[2]) for w in here if w[4] == top)
                    if s == to:
                        s, path = max((w[0], w[2]) for w in here if w[4] == top)
                    best[direction, to] = (top, d, s, path)
            walks = {w[:3] for w in longer}
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_impact_names_a_source_and_a_path(spark, seed):
    rng = random.Random(seed)
    rows = sorted({(f"n{rng.randrange(18)}", f"n{rng.randrange(18)}", rng.choice([*impact.WEIGHTS, "unknown"]), 1.0) for _ in range(55)})
    sources = [f"n{k}" for k in range(0, 18, 3)]
    got = impact.impact(spark.createDataFrame(rows, EDGE), spark.createDataFrame([(x, "BODY") for x in [*sources, None, "n0"]], "id string, change string"))
    assert {(r.direction, r.node_id): (round(r.score, 6), r.depth, r.source_node_id, tuple(r.relation_path)) for r in got.collect()} == witnesses(rows, sources)


def test_impact_of_one_source_goes_its_way(spark):
    rows = [("B", "A", "calls", 1.0), ("C", "B", "imports", 1.0), ("C", "B", "calls", 1.0), ("D", "C", "extends", 1.0), ("A", "D", "calls", 1.0)]
    got = impact.impact(spark.createDataFrame(rows, EDGE), spark.createDataFrame([("A", "DELETED")], "id string, change string")).where("direction = 'FORWARD'").collect()
    assert {r.node_id: (r.source_node_id, r.relation_path, round(r.score, 6)) for r in got} == {"B": ("A", ["calls"], 1.0), "C": ("A", ["calls", "calls"], 0.6), "D": ("A", ["calls", "calls", "extends"], 0.27)}


def test_merged_impacts_keep_the_first_of_equals(spark):
    nodes = spark.createDataFrame([("x", "L", "x", None)], "id string, label string, name string, file_path string")
    rows = [("x", "F", 0.3, 1, "b", ["calls"]), ("x", "F", 0.1 + 0.2, 1, "a", ["imports"]), ("x", "F", 0.3, 2, "0", ["calls"])]
    best = impact.merged(spark.createDataFrame(rows, "node_id string, direction string, score double, depth int, source_node_id string, relation_path array<string>"), nodes).first()
    assert (best.source_node_id, best.relation_path, best.depth, best.severity) == ("a", ["imports"], 1, "MEDIUM")


def test_label_propagation_and_cohesion(spark):
    assert set(clustering.sweep({"a": {"b", "c"}, "b": {"a", "c"}, "c": {"a", "b"}}).values()).__len__() == 1
    assert len(set(clustering.sweep({"a": {"b"}, "b": {"a"}, "c": {"d"}, "d": {"c"}}).values())) == 2
    assert clustering.sweep({"x": set()}) == {"x": "x"}
    rng = random.Random(1)
    pairs = {tuple(sorted((f"{g}{rng.randrange(7)}", f"{g}{rng.randrange(7)}"))) for g in "abcdef" for _ in range(8)}
    pairs = {p for p in pairs if p[0] != p[1]}
    frame = spark.createDataFrame(sorted(pairs), "a string, b string")
    adjacency: dict = {}
    for a, b in pairs:
        adjacency.setdefault(a, set()).add(b)
        adjacency.setdefault(b, set()).add(a)
    assert {r.id: r.community for r in clustering.label_propagation(frame).collect()} == clustering.sweep(adjacency)
    alone = spark.createDataFrame([("zz",), ("zz",), (next(iter(adjacency)),)], "id string")
    assert {r.id: r.community for r in clustering.label_propagation(frame, alone, one_task=1).collect()} == clustering.sweep(adjacency) | {"zz": "zz"}
    members = spark.createDataFrame([("1", "t"), ("2", "t"), ("3", "t"), ("4", "c"), ("5", "c"), ("6", "c"), ("7", "s")], "id string, community string")
    inside = spark.createDataFrame([("1", "2"), ("2", "3"), ("1", "3"), ("4", "5"), ("5", "6")], "a string, b string")
    assert {r.community: round(r.cohesion, 6) for r in clustering.cohesion(inside, members).collect()} == {"t": 1.0, "c": round(2 / 3, 6), "s": 0.0}


def test_labels_do_not_depend_on_the_size_of_components(spark):
    rng = random.Random(2)
    pairs = {(f"n:{k % 3}", f"s:{k}") for k in range(40)} | {(f"n:{k}", "r:0") for k in range(3)}
    pairs |= {tuple(sorted((f"{g}{rng.randrange(9)}", f"{g}{rng.randrange(9)}"))) for g in "abc" for _ in range(14)}
    pairs = {p for p in pairs if p[0] != p[1]}
    adjacency: dict = {}
    for a, b in pairs:
        adjacency.setdefault(a, set()).add(b)
        adjacency.setdefault(b, set()).add(a)
    frame = spark.createDataFrame(sorted(pairs), "a string, b string")
    want = clustering.sweep(adjacency)
    assert {r.id: r.community for r in clustering.label_propagation(frame, one_task=1).collect()} == want
    assert {r.id: r.community for r in clustering.label_propagation(frame, one_task=20).collect()} == want


def test_path_grammar():
    assert shapes.parse_path("CALLS+ -> X") == ([(False, "calls", 1, 3)], "X")
    assert shapes.parse_path("^CALLS* -> X")[0] == [(True, "calls", 0, 3)]
    assert shapes.parse_path("CALLS{1,9} -> X", 5)[0] == [(False, "calls", 1, 5)] and shapes.parse_path("A{7}/B -> X")[0][0] == (False, "a", 7, 7)
    assert shapes.parse_path("SELF") == ([], None)
    for bad in ("CALLS", "CALLS -> ", "A/B/C/D -> X", "9 -> X"):
        with pytest.raises(ValueError):
            shapes.parse_path(bad)
    with pytest.raises(ValueError):
        shapes.parse_path("FLIES -> X", known={"calls"})


@pytest.mark.parametrize("operator,value,want", [("in", ("a", "b"), True), ("in", ("z",), False), ("equals", "a", True), ("not_in", ("z",), True), ("not_in", ("a",), False), ("not_equals", "z", True), ("not_equals", "a", False), ("exists", None, True), ("odd", None, False)])
def test_predicates_over_collected_values(spark, operator, value, want):
    nodes = spark.createDataFrame([("1", "CodeEntity", "one", "f", None, None, None, 5), ("2", "T", "two", "f", None, None, "a", 1), ("3", "T", "three", "f", None, None, "c", 1), ("4", "CodeEntity", "none", "f", None, None, None, 5)], NODE)
    graph = Graph(nodes, edges(spark, [("1", "2"), ("1", "3")]))
    shape = shapes.Shape("s", "CALLS -> T", "sensitivity", operator, value, "warn", 1)
    assert [r.id for r in shapes.triggered(graph, shape).collect()] == (["1"] if want else [])


def test_fusion(spark):
    found = [("a", "s1", "warn", 1, "w"), ("b", "s1", "warn", 1, "w"), ("b", "s2", "block", 5, "x\ny"), ("b", "s3", "block", 5, "y \n"), ("c", "s1", "warn", 0, "w"), ("d", "s1", "block", 2, ""), ("d", "s2", "block", 2, " "), ("e", "s1", "escalate", 1, "e"), ("e", "s2", "warn", 9, "w")]
    frame = spark.createDataFrame(found, "id string, shape_id string, severity string, priority int, suggestion string")
    entities = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    got = {r.id: (r.decision, r.suggestion) for r in shapes.fused(entities, frame).collect()}
    assert got["a"] == ("warn", "w") and got["b"] == ("block", "x\ny") and got["c"][0] == "escalate" and got["d"][0] == "escalate"
    assert got["e"] == ("escalate", "e") and got["f"] == ("allow", "")


def test_paths_use_no_edge_twice(spark):
    start = spark.createDataFrame([("a",)], "id string")
    got = sorted((r.node, r.hops) for r in patterns.paths(edges(spark, [("a", "b"), ("b", "a"), ("b", "c")]), start, 0, 3).collect())
    assert got == [("a", 0), ("a", 2), ("b", 1), ("c", 2)]


def test_upserts_and_versions(spark):
    old = spark.createDataFrame([("1", "x", 1), ("2", "y", 2)], "id string, name string, n int")
    new = spark.createDataFrame([("2", None, 5), ("3", "z", None)], "id string, name string, n int")
    assert sorted(tuple(r) for r in store.upsert(old, new, ["id"]).collect()) == [("1", "x", 1), ("2", "y", 5), ("3", "z", None)]
    with pytest.raises(Exception, match="missing"):
        store.upsert(old, spark.createDataFrame([(None, "q", 1)], "id string, name string, n int"), ["id"]).collect()
    state = lambda rows: store.version_state(spark.createDataFrame(rows, "version string, applied_at int"), "2.3.0").first().state
    assert [state(r) for r in ([], [("2.3.0", 1)], [("2.3.0", 1), ("2.2.9", 2)], [("2.10.0", 1)])] == ["EMPTY", "MATCH", "BEHIND", "AHEAD"]


def test_changes(spark):
    one = lambda rows: spark.createDataFrame(rows, "path string, content string")
    got = {r.path: r.change_type for r in changes.detect(one([("a", "1"), ("b", "2"), ("c", None)]), one([("a", "1"), ("b", "3"), ("d", "4"), ("c", "")])).collect()}
    assert got == {"b": "BODY", "d": "ADDED"}
    rows = spark.createDataFrame([("+def f(x):",), ("+# note\n-# old",), ("+x = 1",), ("",), (None,)], "d string")
    assert [r[0] for r in rows.select(S.diff_change(F.col("d"))).collect()] == ["SIGNATURE", "DOC_ONLY", "BODY", "DOC_ONLY", "DOC_ONLY"]


def test_scalars(spark):
    row = spark.range(1).select(
        S.snake_to_camel(F.lit("file_path_id")), S.upper_snake(F.lit("SemanticImpact2")), S.effective_severity(F.lit("block"), F.lit(0.8)), S.effective_severity(F.lit("escalate"), F.lit(0.1)),
        S.bounded(F.lit("see a/b.py here"), F.lit("b.py")), S.bounded(F.lit("xb.py"), F.lit("b.py")), S.repo_id(F.lit("https://h/x/repo.git")), S.git_status(F.lit("R100")),
        S.relation_name(F.lit("hasPart")), S.stem(F.lit("a/b.tar.gz")), S.suffix(F.lit("a/.hidden")), S.masked_url(F.lit("https://t:s@h/x")), S.complexity(F.lit(100), F.lit(20)), S.code_identifiers(F.lit("```python\nfoo = ab(bar)\n```")),
        S.business_domain(F.lit("/api/orders/1")), S.business_domain(F.lit("/")), S.role_allows(F.lit("ghost"), "reader"),
    ).first()
    assert list(row) == ["filePathId", "SEMANTIC_IMPACT_2", "warn", "warn", True, False, "repo", "R", "CONTAINS", "b.tar", "", "https://***@h/x", 1.0, ["bar", "foo"], "orders", "root", False]


def test_skills_and_evictions(spark):
    rows = spark.createDataFrame([("a",)] * 4 + [("b",), (None,)], "signature string")
    assert {r.signature: (r.hits, r.confidence, r.layer) for r in tables.skills(rows).collect()} == {"a": (3, 0.8, "active"), "b": (0, 0.5, "candidate")}
    traces = spark.createDataFrame([(f"t{k}", float(k)) for k in range(10)], "trace_id string, at double")
    assert {r.trace_id: r.reason for r in tables.evicted(traces, 10.0, 7.0, 4).collect()} == {"t0": "expired", "t1": "expired", "t2": "expired", "t3": "excess", "t4": "excess", "t5": "excess"}


def test_the_stream_ends_where_the_batch_does(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch.repartition(4).write.parquet(str(tmp_path / "in"))
    stream.run_available(stream.reflection(stream.read(spark, str(tmp_path / "in"), 1)), "skills_seen", str(tmp_path / "c"))
    assert sorted(map(tuple, spark.table("skills_seen").collect())) == sorted(map(tuple, stream.reflection(batch).collect()))


def test_python_files(spark, tmp_path):
    (tmp_path / "a.py").write_text('import os.path\nfrom x import y\n\nclass A(b.Base):\n    """doc"""\n    @deco\n    def m(self):\n        def inner(): pass\n        run_it(len([1]))\n')
    (tmp_path / "bad.py").write_text("def (")
    (tmp_path / "build").mkdir()
    (tmp_path / "build" / "c.py").write_text("x = 1")
    got = {(r.kind, r.name, r.target) for r in files.python_entities(files.scan(spark, str(tmp_path), (".py",))).collect()}
    assert got == {("module", "a", None), ("module", "bad", None), ("class", "A", "doc"), ("extends", "A", "Base"), ("function", "A.m", None), ("imports", None, "path"), ("imports", None, "y"), ("calls", "A.m", "run_it")}


def test_path_grammar():
    steps = lambda p, d=3: shapes.parse_path(p, d)[0]
    assert steps("CALLS -> CodeEntity") == [(False, "calls", 1, 1)]
    assert steps("^CALLS+ -> CodeEntity") == [(True, "calls", 1, 3)]
    assert steps("CALLS* / IMPORTS{2} -> CodeEntity") == [(False, "calls", 0, 3), (False, "imports", 2, 2)]
    assert steps("CALLS{5} -> CodeEntity") == [(False, "calls", 5, 5)]
    assert steps("CALLS{2,} -> CodeEntity") == [(False, "calls", 2, 3)]
    assert steps("CALLS{1,9} -> CodeEntity") == [(False, "calls", 1, 3)]
    for bad in ("CALLS", "CALLS{ -> X", "A/B/C/D -> X", "CALLS{4,} -> X"):
        with pytest.raises(ValueError):
            shapes.parse_path(bad)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_capability_scalars(spark):
    c = capabilities
    domain = lambda p, n="f": one(spark, c.domain(F.lit(p), F.lit(n)))
    assert [domain(p) for p in ("/api/credit/x", "/orders", "/app/api/pay.py", "/", "/api")] == ["credit", "orders", "pay", "root", "api"]
    assert [domain(None, n) for n in ("validate_credit_card", "order_list", "ping", "")] == ["credit", "order", "unknown", "unknown"]
    assert domain("", "get_total") == "total"
    plain = lambda t: one(spark, c.plain_type(F.lit(t)))
    assert [plain(t) for t in ("Optional[str]", "str | None", "'A'", "", None, "dict[str, int]")] == ["str", "str", "A", "any", "any", "dict[str, int]"]
    contract = lambda j: one(spark, c.contract(F.lit(j)))
    assert contract('["a: int", "b", "c: x: y", "a: str | None"]') == {"a": "str", "b": "any", "c": "x: y"}
    assert contract("nope") == contract(None) == contract("[]") == {}
    words = one(spark, c.keywords(F.lit("Get_total_x"), F.lit("@p a The total of all")))
    assert words == ["get", "total", "x", "the", "of"]
    assert one(spark, c.description(F.lit("\n  First. \n rest"), F.lit("f"))) == "First."
    assert one(spark, c.description(F.lit("  \n"), F.lit("f"))) == "Capability: f"


def test_topics_skip_bad_metadata_and_repeats(spark):
    published = spark.createDataFrame([("a", "t"), ("a", "t"), ("b", ""), ("c", None)], "source string, topic string")
    consumers = spark.createDataFrame([("e", "mq_consumer", '{"topic": "t"}'), ("f", "mq_consumer", "{"), ("g", "http_api", '{"topic": "t"}'), ("h", "mq_consumer", None)], "id string, entry_category string, entry_metadata string")
    got = capabilities.topics(published, consumers).collect()
    assert sorted((r.topic, r.rel_type, r.entity) for r in got) == [("t", "consumed_by", "e"), ("t", "publishes_to", "a")]
    assert len({r.id for r in got}) == 1


def test_approvals_and_conditions(spark):
    rows = [(None, [], False, "query_entity"), (None, ["w"], False, "query_entity"), ("no", [], False, "query_entity"), (None, [], True, None), (None, [], None, "create_entity"), (None, [], None, "unknown")]
    asked = spark.createDataFrame(rows, "block_reason string, warnings array<string>, requires_approval boolean, function string")
    levels = lambda **k: [r.level for r in actions.approvals(asked, **k).collect()]
    assert levels() == ["approved", "pending", "pending", "pending", "pending", "approved"]
    assert levels(on_block="auto_reject", on_warn="auto_allow") == ["approved", "approved", "denied", "pending", "pending", "approved"]
    assert one(spark, actions.condition(F.lit(3), ">=", F.lit(3)))
    with pytest.raises(ValueError):
        actions.condition(F.lit(1), "<=", F.lit(1))
    with pytest.raises(Exception, match="field is missing"):
        one(spark, actions.condition(F.lit(None).cast("int"), ">", F.lit(1)))


def test_migrations_go_by_number(spark):
    g = Graph(spark.createDataFrame([("a", "X", None, None, None, None, None, None)], NODE), edges(spark, []))
    steps = [(v, lambda g, v=v: Graph(g.nodes.withColumn("label", F.concat("label", F.lit(f" {v}"))), g.edges)) for v in ("1.10.0", "1.2.0", "2.0.0")]
    moved, path = store.migrated(g, steps, "1.1.0", "1.10.0")
    assert path == ["1.2.0", "1.10.0"] and moved.nodes.first().label == "X 1.2.0 1.10.0"
    assert store.migrated(g, steps, "2.0.0", "2.0.0")[1] == []
    with pytest.raises(ValueError):
        store.migrated(g, [*steps, ("2.0.0", lambda g: g)], "1.0.0", "2.0.0")
    with pytest.raises(ValueError):
        store.set_property(g.nodes, "a", "id; drop", F.lit("x"))


def test_lookup_suggests_only_without_an_exact_name(spark):
    n = spark.createDataFrame([(k, "X", name, None, None, None, None, None) for k, name in (("a", "ring"), ("b", "rings"), ("c", "string"))], NODE)
    assert [(r.id, r.how) for r in patterns.lookup(n, "ring").collect()] == [("a", "exact")]
    assert [(r.id, r.how) for r in patterns.lookup(n, "rin").collect()] == [("a", "suggestion"), ("b", "suggestion"), ("c", "suggestion")]
    assert patterns.lookup(n, "zzz").collect() == []


def test_changeset_ignores_row_order(spark):
    rows = [("a", "ADDED", None, "1"), ("b", "DELETED", "2", None), ("c", "BODY", "3", "4")]
    make = lambda rs: changes.changeset(spark.createDataFrame(rs, "path string, change_type string, old_sha string, new_sha string")).first()
    assert make(rows) == make(rows[::-1]) and make(rows).changeset_id.startswith("cs-") and len(make(rows).changeset_id) == 15
    assert make(rows).changeset_id != make(rows[:2]).changeset_id
    assert tuple(make(rows))[1:] == (3, 1, 1, 1)


def test_dispatch_tries_again(spark, tmp_path):
    spark.createDataFrame([(1, "click"), (2, "view")], "event_id long, event_type string").write.parquet(str(tmp_path / "in"))
    seen, failures = [], [RuntimeError("once")]

    def build(rows, batch_id):
        if failures:
            raise failures.pop()
        seen.extend(("build", r.event_id) for r in rows.collect())

    arriving = spark.readStream.schema("event_id long, event_type string").parquet(str(tmp_path / "in"))
    handlers = {"build": build, "audit": lambda rows, _: seen.extend(("audit", r.event_id) for r in rows.collect())}
    stream.dispatch(arriving, handlers, {"*": ["audit"], "click": ["build"]}, str(tmp_path / "check"))
    assert sorted(seen) == [("audit", 1), ("audit", 2), ("build", 1)]


JAVA = """package a.b;
import java.util.List;
import x.y.*;
import static q.Z.go;
/** doc { */
@Service("x")
public class Orders<T extends Foo> extends base.Base<T> implements Api, Other<List<T>> {
    private final Repo repo = new Repo(1);
    public Orders(Repo r) { this.repo = r; }
    @Override
    public List<String> find(final Map<String, Integer> m, int[] k) throws IOException {
        if (k == null) { helper(k); }
        Item i = new Item("}");
        restTemplate.getForObject("http://svc1/a", String.class);
        kafkaTemplate.send("topic.a", i);
        rabbitTemplate.convertAndSend("q.b", i);
        return repo.load(m).size();
    }
    abstract void later(int a);
    enum Kind { A, B; int code() { return 1; } }
    interface Api { void go(); }
}
record Point(int x, int y) { }
@interface Marked { }
"""


def test_java_files(spark):
    from tesserae.sources.java import java_entities

    df = spark.createDataFrame([("A.java", bytearray(JAVA.encode())), ("empty.java", bytearray(b"")), ("broken.java", bytearray(b"class { ) } } \"")), ("null.java", None)], "path string, content binary")
    got = {(r.file_path, r.kind, r.name, r.target) for r in java_entities(df).collect()}
    a = {x[1:] for x in got if x[0] == "A.java"}
    assert {n for k, n, _ in a if k in ("method", "constructor")} == {"Orders.<init>(Repo)", "Orders.find(Map,int[])", "Orders.later(int)", "Kind.code()", "Api.go()"}
    assert {(k, n) for k, n, _ in a if k in ("class", "enum", "interface", "record", "annotation")} == {("class", "Orders"), ("enum", "Kind"), ("interface", "Api"), ("record", "Point"), ("annotation", "Marked")}
    assert {(k, t) for k, _, t in a if t} == {("imports", "List"), ("imports", "go"), ("extends", "Base"), ("implements", "Api"), ("implements", "Other"), ("calls", "helper"), ("uses", "Item"), ("calls", "getForObject"), ("calls", "send"), ("calls", "convertAndSend"), ("calls", "load"), ("calls_service", "svc1"), ("publishes_to", "topic.a"), ("publishes_to", "q.b")}
    assert {x[:2] for x in got if x[0] != "A.java"} == {("empty.java", "module"), ("broken.java", "module")}


def test_ontology_files(spark, tmp_path):
    from tesserae.operators import shapes
    from tesserae.sources import ontologies

    (tmp_path / "o.json").write_text('{"entity_types": [{"id": "a", "name": "A", "confidence": 0.9},\n {"id": "b", "name": "B", "is_entity_type": false}], "properties": [{"id": "p", "name": "p", "value_type": "enum", "enum_values": ["x", "y"]}], "metadata": {}}')
    got = ontologies.read(spark, str(tmp_path / "o.json"))
    assert [r.id for r in got["entity_types"].collect()] == ["a", "b"] and got["axioms"].count() == 0
    rules = shapes.from_ontology(got["entity_types"], got["properties"], got["relations"].selectExpr("id", "name relation_type", "range_concept_id range_label", "confidence"))
    assert {(r.id, r.value, r.confidence) for r in rules.collect()} == {("type_a", "A", 0.9), ("enum_p", "x,y", 1.0)}


def test_snapshots_and_saved_graphs(spark, tmp_path):
    from tesserae.graph import Graph, graph_from_tables
    from tesserae.sources import ontologies

    (tmp_path / "c.json").write_text('{"a.py": "1", "b.py": "2"}')
    assert {tuple(r) for r in ontologies.read_snapshot(spark, str(tmp_path / "c.json")).collect()} == {("a.py", "1"), ("b.py", "2")}
    ontologies.write_snapshot(spark.createDataFrame([("a", bytearray(b"x"))], "path string, content binary"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1
    g = graph_from_tables(spark, "/root/testdata/sf0.001")
    g.save(str(tmp_path / "g"))
    back = Graph.load(spark, str(tmp_path / "g"))
    assert back.nodes.count() == g.nodes.count() and back.edges.exceptAll(g.edges).isEmpty() and back.nodes.columns == g.nodes.columns


def test_registered_searches_ask_every_twentieth_row(spark):
    from tesserae import catalog

    sf = "/root/testdata/sf0.001"
    e = {r.vec_id: r for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}

    def distance(a, b):
        dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
        return 1 - dot(a, b) / (dot(a, a) ** 0.5 * dot(b, b) ** 0.5)

    near = {q: sorted((distance(r.embedding, e[q].embedding), i) for i, r in e.items() if i != q) for q in e if q % 20 == 0}
    want = {(q, i, k + 1) for q, best in near.items() for k, (_, i) in enumerate(best[:5])}
    assert {tuple(r) for r in catalog.QUERIES["vec_02_search"](spark, sf).collect()} == want
    labelled = {(q, i) for q, best in near.items() for _, i in [b for b in best if e[b[1]].label == 1][:5]}
    assert {tuple(r) for r in catalog.QUERIES["fil_09_metadata"](spark, sf).collect()} == labelled
    hits = [[e[i].label == e[q].label for _, i in best[:3]] for q, best in near.items()]
    recall = catalog.QUERIES["agg_14_recall"](spark, sf).first()
    assert recall.recall_1 == round(sum(h[0] for h in hits) / len(hits), 6) and recall.recall_3 == round(sum(map(any, hits)) / len(hits), 6)
    v = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id id", "embedding")
    asked = v.where("id % 20 = 0").selectExpr("id query_id", "embedding vector")
    assert {(r.query_id, r.id, r["rank"]) for r in vectors.search(v, asked, block=3).collect()} == want


def test_vector_search_odd_rows(spark):
    rows = [(0, [1.0, 0.0], "a"), (1, [0.0, 2.0], "a"), (2, None, "a"), (3, [0.0, 0.0], "a"), (4, [1.0], "a"), (5, [1.0, 1.0], "b"), (6, [2.0, 2.0], None)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>, kind string")
    asked = spark.createDataFrame([(0, [1.0, 0.0], "b"), (9, [1.0, 0.0], None), (3, [0.0, 0.0], None), (8, None, None)], "query_id long, vector array<float>, kind string")
    got = sorted((r.query_id, r["rank"], r.id) for r in vectors.search(v, asked, 3, within="kind").collect())
    assert got == [(0, 1, 5), (9, 1, 0), (9, 2, 5), (9, 3, 6)]
    assert vectors.search(v, asked.limit(0)).count() == 0 and vectors.search(v.limit(0), asked).count() == 0
    left, gone = vectors.delete(v, spark.createDataFrame([(0,), (77,), (0,)], "id long"), F.col("kind") == "b")
    assert sorted(r.id for r in left.collect()) == [1, 2, 3, 4, 6] and gone.first().n == 2


def test_jaccard_of_sets(spark):
    rng = random.Random(3)
    sets = {k: {rng.randrange(12) for _ in range(rng.randrange(1, 7))} for k in range(60)}
    frame = spark.createDataFrame([(k, x) for k, s in sets.items() for x in s for _ in range(2)] + [(None, 1), (99, None)], "id int, item int")
    reps = {}
    for k, s in sorted(sets.items()):
        reps.setdefault(frozenset(s), k)
    assert {r.id: r.rep for r in clustering.set_classes(frame).collect()} == {k: reps[frozenset(s)] for k, s in sets.items()}
    chosen = sorted(reps.values())
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in chosen for b in chosen if a < b and len(sets[a] & sets[b]) > 0.4 * len(sets[a] | sets[b])}
    assert {(r.a, r.b): round(r.overlap, 6) for r in clustering.jaccard(frame, 0.4).collect()} == want


def test_registered_impacts_take_all_modules(spark):
    from tesserae import catalog
    from tesserae.graph import graph_from_tables

    g = graph_from_tables(spark, "/root/testdata/sf0.001")
    changed = g.labelled("ModuleEntity").select("id", F.lit("BODY").alias("change"))
    want = impact.impact(g.edges, changed).count()
    assert sum(r.n for r in catalog.QUERIES["gr_09_impact_all_changes"](spark, "/root/testdata/sf0.001").where("change = 'BODY'").collect()) == want


def test_eviction_starts_late_and_clears_some_at_once(spark):
    traces = spark.createDataFrame([(f"t{k}", float(k)) for k in range(10)], "trace_id string, at double")
    drop = lambda *a: {r.trace_id: r.reason for r in tables.evicted(traces, 10.0, *a).collect()}
    assert drop(7.0, 12, 0.9) == {} and drop(7.0, 11, 0.9) == {"t0": "expired", "t1": "expired", "t2": "expired"}
    assert drop(7.0, 5, 0.9, 2) == {"t0": "expired", "t1": "expired", "t2": "excess", "t3": "excess"}
    assert drop(20.0, 9, 0.9, 100) == {"t0": "excess"}


def test_stored_graph_sees_changed_tables(spark, tmp_path):
    import shutil

    from tesserae.graph import TABLES, stored_graph, table

    for t in TABLES:
        shutil.copyfile(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    before = stored_graph(spark, str(tmp_path)).labelled("RepositoryEntity").count()
    table(spark, str(tmp_path), "region").limit(2).toPandas().to_parquet(tmp_path / "region.parquet")
    assert before == 5 and stored_graph(spark, str(tmp_path)).labelled("RepositoryEntity").count() == 2


@pytest.mark.parametrize("direction", ["out", "in", "both"])
@pytest.mark.parametrize("some", [False, True])
def test_distances_are_those_of_paths(spark, direction, some):
    """Chains, a diamond and graphs with cycles, from all nodes or from a few."""
    rng = random.Random(9)
    rows = {(f"c{k}", f"c{k + 1}", "calls") for k in range(6)} | {("d0", x, "calls") for x in ("d1", "d2")} | {(x, "d3", kind) for x in ("d1", "d2") for kind in ("calls", "imports")} | {(f"r{rng.randrange(6)}", f"r{rng.randrange(6)}", "calls") for _ in range(8)} | {("e", "r0", "calls"), ("f", "f", "calls")}
    e = spark.createDataFrame([(*r, 1.0) for r in sorted(rows)], EDGE)
    names = sorted({x for a, b, _ in rows for x in (a, b)})
    starts = spark.createDataFrame([(x,) for x in (["e", "d0", "c2", "nowhere"] if some else names)], "id string")
    got = {tuple(r) for r in patterns.distances(e, starts, 4, direction).select("start", "node", "hops").collect()}
    assert got == {tuple(r) for r in patterns.paths(e, starts, 1, 4, direction).select("start", "node", "hops").collect()}
