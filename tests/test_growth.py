"""What operators shuffle and keep as their input grows: few rows, not one per pair of rows that meet."""

from __future__ import annotations

import random

import pytest

from tesserae.operators import clustering, linking, patterns


@pytest.fixture
def shuffled(spark):
    """Runs an action and gives its result, the rows that its stages wrote to shuffles, the most that one stage wrote, and the most memory that a stage's tasks took together."""

    def run(action):
        jvm = spark.sparkContext._jvm
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = lambda: {(x.stageId(), x.attemptId()): (x.shuffleWriteRecords(), x.peakExecutionMemory()) for x in jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList()))}
        before = stages()
        result = action()
        new = [n for k, n in stages().items() if k not in before]
        return result, sum(n for n, _ in new), max(n for n, _ in new), max(m for _, m in new)

    return run


@pytest.mark.parametrize("both", [False, True])
def test_sets_that_share_little_are_not_shuffled_as_pairs(spark, shuffled, both):
    """F1, F2: random sets of 20 of 200 items nearly all share an item, and hardly any overlap by more than 0.5."""
    rng = random.Random(5)
    sets = {k: frozenset(rng.sample(range(200), 20)) for k in range(400)}
    sets[400] = sets[7] - {min(sets[7])}
    frame = spark.createDataFrame([(k, x) for k, s in sets.items() for x in s], "id long, item long")
    got, _, most, _ = shuffled(lambda: (clustering.overlaps(frame, frame, 0.5) if both else clustering.jaccard(frame, 0.5)).collect())
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if (both or a < b)}
    assert {(r.a, r.b): r.overlap for r in got} == {k: v for k, v in want.items() if v > 0.5}
    # A row per set and item, not one of the 80,000 pairs.
    assert most < 12_000


def test_documents_meet_only_the_first_entities_of_a_path(spark, shuffled):
    """100 documents name one file of 500 entities, ten of which share an order and some of which are named in code too."""
    index = spark.createDataFrame([(f"e{k:03}", "src/a.py", f"name_{k % 400}", k // 10) for k in range(500)] * 2, "id string, file_path string, name string, ord int")
    docs = spark.createDataFrame([(k, f"see src/a.py now\n```python\nname_{k} name_450\n```" if k % 2 else "in a.py") for k in range(100)], "doc_id int, text string")
    got, _, most, _ = shuffled(lambda: linking.document_links(docs, index, 7).collect())
    assert {(r.doc_id, r["id"], r.rule, r["rank"]) for r in got} == {(d, f"e{k:03}", 1 if d % 2 else 2, k + 1) for d in range(100) for k in range(7)} and len(got) == 700
    # Not 50,000: a row per document and entity of the file.
    assert most < 5_000


def test_a_task_holds_the_join_of_one_level_alone(spark, shuffled):
    """each calls the one of a third of its number, whose distances are those of a walk; number 0 is no start."""
    edges = spark.createDataFrame([(f"{k}", f"{k // 3}", "calls", 1.0) for k in range(1, 300)], "src string, dst string, rel_type string, weight double")
    starts = spark.createDataFrame([(f"{k}",) for k in range(1, 300)], "id string")
    got, _, _, memory = shuffled(lambda: patterns.distances(edges, starts, 10, "in").collect())
    want, up = set(), lambda k: k // 3
    for k in range(1, 300):
        at, hops = up(k), 1
        while at > 0:
            want.add((str(at), str(k), hops))
            at, hops = up(at), hops + 1
    assert {(r.start, r.node, r.hops) for r in got} == want and len(got) == len(want)
    # 136 MB where one stage joins all ten levels, 84 MB where each has its own.
    assert memory < 110_000_000


def test_stored_nodes_are_neither_shuffled_nor_stored_with_edges(spark, shuffled, tmp_path):
    """Edges are only shuffled to be made distinct, nodes not at all."""
    import shutil

    from tesserae.graph import TABLES, graph_from_tables, stored_graph

    for t in TABLES:
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", tmp_path)
    made, g = graph_from_tables(spark, str(tmp_path)), stored_graph(spark, str(tmp_path))
    rows = lambda df: sorted(map(str, df.collect()))
    got, nodes, _, _ = shuffled(lambda: rows(g.nodes))
    assert nodes == 0 and got == rows(made.nodes)
    lines = spark.read.parquet(f"{tmp_path}/lineitem.parquet").count()
    got, edges, _, _ = shuffled(lambda: rows(g.edges))
    assert edges <= 2 * lines and got == rows(made.edges)


@pytest.mark.parametrize("name", ["prs_02_python_entities", "prs_05_python_decorators", "prs_10_external_calls", "join_20_alternatives"])
def test_long_work_on_few_bytes_is_spread(spark, name):
    """as many tasks as the session shuffles to, however small the table's file is."""
    from tesserae import catalog

    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_search_holds_few_vectors_at_once():
    """neither the products of a shard nor the vectors of all beams are held together, however many queries and rows there are."""
    import tracemalloc

    import numpy as np

    from tesserae.operators import neighbour_graph

    def most(action):
        tracemalloc.start()
        try:
            return action(), tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    rng = np.random.default_rng(4)
    x = neighbour_graph.unit(rng.standard_normal((20_000, 16))).astype(np.float32)
    near, built = most(lambda: neighbour_graph.nearest(x, 64))
    s = x[:50] @ x.T
    s[np.arange(50), np.arange(50)] = -9
    assert (np.sort(-s, axis=1)[:, :64] == -np.take_along_axis(s, near[:50], 1)).all()
    # 92 MB where 256 rows' products are held twice, and their order.
    assert built < 60
    v = x[:1_500].astype(np.float64)
    graph = neighbour_graph.layers(x[:1_500])
    listed = neighbour_graph._layered(neighbour_graph.pa.chunked_array([neighbour_graph._listed(graph, 1_500)]))
    assert len(listed) == len(graph) and all((a == c).all() and [r[r >= 0].tolist() for r in b] == [r[r >= 0].tolist() for r in d] for (a, b), (c, d) in zip(graph, listed, strict=True))
    used = {n: most(lambda n=n: neighbour_graph.answered(v, x[:1_500], listed, v[np.arange(n) % 1_500], 3, 128)) for n in (1_000, 4_000)}
    row, p, distance, _ = used[1_000][0]
    assert (row == np.repeat(np.arange(1_000), 3)).all() and (p[::3] == np.arange(1_000)).all() and np.abs(distance - (1 - np.einsum("ij,ij->i", v[p] / np.linalg.norm(v[p], axis=1)[:, None], v[row] / np.linalg.norm(v[row], axis=1)[:, None]))).max() < 1e-12
    # Vectors of all beams of 4,000 queries would be 65 MB on each side.
    assert used[4_000][1] < used[1_000][1] + 10


def test_impact_shuffles_only_steps_from_nodes_that_it_has_reached(spark, shuffled):
    """40 parts of 10 services and 20 of their orders, beside 4,000 calls that none of them is near; kinds of change go together and give what each gives alone."""
    from pyspark.sql import functions as F

    from tesserae.operators import impact

    schema = "src string, dst string, rel_type string, weight double"
    near = [(f"p:{k}", f"s:{k % 10}", "implements", 1.0) for k in range(40)] + [(f"o:{k}", f"p:{k * j % 40}", "imports", 1.0) for k in range(20) for j in (1, 3)] + [("s:1", "p:1", "calls", 1.0), ("s:2", "s:3", "extends", 1.0)]
    far = [(f"x:{k}", f"y:{k % 90}", "calls", 1.0) for k in range(4_000)]
    edges = spark.createDataFrame(sorted({*near, *far}), schema)
    changed = spark.createDataFrame([(f"s:{k}", "BODY") for k in range(10)] + [(f"s:{k}", c) for k in range(5) for c in ("DELETED", "DOC_ONLY", "unknown", None)] + [(None, "BODY")], "id string, change string")
    rows = lambda df: sorted(map(str, df.collect()))
    # Tables of this size would be broadcast, not shuffled.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, records, _, _ = shuffled(lambda: rows(impact.impact(edges, changed)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    alone = [rows(impact.impact(spark.createDataFrame(sorted(set(near)), schema), changed.where(F.col("change") == c))) for c in ("BODY", "DELETED", "DOC_ONLY")]
    assert got == sorted(x for r in alone for x in r) and all(alone)
    # 8,000 steps a level, each met with its end's number before, where all go.
    assert records < 3_000


def test_short_names_in_texts_shuffle_nothing(spark, shuffled):
    """200 texts and names of up to three characters, one of them outside the basic plane; longer ones are still confirmed by the text."""
    rng = random.Random(8)
    texts = {k: "".join(rng.choice("abcdefgh \U0001f600") for _ in range(60)) for k in range(200)} | {900: "", 901: None, 902: "abxbc cd"}
    names = {(k, rng.choice(["", "a", "\U0001f600", "\U0001f600a", "ab ", "cd", "?", "abc"])) for k in range(30)}
    frame = spark.createDataFrame([*texts.items(), (None, "a")], "text_id long, text string")
    want = lambda some: sorted((t, n) for t, x in texts.items() for n, y in some if x and y and y in x)
    found = lambda some: sorted((r.text_id, r.needle_id) for r in linking.contained(frame, spark.createDataFrame([*some, *some, (99, None)], "needle_id long, needle string").coalesce(1)).collect())
    got, records, _, _ = shuffled(lambda: found(sorted(names)))
    assert got == want(names) and len(got) > 500
    # Some thousand where texts' characters are dealt by character, then met with their texts.
    assert records < 300
    more = names | {(k % 60, texts[k][k % 20 : k % 20 + 4 + k % 3]) for k in range(80)} | {(70, "abcd"), (71, "abbccd"), (72, "bxbc")}
    assert found(sorted(more)) == want(more)


def test_overlaps_run_the_plans_of_their_sides_once(spark):
    """what the sides are made of may be long, as the code around names is."""
    from tesserae.operators import vectors

    runs = spark.sparkContext.accumulator(0)

    def seen(tables):
        for t in tables:
            runs.add(len(t))
            yield t

    sets = {k: {k, k + 1, k + 2, k % 7 + 100} for k in range(0, 60, 2)}
    rows = [(k, x) for k, s in sets.items() for x in s]
    frame = lambda: spark.createDataFrame(rows, "id long, item long").mapInPandas(seen, "id long, item long")
    got = {(r.a, r.b) for r in clustering.overlaps(frame(), frame(), 0.8).collect()}
    assert got == {(k, k) for k in sets} and runs.value == 2 * len(rows)
    runs.value = 0
    nodes = spark.createDataFrame([(f"c{k}", "CodeEntity", f"c{k}") for k in range(6)], "id string, label string, name string")
    edges = spark.createDataFrame([(f"c{k}", f"c{k + 1}", "calls", 1.0) for k in range(5)], "src string, dst string, rel_type string, weight double")
    around = vectors.code_around(vectors.Graph(nodes, edges.mapInPandas(seen, edges.schema)), nodes.where("id in ('c0', 'c3')").select("name"))
    assert {(r.name, r.id) for r in around.collect()} == {("c0", "c1"), ("c0", "c2"), ("c3", "c1"), ("c3", "c2"), ("c3", "c4"), ("c3", "c5")}
    # Once for the steps, once for loops.
    assert runs.value == 2 * 5
