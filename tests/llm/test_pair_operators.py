"""SimHash components, substring cuts, neighbours and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tesserae.llm import ann, queries, simhash, substring
from tesserae.llm.common import connected_components

from .conftest import SF


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_fingerprint(text: str | None) -> int:
    words = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps: dict[int, int]) -> dict[int, int]:
    ids, f = list(fps), np.array(list(fps.values()), np.uint64)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[k]) <= 4):
            a, b = sorted((root(i), root(ids[j])))
            up[b] = a
    return {i: root(i) for i in ids}


def test_simhash_on_texts(spark, docs, sample):
    texts = [(int(d), t) for d, t in zip(sample.doc_id, sample.text, strict=True)] + [(10_000 + k, t) for k, t in enumerate([None, "", " ", "One two", "one TWO", "É é", "w " * 3000])]
    rows = {r.doc_id: r for r in simhash.components(docs(texts)).collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts}
    assert {i: int(r.fingerprint, 16) for i, r in rows.items()} == fps
    assert {i: r.component_id for i, r in rows.items()} == plain_components(fps)


@pytest.mark.parametrize("seed", [1, 2])
def test_simhash_links_between_many_near_fingerprints(spark, seed, monkeypatch):
    """Chains and clusters of fingerprints that differ in 0 to 6 bits, in small blocks."""
    monkeypatch.setattr(simhash, "BLOCK", 64)
    rng = np.random.default_rng(seed)
    fps = []
    for _ in range(40):
        at = int(rng.integers(0, 1 << 63))
        for _ in range(25):
            for b in rng.choice(64, int(rng.integers(0, 7)), replace=False):
                at ^= 1 << int(b)
            fps.append(at)
    centre = int(rng.integers(0, 1 << 63))
    fps += [centre ^ sum(1 << int(b) for b in rng.choice(16, 5, replace=False)) for _ in range(300)]
    fps += [int(x) for x in rng.integers(0, 1 << 63, 300)]
    fps = sorted(set(fps))
    reps = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, k) for k, x in enumerate(fps)], "fp long, rep long")
    got = {r.rep: r.component for r in simhash._distinct_components(reps).collect()}
    want = plain_components(dict(enumerate(fps)))
    assert {k: got.get(k, k) for k in want} == want


@pytest.mark.parametrize("distinct, many", [(1, 18), (10**8, 45), (10**11, 126)])
def test_every_pair_within_four_bits_shares_a_key(distinct, many):
    rng, keys = np.random.default_rng(3), simhash.keys(distinct)
    assert len(keys) == many
    for _ in range(2000):
        diff = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(diff & mask & (1 << 64) - 1 == 0 and all((diff & m & (1 << 64) - 1).bit_count() <= most for m, most in simhash.CHAINS[start]) for start, mask in keys)


def test_simhash_odd_rows(spark, docs):
    rows = simhash.components(docs([(5, "a b c"), (5, "quite other words here now"), (None, "a b c"), (7, "a b c"), (3, "quite other words here now"), (7, "a b c")])).collect()
    assert len(rows) == 6 and {r.component_id for r in rows} == {3, None}
    assert simhash.components(docs(["a"]).limit(0)).count() == 0
    kept = simhash.deduplicated(docs([(2, "a b c"), (1, "a b c"), (1, "a b c"), (None, "z")]))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"]
    kept = simhash.deduplicated(docs([(1, "quite other words"), (1, "a b c"), (1, "b"), (2, "a b c")]))
    assert [(r.doc_id, r.text) for r in kept.collect()] == [(1, "a b c")]


def test_components(spark):
    path = [(k, k + 1) for k in range(200)]
    star = [(1000, k) for k in range(1001, 1500)]
    edges = spark.createDataFrame([*path, *star, (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {k: 0 for k in range(201)} | {k: 1000 for k in range(1000, 1500)}


def plain_removed(texts: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str]]:
    first: dict[tuple, int] = {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        w = words_of(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    out = {}
    for i, t in texts:
        w = words_of(t)
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def repeated_texts(seed: int) -> list[tuple[int, str | None]]:
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 4000, n)]
    passages = [word(int(rng.integers(49, 90))) for _ in range(8)]
    out: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, "a " * 49), (3, "a " * 50), (4, "a " * 180), (5, "b " + "a " * 60)]
    for i in range(6, 90):
        parts = []
        for _ in range(int(rng.integers(1, 4))):
            parts += word(int(rng.integers(0, 60))) + passages[int(rng.integers(0, 8))][: int(rng.integers(45, 95))]
        out.append((i, "\n".join(parts)))
    return out


@pytest.mark.parametrize("seed", [1, 3])
def test_substring(spark, docs, seed):
    texts = repeated_texts(seed)
    rows = substring.removed(docs(texts)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == plain_removed(texts)
    cut = {r.doc_id: r.text for r in substring.cut(docs(texts)).collect()}
    for i, (n, gone, digest) in plain_removed(texts).items():
        assert gone == 0 and cut[i] == dict(texts)[i] or hashlib.sha256(cut[i].encode()).hexdigest() == digest


def test_substring_on_the_table(spark):
    from tesserae.llm.common import table

    texts = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    rows = queries.op8_substring(spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == plain_removed(texts)


def test_substring_in_texts_that_repeat_themselves(spark, docs):
    line = " ".join(f"l{k}" for k in range(17))
    page = " ".join(f"p{k}" for k in range(60))
    texts = list(enumerate(["x " * 400, f"start {'x ' * 300} end", "a b c " * 90, f"{page} {'a b c ' * 50} {page}", f"{line} " * 40, f"own words {line} {line} {line} {line} {line} tail", f"{page} new {page} {'x ' * 60}", "x " * 49, "y " * 200]))
    rows = substring.removed(docs(texts)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == plain_removed(texts)


def test_substring_odd_rows(spark, docs):
    long = " ".join(f"x{k}" for k in range(120))
    rows = substring.removed(docs([(9, long), (9, long), (4, long), (None, long), (None, None)])).collect()
    assert Counter((r.doc_id, r.n_removed) for r in rows) == Counter({(9, 120): 2, (4, 0): 1, (None, 0): 2})
    assert substring.removed(docs(["a"]).limit(0)).count() == 0


def test_a_cover_position_serves_every_alignment():
    for p in range(31):
        for q in range(31):
            assert any((p + s) % 31 in substring.COVER and (q + s) % 31 in substring.COVER for s in range(31))


def plain_neighbours(keys: list[int], vectors: np.ndarray, asked: list[int], k: int = 5) -> dict[int, list[tuple[int, float]]]:
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for q in asked:
        s = unit @ unit[keys.index(q)]
        out[q] = sorted(((keys[j], s[j]) for j in range(len(keys)) if keys[j] != q), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return out


def test_neighbours(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas()
    keys, vectors = table.vec_id.tolist(), np.stack(table.embedding).astype(float)
    want = plain_neighbours(keys, vectors, [k for k in keys if k % 50 == 0])
    got: dict[int, dict[int, tuple[int, float]]] = {}
    for r in queries.op9_ann(spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert got.keys() == want.keys() and all(sorted(v) == [1, 2, 3, 4, 5] for v in got.values())
    hits = np.mean([got[q][k + 1][0] == want[q][k][0] for q in want for k in range(5)])
    assert hits >= 0.95
    for q in want:
        for i, s in got[q].values():
            a, b = vectors[keys.index(q)], vectors[keys.index(i)]
            assert abs(s - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12


def test_neighbours_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [1.0, 1.0]), (6, [2.0, 2.0]), (6, [2.0, 2.0]), (7, [1.0]), (None, [1.0, 0.0])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, key string")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.search(frame, F.col("key") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 5), (0, 2, 6), (0, 3, 50), (50, 1, 5), (50, 2, 6), (50, 3, 0)]
    assert ann.search(frame.limit(0), F.col("key") % 50 == 0).count() == 0


def test_rotated_codes_bound_their_errors():
    rng = np.random.default_rng(5)
    v, q = rng.standard_normal((2_000, 64)), rng.standard_normal((200, 64))
    code, scale = ann.codes(v, ann.rotation(64))
    scan = ann.Scan(q, 5)
    got = scan.estimates(np.ascontiguousarray(code).view(np.uint64), scale, slice(0, 200))
    error = got - (v / np.linalg.norm(v, axis=1, keepdims=True)) @ (q / np.linalg.norm(q, axis=1, keepdims=True)).T
    bound = ann.bounds(scale, ann.width(64))[:, None]
    assert abs(error.mean()) < 1e-3 and (np.abs(error) <= bound).mean() > 0.88 and (np.abs(error) <= 2 * bound).mean() > 0.999


def test_neighbours_of_many_copies(spark, monkeypatch):
    """A third of all rows are one vector; blocks of queries and of held candidates are small."""
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((600, 12))
    vectors[rng.choice(600, 200, replace=False)] = vectors[0]
    vectors[5] *= 1e180
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    vectors[5] /= 1e180
    want = plain_neighbours(list(range(600)), vectors, list(range(0, 600, 20)))
    got: dict[int, list[int]] = {}
    for r in ann.search(frame, F.col("key") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert np.mean([got[q][k] == want[q][k][0] for q in want for k in range(5)]) > 0.9
    copies = [q for q in want if want[q][0][1] > 0.999999]
    assert copies and all(got[q] == [i for i, _ in want[q]] for q in copies)
