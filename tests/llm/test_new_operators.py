"""Alignment, hard negatives and language identification against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tesserae.llm import hard_negatives, hyper_language, queries, token_alignment
from tesserae.shared import materialised

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


class Plain:
    """Both tokenizers on whole texts."""

    def __init__(self):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(A_FILE)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=B_FILE)
        self.entry, self.byte = {i: t for t, i in self.a.get_vocab().items()}, token_alignment.byte_of()

    def tokens(self, text: str) -> tuple[list[int], list[int], list[bytes], list[bytes]]:
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        parts = [self.b.id_to_piece(i) for i in b]
        return a, b, [bytes(self.byte[c] for c in self.entry[i]) for i in a], [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, parts, strict=True)]

    def document(self, text: str | None) -> tuple | None:
        """Token counts, groups and links, or None if there are no tokens."""
        if not text:
            return None
        a, b, x, y = self.tokens(text)
        if not b"".join(x) == (" " + text).encode() == b"".join(y):
            return None
        ia, ib = ([(s, s + len(p)) for s, p in zip(np.cumsum([0, *map(len, z[:-1])]).tolist(), z, strict=True)] for z in (x, y))
        links, j0 = [], 0
        for k, (s, e) in enumerate(ia):
            while ib[j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(ib) and ib[j][0] < e:
                links.append((a[k], b[j]))
                j += 1
        groups, k, j = [], 0, 0
        for end in sorted({e for _, e in ia} & {e for _, e in ib}):
            u, v = k, j
            while k < len(ia) and ia[k][1] <= end:
                k += 1
            while j < len(ib) and ib[j][1] <= end:
                j += 1
            groups.append(",".join(map(str, a[u:k])) + "|" + ",".join(map(str, b[v:j])))
        return len(a), len(b), groups, links

    def rows(self, texts: list[tuple[int, str | None]]) -> Counter:
        found = [(i, self.document(t)) for i, t in texts]
        count = Counter(x for _, d in found if d for x in d[3])
        top: Counter = Counter()
        for (_, b), n in count.items():
            top[b] = max(top[b], n)
        return Counter(
            (i, 0, 0, 0, 0, 0, 0, "") if d is None else (i, d[0], d[1], len(d[2]), len(d[3]), sum(count[x] == top[x[1]] for x in d[3]), sum(count[x] for x in d[3]), hashlib.sha256(";".join(d[2]).encode()).hexdigest())
            for i, d in found
        )


@pytest.fixture(scope="session")
def plain():
    return Plain()


def test_alignment_on_the_table(spark, sample, plain):
    texts = list(zip(sample.doc_id.tolist(), sample.text, strict=True))
    assert Counter(map(tuple, queries.op11_alignment(spark, SF).collect())) == plain.rows(texts)


def test_alignment_odd_rows(spark, docs, plain, monkeypatch):
    texts = [None, "", " ", "  a", "a  b", "a \n b\n\nc\t d", "x▁y", "▁", "<|endoftext|> </s> <0x41>", "naïve Ünïcode 漢字 😀", "e" * 5_000, "it's ' s", "\x00\x1c z", "ab " * 3_000, "word word"]
    rows = [*enumerate(texts), (3, "  a"), (None, "again the word")]
    got = token_alignment.align(docs(rows), A_FILE, B_FILE)
    assert Counter(map(tuple, got.collect())) == plain.rows(rows)
    assert token_alignment.align(docs(["a"]).limit(0), A_FILE, B_FILE).count() == 0


def test_alignment_in_small_blocks(spark, docs, sample, plain, monkeypatch):
    """In one process, since a patch does not reach Spark's workers."""
    monkeypatch.setattr(token_alignment, "BLOCK", 900)
    by = token_alignment.Aligner(A_FILE, B_FILE)
    for begin in range(0, 40, 5):
        block = token_alignment.Block(by)
        part = sample.text.tolist()[begin : begin + 5]
        for k, t in enumerate(part):
            block.add(k, t)
        columns = block.columns()
        want = [plain.document(t) for t in part]
        assert columns[4] == [len(w[3]) if w else 0 for w in want]
        assert dict(zip(*[[*map(int, x)] for x in columns[-2:]], strict=True)) == Counter(a << 32 | b for w in want if w for a, b in w[3])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chunks_are_what_whole_texts_give(plain, seed):
    rng = random.Random(seed)
    letters = [*"ab .,'\n\t\r\x0b\x1c\xa0 　é漢か😀́​▁-1９ß", "<|endoftext|>", "  ", "\n\n", " the", "'s", "ing", " ", "</s>", "<0x41>"]
    by = token_alignment.Aligner(A_FILE, B_FILE)
    for _ in range(2_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 25)))
        found, want = by.chunks(text), plain.document(text)
        assert (want is not None) == all(by.n_groups[k] for k in found), repr(text)
        assert want is None or ";".join(by.groups[k] for k in found) == ";".join(want[2]), repr(text)


def plain_negatives(rows: list[tuple], scale: int = 256) -> Counter:
    usable = [(k, n, np.floor(np.array(v, float) * scale).astype(object)) for k, v, n in rows if None not in (k, n) and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    usable = [(k, n, np.array([int(x) for x in v], object)) for k, n, v in usable]
    out = []
    for a, n, v in usable:
        if a % 50:
            continue
        scored = sorted(((int(v @ w), k, m) for k, m, w in usable if k != a), key=lambda x: (-x[0], x[1]))
        for p, i, _ in [x for x in scored if x[2] == n][:5]:
            fits = [(s, k) for s, k, m in scored if m != n and 50 * p <= 100 * s <= 95 * p][:3]
            out += [(a, i, r + 1, k, p, s) for r, (s, k) in enumerate(fits)]
    return Counter(out)


def frame(spark, rows):
    return spark.createDataFrame([(k, v, n, "x", 1) for k, v, n in rows], "vec_id long, embedding array<double>, label int, key string, rank int").repartition(4)


def mined(spark, rows):
    return hard_negatives.mine(frame(spark, rows), F.col("key") % 50 == 0)


@pytest.mark.parametrize("kind", ["plain", "leading", "copies", "one label", "large"])
def test_negatives(spark, kind, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 5)
    rng = np.random.default_rng(4)
    v = rng.standard_normal((900, 24)) + 0.4
    if kind == "leading":
        v = (rng.standard_normal((900, 5)) * [9, 5, 2, 1, 1]) @ rng.standard_normal((5, 24)) + 0.01 * v
    if kind == "copies":
        v[rng.choice(900, 300, replace=False)] = v[0]
    if kind == "large":
        v *= 1e5
    labels = rng.integers(0, 4, 900) if kind != "one label" else np.where(np.arange(900) % 9 == 0, 2, 1)
    rows = [(k, x.tolist(), int(n)) for k, (x, n) in enumerate(zip(v, labels, strict=True))]
    want = plain_negatives(rows)
    assert len(want) > 100 and Counter(map(tuple, mined(spark, rows).collect())) == want


def test_negatives_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (2, [0.7, 0.1], 2), (3, [0.7, 0.1], 2), (4, [0.6, nan], 2), (5, [0.6, None], 2), (6, None, 2), (7, [0.6, 0.0], None), (8, [0.8, 0.0], 3), (None, [0.7, 0.0], 2), (50, [0.0, 0.0], 7), (51, [0.0, 0.0], 7), (100, [-1.0, 0.0], 9), (101, [1.0, 0.0], 9)]
    assert Counter(map(tuple, mined(spark, rows).collect())) == plain_negatives(rows)
    odd = [*rows, (2, [0.7, 0.1], 2), (9, [0.7], 2), (10, [], 2), (11, [1e300, 0.7], 2)]
    assert Counter(map(tuple, mined(spark, odd).collect())) == plain_negatives(rows)
    assert mined(spark, rows).schema == hard_negatives.mine(frame(spark, rows).limit(0), F.col("key") % 50 == 0).schema
    assert hard_negatives.mine(frame(spark, rows).limit(0), F.col("key") % 50 == 0).count() == 0


def test_few_pairs_are_verified():
    """Where few components hold most of the vectors, most pairs go early; the lists are those of all pairs."""
    rng = np.random.default_rng(6)
    v = np.floor(256 * (rng.standard_normal((6_000, 8)) @ rng.standard_normal((8, 64)) / 8 + 0.02 * rng.standard_normal((6_000, 64)))).astype(np.int64)
    axis, stages = hard_negatives.rotation(v[:500].astype(float))
    key, label = np.arange(6_000), np.zeros(6_000, np.int64)
    rows = hard_negatives.Rotated.of(key, label, v, axis, stages)
    anchors = rows.at(slice(0, 40))
    scan = hard_negatives.Scan(anchors, stages, hard_negatives.Lists(40, 5, np.full(40, hard_negatives.LEAST + 1), np.full(40, hard_negatives.MOST)), True)
    for k in range(0, 6_000, 1_000):
        scan.add(rows.at(slice(k, k + 1_000)), np.arange(40))
    score = v[:40] @ v.T
    score[np.arange(40), np.arange(40)] = hard_negatives.LEAST
    best = np.stack([np.lexsort((key, -s))[:5] for s in score]).T
    assert np.array_equal(scan.lists.key, best) and scan.verified < scan.pairs / 20


def plain_vector(text: str | None) -> np.ndarray:
    """The bundle of a text by the definition, n-gram after n-gram."""
    words, word = [], ""
    for c in (text or "") + " ":
        if c.isalpha():
            word += c.lower() if len(c.lower()) == 1 else c
        elif word:
            words.append(word)
            word = ""
    line = f" {' '.join(words)} " if words else ""
    out = np.zeros(hyper_language.PLACES)
    for k in range(len(line) - hyper_language.N + 1):
        bound = np.ones(hyper_language.PLACES)
        for j in range(hyper_language.N):
            bound *= np.roll(hyper_language.letter_vector(ord(line[k + j])), hyper_language.N - 1 - j)
        out += bound
    return out


def plain_languages(rows: list[tuple]) -> list[tuple]:
    out_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    by: dict[str, np.ndarray] = {}
    vectors = [plain_vector(t) for _, t, _ in rows]
    for (i, _, lang), v in zip(rows, vectors, strict=True):
        if i is not None and lang is not None and not out_of(i):
            by[lang] = by.get(lang, 0) + v
    by = {k: v for k, v in sorted(by.items()) if v.any()}
    out = []
    for (i, _, _), v in zip(rows, vectors, strict=True):
        cosines = [(v @ p / np.linalg.norm(v) / np.linalg.norm(p), k) for k, p in by.items()] if v.any() else []
        best = max(cosines, key=lambda x: x[0], default=(0.0, "und"))
        out.append((i, out_of(i), best[1], round(min(1.0, max(0.0, best[0])), 9)))
    return sorted(out, key=str)


def languages(df) -> list[tuple]:
    return sorted(((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in df.collect()), key=str)


def test_languages_against_the_definition(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.substring("text", 1, 400), "lang").limit(60).collect()]
    rows += [(1_000, None, "en"), (1_001, "", "en"), (1_002, "12 !?", "de"), (1_003, "a", None), (1_004, "漢字 İß ǅ 😀", "zh"), (1_005, "e" * 3_000, "en"), (None, "the words", "en"), (1_003, "a", None), (1_006, "x", "")]
    df = spark.createDataFrame([(*r, "s", 1.0) for r in rows], "doc_id long, text string, lang string, source string, score double").repartition(3)
    assert languages(hyper_language.predicted(df)) == plain_languages(rows)
    none = hyper_language.predicted(df.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}
    assert hyper_language.predicted(df.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op13_language(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/documents.parquet")[["doc_id", "lang"]], on="doc_id")
    held = got[got.held_out & got.lang.notna()]
    assert len(got) == 1_000 and len(held) > 200 and (held.lang_pred == held.lang).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_long_texts_are_summed_exactly():
    by = hyper_language.Profiles()
    g, n = hyper_language.grams("ab " * 10)
    many = by.bundles([(g, n * 10_000_000)])
    assert np.array_equal(many, by.bundles([(g, n)]) * 10_000_000)


def test_aligner_forgets_many_chunks_between_tasks(plain, monkeypatch):
    by = token_alignment.Aligner(A_FILE, B_FILE)
    monkeypatch.setattr(token_alignment, "KEPT", 3)
    for text, kept in (("one two", True), ("three four five six seven", False), ("one two", True)):
        found = by.chunks(text)
        assert ";".join(by.groups[k] for k in found) == ";".join(plain.document(text)[2])
        by.rest()
        assert bool(by.known) == kept and (kept or not len(by.links))


def test_aligner_memory_has_a_bound():
    """A block of words that are all new ends before the worker holds much."""
    block = token_alignment.Block(token_alignment.Aligner(A_FILE, B_FILE))
    rng = random.Random(5)
    tracemalloc.start()
    try:
        while not block.full():
            block.add(len(block.keys), " ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(2_000)))
        block.columns()
        assert tracemalloc.get_traced_memory()[1] < 130e6
    finally:
        tracemalloc.stop()


def test_alignment_hands_on_one_block_at_a_time(spark, docs):
    """Python gets a block as a group; a batch of a whole partition grows with the input."""
    plan = token_alignment.align(docs(["a word", "the word"]), A_FILE, B_FILE)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and " MapInArrow" not in plan


def test_rows_of_blocks_are_written_in_small_row_groups(spark):
    """Rows of 4 MB, fewer than the hundred that a writer waits for by default."""
    rows = spark.range(0, 12, 1, 1).selectExpr("id", "cast(array_join(transform(sequence(0, 65535), k -> sha2(concat(id, k), 256)), '') as binary) x")
    files = materialised(rows, **token_alignment.WRITTEN).inputFiles()
    found = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in files]
    assert sum(m.num_rows for m in found) == 12 and max(m.row_group(k).num_rows for m in found for k in range(m.num_row_groups)) <= 6
