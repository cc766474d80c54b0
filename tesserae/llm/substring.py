"""Repeated passages: windows of 50 words that also start in a document with a smaller key are cut.

Anchors, hashes of 20 consecutive words, are taken only where the position modulo 31 is in a difference cover. For any
two positions some shift below 31 brings both into the cover, so two equal windows of 50 words share an aligned anchor.
Anchors of one text are dropped. Around the others the match is extended: each window of 50 words that contains one
is hashed (96 bits), and goes where the same window starts under a smaller key. Windows are judged on the input.

Shuffled are anchors and the windows around repeated ones, never pairs of documents; a text has one row for a window
however often it repeats it, so texts of a repeated line make no large groups. Windows are reduced to their smallest key,
within tasks before the shuffle, and joined back, a join whose hot keys Spark splits; so no group is ever held or sorted
by one task, at any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, word_bounds

WINDOW = 50
PERIOD = 31
#: A perfect difference set modulo 31: each non-zero difference occurs exactly once.
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
IN_COVER = np.zeros(PERIOD, bool)
IN_COVER[list(COVER)] = True


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _tag(text: str) -> int:
    """Tells rows apart that share a key."""
    return xxhash.xxh32_intdigest(text.encode()) >> 1


def _anchors(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The places of a text's anchors, and 48-bit hashes of them."""
    joined, starts, ends = word_bounds(words)
    digest = xxhash.xxh3_64_intdigest
    at = np.flatnonzero(IN_COVER[np.arange(len(words) - ANCHOR + 1) % PERIOD])
    found = [digest(joined[s:e]) for s, e in zip(starts[at].tolist(), ends[at + ANCHOR - 1].tolist(), strict=True)]
    return at, (np.array(found, np.uint64) >> np.uint64(16)).astype(np.int64)


def _once(values: np.ndarray, at: np.ndarray, **kw: int) -> tuple[np.ndarray, np.ndarray]:
    """Each value once with its first place, whose bits are inverted if there are others."""
    some, first, times = np.unique(values, return_index=True, return_counts=True, **kw)
    return some, np.where(times > 1, ~at[first], at[first])


def anchors(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(anchor, key, pos): the anchors of all texts that hold a window; equal hashes are only candidates.

    An anchor that a text repeats is one row, with the inverted bits of its first place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(k, 500) for k in range(0, whole.num_rows, 500)):
                found, keys, places = [], [], []
                for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    words = _words(x)
                    if len(words) < WINDOW or d is None:
                        continue
                    at, hashes = _anchors(words)
                    hashes, at = _once(hashes, at)
                    found.append(hashes)
                    keys.append(np.full(len(at), d, np.int64))
                    places.append(at.astype(np.int32))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(places))], ["anchor", "key", "pos"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text)).mapInArrow(run, "anchor long, key long, pos int")


def _everywhere(words: list[bytes], pos: np.ndarray) -> np.ndarray:
    """Places with all those of the anchors that the text repeats."""
    again = pos < 0
    if not again.any():
        return pos
    at, hashes = _anchors(words)
    return np.concatenate((pos[~again], at[np.isin(hashes, hashes[np.searchsorted(at, ~pos[again])])]))


def _digests(words: list[bytes], at: np.ndarray) -> np.ndarray:
    """Three 32-bit numbers for each window of 50 words that starts there."""
    joined, starts, ends = word_bounds(words)
    digest = xxhash.xxh3_128_digest
    found = b"".join([digest(joined[s:e]) for s, e in zip(starts[at].tolist(), ends[at + WINDOW - 1].tolist(), strict=True)])
    return np.frombuffer(found, "<i4").reshape(-1, 4)[:, :3]


def _windows(marked: DataFrame) -> DataFrame:
    """(h1, h2, key, tag, pos): windows of 50 words around repeated anchors; marked: (key, text, pos).

    A window that a text repeats is one row, with the inverted bits of its first place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(k, 200) for k in range(0, whole.num_rows, 200)):
                cols: list[list[np.ndarray]] = [[] for _ in range(5)]
                for d, x, pos in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    words = _words(x)
                    size = len(words) - WINDOW + 1
                    if size < 1:
                        continue
                    pos = _everywhere(words, np.array(pos))
                    # Starts of the windows that contain an anchor at one of these positions.
                    edge = np.zeros(size + 1, np.int64)
                    first = np.clip(pos - (WINDOW - ANCHOR), 0, size)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, np.maximum(np.clip(pos + 1, 0, size), first), -1)
                    at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                    if not len(at):
                        continue
                    got = _digests(words, at)
                    h1, h2 = np.ascontiguousarray(got[:, :2]).view("<i8")[:, 0], got[:, 2]
                    if len(np.unique(h1)) < len(h1):
                        some, at = _once(np.stack((h1, h2.astype(np.int64)), axis=1), at, axis=0)
                        h1, h2 = some[:, 0], some[:, 1].astype(np.int32)
                    for c, v in zip(cols, (h1, h2, np.full(len(at), d, np.int64), np.full(len(at), _tag(x), np.int32), at.astype(np.int32)), strict=True):
                        c.append(v)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["h1", "h2", "key", "tag", "pos"])

    return marked.mapInArrow(run, "h1 long, h2 int, key long, tag int, pos int")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, cuts): for each key with any, the (tag, pos) of windows that also start under a smaller key, pos as in _windows()."""
    found = anchors(docs, key, text)
    again = found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    marks = materialise(found.join(again, "anchor").groupBy("key").agg(F.collect_list("pos").alias("pos")))
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where(F.col(key).isNotNull())
    around = _windows(texts.join(marks, "key").select("key", "text", "pos"))
    first = around.groupBy("h1", "h2").agg(F.min("key").alias("first"))
    least = around.join(first, ["h1", "h2"]).where("key > first").select("key", "tag", "pos")
    return least.groupBy("key").agg(F.collect_list(F.struct("tag", "pos")).alias("cuts"))


def _kept(text: str | None, cuts: list[dict] | None) -> tuple[list[bytes], np.ndarray]:
    words = _words(text)
    gone = np.zeros(len(words), bool)
    if cuts:
        tag = _tag(text or "")
        at = np.array([c["pos"] for c in cuts if c["tag"] == tag], np.int64)
        if (at < 0).any():
            every = [x.tobytes() for x in _digests(words, np.arange(len(words) - WINDOW + 1))]
            again = {every[~p] for p in at[at < 0].tolist()}
            at = np.concatenate((at[at >= 0], np.flatnonzero([x in again for x in every])))
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WINDOW, -1)
        gone = np.cumsum(edge[:-1]) > 0
    return words, gone


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) for every row of docs; keys are integers.

    A null or empty text has no words. A row with a null key loses nothing and makes no other row lose anything. Rows
    that share a key do not affect each other. A text of under 50 words has no window. An empty table gives an empty
    table; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    # The texts are dealt by key as for the windows, so Spark shuffles them once; rows without a key need no join.
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where(F.col(key).isNotNull())
    joined = texts.join(repeats(docs, key, text), "key", "left").select(F.col("key").cast(kind).alias(key), F.col("text").alias(text), F.col("cuts").alias("_cuts"))
    joined = joined.unionByName(docs.where(F.col(key).isNull()).select(key, text, F.lit(None).cast(joined.schema["_cuts"].dataType).alias("_cuts")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(k, 500) for k in range(0, whole.num_rows, 500)):
                n, m, h = [], [], []
                for x, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    words, gone = _kept(x, c)
                    n.append(len(words))
                    m.append(int(gone.sum()))
                    h.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if m[-1] else words)).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(h, pa.string())], [key, "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(run, f"{key} {kind}, n_words long, n_removed long, kept_sha256 string")


def cut(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated passages cut out of text: where any is cut, the kept words are joined by one space.

    Odd rows are treated as in removed(); other columns of any name come through unchanged.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.struct("*").alias("row"))
    joined = rows.join(repeats(docs, key, text), "key", "left").select("row", "text", "cuts")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(k, 500) for k in range(0, whole.num_rows, 500)):
                out = []
                for x, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    words, gone = _kept(x, c)
                    out.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode() if gone.any() else x)
                row = pa.RecordBatch.from_struct_array(b.column(0))
                yield row.set_column(at, row.schema.field(at), pa.array(out, row.schema.field(at).type))

    return joined.mapInArrow(run, docs.schema)
