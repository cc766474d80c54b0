"""Hard-negative mining by inner products of whole-number vectors, pruned in a rotated space.

An orthogonal rotation, the principal axes of second moments, keeps inner products and moves most of them into the leading
components. For a row and an anchor the products of the leading components are summed up; the norms of what is left of
both vectors, multiplied, bound the remainder, and a slack covers all rounding. A pair whose bounds cannot enter any list
that is still open is discarded after few components; the products of those that stay are computed in whole numbers, so
that results never depend on the rotation or on the order of rows.

Anchors are a stated query set. For each block of them all rows are scanned twice: for the nearest rows of the same label,
the positives, and then, inside the window of scores that each positive opens, for the first rows of other labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, new_path

#: Rows on which the rotation is fitted, those of the smallest hash of their key. It decides how early pairs go, not which are found.
FIT = 4_096
#: Anchors that are scanned for at once; the driver holds no more than one block of them and their positives.
ANCHOR_BLOCK = 4_096
#: Rows and anchors whose partial products a task holds at once, and pairs that are verified together.
ROWS, COLUMNS, PAIRS = 8_192, 256, 65_536
#: Shares of the second moments that may be left behind the leading components of a stage.
LEFT = (0.5, 0.25, 0.12, 0.03)
#: Products of all pairs go on to the next stage while more than this share of pairs stays; below it, pair by pair.
DENSE = 1 / 16
#: Best partial products that are verified first where an anchor has no list yet, times the list's length.
FIRST = 3
MOST = np.iinfo(np.int64).max
#: No score is as small; unlike the smallest long, it can be negated.
LEAST = -MOST
VECTORS = "key long, label long, same binary, whole binary"


def largest(d: int) -> int:
    """Whole-number components up to this size have inner products that fit a long."""
    return min(math.isqrt(MOST // d), 2**31 - 1)


def whole_numbers(vectors: DataFrame, d: int, key: str, label: str, column: str, scale: float) -> DataFrame:
    """(key, label, same, whole): floor(scale * x) of each component in 32 bits, and a digest that equal vectors of one label share."""
    most = largest(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k is None or n is None or x is None or len(x) != d or any(v is None for v in x):
                    continue
                v = np.floor(np.array(x, np.float64) * scale)
                if np.isfinite(v).all() and np.abs(v).max() <= most:
                    raw = v.astype("<i4").tobytes()
                    rows.append((k, n, xxhash.xxh3_128_digest(raw + n.to_bytes(8, "little", signed=True)), raw))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["key", "label", "same", "whole"])

    return vectors.select(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), F.col(column)).mapInArrow(run, VECTORS)


def rotation(sample: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Principal axes of second moments, largest first, and the numbers of leading components after which pairs are judged."""
    d = sample.shape[1]
    scaled = sample / max(1.0, np.abs(sample).max(initial=1.0))
    value, axis = np.linalg.eigh(scaled.T @ scaled)
    value, axis = np.maximum(value[::-1], 0), np.ascontiguousarray(axis[:, ::-1])
    if not np.allclose(axis.T @ axis, np.eye(d), rtol=0, atol=1e-12):
        raise RuntimeError("the rotation is not orthogonal")
    left = 1 - np.cumsum(value) / max(value.sum(), np.finfo(float).tiny)
    return axis, sorted({min(d, int(np.argmax(left <= x + 1e-12)) + 1) for x in LEFT} | {d})


@dataclass
class Rotated:
    """Vectors with their rotated components and, per stage, norms of what is left behind the leading ones."""

    key: np.ndarray
    label: np.ndarray
    whole: np.ndarray
    turned: np.ndarray
    rest: np.ndarray
    norm: np.ndarray

    @classmethod
    def of(cls, key: np.ndarray, label: np.ndarray, whole: np.ndarray, axis: np.ndarray, stages: list[int]) -> Rotated:
        turned = whole.astype(np.float64) @ axis
        square = np.concatenate((np.zeros((len(turned), 1)), np.cumsum((turned * turned)[:, ::-1], axis=1)), axis=1)[:, ::-1]
        # Rounded up, so that a bound stays one.
        rest = np.sqrt(square[:, stages]) * (1 + 1e-6)
        return cls(key, label, whole, turned.astype(np.float32), rest.astype(np.float32) * np.float32(1 + 1e-6), np.sqrt(square[:, 0]).astype(np.float32) * np.float32(1 + 1e-6))

    def at(self, which: np.ndarray | slice) -> Rotated:
        return Rotated(*(getattr(self, f)[which] for f in ("key", "label", "whole", "turned", "rest", "norm")))


class Lists:
    """The first `most` of each list by score, ties to the smaller key; a list takes scores from floor to top."""

    def __init__(self, n: int, most: int, floor: np.ndarray, top: np.ndarray):
        self.most, self.floor, self.top = most, floor, top
        self.score, self.key = np.full((most, n), LEAST), np.full((most, n), MOST)

    def need(self) -> np.ndarray:
        """The least score that can still enter each list."""
        return np.maximum(self.floor, self.score[-1])

    def add(self, of: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        fits = (score >= self.need()[of]) & (score <= self.top[of])
        of, score, key = of[fits], score[fits], key[fits]
        if not len(of):
            return
        order = np.lexsort((key, -score, of))
        of, score, key = of[order], score[order], key[order]
        each, begin = np.unique(of, return_index=True)
        nth = np.arange(len(of)) - np.repeat(begin, np.diff(np.append(begin, len(of))))
        keep = nth < self.most
        place = np.searchsorted(each, of[keep])
        scores, keys = np.full((2 * self.most, len(each)), LEAST), np.full((2 * self.most, len(each)), MOST)
        scores[: self.most], keys[: self.most] = self.score[:, each], self.key[:, each]
        scores[self.most + nth[keep], place], keys[self.most + nth[keep], place] = score[keep], key[keep]
        best = np.lexsort((keys, -scores), axis=0)[: self.most]
        self.score[:, each], self.key[:, each] = np.take_along_axis(scores, best, 0), np.take_along_axis(keys, best, 0)


class Scan:
    """Lists of anchors over the rows that are added. Anchor a's lists are those numbered a * width to a * width + width - 1."""

    def __init__(self, anchors: Rotated, stages: list[int], lists: Lists, same_label: bool):
        self.anchors, self.stages, self.lists, self.same = anchors, stages, lists, same_label
        self.width = lists.score.shape[1] // max(1, len(anchors.key))
        #: Relative rounding of products of 32 bits, of their sums and of the rotation.
        self.slack = np.float32((2 * stages[-1] + 32) * 2.0**-24)
        self.pairs = self.verified = 0

    def _open(self, low: np.ndarray, high: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Whether the bounds of pairs leave one of their anchor's lists possible."""
        need, top = (x.reshape(-1, self.width) for x in (self.lists.need(), self.lists.top))
        out = np.zeros(len(col), bool)
        for j in range(self.width):
            out |= (high >= need[col, j]) & (low <= top[col, j])
        return out

    def _verify(self, rows: Rotated, r: np.ndarray, c: np.ndarray) -> None:
        mine = (rows.label[r] == self.anchors.label[c]) == self.same
        if self.same:
            mine &= rows.key[r] != self.anchors.key[c]
        r, c = r[mine], c[mine]
        for k in range(0, len(r), PAIRS):
            a, b = r[k : k + PAIRS], c[k : k + PAIRS]
            score = (rows.whole[a].astype(np.int64) * self.anchors.whole[b].astype(np.int64)).sum(axis=1)
            self.verified += len(a)
            for j in range(self.width):
                self.lists.add(b * self.width + j, score, rows.key[a])

    def add(self, rows: Rotated, which: np.ndarray) -> None:
        """Judge rows for the anchors numbered which."""
        for k in range(0, len(which), COLUMNS):
            self._block(rows, which[k : k + COLUMNS])

    def _block(self, rows: Rotated, which: np.ndarray) -> None:
        anchors, begin, row = self.anchors.at(which), 0, None
        partial = np.zeros((len(rows.key), len(which)), np.float32)
        self.pairs += partial.size
        for s, end in enumerate(self.stages):
            if row is None:
                partial += rows.turned[:, begin:end] @ anchors.turned[:, begin:end].T
                if not s:
                    self._first(rows, which, partial)
                least = self.lists.need().reshape(-1, self.width)[which].min(axis=1).astype(np.float32)
                # The error is bounded by the slack; comparing in 32 bits rounds once more, which the slack covers too.
                over = np.outer(rows.rest[:, s], anchors.rest[:, s]) + np.outer(rows.norm * self.slack, anchors.norm)
                at, of = np.nonzero(partial + over >= least - np.abs(least) * np.float32(1e-6))
                if len(at) <= DENSE * partial.size or end == self.stages[-1]:
                    row, col, value = at, of, partial[at, of]
            else:
                value = value + np.einsum("ij,ij->i", rows.turned[row, begin:end], anchors.turned[col, begin:end])
            if row is not None:
                over = rows.rest[row, s].astype(np.float64) * anchors.rest[col, s] + rows.norm[row].astype(np.float64) * anchors.norm[col] * self.slack
                stays = self._open(value - over, value + over, which[col])
                row, col, value = row[stays], col[stays], value[stays]
            begin = end
        self._verify(rows, row, which[col])

    def _first(self, rows: Rotated, which: np.ndarray, partial: np.ndarray) -> None:
        """Verify the best partial products of anchors whose only list is not full, so that there is something to prune by."""
        if self.width == 1 and (self.lists.score[-1, which] == LEAST).any():
            many = min(len(partial), FIRST * self.lists.most)
            likely = np.argpartition(-partial, many - 1, axis=0)[:many]
            of = np.broadcast_to(np.arange(partial.shape[1]), likely.shape)
            self._verify(rows, likely.reshape(-1), which[of.reshape(-1)])
            # So that none of them is verified again.
            np.put_along_axis(partial, likely, -np.inf, 0)


def _batches(batches: Iterator[pa.RecordBatch], axis: np.ndarray, stages: list[int]) -> Iterator[Rotated]:
    for whole in batches:
        for b in (whole.slice(k, ROWS) for k in range(0, whole.num_rows, ROWS)):
            numbers = np.frombuffer(b"".join(b.column(2).to_pylist()), "<i4").reshape(b.num_rows, -1)
            yield Rotated.of(b.column(0).to_numpy(), b.column(1).to_numpy(), numbers, axis, stages)


def _scanned(table: DataFrame, found: str, make: object) -> DataFrame:
    """Rows (as found says) that make, a function of a task's rotated batches, gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = make(batches)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], [x.split()[0] for x in found.split(", ")])

    return table.select("key", "label", "whole").mapInArrow(run, found)


def _positives(table: DataFrame, shared: object, k: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> list:
        anchors, axis, stages = shared.value[:3]
        n = len(anchors.key)
        scan = Scan(anchors, stages, Lists(n, k, np.full(n, LEAST + 1), np.full(n, MOST)), True)
        of = {x: np.flatnonzero(anchors.label == x) for x in np.unique(anchors.label).tolist()}
        for rows in _batches(batches, axis, stages):
            order = np.argsort(rows.label, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(rows.label[order])) + 1):
                if (which := of.get(int(rows.label[part[0]]))) is not None:
                    scan.add(rows.at(part), which)
        rank, a = np.nonzero(scan.lists.score != LEAST)
        return [anchors.key[a], scan.lists.key[rank, a], scan.lists.score[rank, a]]

    return _scanned(table, "anchor long, key long, score long", make)


def _negatives(table: DataFrame, shared: object, n: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> list:
        anchors, axis, stages, ids, scores, floor, top = shared.value
        scan = Scan(anchors, stages, Lists(ids.size, n, floor.reshape(-1), top.reshape(-1)), False)
        everyone = np.arange(len(anchors.key))
        for rows in _batches(batches, axis, stages):
            scan.add(rows, everyone)
        rank, of = np.nonzero(scan.lists.score != LEAST)
        a = of // ids.shape[1]
        return [anchors.key[a], ids.reshape(-1)[of], scores.reshape(-1)[of], scan.lists.key[rank, of], scan.lists.score[rank, of]]

    return _scanned(table, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long", make)


def _first_of(df: DataFrame, most: int, by: list[str], *order: Column | str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("int")).where(F.col("rank") <= most)


def windows(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest score s with low * p <= 100 * s <= high * p; where there is none, the least is the larger one."""
    exact = [(-(-low * p // 100), high * p // 100) for p in scores.reshape(-1).tolist()]
    return tuple(np.array(x, np.int64).reshape(scores.shape) for x in zip(*exact, strict=True))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256, key: str = "vec_id", label: str = "label", column: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor's first rows of the same label, the first rows of other labels that score from low to high percent of it.

    Scores are inner products of floor(scale * x); higher ones come first, ties by the smaller key. Anchors are the rows for
    which is_anchor, over key, holds. Rows with a null key, label or vector, a null or non-finite component, another
    length than most, or a component so large that products would not fit a long (largest()) take no part. Rows that
    repeat a key count once, with the greatest label and vector. An anchor without positives, and a positive whose window
    is empty, give no rows; an empty table gives none. Other columns are not read.
    """
    common = vectors.where(F.col(column).isNotNull() & (F.size(column) > 0)).groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").first()
    table = materialise(whole_numbers(vectors, common.d if common else 1, key, label, column, scale))
    if not table.groupBy("key").count().where("count > 1").isEmpty():
        table = materialise(_first_of(table, 1, ["key"], F.desc("label"), F.desc("whole")).drop("rank"))
    # Of equal vectors of one label no more than an anchor itself and the first ones of a list can be found.
    pool, most = table, max(positives + 1, negatives)
    if not table.groupBy("same").count().where(f"count > {most}").isEmpty():
        pool = materialise(_first_of(table, most, ["same"], "key").drop("rank"))
    spark = table.sparkSession
    sample = [bytes(r.whole) for r in pool.orderBy(F.xxhash64("key"), "key").limit(FIT).select("whole").collect()]
    made = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    anchors, folder = table.where(is_anchor), new_path(spark)
    found = spark.createDataFrame([], made)
    blocks = -(-anchors.count() // ANCHOR_BLOCK)
    if blocks:
        axis, stages = rotation(np.frombuffer(b"".join(sample), "<i4").reshape(len(sample), -1).astype(np.float64))
    for block in range(blocks):
        # A block is done, and its anchors are off the driver, before the next one begins.
        rows = sorted((r.key, r.label, bytes(r.whole)) for r in anchors.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).select("key", "label", "whole").collect())
        if not rows:
            continue
        asked = Rotated.of(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.frombuffer(b"".join(r[2] for r in rows), "<i4").reshape(len(rows), -1), axis, stages)
        _positives(pool, spark.sparkContext.broadcast((asked, axis, stages)), positives).write.parquet(f"{folder}/positives/block={block}")
        nearest = spark.read.schema("anchor long, key long, score long").parquet(f"{folder}/positives/block={block}")
        # Lists of too few positives are filled up with windows that take nothing.
        ids, scores = np.zeros((len(rows), positives), np.int64), np.full((len(rows), positives), -1)
        place = {k: i for i, k in enumerate(asked.key.tolist())}
        for r in _first_of(nearest, positives, ["anchor"], F.desc("score"), "key").collect():
            ids[place[r.anchor], r.rank - 1], scores[place[r.anchor], r.rank - 1] = r.key, r.score
        floor, top = windows(scores, low, high)
        empty = (floor > top) | (scores < 0)
        floor[empty], top[empty] = MOST, LEAST
        _negatives(pool, spark.sparkContext.broadcast((asked, axis, stages, ids, scores, floor, top)), negatives).write.parquet(f"{folder}/negatives/block={block}")
        found = spark.read.schema(made).parquet(f"{folder}/negatives").select("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
    first = _first_of(found, negatives, ["anchor_id", "positive_id", "positive_score"], F.desc("negative_score"), "negative_id")
    return first.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
