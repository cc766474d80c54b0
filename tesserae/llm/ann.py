"""Approximate nearest neighbours by cosine: randomly rotated one-bit codes with error bounds that choose what to rerank.

A vector, scaled to length one, is padded with zeros to a whole number of 64 places, 256 at least, and rotated. Its code
are the signs, packed, and one correction scalar, its inner product with the code itself. A query's inner product with
the code, divided by that scalar, estimates the cosine without bias; its error is below EPS * sqrt((1 - s^2) / s^2 /
(D - 1)) but for a share of cases that falls off as exp(-c EPS^2). A rotated query is rounded to whole numbers of four
bits, so that its inner product with a code is four counts of the bits that both have.

The codes of all rows are scanned for each block of queries. A task scores exactly, first, the candidates of a query's
best estimates among the first rows it reads, and then those whose estimate plus bound reaches the query's k-th best
exact score so far; of the others no vector is touched. It hands on the k nearest it found for each query.

Equal vectors are one query, and of equal vectors no more than k + 1 rows, those of the smallest keys, can be among a
query's k nearest, so copies make no large groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, new_path

EPS = 1.7
#: Places of a code, at least.
PLACES = 256
#: Bits of a query's rounded components.
BITS = 4
#: Queries that are scanned for at once; the driver hands them to the executors and holds no more than one block.
QUERY_BLOCK = 4_096
#: Best estimates of a query that are scored first, times k.
FIRST = 3
#: Rows and queries whose estimates a task holds at once, and rows of them that are computed together.
ROWS, COLUMNS, TOGETHER = 8_192, 128, 512
SEED = 20_240


def rotation(d: int, places: int | None = None, seed: int = SEED) -> np.ndarray:
    """d orthonormal rows in random directions, the same for every index of this dimension."""
    places = places or width(d)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((places, places)))
    return (q * np.sign(np.diag(r)))[:d]


def width(d: int) -> int:
    return -(-max(d, PLACES) // 64) * 64


def bounds(scale: np.ndarray, places: int) -> np.ndarray:
    return EPS * np.sqrt(np.maximum(1 - scale**2, 0) / scale**2 / (places - 1))


def _usable(x: list | None, d: int) -> np.ndarray | None:
    if x is None or len(x) != d or any(v is None for v in x):
        return None
    v = np.array(x, np.float64)
    return v if np.isfinite(v).all() and v.any() else None


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows of a and b; only components so large or small that squares of them would not hold are scaled first."""
    a, b = ((x if 1e-100 < (m := np.abs(x).max(axis=1)).min() and m.max() < 1e100 else x / m[:, None]) for x in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def codes(v: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs and correction scalars of the rows of v."""
    turned = _unit(v) @ turn
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(turn.shape[1])


def index(vectors: DataFrame, d: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, same, code, scale, vector): a digest that equal vectors share, packed signs, correction scalar, and the vector in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(d)
        for whole in batches:
            for b in (whole.slice(k, 2_000) for k in range(0, whole.num_rows, 2_000)):
                rows = [(i, v) for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if i is not None and (v := _usable(x, d)) is not None]
                if not rows:
                    continue
                v = np.stack([x for _, x in rows])
                code, scale = codes(v, turn)
                raw = [x.tobytes() for x in v]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([xxhash.xxh3_128_digest(x) for x in raw], pa.binary()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(raw, pa.binary())], ["key", "same", "code", "scale", "vector"])

    return vectors.select(F.col(key).cast("long").alias("key"), F.col(column)).mapInArrow(run, "key long, same binary, code binary, scale double, vector binary")


class Scan:
    """The k nearest of each of a block of queries among the rows that are added."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k, self.places = queries, k, width(queries.shape[1])
        turned = _unit(queries) @ rotation(queries.shape[1])
        low = turned.min(axis=1)
        step = (turned.max(axis=1) - low) / ((1 << BITS) - 1)
        level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
        # Twice the rounded query's sum over the places of a code's bits, less its sum over all places.
        self.low, self.step = (2 * low).astype(np.float32), (2 * step).astype(np.float32)
        self.total = (low * self.places + step * level.sum(axis=1)).astype(np.float32)
        # Bits of the rounded components: by bit, then by word of a code, then by query.
        self.planes = np.stack([np.ascontiguousarray(np.packbits(level >> j & 1, axis=1).view(np.uint64).T) for j in range(BITS)])
        self.score = np.full((k, len(queries)), -np.inf)
        self.key = np.full((k, len(queries)), np.iinfo(np.int64).max)
        self.scored = 0

    def estimates(self, code: np.ndarray, scale: np.ndarray, at: slice) -> np.ndarray:
        """Estimated cosines of rows of codes (words) with the queries at."""
        out = np.empty((len(code), len(self.low[at])), np.float32)
        for r in range(0, len(code), TOGETHER):
            part = code[r : r + TOGETHER]
            both = np.zeros((len(part), out.shape[1]), np.uint16)
            common, n = np.empty(both.shape, np.uint64), np.empty(both.shape, np.uint8)
            for j in range(BITS):
                count = np.zeros_like(both)
                for w in range(part.shape[1]):
                    np.bitwise_and(part[:, w, None], self.planes[j, w, at], out=common)
                    count += np.bitwise_count(common, out=n)
                both += count << j
            ones = np.bitwise_count(part).sum(axis=1, dtype=np.int64).astype(np.float32)
            inner = self.low[at] * ones[:, None] + self.step[at] * both - self.total[at]
            out[r : r + TOGETHER] = inner / (math.sqrt(self.places) * scale[r : r + TOGETHER, None]).astype(np.float32)
        return out

    def rerank(self, row: np.ndarray, col: np.ndarray, keys: np.ndarray, vectors: np.ndarray) -> None:
        """Score these pairs of rows and queries exactly and keep each query's k nearest, ties to the smaller key."""
        for a in range(0, len(row), ROWS):
            r, c = row[a : a + ROWS], col[a : a + ROWS]
            score, key = cosines(vectors[r], self.queries[c]), keys[r]
            self.scored += len(r)
            order = np.lexsort((key, -score, c))
            c, score, key = c[order], score[order], key[order]
            of, first = np.unique(c, return_index=True)
            nth = np.arange(len(c)) - np.repeat(first, np.diff(np.append(first, len(c))))
            keep = nth < self.k
            place = np.searchsorted(of, c[keep])
            scores, names = (np.full((2 * self.k, len(of)), x) for x in (-np.inf, np.iinfo(np.int64).max))
            scores[: self.k], names[: self.k] = self.score[:, of], self.key[:, of]
            scores[self.k + nth[keep], place], names[self.k + nth[keep], place] = score[keep], key[keep]
            best = np.lexsort((names, -scores), axis=0)[: self.k]
            self.score[:, of], self.key[:, of] = np.take_along_axis(scores, best, 0), np.take_along_axis(names, best, 0)

    def add(self, keys: np.ndarray, code: np.ndarray, scale: np.ndarray, vectors: np.ndarray) -> None:
        bound = bounds(scale, self.places).astype(np.float32)[:, None]
        for q in range(0, len(self.low), COLUMNS):
            at = slice(q, q + COLUMNS)
            e = self.estimates(code, scale, at)
            if np.isneginf(self.score[-1, at]).any():
                many = min(len(keys), FIRST * self.k)
                likely = np.argpartition(-e, many - 1, axis=0)[:many]
                cols = np.broadcast_to(np.arange(e.shape[1]), likely.shape)
                self.rerank(likely.reshape(-1), q + cols.reshape(-1), keys, vectors)
                # Not a number, so that none of them is scored again.
                np.put_along_axis(e, likely, np.nan, 0)
            row, col = np.nonzero(e + bound >= self.score[-1, at].astype(np.float32) - np.float32(1e-6))
            self.rerank(row, q + col, keys, vectors)


def _rows_of(column: pa.Array, dtype: type) -> np.ndarray:
    """A column of equally long binary values as rows of numbers, without a copy."""
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(dtype).reshape(len(column), -1)


def _nearest(table: DataFrame, asked: list[tuple[int, bytes]], d: int, k: int) -> DataFrame:
    """(query, key, score): the k nearest that each task finds for one block of queries (key, vector)."""
    shared = table.sparkSession.sparkContext.broadcast((np.array([i for i, _ in asked], np.int64), np.frombuffer(b"".join(v for _, v in asked), np.float64).reshape(-1, d)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        scan = Scan(queries, k)
        for whole in batches:
            for b in (whole.slice(x, ROWS) for x in range(0, whole.num_rows, ROWS)):
                scan.add(b.column(0).to_numpy(), _rows_of(b.column(1), np.uint64), b.column(2).to_numpy(), _rows_of(b.column(3), np.float64))
        rank, q = np.nonzero(~np.isneginf(scan.score))
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(scan.key[rank, q]), pa.array(scan.score[rank, q])], ["query", "key", "score"])

    return table.select("key", "code", "scale", "vector").mapInArrow(run, "query long, key long, score double")


def _first_of(df: DataFrame, most: int, by: str, *order: Column | str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def reranked(table: DataFrame, asked: DataFrame, d: int, k: int) -> DataFrame:
    """(query, key, score): for the queries (query, vector) the k nearest that each task found among the rows of the index."""
    spark = table.sparkSession
    blocks = -(-asked.count() // QUERY_BLOCK)
    folder = new_path(spark)
    found = table.select(F.col("key").alias("query"), "key", F.col("scale").alias("score")).limit(0)
    for block in range(blocks):
        # A block is done, and its queries are off the driver, before the next one begins.
        rows = sorted((r.query, bytes(r.vector)) for r in asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).select("query", "vector").collect())
        if rows:
            _nearest(table, rows, d, k).write.parquet(f"{folder}/block={block}")
            found = spark.read.schema("query long, key long, score double").parquet(folder).select("query", "key", "score")
    return found


def search(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row, nearest first, ties to the smaller id.

    Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part,
    nor do rows with a null key. A query is not its own neighbour. Rows that repeat a key count once, with the greatest
    vector. With fewer candidates than k all are returned; an empty table gives no rows. Other columns are not read.
    """
    common = vectors.where(F.col(column).isNotNull() & (F.size(column) > 0)).groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = common.d if common else 1
    table = materialise(index(vectors, d, key, column))
    # Keys and digests alone tell whether there are repeated keys or many equal vectors; only then rows are moved.
    if not table.groupBy("key").count().where("count > 1").isEmpty():
        table = materialise(_first_of(table, 1, "key", F.desc("vector")))
    pool = table
    if not table.groupBy("same").count().where(f"count > {k + 1}").isEmpty():
        pool = materialise(_first_of(table, k + 1, "same", "key"))
    asked = table.where(is_query).select("key", "same", "vector")
    distinct = materialise(asked.groupBy("same").agg(F.min("key").alias("query"), F.max("vector").alias("vector")))
    scored = reranked(pool, distinct, d, k + 1)
    nearest = _first_of(scored, k + 1, "query", F.desc("score"), "key")
    each = asked.select(F.col("key").alias("query_id"), "same").join(distinct.select("same", "query"), "same")
    others = each.join(nearest, "query").where("query_id <> key").select("query_id", F.col("key").alias("vec_id"), "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return others.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
