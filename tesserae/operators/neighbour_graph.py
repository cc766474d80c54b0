"""An approximate index of vectors: layered neighbour graphs, one for each shard, searched with a beam.

A shard holds up to SHARD vectors. Each layer above the first holds about one in SPREAD vectors of the one below. A
vector's neighbours in a layer are found exactly, by block products within the shard, thinned out so that none lies nearer
to another neighbour than to the vector, and made mutual. A search scans the highest layer, steps greedily down and keeps
the `beam` best in the lowest one, going on from the best whose neighbours are unseen. The index is a table with a row a
vector; a shard is built by one task and searched by one task for each block of queries. The sizes of both are bounded, and
a task goes through them in pieces, so its memory has a bound, and work grows with the number of shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a shard at most, on average, and queries in a block.
SHARD, QUERIES = 25_000, 16_384
#: Neighbours in a layer, candidates they are chosen from, and the share that a layer above holds.
NEIGHBOURS, CANDIDATES, SPREAD = 32, 64, 32
#: A layer of no more vectors is the highest.
TOP = 64
#: Best vectors that a search keeps.
BEAM = 128
#: Rows whose products are computed together, and queries that are walked together.
BLOCK, TOGETHER = 256, 256
#: Products held at once, and pairs whose vectors are.
PRODUCTS, PAIRS = 1 << 21, 1 << 14


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _single(vectors: np.ndarray) -> np.ndarray:
    """unit() in single precision, without whole copies in double."""
    out = np.empty(vectors.shape, np.float32)
    for s in range(0, len(vectors), PAIRS):
        out[s : s + PAIRS] = unit(vectors[s : s + PAIRS])
    return out


def nearest(x: np.ndarray, most: int) -> np.ndarray:
    """The `most` nearest rows of each row of x by inner product, itself left out, nearest first."""
    most = min(most, len(x) - 1)
    out = np.empty((len(x), most), np.int64)
    rows = max(1, min(BLOCK, PRODUCTS // len(x)))
    for s in range(0, len(x), rows):
        part = x[s : s + rows] @ x.T
        np.negative(part, out=part)
        part[np.arange(len(part)), np.arange(s, s + len(part))] = np.inf
        some = np.argpartition(part, most - 1, axis=1)[:, :most]
        out[s : s + rows] = np.take_along_axis(some, np.argsort(np.take_along_axis(part, some, 1), axis=1, kind="stable"), 1)
    return out


def thinned(x: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` of each row's candidates, -1 behind them: one is kept if no kept one is nearer to it than the row itself."""
    out = np.full((len(x), most), -1)
    for s in range(0, len(x), BLOCK):
        c = near[s : s + BLOCK]
        v = x[c]
        own = np.einsum("bcd,bd->bc", v, x[s : s + BLOCK])
        among = np.einsum("bcd,bed->bce", v, v)
        kept = np.zeros(c.shape, bool)
        for k in range(c.shape[1]):
            closer = (kept & (among[:, k] > own[:, k, None])).any(axis=1)
            kept[:, k] = ~closer & (kept.sum(axis=1) < most)
        row, at = np.nonzero(kept)
        out[s + row, kept.cumsum(axis=1)[row, at] - 1] = c[row, at]
    return out


def mutual(x: np.ndarray, links: np.ndarray, most: int) -> np.ndarray:
    """links with those of the other side, the nearest `most` of each."""
    a, k = np.nonzero(links >= 0)
    b = links[a, k]
    pairs = np.unique(np.concatenate((a * len(x) + b, b * len(x) + a)))
    a, b = pairs // len(x), pairs % len(x)
    near = np.concatenate([np.einsum("ij,ij->i", x[a[s : s + PAIRS]], x[b[s : s + PAIRS]]) for s in range(0, len(a), PAIRS)]) if len(a) else np.empty(0)
    order = np.lexsort((b, -near, a))
    a, b = a[order], b[order]
    nth = np.arange(len(a)) - np.searchsorted(a, a)
    out = np.full((len(x), most), -1)
    out[a[nth < most], nth[nth < most]] = b[nth < most]
    return out


def layers(x: np.ndarray, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """(members, neighbours of each member as places in x) of each layer, the lowest first."""
    members, rng, out = np.arange(len(x)), np.random.default_rng(seed), []
    while True:
        if len(members) <= TOP:
            out.append((members, np.full((len(members), 1), -1)))
            return out
        own = x[members]
        links = mutual(own, thinned(own, nearest(own, CANDIDATES), NEIGHBOURS // 2), NEIGHBOURS)
        out.append((members, np.where(links >= 0, members[links], -1)))
        members = np.sort(rng.choice(members, max(TOP, len(members) // SPREAD), replace=False)) if len(members) > TOP else members


def _walk(x: np.ndarray, q: np.ndarray, links: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, products, number of products) of the `beam` best that each of the queries q finds from its start."""
    rows = np.arange(len(q))
    seen = np.zeros((len(q), len(x)), bool)
    place, score, done = np.full((len(q), beam), -1), np.full((len(q), beam), -np.inf, np.float32), np.ones((len(q), beam), bool)
    place[:, 0], score[:, 0], done[:, 0] = start, np.einsum("ij,ij->i", x[start], q), False
    seen[rows, start] = True
    n = len(q)
    while True:
        at = np.where(done, -np.inf, score).argmax(axis=1)
        live = ~done[rows, at]
        if not live.any():
            return place, score, n
        r, at = rows[live], at[live]
        done[r, at] = True
        near = links[place[r, at]]
        new = (near >= 0) & ~seen[r[:, None], near]
        i, j = np.nonzero(new)
        seen[r[i], near[i, j]] = True
        n += len(i)
        found = np.full(near.shape, -np.inf, np.float32)
        found[i, j] = np.einsum("ij,ij->i", x[near[i, j]], q[r[i]])
        both, where = np.concatenate((score[r], found), axis=1), np.concatenate((place[r], near), axis=1)
        open_ = np.concatenate((done[r], ~new), axis=1)
        best = np.argpartition(-both, beam - 1, axis=1)[:, :beam]
        place[r], score[r], done[r] = (np.take_along_axis(z, best, 1) for z in (where, both, open_))


def found(x: np.ndarray, graph: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, beam: int) -> tuple[np.ndarray, int]:
    """The places of each query's beam, -1 where it is not full, and the number of inner products."""
    out, n = np.full((len(q), beam), -1), 0
    above = []
    for members, links in graph[-2:0:-1]:
        above.append(np.full((len(x), links.shape[1]), -1, np.int32))
        above[-1][members] = links
    for s in range(0, len(q), TOGETHER):
        part = q[s : s + TOGETHER]
        members = graph[-1][0]
        start = members[(part @ x[members].T).argmax(axis=1)]
        n += len(part) * len(members)
        for whole in above:
            place, score, k = _walk(x, part, whole, start, 8)
            start, n = place[np.arange(len(part)), score.argmax(axis=1)], n + k
        if len(graph) == 1:
            most = min(beam, len(x))
            out[s : s + TOGETHER, :most] = np.argsort(-(part @ x.T), axis=1, kind="stable")[:, :most]
        else:
            place, _, k = _walk(x, part, graph[0][1], start, beam)
            out[s : s + TOGETHER], n = place, n + k
    return out, n


def distances(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """1 - cosine of each row of v and that of q, summed place by place, as the SQL engine does, so that ties are its ties."""
    dot, a, b = np.zeros((3, len(v)))
    for x, y in zip(v.T, q.T, strict=True):
        dot, a, b = dot + x * y, a + x * x, b + y * y
    both = np.sqrt(a * b)
    return 1 - np.clip(dot / np.where((both > 0) & (both < np.inf), both, np.sqrt(a) * np.sqrt(b)), -1, 1)


def _first(row: np.ndarray, p: np.ndarray, distance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `most` nearest of each row, nearest first, ties to the smaller place."""
    order = np.lexsort((p, distance, row))
    row, p, distance = row[order], p[order], distance[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < most
    return row[keep], p[keep], distance[keep]


def _checked(v: np.ndarray, x: np.ndarray, q: np.ndarray, asked: np.ndarray, row: np.ndarray, distance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The exact answer from the walks' one (row, distance): rows of x whose product is not below that of the last one found are compared in double precision."""
    # Products of unit vectors in single precision are wrong by half of this at most.
    slack = (x.shape[1] + 4) * 2.0**-23
    n = np.bincount(row, minlength=len(q))
    full = n == most
    least = np.empty(len(q))
    least[full] = 1 - distance[np.cumsum(n)[full] - 1] - slack
    out = []
    step = max(1, PRODUCTS // len(x))
    for s in range(0, len(q), step):
        near, bound, few = asked[s : s + step] @ x.T, least[s : s + step], ~full[s : s + step]
        if few.any():
            # A walk that has found too few gives no bound.
            place = max(0, len(x) - most)
            bound[few] = np.partition(near[few], place, axis=1)[:, place] - 2 * slack
        r, p = np.nonzero(near >= bound[:, None].astype(np.float32))
        exact = [distances(v[p[t : t + PAIRS]], q[s + r[t : t + PAIRS]]) for t in range(0, len(p), PAIRS)]
        r, p, d = _first(r, p, np.concatenate([np.empty(0), *exact]), most)
        out.append((s + r, p, d))
    return tuple(np.concatenate(o) for o in zip(*out, strict=True))


def answered(v: np.ndarray, x: np.ndarray, graph: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, most: int, beam: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, place, distance, number of inner products): the `most` nearest that each of q finds among v, ties to the smaller place.

    x is v as unit vectors in single precision. Few queries are answered at once, so that no more than PAIRS of their
    beams' vectors are held together, however many queries there are. exact: what the walks missed is found too.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    n, together = len(q) * len(x) if exact else 0, max(1, PAIRS // beam)
    for s in range(0, len(q), TOGETHER):
        asked = unit(q[s : s + TOGETHER]).astype(np.float32)
        place, k = found(x, graph, asked, beam)
        n += k
        for t in range(0, len(asked), together):
            row, at = np.nonzero(place[t : t + together] >= 0)
            p = place[t + row, at]
            row, p, distance = _first(row, p, distances(v[p], q[s + t + row]), most)
            if exact:
                row, p, distance = _checked(v, x, q[s + t : s + min(t + together, len(asked))], asked[t : t + together], row, distance, most)
            out.append((s + t + row, p, distance))
    row, p, distance = (np.concatenate(o) for o in zip(*out, strict=True))
    return row, p, distance, n


def _listed(graph: list[tuple[np.ndarray, np.ndarray]], rows: int) -> pa.Array:
    """The layers of a graph as a column: each row's neighbours by layer, the lowest first."""
    member, layer = np.concatenate([m for m, _ in graph]), np.repeat(np.arange(len(graph)), [len(m) for m, _ in graph])
    lists = np.lexsort((layer, member))
    sizes = np.concatenate([(near >= 0).sum(axis=1) for _, near in graph])
    begin, values = np.concatenate(([0], np.cumsum(sizes))), np.concatenate([near[near >= 0] for _, near in graph]).astype(np.int32)
    sizes = sizes[lists]
    ends = np.cumsum(sizes)
    inner = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values[np.repeat(begin[lists] - ends + sizes, sizes) + np.arange(len(values))]))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(member, minlength=rows)))), pa.int32()), inner)


def _layered(column: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The layers of the graph that _listed() has made."""
    outer = column.combine_chunks()
    inner = outer.flatten()
    height, size, values = (z.to_numpy(zero_copy_only=False) for z in (outer.value_lengths(), inner.value_lengths(), inner.flatten()))
    first, begin = np.cumsum(height) - height, np.cumsum(size) - size
    out = []
    for layer in range(height.max()):
        members = np.flatnonzero(height > layer)
        at = first[members] + layer
        near = np.full((len(members), max(1, size[at].max())), -1, np.int32)
        row, k = np.nonzero(np.arange(near.shape[1]) < size[at][:, None])
        near[row, k] = values[begin[at][row] + k]
        out.append((members, near))
    return out


def _usable(vectors: DataFrame, d: int, column: str) -> DataFrame:
    plain = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.col("id").isNotNull() & (F.size(column) == d) & plain & F.exists(column, lambda v: v != 0))


def build(vectors: DataFrame, path: str, shard: int = SHARD) -> DataFrame:
    """Build the index of vectors (id, embedding), write it to path and return it: (shard, place, id, vector, links).

    links are the neighbours' places by layer, the lowest first. Null and zero vectors, those with null or non-finite
    components, of another length than most, and without an id take no part. Vectors are dealt to shards by their id.
    """
    spark = vectors.sparkSession
    common = vectors.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    usable = _usable(vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding")), common.d if common else 0, "embedding")
    shards = max(1, -(-usable.count() // shard))
    kind = vectors.schema["id"].dataType.simpleString()
    made = f"shard int, place int, id {kind}, vector array<double>, links array<array<int>>"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        raw = table.column("embedding").combine_chunks()
        v = raw.flatten().to_numpy().reshape(len(table), -1)
        links = _listed(layers(_single(v)), len(v))
        return pa.table([table.column("shard"), pa.array(np.arange(len(v), dtype=np.int32)), table.column("id"), table.column("embedding"), links], ["shard", "place", "id", "vector", "links"])

    # Partitions are stated, as shards are long work on few bytes, which would be put together.
    dealt = usable.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    dealt.repartition(2 * shards, "shard").groupBy("shard").applyInArrow(run, made).write.parquet(path)
    return spark.read.schema(made).parquet(path)


def search(index: DataFrame, queries: DataFrame, k: int = 5, beam: int = BEAM, block: int = QUERIES, exact: bool = False) -> DataFrame:
    """(query_id, id, distance, rank, products): the k nearest that the index finds to each of queries (query_id, vector).

    Distance is 1 - cosine in double precision of the original vectors, ties go to the smaller id, a query's own id takes
    no part. products is the number of inner products for the query's block in all shards, a query, on average.
    exact: the nearest of all, by a check of each shard's rows against the last of those that its graph has given.
    """
    shards = [r.shard for r in index.select("shard").distinct().collect()]
    spark = index.sparkSession
    d = index.select(F.size("vector")).first()
    asked = _usable(queries.select(F.col("query_id").alias("id"), F.col("vector").cast("array<double>").alias("vector")), d[0] if d else 0, "vector").withColumnRenamed("id", "query_id")
    blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.array(*map(F.lit, shards))) if shards else F.lit(0))
    every = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    id_kind, query_kind = index.schema["id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()

    def run(nodes: pa.Table, some: pa.Table) -> pa.Table:
        names = ["query_id", "id", "distance", "n"]
        ids, asks = nodes.schema.field("id").type, some.schema.field("query_id").type
        if not len(nodes) or not len(some):
            return pa.table([pa.array([], t) for t in (asks, ids, pa.float64(), pa.float64())], names)
        nodes = nodes.sort_by("place")
        v, q = (t.column("vector").combine_chunks().flatten().to_numpy().reshape(len(t), -1) for t in (nodes, some))
        # One more than k, as a query's own id may be among them.
        row, p, distance, n = answered(v, _single(v), _layered(nodes.column("links")), q, k + 1, beam, exact)
        return pa.table([some.column("query_id").take(pa.array(row)), nodes.column("id").take(pa.array(p)), pa.array(distance), pa.array(np.full(len(row), n / len(q)))], names)

    parts = 2 * blocks * max(1, len(shards))
    met = every.repartition(parts, "shard", "block").groupBy("shard", "block").cogroup(asked.repartition(parts, "shard", "block").groupBy("shard", "block")).applyInArrow(run, f"query_id {query_kind}, id {id_kind}, distance double, n double")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    work = F.sum(F.when(F.col("_r") == 1, F.col("n"))).over(Window.partitionBy("query_id"))
    # A query's rows from one shard have the same number of products; each shard counts once.
    marked = met.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "n").orderBy("distance")))
    own = marked.withColumn("products", work).where(F.col("query_id").cast("string") != F.col("id").cast("string"))
    return own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "distance", "rank", "products")
