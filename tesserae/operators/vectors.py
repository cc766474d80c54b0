"""Vector collections: exact cosine search for stated queries, counts, and the aligner's cascade."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import distance_confidence
from ..graph import Graph
from ..shared import materialised
from . import clustering
from .embedding import Embedder


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null where a vector is null or zero or the lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


#: Queries in one block of a search, vectors in one share of the pool, and queries whose products are held at once.
BLOCK, SHARE, TOGETHER = 4_096, 50_000, 64


def _length(v: str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def _matrices(table: pa.Table, column: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of the vectors in a column: which rows have it, and these as a matrix."""
    lists = table.column(column).combine_chunks()
    size, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    rows = {d: np.flatnonzero(size == d) for d in np.unique(size).tolist()}
    return {d: (at, flat[begin[at][:, None] + np.arange(d)]) for d, at in rows.items()}


def _nearest(v: np.ndarray, q: np.ndarray, barred: Callable[[int], np.ndarray], k: int, first: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, query, distance): the k nearest rows of v to each of q but for the rows barred(query); order tells which of equals comes first."""
    unit = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    asks = q / np.sqrt((q * q).sum(axis=1, keepdims=True))
    score = unit @ asks.T
    for j in range(len(q)):
        score[barred(first + j), j] = -np.inf
    most = min(k, len(v))
    least = np.partition(score, len(v) - most, axis=0)[len(v) - most]
    row, col = np.nonzero((score >= least - 1e-9) & np.isfinite(score))
    # Products of blocks may round equal vectors differently; these do not.
    dot = np.concatenate([np.einsum("ij,ij->i", v[row[s : s + SHARE]], q[col[s : s + SHARE]]) for s in range(0, len(row), SHARE)]) if len(row) else np.empty(0)
    distance = 1 - dot / (np.sqrt(np.einsum("ij,ij->i", v, v))[row] * np.sqrt(np.einsum("ij,ij->i", q, q))[col])
    by = np.lexsort((order[row], distance, col))
    row, col, distance = row[by], col[by], distance[by]
    keep = np.arange(len(col)) - np.searchsorted(col, col) < k
    return row[keep], col[keep], distance[keep]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, where: Column | None = None, block: int = BLOCK, within: str | None = None) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest rows of vectors (id, embedding, ...) to each of queries (query_id, vector).

    where filters vectors; within names a column of both that must be equal where the query has a value.

    Each block of about `block` queries meets each share of about SHARE vectors in one task, as products of matrices;
    nothing is broadcast or sent to the driver but the numbers of both, and a task hands on the k nearest of each query.
    Distance is 1 - cosine in double precision, ties go to the smaller id. Null and zero vectors, those with null or
    non-finite components or of another length, rows without an id, and a query's own id take no part.
    """
    spark = vectors.sparkSession
    pool = vectors if where is None else vectors.where(where)
    rows, parallel = pool.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks, shares = max(1, -(-queries.count() // block)), max(1, -(-rows // SHARE), min(parallel, -(-rows // 1_000)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    part = lambda name: (F.col(within).cast("string") if within else F.lit(None).cast("string")).alias(name)
    usable = lambda df, key, v: df.where(F.col(key).isNotNull() & (_length(v) > 0) & (_length(v) < float("inf")))
    held = usable(pool.select("id", F.col("embedding").cast("array<double>").alias("v"), part("has"), dealt("id", shares).alias("share")), "id", "v").withColumn("block", every(blocks))
    asked = usable(queries.select("query_id", F.col("vector").cast("array<double>").alias("v"), part("asks"), dealt("query_id", blocks).alias("block")), "query_id", "v").withColumn("share", every(shares))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, asks = left.column("id").combine_chunks(), right.column("query_id").combine_chunks()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(left) and len(right):
            order = np.empty(len(left), np.int64)
            order[pc.sort_indices(ids).to_numpy()] = np.arange(len(left))
            of_id: dict = {}
            for p, i in enumerate(ids.to_pylist()):
                of_id.setdefault(i, []).append(p)
            has, wants = np.array(left.column("has").to_pylist(), object), right.column("asks").to_pylist()
            own = [np.array(of_id.get(q, []), np.int64) for q in asks.to_pylist()]
            mine = _matrices(left, "v")
            for d, (at, q) in _matrices(right, "v").items():
                if d not in mine:
                    continue
                which, v = mine[d]
                place = np.full(len(left), -1)
                place[which] = np.arange(len(which))

                def barred(j: int, at: np.ndarray = at, which: np.ndarray = which, place: np.ndarray = place) -> np.ndarray:
                    same = place[own[at[j]]]
                    same = same[same >= 0]
                    return same if wants[at[j]] is None else np.concatenate((same, np.flatnonzero(has[which] != wants[at[j]])))

                for s in range(0, len(q), TOGETHER):
                    row, col, distance = _nearest(v, q[s : s + TOGETHER], barred, k, s, order[which])
                    out.append((which[row], at[s + col], distance))
        row, col, distance = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table([asks.take(pa.array(col)), ids.take(pa.array(row)), pa.array(distance)], ["query_id", "id", "distance"])

    met = held.groupBy("block", "share").cogroup(asked.groupBy("block", "share"))
    scored = met.applyInArrow(run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def text_search(vectors: DataFrame, queries: DataFrame, embed: Callable[[Column], Column] | Embedder, k: int = 10, where: Column | None = None) -> DataFrame:
    """(query_id, rank, distance, id, ...): the k nearest rows of vectors (id, embedding, ...), whole, to texts (query_id, text)."""
    asked = queries.where(F.trim("text") != "")
    asked = embed.vectors(asked, "query_id", "text") if isinstance(embed, Embedder) else asked.select("query_id", embed(F.col("text")).alias("vector"))
    found = search(vectors, asked, k, where).select("query_id", "rank", "distance", "id")
    return found.join(vectors.drop("embedding"), "id").select("query_id", "rank", "distance", "id", *[c for c in vectors.columns if c not in ("id", "embedding")])


def capabilities_found(capabilities: DataFrame, wishes: DataFrame, embed: Callable[[Column], Column], k: int = 5) -> DataFrame:
    """(query_id, rank, id, name, business_domain, confidence): the nearest capabilities to wishes (query_id, text, business_domain).

    capabilities: (id, name, business_domain, searchable). A wish with a domain finds only those of that domain.
    """
    pool = capabilities.select("id", "name", "business_domain", embed(F.col("searchable")).alias("embedding"))
    asked = wishes.where(F.trim("text") != "").select("query_id", embed(F.col("text")).alias("vector"), "business_domain")
    found = search(pool, asked, k, within="business_domain").select("query_id", "rank", "id", distance_confidence(F.col("distance")).alias("confidence"))
    return found.join(pool.drop("embedding"), "id").select("query_id", "rank", "id", "name", "business_domain", "confidence")


def get(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of vectors whose id is among ids (id)."""
    return vectors.join(ids.select("id").distinct(), "id", "left_semi")


def delete(vectors: DataFrame, ids: DataFrame | None = None, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The vectors left after those with an id among ids (id), or for which where holds, are deleted, and (n) how many are."""
    gone = vectors.where("false")
    left = vectors
    if ids is not None:
        gone, left = get(left, ids), left.join(ids.select("id").distinct(), "id", "left_anti")
    if where is not None:
        hit = F.coalesce(where, F.lit(False))
        gone, left = gone.unionByName(left.where(hit)), left.where(~hit)
    return left, gone.agg(F.count("*").alias("n"))


def count(vectors: DataFrame, where: Column | None = None) -> DataFrame:
    return (vectors if where is None else vectors.where(where)).agg(F.count("*").alias("n"))


def align(names: DataFrame, concepts: DataFrame, near: DataFrame | None = None, least: float = 0.7, graph: Graph | None = None, overlap: float = 0.8) -> DataFrame:
    """(name, concept_id, method, confidence): by exact name, else alias in any case, else the nearest vector, else the graph, else none.

    names: (name); concepts: (concept_id, name, aliases, ord); near: (name, concept_id, distance). Of equal names the
    first concept wins, of equal aliases the last. Blank names align with none. With a graph, names that nothing else
    aligns take the concept whose code overlaps most, above overlap, with the code around the name's own (structural()).
    """
    exact = concepts.groupBy("name").agg(F.min_by("concept_id", "ord").alias("exact"))
    alias = concepts.select(F.explode("aliases").alias("a"), "concept_id", "ord").groupBy(F.lower("a").alias("low")).agg(F.max_by("concept_id", "ord").alias("alias"))
    out = names.distinct().withColumn("low", F.lower("name")).join(exact, "name", "left").join(alias, "low", "left")
    if near is not None:
        best = near.groupBy("name").agg(F.min_by("concept_id", "distance").alias("near"), F.min("distance").alias("d")).where(distance_confidence(F.col("d")) >= least)
        out = out.join(best, "name", "left")
    else:
        out = out.withColumn("near", F.lit(None).cast("string")).withColumn("d", F.lit(None).cast("double"))
    blank = F.trim("name") == ""
    how = F.when(blank, "none").when(F.col("exact").isNotNull(), "exact").when(F.col("alias").isNotNull(), "alias").when(F.col("near").isNotNull(), "vector").otherwise("none")
    got = out.withColumn("method", how)
    if graph is not None:
        open_ = got.where((F.col("method") == "none") & ~blank)
        by_graph = structural(graph, open_.select("name"), overlap).join(exact.withColumnRenamed("name", "concept"), "concept").select("name", F.col("exact").alias("like"), "overlap")
        got = got.join(by_graph, "name", "left").withColumn("method", F.when((F.col("method") == "none") & F.col("like").isNotNull(), "graph_structure").otherwise(F.col("method")))
    else:
        got = got.withColumn("like", F.lit(None).cast("string")).withColumn("overlap", F.lit(None).cast("double"))
    return got.select("name", F.when(F.col("method") != "none", F.coalesce("exact", "alias", "near", "like")).alias("concept_id"), "method", F.when(F.col("method").isin("exact", "alias"), 1.0).when(F.col("method") == "vector", distance_confidence(F.col("d"))).when(F.col("method") == "graph_structure", F.round("overlap", 4)).otherwise(0.0).alias("confidence"))


def code_around(graph: Graph, names: DataFrame) -> DataFrame:
    """(name, id) distinct: code within two relations, either way, of the code of each of names (name), no relation twice."""
    code = graph.labelled("CodeEntity")
    starts = code.join(names.select("name").distinct(), "name").select("name", F.col("id").alias("start"))
    way = lambda a, b: F.struct(F.col(a).alias("here"), F.col(b).alias("there"))
    ways = graph.edges.select(F.explode(F.array(way("src", "dst"), way("dst", "src"))).alias("way")).select("way.*").where("here <> there")
    # Both are read more than once below, and by Spark not told apart from new work.
    steps = materialised(ways.groupBy("here", "there").agg(F.count("*").alias("n")))
    one = materialised(starts.join(steps, F.col("start") == F.col("here")).select("name", "start", F.col("there").alias("at"), "n"))
    two = one.select("name", "start", "at").join(steps.select("here", "there"), F.col("at") == F.col("here")).where("there <> start").select("name", F.col("there").alias("id"))
    # Back at the start are those that another relation leads back from; a loop is a relation to itself.
    back = one.where("n > 1").select("name", F.col("start").alias("id"))
    loops = starts.join(graph.edges.where("src = dst").select(F.col("src").alias("start")), "start", "left_semi").select("name", F.col("start").alias("id"))
    every = one.select("name", F.col("at").alias("id")).unionByName(two).unionByName(back).unionByName(loops).distinct()
    return every.join(code.select("id"), "id", "left_semi").select("name", "id")


def structural(graph: Graph, names: DataFrame, least: float = 0.8) -> DataFrame:
    """(name, concept, overlap): the concept whose code, by derived_from or semantic_impact either way, overlaps most with the code around a name, above least.

    Overlap is that of sets (Jaccard); of equal overlaps the first concept by name counts.
    """
    concepts, code = graph.labelled("ConceptEntity"), graph.labelled("CodeEntity").select("id")
    e = graph.typed("derived_from", "semantic_impact")
    ends = e.select(F.col("src").alias("concept_id"), F.col("dst").alias("id")).unionByName(e.select(F.col("dst").alias("concept_id"), F.col("src").alias("id")))
    known = ends.join(code, "id", "left_semi").join(concepts.select(F.col("id").alias("concept_id"), F.col("name").alias("concept")), "concept_id").select("concept", "id")
    met = clustering.overlaps(code_around(graph, names).toDF("id", "item"), known.toDF("id", "item"), least)
    best = met.groupBy("a").agg(F.min(F.struct((-F.col("overlap")).alias("o"), "b")).alias("m"))
    return best.select(F.col("a").alias("name"), F.col("m.b").alias("concept"), (-F.col("m.o")).alias("overlap"))


def hashed(text: Column, d: int = 256) -> Column:
    """Counts of a text's words, in lower case, in d places by their hash; a null text gives zeros. It needs no model."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)
    places = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(d)))

    @F.pandas_udf("array<double>")
    def counted(rows: pd.Series) -> pd.Series:
        return rows.map(lambda p: np.bincount(np.asarray(p, np.int64), minlength=d).astype(np.float64))

    return counted(places)
