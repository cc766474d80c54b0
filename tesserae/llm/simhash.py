"""Near-duplicates by SimHash: fingerprints of word shingles, linked where few bits differ, found by pigeonring filtering.

The 64 bits form a ring of nine segments. If two fingerprints differ in at most 4 bits, then from some segment on every
chain of l consecutive segments holds at most l * 4 / 9 differences (the strong form of the pigeonhole principle on a
ring). So of the chain's first segments a known number agree: the first two, then at least one of the next two, then
at least four of the first six, and so on. A key is one such choice of agreeing segments: 3 segments and 18 keys a
fingerprint, 4 segments and 45 keys, or 5 segments and more keys. All of them bring every such pair together; the more
distinct fingerprints there are, the longer the keys are taken, so that chance keeps few fingerprints in a bucket. Pairs
that meet must pass the budgets of all longer chains from there, the last of which is the full Hamming check.

Pairs are not listed. In each bucket every fingerprint is first compared with two centres, the smallest and the largest
one, and components are formed. Only buckets with several components left are looked at again: there, in blocks of
bounded size, the fingerprints outside a block pair's largest component are compared with all others. So no link between
components is lost, and a group of very many near copies costs a few comparisons a member.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, materialise, word_bounds

SEED, SHINGLE, BITS, MOST, PARTS = 42, 4, 64, 4, 9
#: Fingerprints in one block of a bucket that is looked at again.
BLOCK = 2_048

_EDGES = [BITS * k // PARTS for k in range(PARTS + 1)]
SEGMENTS = [((1 << _EDGES[k + 1]) - 1) ^ ((1 << _EDGES[k]) - 1) for k in range(PARTS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ring(start: int, length: int) -> int:
    return sum(SEGMENTS[(start + k) % PARTS] for k in range(length))


#: Fingerprints that chance may leave in a bucket, on average, before keys get longer.
CHANCE = 32


def _agreeing(many: int) -> list[tuple[int, ...]]:
    """The ways in which the first `many` agreeing segments of a chain within its budgets can lie."""
    return [c for c in combinations(range(PARTS), many) if all(x - k <= x * MOST // PARTS for k, x in enumerate(c))]


def keys(distinct: int) -> list[tuple[int, int]]:
    """(start of the chain, mask of the key) for so many distinct fingerprints; any length finds all pairs."""
    many = next((n for n in (3, 4) if distinct <= CHANCE << (n * BITS // PARTS)), 5)
    return [(k, _signed(sum(SEGMENTS[(k + x) % PARTS] for x in c))) for k in range(PARTS) for c in _agreeing(many)]


#: For each start: masks of the chains of 3 to 9 segments and the differences they may hold.
CHAINS = {k: [(_signed(_ring(k, n)), n * MOST // PARTS) for n in range(3, PARTS + 1)] for k in range(PARTS)}


def fingerprint(text: str | None) -> int:
    """The SimHash of one text, unsigned; zero if it has no words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, starts, ends = word_bounds(words)
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)]
    n, total = len(hashes), np.zeros(BITS, np.int64)
    for at in range(0, n, 255 * 64):
        bits = np.unpackbits(np.array(hashes[at : at + 255 * 64], "<u8").view(np.uint8), bitorder="little").reshape(-1, BITS)
        for k in range(0, len(bits), 255):
            total += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) with the fingerprint as a signed 64-bit number, for every row of docs."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(x) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], [key, "fp"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, fp long")


def _passes(a: Column, b: Column) -> Column:
    """Whether a and b keep within the budgets of all chains from the start that their bucket stands for."""
    diff, out = a.bitwiseXOR(b), None
    for k, chains in CHAINS.items():
        ok = None
        for mask, most in chains:
            one = F.bit_count(diff.bitwiseAND(F.lit(mask))) <= most
            ok = one if ok is None else ok & one
        out = F.when(F.col("start") == k, ok) if out is None else out.when(F.col("start") == k, ok)
    return out


def _between(block: pd.DataFrame) -> pd.DataFrame:
    """Links between components within one pair of blocks: those outside the largest component against all."""
    fp, node, label = (block[c].to_numpy() for c in ("fp", "rep", "component"))
    names, counts = np.unique(label, return_counts=True)
    links = []
    for at in np.flatnonzero(label != names[counts.argmax()]):
        diff = (fp ^ fp[at]).view(np.uint64)
        near = label != label[at]
        for mask, most in CHAINS[int(block["start"].iloc[0])]:
            near &= np.bitwise_count(diff & np.uint64(mask & (1 << 64) - 1)) <= most
        if near.any():
            _, first = np.unique(label[near], return_index=True)
            links += [(node[at], x) for x in node[near][first]]
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def _distinct_components(reps: DataFrame) -> DataFrame:
    """(rep, component) for the representatives (fp, rep) of distinct fingerprints that have any link."""
    spark = reps.sparkSession
    each = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(start).alias("start"), F.col("fp").bitwiseAND(F.lit(mask)).alias("k")) for j, (start, mask) in enumerate(keys(reps.count()))])).alias("key")
    keyed = reps.select("fp", "rep", each).select("fp", "rep", "key.*")
    me = F.struct("fp", "rep")
    buckets = keyed.groupBy("j", "k").agg(F.count("*").alias("n"), F.min(me).alias("low"), F.max(me).alias("high")).where("n > 1")
    met = materialise(keyed.join(buckets, ["j", "k"]))
    centre = F.explode(F.array("low", "high")).alias("c")
    links = met.select("start", "fp", "rep", centre).where("rep <> c.rep").where(_passes(F.col("fp"), F.col("c.fp"))).select(F.col("rep").alias("a"), F.col("c.rep").alias("b"))
    first = materialise(connected_components(links))
    # Buckets of up to three fingerprints have no pair that was not compared with a centre.
    left = met.where("n > 3").join(first.withColumnRenamed("node", "rep"), "rep", "left").select("j", "k", "start", "n", "fp", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = left.groupBy("j", "k").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("j", "k")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = left.join(mixed, ["j", "k"]).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
    # A stated number of partitions: few bytes stand for much work here, so they must not be joined into one task.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    more = materialise(paired.repartition(tasks, "j", "k", "x", "y").groupBy("j", "k", "x", "y").applyInPandas(_between, "a long, b long"))
    if more.isEmpty():
        return first.toDF("rep", "component")
    stars = first.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return connected_components(stars.unionByName(more)).toDF("rep", "component")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) for every row of docs; key must be a long.

    A null text counts as empty; texts without words have fingerprint zero and are linked like any other. Rows with a
    null key get their fingerprint but link nothing, and have a null component. Repeated rows and rows that share a key
    count as copies. An empty table gives an empty table; other columns are not read.
    """
    fps = materialise(fingerprints(docs, key, text))
    reps = materialise(fps.where(F.col(key).isNotNull()).groupBy("fp").agg(F.min(key).alias("rep")))
    # A key with several texts is one node: its fingerprints are linked through it.
    shared = fps.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.count("*").alias("n")).where("lo < hi").select(key)
    linked = _distinct_components(reps)
    if not shared.isEmpty():
        node = fps.join(shared, key).join(reps, "fp").select(F.col(key).alias("a"), F.col("rep").alias("b"))
        stars = linked.select(F.col("rep").alias("a"), F.col("component").alias("b"))
        linked = connected_components(stars.unionByName(node)).toDF("rep", "component")
    named = reps.join(linked, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    out = fps.join(named, "fp", "left")
    return out.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col(key).isNotNull(), F.col("component")).alias("component_id"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component, that of its smallest key; rows with a null key stay. All columns stay.

    Of rows that share that key the one with the smallest text stays, nulls first.
    """
    kept = components(docs, key, text).where(F.col(key) == F.col("component_id")).select(key).distinct()
    rows = docs.join(materialise(kept), key, "left_semi").select(F.struct(*docs.columns).alias("row"))
    order = Window.partitionBy(f"row.{key}").orderBy(f"row.{text}")
    one = rows.withColumn("r", F.row_number().over(order)).where("r = 1").select("row.*")
    return one.unionByName(docs.where(F.col(key).isNull()))
