"""Module clustering: the clustering graph, label propagation per connected component, cohesion and names."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import stable_id
from ..shared import materialised, remove
from .numbering import numbered

#: Entities of one file are linked with each other if there are 2 to this many.
CLIQUE = 30
SWEEPS = 100
#: Components of up to this many edges are swept in one task each, larger ones by joins; the labels are the same.
ONE_TASK = 100_000


def clustering_edges(edges: DataFrame, nodes: DataFrame, types: list[str]) -> DataFrame:
    """(a, b), a < b, distinct: edges of the types between nodes, and pairs in the same file of 2 to CLIQUE entities."""
    ids = nodes.select("id")
    direct = edges.where(F.col("rel_type").isin(*types)).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    filed = nodes.where("file_path is not null").select("id", "file_path")
    small = filed.groupBy("file_path").agg(F.count("*").alias("n")).where(f"n between 2 and {CLIQUE}").select("file_path")
    inside = filed.join(small, "file_path").select("file_path", "id")
    pairs = inside.withColumnRenamed("id", "src").join(inside.withColumnRenamed("id", "dst"), "file_path").where("src < dst")
    both = direct.select("src", "dst").unionByName(pairs.select("src", "dst")).where("src <> dst")
    return both.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that can be reached, by alternating minimum steps with pointer jumps.

    A round is written to the shared folder, and the one before it is removed.
    """
    both = materialised(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))))
    label = materialised(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("l")))
    before = None
    for _ in range(rounds):
        near = both.join(label.select(F.col("x").alias("y"), "l"), "y").groupBy("x").agg(F.min("l").alias("m"))
        step = label.join(near, "x").select("x", F.least("l", "m").alias("l"))
        jump = step.join(step.select(F.col("x").alias("l"), F.col("l").alias("ll")), "l", "left").select("x", F.least("l", F.coalesce("ll", "l")).alias("l"))
        old, label = label, materialised(jump)
        remove(old)
        now = tuple(label.agg(F.sum(F.xxhash64("x", "l").cast("decimal(38,0)"))).first())
        if now == before:
            return label.toDF("id", "component")
        before = now
    raise RuntimeError("components did not settle")


def sweep(adjacency: dict[str, set[str]], sweeps: int = SWEEPS) -> dict[str, str]:
    """Labels after sequential sweeps in sorted order: the commonest label around, ties to the first sorted neighbour's."""
    label = {n: n for n in adjacency}
    for _ in range(sweeps):
        changed = False
        for n in sorted(adjacency):
            around = [label[m] for m in sorted(adjacency[n])]
            if not around:
                continue
            counts = Counter(around)
            most = max(counts.values())
            new = next(x for x in around if counts[x] == most)
            changed |= new != label[n]
            label[n] = new
        if not changed:
            break
    return label


def sweep_large(edges: DataFrame, sweeps: int = SWEEPS) -> DataFrame:
    """(id, community) as sweep() gives them, by joins over the edges (a, b), so that no component meets in one task.

    In a sweep a node sees the new labels of smaller nodes and the old ones of larger nodes. New labels start as the old
    ones and are voted anew until none changes: then every node agrees with the smaller ones around it, which only the
    sequential sweep's labels do. That takes as many rounds as changes follow one another in a sweep, and one more.
    """
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).where("x <> y").distinct()
    both = materialised(both)
    label, written = both.select(F.col("x").alias("id"), F.col("x").alias("old"), F.col("x").alias("new")).distinct(), None
    for _ in range(sweeps):
        first = True
        while True:
            seen = both.join(label.withColumnRenamed("id", "y"), "y").select("x", "y", F.when(F.col("y") < F.col("x"), F.col("new")).otherwise(F.col("old")).alias("community"))
            votes = seen.groupBy("x", "community").agg(F.count("*").alias("v"), F.min("y").alias("y"))
            won = votes.groupBy("x").agg(F.min_by("community", F.struct(-F.col("v"), "y")).alias("won"))
            step = label.join(won, F.col("id") == F.col("x")).select("id", "old", F.col("won").alias("new"), (F.col("won") != F.col("new")).alias("moved"))
            step = materialised(step)
            moved = not step.where("moved").isEmpty()
            if written is not None:
                remove(written)
            written, label = step, step.drop("moved")
            if not moved:
                break
            first = False
        # Without a round that moved a label, the whole sweep changed nothing.
        if first:
            break
        label = label.select("id", F.col("new").alias("old"), "new")
    return label.select("id", F.col("new").alias("community"))


def label_propagation(edges: DataFrame, nodes: DataFrame | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """(id, community) for every node of edges (a, b), by sequential sweeps in sorted order at every size.

    nodes (id) without an edge keep their own id as community. Components do not interact, so each whose edges fit
    one_task is swept alone there, and the larger ones by joins; their labels do not depend on which way is taken.
    """
    comps = materialised(components(edges))
    placed = edges.join(comps, F.col("a") == F.col("id")).select("component", "a", "b")
    size = placed.groupBy("component").agg(F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        adjacency: dict[str, set[str]] = {}
        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            adjacency.setdefault(a, set()).add(b)
            adjacency.setdefault(b, set()).add(a)
        return pd.DataFrame(sorted(sweep(adjacency).items()), columns=["id", "community"])

    out = placed.join(size.where(F.col("n") <= one_task), "component").select("component", "a", "b").groupBy("component").applyInPandas(run, "id string, community string")
    large = placed.join(size.where(F.col("n") > one_task), "component").select("a", "b")
    if not large.isEmpty():
        out = out.unionByName(sweep_large(large))
    if nodes is not None:
        alone = nodes.select("id").distinct().join(comps.select("id"), "id", "left_anti")
        out = out.unionByName(alone.select("id", F.col("id").alias("community")))
    return out


def cohesion(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(community, n, n_inside, cohesion) from (id, community): inside edges over all possible pairs, zero for one node."""
    a, b = members.select(F.col("id").alias("a"), F.col("community").alias("ca")), members.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    inside = edges.join(a, "a").join(b, "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("n_inside"))
    size = members.groupBy("community").agg(F.count("*").alias("n"))
    possible = F.col("n") * (F.col("n") - 1) / 2
    return size.join(inside, "community", "left").select("community", "n", F.coalesce("n_inside", F.lit(0)).alias("n_inside"), F.when(F.col("n") > 1, F.coalesce("n_inside", F.lit(0)) / possible).otherwise(0.0).alias("cohesion"))


def described(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(community, name, classes, n_functions): the last part of the members' common path, their classes and functions.

    Members of one file alone are named by it. The name is null where no member has a path, or they share no folder; null
    and empty paths are left out, and a path from the root shares nothing with one that is not.
    """
    path = F.when(F.col("file_path") != "", F.col("file_path"))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    parts = F.when(F.startswith(path, F.lit("/")), F.concat(F.array(F.lit("")), parts)).otherwise(parts)
    full = members.join(nodes, "id").withColumn("parts", parts)
    # The common prefix of all paths is that of the smallest and the largest one.
    ends = full.groupBy("community").agg(F.min("parts").alias("lo"), F.max("parts").alias("hi"), F.array_sort(F.collect_set(F.when(F.col("entity_type") == "class", F.col("name")))).alias("names"), F.count_if(F.col("entity_type") == "function").alias("n_functions"))
    same = F.expr("aggregate(sequence(0, greatest(least(size(lo), size(hi)) - 1, 0)), 0, (k, i) -> case when k = i and i < size(lo) and i < size(hi) and lo[i] = hi[i] then k + 1 else k end)")
    return ends.withColumn("k", same).select("community", F.when(F.col("k") > 0, F.nullif(F.element_at("lo", F.greatest(F.col("k"), F.lit(1))), F.lit(""))).alias("name"), F.array_join("names", ",").alias("classes"), "n_functions")


def named(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """described() with module_{N} for communities without a name, N from 0 in order of the communities."""
    found = described(members, nodes)
    counted = numbered(found.where("name is null").select("community"), "k", "community")
    return found.join(counted, "community", "left").select("community", F.coalesce("name", F.concat(F.lit("module_"), F.col("k").cast("string"))).alias("name"), "classes", "n_functions")


@dataclass
class Modules:
    """Detected modules as nodes (id, community, name, description, size, cohesion), edges to what they contain (src, dst, rel_type), and the tree as rows (parent, child, cohesion, entity_count)."""

    nodes: DataFrame
    contains: DataFrame
    tree: DataFrame


def saved(edges: DataFrame, members: DataFrame, nodes: DataFrame) -> Modules:
    """What is kept of the communities members (id, community) of edges (a, b) between nodes (id, file_path, entity_type, name).

    The description lists classes and the number of functions, null if there are neither. The tree is keyed by name; of
    modules of equal name the last community counts.
    """
    members = members.select("id", "community").distinct()
    described_ = F.concat_ws(" | ", F.when(F.col("classes") != "", F.concat(F.lit("Classes: "), F.replace("classes", F.lit(","), F.lit(", ")))), F.when(F.col("n_functions") > 0, F.concat(F.col("n_functions").cast("string"), F.lit(" function(s)"))))
    found = modules(members).join(named(members, nodes), "community").join(cohesion(edges, members).select("community", "cohesion"), "community")
    made = materialised(found.select(F.col("module_id").alias("id"), "community", "name", F.nullif(described_, F.lit("")).alias("description"), F.col("n").alias("size"), "cohesion"))
    inside = members.join(made.select("community", F.col("id").alias("src")), "community")
    last = made.groupBy("name").agg(F.max("community").alias("community"))
    top = made.join(last, ["name", "community"]).select("community", "name", "cohesion", "size")
    tree = members.join(top, "community").select(F.col("name").alias("parent"), F.col("id").alias("child"), "cohesion", F.col("size").alias("entity_count"))
    return Modules(made, inside.select("src", F.col("id").alias("dst"), F.lit("contains").alias("rel_type")), tree)


def set_classes(sets: DataFrame) -> DataFrame:
    """(id, rep) for sets (id, item): rep is the smallest id with the same items, told by their number and digests."""
    distinct = sets.where("id is not null and item is not null").distinct()
    print_of = [F.count("*"), *(F.sum(h.cast("decimal(38,0)")) for h in (F.xxhash64("item"), F.xxhash64("item", F.lit(1))))]
    prints = distinct.groupBy("id").agg(*[c.alias(f"p{k}") for k, c in enumerate(print_of)])
    least = prints.groupBy("p0", "p1", "p2").agg(F.min("id").alias("rep"))
    return prints.join(least, ["p0", "p1", "p2"]).select("id", "rep")


#: Longs of a set's signature: each item sets one of 64 times so many bits.
SIGNATURE = 4


def _signed(sets: DataFrame) -> DataFrame:
    """(id, n, s0, s1, ...): sizes of sets (id, item), and signatures of as many bits in all cases."""
    bit = F.pmod(F.xxhash64("item"), F.lit(64 * SIGNATURE))
    words = [F.bit_or(F.when(F.shiftright(bit, 6) == w, F.expr("shiftleft(1L, cast(bit % 64 as int))")).otherwise(F.lit(0).cast("long"))).alias(f"s{w}") for w in range(SIGNATURE)]
    return sets.withColumn("bit", bit).groupBy("id").agg(F.count("*").alias("n"), *words)


def _prefix(sets: DataFrame, often: DataFrame, name: str, kept: Column, least: float) -> DataFrame:
    """The first kept items of each set, in order of often (item, f): the set's id, size, signature and the item's place, under names with the given ending.

    d is the set's part of the items that two sets may have alone. The number of partitions is stated: few bytes make
    many pairs, which would otherwise meet in one task.
    """
    at = F.row_number().over(Window.partitionBy("id").orderBy("f", "item"))
    alone = F.col("n") * F.lit((1 - least) / (1 + least)) + 1e-6
    out = sets.join(often, "item").withColumn("p", at).join(_signed(sets), "id").where(F.col("p") <= kept).withColumn("d", alone)
    out = out.select("item", F.col("id").alias(name), *[F.col(c).alias(c + name) for c in ("n", "p", "d", *[f"s{w}" for w in range(SIGNATURE)])])
    return out.repartition(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "item")


def _possible(a: str, b: str, least: float) -> Column:
    """Whether two sets that share an item can overlap by more than least: by their signatures, their sizes, and the places of the item, if it is their first common one."""
    # Every bit in which two signatures differ stands for an item, at least, that one of the sets has alone.
    differ = sum((F.bit_count(F.col(f"s{w}{a}").bitwiseXOR(F.col(f"s{w}{b}"))) for w in range(1, SIGNATURE)), F.bit_count(F.col(f"s0{a}").bitwiseXOR(F.col(f"s0{b}"))))
    na, nb = F.col("n" + a), F.col("n" + b)
    enough = lambda k: k / (na + nb - k) > least
    return (differ < F.col("d" + a) + F.col("d" + b)) & enough(F.least(na, nb)) & enough(F.least(na - F.col("p" + a), nb - F.col("p" + b)) + 1)


def jaccard(sets: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, overlap) with a < b for pairs of unequal sets (id, item) whose overlap is above least.

    Equal sets count once, under their smallest id (set_classes), so copies give no pairs. Prefix filtering: items are
    ordered from rare to frequent, and only sets that share one of the smaller one's first n - ceil(2 least / (1 + least) n)
    + 1 items and of the larger one's first n - ceil(least * n) + 1 meet; exact, since any other pair overlaps too little.
    Sizes, places and signatures travel with the items, so that pairs that can't overlap enough are dropped where they
    meet, before anything is shuffled; the others are joined with both sets to count what they share.
    """
    distinct = sets.where("id is not null and item is not null").distinct()
    distinct = materialised(distinct.join(set_classes(sets).where("id = rep").select("id"), "id", "left_semi"))
    often = distinct.groupBy("item").agg(F.count("*").alias("f"))
    n = F.col("n")
    larger = _prefix(distinct, often, "y", n - F.ceil(F.lit(least) * n) + 1, least)
    # A little less than the bound, for the bound itself is a rounded number.
    smaller = _prefix(distinct, often, "x", n - F.ceil(F.lit(2 * least / (1 + least) - 1e-9) * n) + 1, least)
    ordered = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    met = smaller.join(larger, "item").where(_possible("x", "y", least) & ordered).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    items = distinct.groupBy("id").agg(F.collect_list("item").alias("items"))
    both = met.join(items.toDF("a", "ia"), "a").join(items.toDF("b", "ib"), "b")
    common = F.size(F.array_intersect("ia", "ib"))
    return both.select("a", "b", (common / (F.size("ia") + F.size("ib") - common)).alias("overlap")).where(F.col("overlap") > least)


def overlaps(left: DataFrame, right: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, overlap) for sets a of left and b of right, both (id, item), whose overlap is above least.

    Of equal sets one on each side is compared, that of the smallest id. For a set of left all b of equal items have the
    same overlap, so only the smallest of them is given; sets of left that are equal are all given. Both sides' items are
    in one order, from rare to frequent, and only sets that share an item of their first n - ceil(least * n) + 1 meet, at
    such places in both that the rest can still make up the overlap, and with signatures that allow it.
    """
    sides, all_items = [], None
    # Both sides may be long plans; each is run once.
    given = [materialised(x.where("id is not null and item is not null").select("id", "item").distinct()) for x in (left, right)]
    classes = [materialised(set_classes(x)) for x in given]
    for distinct, of in zip(given, classes, strict=True):
        sides.append(materialised(distinct.join(of.where("id = rep").select("id"), "id", "left_semi")))
    all_items = sides[0].select("item").unionByName(sides[1].select("item")).groupBy("item").agg(F.count("*").alias("f"))
    kept = F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1
    a, b = _prefix(sides[0], all_items, "a", kept, least), _prefix(sides[1], all_items, "b", kept, least)
    met = a.join(b, "item").where(_possible("a", "b", least)).select("a", "b").distinct()
    items = [x.groupBy("id").agg(F.collect_list("item").alias("items")) for x in sides]
    both = met.join(items[0].toDF("a", "ia"), "a").join(items[1].toDF("b", "ib"), "b")
    common = F.size(F.array_intersect("ia", "ib"))
    found = both.select("a", "b", (common / (F.size("ia") + F.size("ib") - common)).alias("overlap")).where(F.col("overlap") > least)
    return classes[0].select("id", F.col("rep").alias("a")).join(found, "a").select(F.col("id").alias("a"), "b", "overlap")


def modules(members: DataFrame) -> DataFrame:
    """(community, module_id, n): a module's id stands for its members (id), whatever their order and the community's name.

    Members stay rows: the digits of their digests are added up, so no row holds a module's members.
    """
    digits = F.conv(F.substring(F.md5("id"), 1, 12), 16, 10).cast("decimal(38,0)")
    per = members.select("community", "id").distinct().groupBy("community").agg(F.sum(digits).alias("s"), F.count("*").alias("n"))
    return per.select("community", stable_id(F.lit("module"), F.col("s"), F.col("n")).alias("module_id"), "n")
