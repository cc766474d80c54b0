"""Weighted change impact: level-synchronous breadth-first search from any number of changed nodes at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import materialised
from .numbering import numbered

# Weight of a relation by kind of change (ADDED, DELETED, SIGNATURE, BODY, DOC_ONLY).
CHANGES = ("ADDED", "DELETED", "SIGNATURE", "BODY", "DOC_ONLY")
WEIGHTS = {
    "calls": (0.9, 1.0, 0.9, 0.7, 0.1),
    "implements": (0.8, 1.0, 0.8, 0.5, 0.1),
    "extends": (0.8, 0.9, 0.9, 0.6, 0.1),
    "imports": (0.5, 0.6, 0.5, 0.3, 0.0),
    "semantic_impact": (0.4, 0.5, 0.5, 0.4, 0.2),
    "describes": (0.3, 0.3, 0.3, 0.2, 0.3),
}
# Decay by depth, and the least score that counts.
DECAY = (1.0, 0.6, 0.3)
LEAST = 0.05


def weight(rel_type: Column, change: Column) -> Column:
    """The weight as an expression, so that no join is needed; unknown relations and changes weigh nothing."""
    known = [(f"{r}|{c}", w) for r, ws in WEIGHTS.items() for c, w in zip(CHANGES, ws, strict=True)]
    lookup = F.create_map(*[F.lit(x) for pair in known for x in pair])
    return F.coalesce(F.try_element_at(lookup, F.concat_ws("|", rel_type, change)), F.lit(0.0))


def severity(score: Column) -> Column:
    return F.when(score >= 0.8, "CRITICAL").when(score >= 0.5, "HIGH").when(score >= 0.2, "MEDIUM").otherwise("LOW")


#: Relations in a path are digits, three bits each, and a walk is a number: its source's number and its path behind it.
KINDS = sorted(WEIGHTS)
PATH_BITS, WALK_BITS, UNIT = 9, 43, 1000
LAST = (1 << WALK_BITS) - 1


def _source(walk: Column) -> Column:
    return F.shiftright(walk, PATH_BITS)


def _longer(walk: Column, digit: Column) -> Column:
    """A walk with one more relation."""
    path = walk.bitwiseAND(F.lit((1 << PATH_BITS) - 1).cast("long"))
    return walk - path + path * 8 + digit


#: Ends of a relation where a step begins and where it leads, by direction.
WAYS = {"FORWARD": ("dst", "src"), "BACKWARD": ("src", "dst")}
#: First characters of an id that steps are chosen by, and how many different ones are told apart.
HEAD, HEADS = 2, 32


def _heads(ids: DataFrame, column: str) -> list[str] | None:
    """The different first characters of a column's ids; None: too many to tell apart."""
    found = [r.head for r in ids.where(F.col(column).isNotNull()).select(F.substring(column, 1, HEAD).alias("head")).distinct().limit(HEADS + 1).collect()]
    return found if len(found) <= HEADS else None


def _begins(column: str, heads: list[str] | None) -> Column:
    if heads is None:
        return F.col(column).isNotNull()
    out = F.lit(False)
    for head in heads:
        out |= F.col(column).startswith(head)
    return out


def impact(edges: DataFrame, changed: DataFrame, depth: int = 3) -> DataFrame:
    """(change, direction, node_id, score, depth, source_node_id, relation_path) from changed (id, change): each node's best score over all changed nodes, and a walk that gives it.

    FORWARD goes to nodes that depend on a changed one, BACKWARD to those it depends on. A score is a relation's weight
    times the depth's decay, not multiplied along the path. Scores below LEAST do not count, and nothing is an impact of
    itself. Of equal scores the smaller depth counts. Null ids never match; repeated rows count once. The walk's source is
    the smallest of those whose walks give score and depth over such a last step; if that is the node itself, the largest.
    Its relations are the least in alphabetical order, or the greatest for the largest source.

    A later visit of a node can only lower the scores beyond it, so a level needs no memory of those before: its rows are
    the nodes at that distance, one per direction, however many changed nodes reach them. Each keeps, for each kind of
    change, its smallest and its largest walk, which also tell whether one is from another than the node itself. Walks are
    numbers, so levels are aggregates over numbers; they are written to the shared folder.

    Of the edges only those whose end begins as some id of the level before does are shuffled, once a level; kinds of
    change with the same walks are bits of one row. Only steps to what may be a changed node look up its number.
    """
    bits = {c: 1 << k for k, c in enumerate(CHANGES)}
    bit = F.coalesce(*[F.when(F.col("change") == c, b) for c, b in bits.items()])
    starts = changed.where(F.col("id").isNotNull() & F.col("change").isin(*CHANGES)).groupBy("id").agg(F.bit_or(bit).alias("mask"))
    numbers = materialised(numbered(starts, "no", "id"))
    present = numbers.agg(F.bit_or("mask").alias("m")).first().m or 1
    kinds = [c for c in CHANGES if present & bits[c]]
    own_heads = _heads(numbers, "id")
    digit = F.array_position(F.array(*map(F.lit, KINDS)), F.col("rel_type")).cast("int")
    walk = F.shiftleft("no", PATH_BITS)
    first = numbers.select(F.col("id").alias("at"), "mask", walk.alias("lo"), walk.alias("hi"))
    fronts, heads = {d: first for d in WAYS}, {d: own_heads for d in WAYS}
    found, last = None, min(depth, len(DECAY))
    for d in range(1, last + 1):
        scores = {c: [w if (w := WEIGHTS[r][CHANGES.index(c)] * DECAY[d - 1]) >= LEAST else 0.0 for r in KINDS] for c in kinds}
        counts = F.element_at(F.array(*[F.lit(sum(bits[c] for c in kinds if scores[c][k])) for k in range(len(KINDS))]), F.col("digit"))
        used = [r for k, r in enumerate(KINDS) if any(scores[c][k] for c in kinds)]
        met = None
        for number, (direction, (a, b)) in enumerate(WAYS.items()):
            steps = edges.select(F.col(a).alias("at"), F.col(b).alias("to"), "rel_type").where(F.col("rel_type").isin(*used) & _begins("at", heads[direction])).select("at", "to", digit.alias("digit"))
            if d > 1 and (heads[direction] == [] or steps.isEmpty()):
                continue

            def reached(some: DataFrame, front: DataFrame = fronts[direction], number: int = number, counts: Column = counts) -> DataFrame:
                longer = [_longer(F.col(w), F.col("digit")).alias(w) for w in ("lo", "hi")]
                return front.join(some, "at").select("to", "digit", F.col("mask").bitwiseAND(counts).alias("mask"), *longer, F.lit(number).alias("way")).where("mask <> 0")

            own = _begins("to", own_heads)
            parts = [reached(steps.where(~F.coalesce(own, F.lit(False)))).withColumn("own", F.lit(-1).cast("long"))]
            if not steps.where(own).isEmpty():
                parts.append(reached(steps.where(own)).join(numbers.select(F.col("id").alias("to"), F.col("no").alias("own")), "to", "left").withColumn("own", F.coalesce("own", F.lit(-1).cast("long"))))
            for part in parts:
                met = part if met is None else met.unionByName(part)
        if met is None:
            break
        other = (_source(F.col("lo")) != F.col("own")) | (_source(F.col("hi")) != F.col("own"))
        # Steps with the same direction, relation and kinds of change are one row: a bit each for direction and other, then the rest.
        code = F.col("way") + other.cast("int") * 2 + F.col("digit") * 4 + F.col("mask") * 32
        reduced = met.groupBy("to", code.alias("code")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("own").alias("own"))
        field = lambda at, ones: F.shiftright("code", at).bitwiseAND(F.lit(ones))
        columns = [F.max("own").alias("own")]
        for k, c in enumerate(kinds):
            has = field(5, bits[c]) != 0
            score = F.element_at(F.array(*[F.lit(round(x * UNIT)).cast("long") for x in scores[c]]), field(2, 7))
            best = lambda w, has=has, score=score: F.max(F.when(has & (field(1, 1) == 1), F.shiftleft(score, WALK_BITS) + w))  # noqa: B023, E731
            columns += [F.min(F.when(has, F.col("lo"))).alias(f"lo{k}"), F.max(F.when(has, F.col("hi"))).alias(f"hi{k}"), best(LAST - F.col("lo")).alias(f"least{k}"), best(F.col("hi")).alias(f"most{k}")]
        level = reduced.groupBy(F.col("to").alias("at"), field(0, 1).alias("way")).agg(*columns)
        ranks = []
        for k in range(len(kinds)):
            small, large = LAST - F.col(f"least{k}").bitwiseAND(F.lit(LAST)), F.col(f"most{k}").bitwiseAND(F.lit(LAST))
            chosen = F.when(_source(small) != F.col("own"), small).otherwise(large)
            ranks.append((F.shiftleft(F.shiftright(f"least{k}", WALK_BITS) * 4 + 3 - d, WALK_BITS) + LAST - chosen).alias(f"rank{k}"))
        walks = [f"{w}{k}" for k in range(len(kinds)) for w in ("lo", "hi")]
        level = level.select("at", "way", *ranks, *walks)
        if d < last:
            level = materialised(level)
            pairs = F.array(*[F.struct(F.col(f"lo{k}").alias("lo"), F.col(f"hi{k}").alias("hi")) for k in range(len(kinds))])
            mask = sum((F.when((F.col(f"lo{k}") == F.col("w.lo")) & (F.col(f"hi{k}") == F.col("w.hi")), bits[c]).otherwise(0) for k, c in enumerate(kinds)), F.lit(0))
            front = level.withColumn("w", F.explode(F.array_distinct(pairs))).where("w.lo is not null").select("at", "way", mask.alias("mask"), "w.lo", "w.hi")
            for number, direction in enumerate(WAYS):
                mine = level.where(F.col("way") == number)
                fronts[direction], heads[direction] = front.where(F.col("way") == number).drop("way"), _heads(mine, "at")
        ranked = level.select(F.col("at").alias("node_id"), "way", *[f"rank{k}" for k in range(len(kinds))])
        found = ranked if found is None else found.unionByName(ranked)
    # A row a node, whatever the directions and kinds of change, so that what follows by node needs no other shuffle.
    ways = [(F.lit(c).alias("change"), F.lit(direction).alias("direction"), f"rank{k}_{number}", F.max(F.when(F.col("way") == number, F.col(f"rank{k}")))) for k, c in enumerate(kinds) for number, direction in enumerate(WAYS)]
    best = found.groupBy("node_id").agg(*[x.alias(name) for _, _, name, x in ways])
    best = best.select("node_id", F.explode(F.array(*[F.struct(c, direction, F.col(name).alias("rank")) for c, direction, name, _ in ways])).alias("x")).select("node_id", "x.*").where("rank is not null")
    walk = LAST - F.col("rank").bitwiseAND(F.lit(LAST))
    named = best.withColumn("no", _source(walk)).join(numbers.select("no", F.col("id").alias("source_node_id")), "no")
    return named.select("change", "direction", "node_id", *_decoded(F.col("rank")), "source_node_id", _path(walk).alias("relation_path"))


def _decoded(rank: Column) -> list[Column]:
    return [(F.shiftright(rank, WALK_BITS + 2) / UNIT).alias("score"), (3 - F.shiftright(rank, WALK_BITS).bitwiseAND(F.lit(3))).cast("int").alias("depth")]


def _path(walk: Column) -> Column:
    digits = [F.shiftright(walk, 3 * k).bitwiseAND(F.lit(7)).cast("int") for k in (2, 1, 0)]
    return F.array_compact(F.array(*[F.try_element_at(F.array(*map(F.lit, KINDS)), F.when(d > 0, d)) for d in digits]))


def merged(impacts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The best row per node and direction over all lists and kinds of change, with severity: ties to the smaller depth, then the smaller source, then the smaller path."""
    # A row's score as a whole number, so that scores that differ by rounding alone tie.
    least = F.min(F.struct((-F.round(F.col("score") * 1_000_000).cast("long")).alias("s"), "depth", "source_node_id", "relation_path"))
    best = impacts.groupBy("node_id", "direction").agg(least.alias("b")).select("node_id", "direction", (-F.col("b.s") / 1_000_000).alias("score"), "b.depth", "b.source_node_id", "b.relation_path")
    named = best.join(nodes.select(F.col("id").alias("node_id"), "label", "name", "file_path"), "node_id")
    return named.select("node_id", "label", "name", "file_path", "direction", F.round("score", 6).alias("impact_score"), severity(F.col("score")).alias("severity"), "depth", "source_node_id", "relation_path")


def report(rows: DataFrame) -> DataFrame:
    """(severity, n, n_files) of merged impacts."""
    return rows.groupBy("severity").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("n_files"))
