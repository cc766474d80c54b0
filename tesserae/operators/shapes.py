"""Constraint shapes: a path from each entity, a predicate over the values at its ends, a severity, and fused decisions.

A shape is evaluated for all entities in one plan. Predicates that ask for some value (in, equals, exists, comparisons)
need only the set of ends that satisfy them, so the plan walks backwards from those ends and the filter comes first;
those that ask for all values (not_in, not_equals) aggregate a boolean per entity, combined before the shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import FUSION, lowered
from ..graph import Graph

STEP = re.compile(r"(\^?)([A-Za-z_]+)(\+|\*|\{(\d+)(?:(,)(\d*))?\})?$")
SOME = {"in": lambda c, v: c.isin(*v), "equals": lambda c, v: c == v, "exists": lambda c, v: c.isNotNull(), ">": lambda c, v: c > v, "<": lambda c, v: c < v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v}
ALL = {"not_in": lambda c, v: ~c.isin(*v), "not_equals": lambda c, v: c != v}


@dataclass(frozen=True)
class Shape:
    id: str
    path: str
    field: str
    operator: str
    value: object
    severity: str
    priority: int = 0
    suggestion: str = ""
    label: str = "CodeEntity"
    operation: str = "UPDATE"
    max_depth: int = 3
    enabled: bool = True
    unless: tuple[str, tuple] | None = None
    field_filter: str | None = None
    allow: tuple[str, ...] = field(default=())
    name: str = ""
    description: str = ""
    ontology_ref: str | None = None
    confidence: float = 1.0


def parse_path(path: str, max_depth: int = 3, known: set[str] | None = None) -> tuple[list[tuple[bool, str, int, int]], str | None]:
    """Steps (reversed, relation, least, most) and the end's label; SELF has none. Bad paths raise ValueError."""
    if path.strip() == "SELF":
        return [], None
    head, arrow, label = (x.strip() for x in path.partition("->"))
    if not arrow or not label.isidentifier():
        raise ValueError(f"no end label in {path!r}")
    steps = []
    for token in head.split("/"):
        m = STEP.match(token.strip())
        if not m or (known is not None and m[2].lower() not in known):
            raise ValueError(f"bad step {token!r}")
        least, most = {"+": (1, max_depth), "*": (0, max_depth), None: (1, 1)}.get(m[3], (0, 0))
        if m[4]:
            # {m} is not capped, {m,} goes up to the greatest depth
            least = int(m[4])
            most = min(int(m[6] or max_depth), max_depth) if m[5] else least
        if least > most:
            raise ValueError(f"no hops in {token!r}")
        steps.append((bool(m[1]), m[2].lower(), least, most))
    if len(steps) > max_depth:
        raise ValueError("the path is too deep")
    return steps, label


def _walk(edges: DataFrame, ends: DataFrame, steps: list[tuple[bool, str, int, int]]) -> DataFrame:
    """(id, ...) with each row of ends (id, ...) moved backwards over the steps; distinct after each hop."""
    for back, kind, least, most in reversed(steps):
        step = edges.where(F.col("rel_type") == kind).select(F.col("dst" if back else "src").alias("to"), F.col("src" if back else "dst").alias("id"))
        out = ends if least == 0 else None
        for k in range(1, most + 1):
            ends = ends.join(step, "id").drop("id").withColumnRenamed("to", "id").distinct()
            if k >= least:
                out = ends if out is None else out.unionByName(ends)
        ends = out.distinct()
    return ends


def _field(shape: Shape) -> Column:
    return F.col(shape.field)


def triggered(graph: Graph, shape: Shape) -> DataFrame:
    """(id) of the entities of the shape's label for which it triggers. Null values count as absent; no value, no trigger."""
    steps, label = parse_path(shape.path, shape.max_depth)
    own = graph.labelled(shape.label)
    ends = graph.labelled(label) if label else own
    if shape.operator in SOME:
        hit = ends.where(SOME[shape.operator](_field(shape), shape.value)).select("id")
        hit = _walk(graph.edges, hit, steps) if steps else hit
    elif shape.operator in ALL:
        value = ends.where(_field(shape).isNotNull()).select("id", ALL[shape.operator](_field(shape), shape.value).alias("ok"))
        value = _walk(graph.edges, value, steps) if steps else value
        hit = value.groupBy("id").agg(F.bool_and("ok").alias("ok")).where("ok").select("id")
    else:
        return own.select("id").where("false")
    keep = own
    if shape.field_filter:
        keep = keep.where(shape.field_filter)
    if shape.unless:
        keep = keep.where(~F.coalesce(F.col(shape.unless[0]).cast("string").isin(*map(str, shape.unless[1])), F.lit(False)))
    names = [a.partition(":")[2] for a in shape.allow if a.partition(":")[0] == shape.label]
    if names:
        keep = keep.where(~F.coalesce(F.col("name").isin(*names), F.lit(False)))
    hit = hit if not steps and not (shape.field_filter or shape.unless or names) else keep.select("id").join(hit, "id", "left_semi")
    return hit.distinct() if steps else hit


def not_allowed(graph: Graph, hit: DataFrame, allowed: DataFrame) -> DataFrame:
    """(id) of the triggered entities (id) but for those whose label and name are in a table of allowed ones (label, name)."""
    exempt = graph.nodes.join(allowed.select("label", "name").distinct(), ["label", "name"], "left_semi").select("id")
    return hit.join(exempt, "id", "left_anti")


def results(graph: Graph, shapes: list[Shape], operation: str = "UPDATE") -> DataFrame:
    """(id, shape_id, severity, priority, suggestion) of all triggered shapes; shapes are a list of rules, not data."""
    out = None
    for s in sorted((s for s in shapes if s.enabled and s.operation == operation), key=lambda s: -s.priority):
        one = triggered(graph, s).select("id", F.lit(s.id).alias("shape_id"), F.lit(s.severity).alias("severity"), F.lit(s.priority).alias("priority"), F.lit(s.suggestion).alias("suggestion"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else graph.nodes.where("false").selectExpr("id", "id shape_id", "id severity", "0 priority", "id suggestion")


def fused(entities: DataFrame, found: DataFrame) -> DataFrame:
    """(id, decision, n_triggered, suggestion) for every entity (id).

    None triggered: allow. Any priority of 0 or less: escalate. Else the strongest severity; several blocks of equal
    top priority unite the distinct lines of their suggestions, and escalate if none has any.
    """
    ranks = F.create_map(*[F.lit(x) for pair in FUSION.items() for x in pair])
    rank = F.element_at(ranks, F.col("severity"))
    per = found.withColumn("rank", rank).groupBy("id").agg(
        F.count("*").alias("n"), F.min("priority").alias("least"), F.max("rank").alias("top"),
        F.sort_array(F.collect_list(F.struct("rank", "priority", F.col("shape_id"), "suggestion")), asc=False).alias("all"),
    )
    first = F.col("all")[0]
    equal = F.filter("all", lambda x: (x["rank"] == first["rank"]) & (x["priority"] == first["priority"]))
    lines = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(equal, lambda x: F.transform(F.split(x["suggestion"], "\n"), lambda line: F.trim(line)))), lambda x: x != "")))
    united = F.array_join(lines, "\n")
    clash = (F.col("top") == FUSION["block"]) & (F.size(equal) > 1)
    names = F.create_map(*[F.lit(x) for k, v in FUSION.items() for x in (v, k)])
    decision = F.when(F.col("least") <= 0, "escalate").when(clash & (united == ""), "escalate").otherwise(F.element_at(names, F.col("top")))
    judged = per.select("id", decision.alias("decision"), "n", F.when(clash, united).otherwise(first["suggestion"]).alias("suggestion"))
    return entities.select("id").join(judged, "id", "left").select("id", F.coalesce("decision", F.lit("allow")).alias("decision"), F.coalesce("n", F.lit(0)).alias("n_triggered"), F.coalesce("suggestion", F.lit("")).alias("suggestion"))


#: The shapes over the graph of the supplied tables.
SHAPES = [
    Shape("sensitive_data", "IMPORTS -> CodeEntity", "sensitivity", "in", ("restricted", "confidential"), "block", 10, "Have the data owner review this change."),
    Shape("region_rules", "CALLS/EXTENDS/SEMANTIC_IMPACT -> RepositoryEntity", "name", "in", ("EUROPE", "ASIA"), "block", 10, "Check the rules of the region."),
    Shape("http_entry_point", "SELF", "entry_category", "in", ("http_api", "rpc_service"), "warn", 5, "Keep the interface stable."),
    Shape("large_unit", "SELF", "lines", ">", 100, "warn", 3, "Split this unit."),
    Shape("upstream_chain", "CALLS{1,5} -> CodeEntity", "entry_category", "in", ("http_api", "rpc_service"), "warn", 6, "Test the entry points above.", max_depth=5),
    Shape("open_suppliers", "IMPLEMENTS -> ServiceEntity", "name", "not_in", ("Supplier#1", "Supplier#000000001"), "escalate", 2, "Name the supplier."),
]


def from_ontology(entity_types: DataFrame, properties: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, path, field, operator, value, severity) rules from entity types, enumerated properties and relations.

    Types that are none are skipped; a null confidence is 0.5, of properties 1, above one is one. Relations under 0.7 only allow.
    """
    sure = lambda c, none=0.5: F.least(F.lit(1.0), F.coalesce(c, F.lit(none)))
    types = entity_types.where("coalesce(is_entity_type, true)").select(F.concat(F.lit("type_"), "id").alias("id"), F.lit("SELF").alias("path"), F.lit("name").alias("field"), F.lit("in").alias("operator"), F.col("name").alias("value"), F.lit("warn").alias("severity"), sure(F.col("confidence")).alias("confidence"))
    enums = properties.where("size(enum_values) > 0").select(F.concat(F.lit("enum_"), "id"), F.lit("SELF"), F.col("name"), F.lit("in"), F.array_join("enum_values", ","), F.lit("block"), sure(F.col("confidence"), 1.0))
    paths = relations.select(F.concat(F.lit("rel_"), "id"), F.concat(F.upper("relation_type"), F.lit(" -> "), F.col("range_label")), F.lit("id"), F.lit("exists"), F.lit(None).cast("string"), F.when(sure(F.col("confidence")) < 0.7, "allow").otherwise("warn"), sure(F.col("confidence")))
    return types.union(enums).union(paths)


# Severity and number of directions of each kind of axiom.
AXIOMS = {"DOMAIN": ("warn", 1), "RANGE": ("warn", 1), "DISJOINT_WITH": ("block", 2), "EQUIVALENT_CLASS": ("escalate", 2)}


def from_axioms(axioms: DataFrame, concepts: DataFrame) -> DataFrame:
    """(axiom_id, direction, ontology_ref, value, severity, confidence) rules from axioms (axiom_id, axiom_type, subject, object, confidence).

    Unknown kinds and confidences under 0.7 give none; under 0.9 the severity is lowered. subject and object are ids of
    concepts (concept_id, name), or names where no concept has that id. A null confidence is one.
    """
    kinds = F.create_map(*[x for k, (s, n) in AXIOMS.items() for x in (F.lit(k), F.struct(F.lit(s).alias("severity"), F.lit(n).alias("n")))])
    sure = F.coalesce("confidence", F.lit(1.0))
    known = axioms.select("axiom_id", "axiom_type", "subject", "object", sure.alias("confidence"), F.try_element_at(kinds, F.col("axiom_type")).alias("k")).where("confidence >= 0.7 and k is not null")
    for end in ("subject", "object"):
        names = concepts.select(F.col("concept_id").alias(end), F.col("name").alias(f"{end}_name"))
        known = known.join(names, end, "left").withColumn(f"{end}_name", F.coalesce(f"{end}_name", end, F.lit("")))
    a, b = F.col("subject_name"), F.col("object_name")
    way = lambda d, x, y: F.struct(F.lit(d).alias("direction"), x.alias("ref"), y.alias("to"))
    both = (F.col("k.n") == 2) & (a != "") & (b != "")
    single = way("single", a, F.when(a != "", b).otherwise(""))
    ways = F.when(both, F.array(way("forward", a, b), way("reverse", b, a))).otherwise(F.array(single))
    severity = lowered(F.col("k.severity"), F.when(F.col("confidence") < 0.9, 1).otherwise(0))
    rows = known.select("axiom_id", "axiom_type", severity.alias("severity"), F.least(F.lit(1.0), "confidence").alias("confidence"), F.explode(ways).alias("w"))
    value = F.when(F.col("w.to") != "", F.concat_ws(":", "axiom_type", "w.to")).otherwise(F.col("axiom_type"))
    return rows.select("axiom_id", "w.direction", F.nullif("w.ref", F.lit("")).alias("ontology_ref"), value.alias("value"), "severity", "confidence")


def as_table(spark: SparkSession, shapes: list[Shape]) -> DataFrame:
    """(shape_id, label, operation, severity, priority) of a registry's shapes."""
    return spark.createDataFrame([(s.id, s.label, s.operation, s.severity, s.priority) for s in shapes], "shape_id string, label string, operation string, severity string, priority int")
