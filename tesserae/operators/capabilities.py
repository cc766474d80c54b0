"""Capabilities of entry points and message topics, as projections and keyed aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import business_domain, searchable, stable_id, stripped

# Categories that make a capability, and verbs that a name may begin with.
CATEGORIES = ("http_api", "rpc_service")
VERBS = ("validate", "create", "get", "update", "delete", "process")
KEYWORDS, DOC_WORDS = 10, 3


def plain_type(annotation: Column) -> Column:
    """A type without Optional[...], | None and quotes; nothing is any."""
    bare = F.regexp_replace(F.regexp_replace(annotation, r"Optional\[(.*?)\]", "$1"), r"\s*\|\s*None", "")
    return F.coalesce(F.nullif(F.regexp_replace(stripped(bare), "^['\"]+|['\"]+$", ""), F.lit("")), F.lit("any"))


def return_type(source: Column) -> Column:
    return plain_type(F.regexp_extract(F.coalesce(source, F.lit("")), r"->\s*(.+?)(?:\s*:|$)", 1))


def contract(parameters: Column) -> Column:
    """A JSON list of "name: type" as a map from name to type; of equal names the last counts, bad JSON gives none."""
    given = F.filter(F.coalesce(F.from_json(parameters, "array<string>"), F.array().cast("array<string>")), lambda p: p.isNotNull())
    name = lambda p: stripped(F.substring_index(p, ":", 1))
    kind = lambda p: F.when(F.contains(p, F.lit(":")), plain_type(F.regexp_replace(p, "^[^:]*:", ""))).otherwise("any")
    last = lambda p, i: F.forall(F.slice(given, i + 2, F.size(given) + 1), lambda q: name(q) != name(p))
    return F.map_from_entries(F.transform(F.filter(given, last), lambda p: F.struct(name(p), kind(p))))


def keywords(name: Column, doc: Column) -> Column:
    """Up to ten distinct words in lower case: the parts of the name, then three words of the docstring."""
    words = F.filter(F.split(F.coalesce(doc, F.lit("")), r"\s+"), lambda w: (F.length(w) > 1) & ~F.startswith(w, F.lit("@")))
    parts = F.filter(F.split(name, r"[_\s]+"), lambda w: w != "")
    return F.slice(F.array_distinct(F.transform(F.concat(parts, F.slice(words, 1, DOC_WORDS)), lambda w: F.lower(w))), 1, KEYWORDS)


def description(doc: Column, name: Column) -> Column:
    first = stripped(F.substring_index(stripped(F.coalesce(doc, F.lit(""))), "\n", 1))
    return F.coalesce(F.nullif(first, F.lit("")), F.concat(F.lit("Capability: "), name))


def domain(path: Column, name: Column) -> Column:
    """Of the path; where that is unknown, the first part of a name of several parts that is no leading verb."""
    parts = F.split(name, "_")
    of_name = F.when(F.size(parts) >= 2, F.when(parts[0].isin(*VERBS), parts[1]).otherwise(parts[0])).otherwise("unknown")
    known = business_domain(path)
    return F.when(known == "unknown", of_name).otherwise(known)


def extracted(entities: DataFrame) -> DataFrame:
    """(id, name, business_domain, description, keywords, input_contract, returns, searchable, realized_by) of entry points.

    entities: (id, name, file_path, entry_category, parameters, source, docstring). One projection, no shuffle. Null
    names give no capability.
    """
    name, doc = F.col("name"), F.col("docstring")
    found = entities.where(F.col("entry_category").isin(*CATEGORIES) & name.isNotNull()).select(
        stable_id(F.lit("capability"), F.col("id")).alias("id"), "name", domain(F.col("file_path"), name).alias("business_domain"), description(doc, name).alias("description"),
        keywords(name, doc).alias("keywords"), contract(F.col("parameters")).alias("input_contract"), return_type(F.col("source")).alias("returns"), F.col("id").alias("realized_by"),
    )
    return found.withColumn("searchable", searchable(F.col("name"), F.col("description"), F.array_join("keywords", " ")))


def topics(published: DataFrame, entities: DataFrame) -> DataFrame:
    """(topic, id, rel_type, entity) links of message topics: publishes_to from (source, topic), consumed_by from mq consumers.

    entities: (id, entry_category, entry_metadata), the topic being a field of the JSON metadata; bad JSON and blank topics
    give no link. Repeated links count once; topics with equal names share an id.
    """
    out = published.select("topic", F.lit("publishes_to").alias("rel_type"), F.col("source").alias("entity"))
    consumed = entities.where("entry_category = 'mq_consumer'").select(F.get_json_object("entry_metadata", "$.topic").alias("topic"), F.lit("consumed_by").alias("rel_type"), F.col("id").alias("entity"))
    links = out.unionByName(consumed).where("topic <> ''").distinct()
    return links.select("topic", stable_id(F.lit("message_topic"), F.col("topic")).alias("id"), "rel_type", "entity")
