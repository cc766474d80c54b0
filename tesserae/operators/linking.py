"""Linking of names, aliases and documents to entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import basename, bounded, code_identifiers, hostname, stable_id
from ..shared import materialised

LINKS = 50


def resolve_names(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """relations (source_name, target_name, file_path) with src and dst ids of entities (id, name, file_path, ord).

    An entity of the same file goes first, the last of its name there; else the first of that name anywhere.
    """
    here = entities.groupBy("file_path", "name").agg(F.max_by("id", "ord").alias("here"))
    there = entities.groupBy("name").agg(F.min_by("id", "ord").alias("there"))
    out = relations
    for name, to in (("source_name", "src"), ("target_name", "dst")):
        out = out.join(here.withColumnsRenamed({"name": name}), ["file_path", name], "left").join(there.withColumnsRenamed({"name": name}), name, "left").withColumn(to, F.coalesce("here", "there")).drop("here", "there")
    return out


def unresolved(resolved: DataFrame) -> DataFrame:
    return resolved.where("src is null or dst is null")


GRAM = 3


def _grams(df: DataFrame, keys: list[str], text: str, lengths: list[int]) -> DataFrame:
    """(keys, gram): the distinct substrings of some lengths of each row's text.

    They are put together from its characters, as to find the k-th character of a text takes k steps.
    """
    some = lambda n: F.transform(F.slice("_c", 1, F.greatest(F.size("_c") - (n - 1), F.lit(0))), lambda c, k: F.concat(c, *[F.get("_c", k + j) for j in range(1, n)]))
    return df.withColumn("_c", F.split(text, "")).select(*keys, F.explode(F.array_distinct(F.concat(*map(some, lengths)))).alias("gram"))


def contained(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(text_id, needle_id) for texts (text_id, text) that hold needles (needle_id, needle) as substrings; empty needles are in none.

    Needles of up to GRAM characters are joined with the texts' substrings of their length. A pair with a longer one is
    proposed by an equi join on the needle's rarest substring of GRAM characters and confirmed by the text itself. Needles
    and their substrings are written first, so that where they are few Spark knows it and sends them to the texts, whose
    many other substrings then go into no shuffle.
    """
    texts = texts.where("text_id is not null")
    wanted = materialised(needles.where("length(needle) > 0").select("needle_id", "needle").distinct())
    size = F.length("needle")
    short, long = wanted.where(size <= GRAM), wanted.where(size > GRAM)
    lengths = sorted(r.size for r in short.select(size.alias("size")).distinct().collect())
    out = _grams(texts, ["text_id"], "text", lengths or [1]).join(short.select("needle_id", F.col("needle").alias("gram")), "gram").select("text_id", "needle_id")
    if long.isEmpty():
        return out
    proposed = _grams(long, ["needle_id", "needle"], "needle", [GRAM])
    known = materialised(proposed.select("gram").distinct())
    held = materialised(_grams(texts, ["text_id"], "text", [GRAM]).join(known, "gram", "left_semi"))
    often = held.groupBy("gram").agg(F.count("*").alias("f"))
    # A needle with a substring that no text has is in none.
    rarest = proposed.join(often, "gram", "left").groupBy("needle_id", "needle").agg(F.min(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "gram")).alias("r")).where("r.f > 0").select("needle_id", "needle", "r.gram")
    met = held.join(materialised(rarest), "gram").select("needle_id", "needle", "text_id").join(texts, "text_id").where(F.contains("text", "needle"))
    return out.unionByName(met.select("text_id", "needle_id"))


def alias_links(entities: DataFrame, assets: DataFrame) -> DataFrame:
    """(id, asset_id): each alias of assets (asset_id, aliases), in order, links the first entity (id, name, ord) that holds it.

    An alias is held as a substring, in any case. An entity that an earlier alias of the asset has linked is passed over
    for the next one. An asset of m aliases needs no more than the first m entities of each, so no alias is a large group.
    """
    listed = assets.select("asset_id", F.size("aliases").alias("m"), F.posexplode("aliases").alias("at", "alias")).where("alias <> ''")
    names = entities.select(F.col("id").alias("text_id"), F.lower("name").alias("text"))
    needles = listed.select(F.lower("alias").alias("needle")).distinct().withColumn("needle_id", F.col("needle"))
    found = contained(names, needles).select(F.col("text_id").alias("id"), F.col("needle_id").alias("low")).join(entities.select("id", "ord"), "id")
    met = listed.withColumn("low", F.lower("alias")).join(found, "low")
    first = met.withColumn("r", F.row_number().over(Window.partitionBy("asset_id", "at").orderBy("ord", "id"))).where("r <= m")
    # In order of aliases and then of entities: an entity is taken if none of its alias was before it and it is free.
    ordered = first.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("at", "r", "id"))).alias("all"))
    none = F.array().cast(f"array<{dict(entities.dtypes)['id']}>")
    start = F.struct(F.lit(-1).alias("done"), none.alias("taken"))
    taken = F.aggregate("all", start, lambda s, x: F.when((s["done"] < x["at"]) & ~F.array_contains(s["taken"], x["id"]), F.struct(x["at"].alias("done"), F.array_append(s["taken"], x["id"]).alias("taken"))).otherwise(s))
    return ordered.select("asset_id", F.explode(taken["taken"]).alias("id")).select("id", "asset_id")


#: Characters that may stand beside a path in a text; words of texts and paths are cut at them.
BOUNDARY = r"[ ./\\_-]+"


def document_links(docs: DataFrame, index: DataFrame, most: int = LINKS) -> DataFrame:
    """(doc_id, id, rule, rank): documents (doc_id, text) linked to entities (id, file_path, name, ord), the first `most` by ord.

    The first rule that holds counts: the text's first occurrence of the whole path stands between boundaries, or that of
    its last part does, or the name, of over three characters, is an identifier of a fenced python block. Null texts
    link nothing. The limit per document is part of the feature.

    Paths are proposed by an equi join on the rarest word of their last part, names by one on identifiers. Of the entities
    of a path, or of a name, only the first `most` meet documents: any later one has those before it in each document.
    """

    def firsts(by: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(by).orderBy("ord", "id"))
        return index.where(F.col(by).isNotNull()).select("id", "ord", by).distinct().withColumn("r", rank).where(F.col("r") <= most).drop("r")

    texts = docs.where("text is not null").select("doc_id", "text")
    words = texts.select("doc_id", F.explode(F.array_distinct(F.split("text", BOUNDARY))).alias("word")).where("word <> ''")
    paths = index.where("file_path <> ''").select("file_path").distinct().withColumn("base", basename(F.col("file_path")))
    parts = paths.select("file_path", "base", F.explode(F.array_distinct(F.split("base", BOUNDARY))).alias("word")).where("word <> ''")
    known = words.join(parts.select("word").distinct(), "word", "left_semi")
    often = known.groupBy("word").agg(F.count("*").alias("f"))
    rarest = parts.join(often, "word", "left").groupBy("file_path", "base").agg(F.min(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "word")).alias("r")).select("file_path", "base", "r.word")
    whole, last = bounded(F.col("text"), F.col("file_path")), bounded(F.col("text"), F.col("base")) & (F.col("base") != F.col("file_path"))
    by_path = rarest.join(known, "word").join(texts, "doc_id").select("doc_id", "file_path", F.when(whole, 1).when(last, 2).alias("rule")).where("rule is not null")
    named = texts.select("doc_id", F.explode(code_identifiers(F.col("text"))).alias("name"))
    found = by_path.join(firsts("file_path"), "file_path").select("doc_id", "id", "ord", "rule")
    found = found.unionByName(named.where("length(name) > 3").join(firsts("name"), "name").select("doc_id", "id", "ord", F.lit(3).alias("rule")))
    once = found.groupBy("doc_id", "id", "ord").agg(F.min("rule").alias("rule"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "id"))).where(F.col("rank") <= most).select("doc_id", "id", "rule", "rank")


def cross_type(code: DataFrame, others: DataFrame, relation: str = "describes") -> DataFrame:
    """(source, target, relation_type, confidence) where the source text of code (id, source) holds the name of others (id, name).

    others describe code, or code is derived from them (derived_from). Names are held as they are, without boundaries.
    """
    if relation not in ("describes", "derived_from"):
        raise ValueError(f"unknown relation {relation}")
    held = contained(code.where("source is not null").select(F.col("id").alias("text_id"), F.col("source").alias("text")), others.where("name is not null").select(F.col("id").alias("needle_id"), F.col("name").alias("needle")))
    ends = ("needle_id", "text_id") if relation == "describes" else ("text_id", "needle_id")
    return held.select(F.col(ends[0]).alias("source"), F.col(ends[1]).alias("target"), F.lit(relation).alias("relation_type"), F.lit(0.7).alias("confidence"))


def services(urls: DataFrame) -> DataFrame:
    """(service, id, n_calls, first_page) per host of (page_id, url); the first page of a host names it."""
    host = hostname(F.col("url"))
    return urls.where("url is not null").groupBy(host.alias("service")).agg(F.count("*").alias("n_calls"), F.min("page_id").alias("first_page")).withColumn("id", stable_id(F.col("service")))


def sections(docs: DataFrame, form: str = "markdown") -> DataFrame:
    """(doc_id, section, title, n_lines) per heading of (doc_id, text); none: the whole text, untitled.

    Headings are lines of one to three # in markdown, and in rst lines over a line of three or more of = : ` ~ or -. Text
    before the first heading is dropped, the line below a heading of rst too; empty and null texts have no section.
    """
    lines = docs.where("length(trim(coalesce(text, ''))) > 0").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    w = Window.partitionBy("doc_id").orderBy("at")
    if form == "rst":
        rule = F.col("line").rlike(r"^[=:`~-]{3,}\s*$")
        # A rule under a heading is no heading of the next rule, nor is it text.
        under = lines.withColumn("next", F.lead(rule).over(w)).withColumn("rule", rule)
        heading = F.when(F.col("next") & (F.trim("line") != "") & ~F.col("rule"), F.trim("line"))
        marked = under.withColumn("title", heading).withColumn("below", F.lag("title").over(w).isNotNull() & F.col("rule")).where("not below").drop("next", "rule", "below")
    else:
        marked = lines.withColumn("title", F.nullif(F.regexp_extract("line", r"^#{1,3}\s+(.+?)\s*$", 1), F.lit("")))
    numbered = marked.withColumn("section", F.count("title").over(w)).withColumn("any", F.count("title").over(Window.partitionBy("doc_id")))
    kept = numbered.where("section > 0 or any = 0")
    return kept.groupBy("doc_id", "section").agg(F.coalesce(F.max("title"), F.lit("")).alias("title"), F.count("*").alias("n_lines"))


def external_modules(imports: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, name, n_imports): a module for each imported name (target_name) that no entity (name) has."""
    names = imports.where("target_name <> ''").groupBy(F.col("target_name").alias("name")).agg(F.count("*").alias("n_imports"))
    return names.join(entities.select("name"), "name", "left_anti").select(stable_id(F.lit("module"), F.col("name")).alias("id"), "name", "n_imports")


def resolve_typed(wanted: DataFrame, entities: DataFrame, strict: bool = False) -> DataFrame:
    """wanted (entity_type, file_path, name, ...) with the id of the first entity, by ord, of that type, path and name.

    Without one, and unless strict, the first of that type and name in any file. how is exact, loose or null.
    """
    exact = entities.groupBy("entity_type", "file_path", "name").agg(F.min_by("id", "ord").alias("exact"))
    out = wanted.join(exact, ["entity_type", "file_path", "name"], "left")
    loose = entities.groupBy("entity_type", "name").agg(F.min_by("id", "ord").alias("loose"))
    out = out.withColumn("loose", F.lit(None).cast(entities.schema["id"].dataType)) if strict else out.join(loose, ["entity_type", "name"], "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("loose").isNotNull(), "loose")
    return out.withColumn("id", F.coalesce("exact", "loose")).withColumn("how", how).drop("exact", "loose")


def trusted(relations: DataFrame, types: tuple[str, ...], least: float = 0.5) -> DataFrame:
    """Relations of a known type whose confidence is least or more; null counts as neither."""
    return relations.where(F.col("relation_type").isin(*types) & (F.col("confidence") >= least))
