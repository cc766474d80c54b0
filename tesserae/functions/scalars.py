"""Scalar functions as column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities from weak to strong when they are lowered, and their ranks when they are fused.
DEMOTION = ("allow", "warn", "block", "escalate")
FUSION = {"allow": 0, "warn": 1, "escalate": 2, "block": 3}
ROLES = {"reader": 1, "writer": 2, "admin": 3}


def stable_id(*parts: Column) -> Column:
    """32 hex digits of the SHA-256 of the parts joined by |; a null part is empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32)


def snake_to_camel(c: Column) -> Column:
    parts = F.split(c, "_")
    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, 1_000), F.initcap), ""))


def upper_snake(c: Column) -> Column:
    """CamelCase to UPPER_SNAKE; text that is upper case already stays."""
    cut = F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Za-z])([0-9])", "$1_$2")
    return F.when(c.rlike("^[A-Z][A-Z0-9_]*$"), c).otherwise(F.upper(cut))


def lowered(severity: Column, steps: Column) -> Column:
    order = F.array(*[F.lit(x) for x in DEMOTION])
    return F.element_at(order, F.greatest(F.lit(1), F.array_position(order, severity).cast("int") - steps))


def effective_severity(severity: Column, confidence: Column) -> Column:
    return lowered(severity, F.when(confidence >= 0.9, 0).when(confidence >= 0.7, 1).otherwise(2))


def confidence(c: Column) -> Column:
    """Clamped to 0..1; null counts as 0.8."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.8))))


def normal_path(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.coalesce(F.when(F.startswith(path, F.lit(root)), F.substring(path, len(root) + 1, 1 << 20)).otherwise(path), F.lit(""))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def suffix(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/.][^/]*(\.[^/.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def bounded(text: Column, word: Column) -> Column:
    """Whether word's first occurrence in text has a boundary character (space . / \\ - _) or the text's end at both sides."""
    at = F.instr(text, word)
    edge = lambda c: (c == "") | c.isin(" ", ".", "/", "\\", "-", "_")
    before = F.when(at > 1, F.substr(text, at - 1, F.lit(1))).otherwise("")
    return (at > 0) & (F.length(word) > 0) & edge(before) & edge(F.substr(text, at + F.length(word), F.lit(1)))


def hostname(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), url)


def business_domain(path: Column) -> Column:
    """The first segment of a route, the second after api; .py paths give their stem; null and empty are unknown, / is root."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    first, second = (F.try_element_at(parts, F.lit(k)) for k in (1, 2))
    segment = F.when(first == "api", F.coalesce(second, first)).otherwise(F.coalesce(first, F.lit("root")))
    return F.when(F.coalesce(path, F.lit("")) == "", "unknown").when(F.endswith(path, F.lit(".py")), stem(path)).otherwise(segment)


def code_identifiers(text: Column) -> Column:
    """Distinct identifiers of three or more characters in fenced python blocks, sorted."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)```python\s*\n(.*?)```"), 1)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"\b[A-Za-z_][A-Za-z0-9_]{2,}\b"), 0)))))


def doc_type(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.contains("readme"), "readme").when(p.contains("docs/") & p.contains("api"), "api_doc").when(p.contains("docs/"), "module_doc").when(p.contains("arch") | p.contains("design"), "architecture_doc").otherwise("comment")


def doc_line(line: Column) -> Column:
    """Whether a stripped line is a comment or opens, closes or is a docstring; a whole one must be longer than 7."""
    edge = lambda mark: (F.startswith(line, F.lit(mark)), F.endswith(line, F.lit(mark)))
    (opens, closes), (opens_single, closes_single) = edge('"""'), edge("'''")
    whole = (opens & closes) | (opens_single & closes_single)
    return F.coalesce(F.startswith(line, F.lit("#")) | F.when(whole, F.length(line) > 7).otherwise(opens | opens_single | closes | closes_single), F.lit(False))


def diff_change(diff: Column) -> Column:
    """SIGNATURE if a changed line defines something, DOC_ONLY if all are documentation or empty, else BODY."""
    changed = F.filter(F.split(F.coalesce(diff, F.lit("")), "\\r?\\n"), lambda x: x.rlike(r"^[+-]") & ~x.rlike(r"^(\+\+\+|---)"))
    bodies = F.filter(F.transform(changed, lambda x: stripped(F.substring(x, 2, 1 << 20))), lambda x: x != "")
    signature = F.exists(bodies, lambda x: x.rlike(r"^(async def|def|class) "))
    return F.when(signature, "SIGNATURE").when(F.forall(bodies, doc_line), "DOC_ONLY").otherwise("BODY")


def git_status(code: Column) -> Column:
    letter = F.upper(F.substring(F.coalesce(code, F.lit("")), 1, 1))
    return F.when(letter.isin("A", "D", "M", "R", "C", "T", "U"), letter).otherwise("X")


def distance_confidence(d: Column) -> Column:
    return F.round(1 / (1 + d), 4)


def complexity(lines: Column, branches: Column, most: int = 100) -> Column:
    return F.round(F.least(F.lit(1.0), lines / most * 0.5 + branches / 20 * 0.5), 2)


def skill_confidence(hits: Column) -> Column:
    return F.least(F.lit(1.0), 0.5 + hits * 0.1)


def repo_id(url: Column) -> Column:
    last = F.regexp_extract(F.coalesce(url, F.lit("")), r"([^/]+?)(?:\.git)?/*$", 1)
    return F.when(last == "", "default").otherwise(last)


def role_allows(role: Column, needed: str) -> Column:
    levels = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(levels, role) >= ROLES.get(needed, 99), F.lit(False))


def relation_name(c: Column) -> Column:
    """Upper-case names; HAS_* counts as CONTAINS."""
    u = upper_snake(c)
    return F.when(F.startswith(u, F.lit("HAS_")), "CONTAINS").otherwise(u)


def masked_url(url: Column) -> Column:
    return F.regexp_replace(url, "://[^/@]+@", "://***@")


def searchable(*parts: Column) -> Column:
    return F.concat_ws(" | ", *[F.nullif(p, F.lit("")) for p in parts])


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def embeddable(source: Column, kind: Column, name: Column, path: Column, most: int = 800) -> Column:
    """The head of the source, or a sentence of type, name and path where there is none."""
    return F.coalesce(F.nullif(F.substring(source, 1, most), F.lit("")), F.concat_ws(" ", kind, name, F.lit("in"), path))


def event_extension(payload: Column) -> Column:
    """The stated extension of an event's JSON payload, else the suffix of its file or repository path, else unknown."""
    of = lambda k: F.nullif(suffix(F.get_json_object(payload, k)), F.lit(""))
    return F.coalesce(F.get_json_object(payload, "$.file_extension"), of("$.file_path"), of("$.repo_path"), F.lit("unknown"))


def reply_json(text: Column) -> Column:
    """The JSON part of a model's reply: thinking is cut, and of fenced blocks the first json one, else the first, is taken."""
    bare = stripped(F.regexp_replace(text, r"(?s)<think\b[^>]*>.*?</think\s*>", ""))
    fenced = lambda mark: stripped(F.substring_index(F.regexp_extract(bare, "(?s)" + mark + "(.*)", 1), "```", 1))
    return F.when(bare.contains("```json"), fenced("```json")).when(bare.contains("```"), fenced("```")).otherwise(bare)


def entry_label(source: Column) -> Column:
    return F.when(source == "doc", "DocEntity").when(source == "code", "CodeEntity").otherwise("ResourceEntity")


def found_share(wanted: Column, text: Column) -> Column:
    """The share of wanted strings that text holds, in any case; zero if none is wanted."""
    n = F.size(wanted)
    return F.when(n > 0, F.size(F.filter(wanted, lambda w: F.contains(F.lower(text), F.lower(w)))) / n).otherwise(0.0)


def level_score(level: Column, tools: Column, answer: Column) -> Column:
    """Tools and answer weighted by the question's level: .3/.7, .4/.6, above .5/.5."""
    t = F.when(level == 1, 0.3).when(level == 2, 0.4).otherwise(0.5)
    return tools * t + answer * (1 - t)


#: Words that a read-only query may not hold.
WRITES = ("create", "merge", "delete", "set", "remove", "drop", "insert", "update", "upsert", "alter", "detach")


def is_write(statement: Column) -> Column:
    """Whether a statement holds a whole word that writes, in any case; null does not."""
    return F.coalesce(statement.rlike(r"(?i)\b(" + "|".join(WRITES) + r")\b"), F.lit(False))


def identifier(name: Column) -> Column:
    """Whether a name can stand for a label, relation or field; null cannot."""
    return F.coalesce(name.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"), F.lit(False))


def approval_token(*parts: Column) -> Column:
    """12 hex digits of the SHA-256 of intent, target, session and nonce joined by colons; null parts are empty."""
    return F.substring(F.sha2(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 12)


def pattern_signature(kind: Column, extension: Column) -> Column:
    return F.concat_ws(":", kind, F.coalesce(extension, F.lit("unknown")))


def literal(c: Column) -> Column:
    """A string as a quoted literal with backslashes, quotes and line breaks escaped; null is NULL."""
    escaped = c
    for plain, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(written))
    return F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("NULL"))


def exact_answer(wanted: Column, answer: Column) -> Column:
    """1.0 if the answer holds the wanted text and no longer word around it, in any case, else 0.0."""
    w, a = F.lower(stripped(wanted)), F.lower(stripped(answer))
    longer = F.exists(F.regexp_extract_all(a, F.lit("[a-z_]+"), 0), lambda x: F.contains(x, w) & (x != w))
    return F.when(F.contains(a, w) & ~longer, 1.0).otherwise(0.0)


def held_answer(wanted: Column, answer: Column) -> Column:
    return F.when(F.contains(F.lower(answer), F.lower(wanted)), 1.0).otherwise(0.0)


def safe_url(url: Column) -> Column:
    """Whether a repository address is http or https with a host and without white space; null is not."""
    return F.coalesce(url.rlike(r"^(?i:https?)://[^\s/]+(/\S*)?$"), F.lit(False))


def decoded(content: Column) -> Column:
    """Bytes as text: as UTF-8 where they are valid, else as Latin-1."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "ISO-8859-1"))
