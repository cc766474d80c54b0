"""Java source files as entities and relations, by declarations, braces and calls; expressions are not understood."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame

from .files import ENTITIES

# Common names of the platform, which are no targets of calls and uses.
PLATFORM = frozenset(
    """String Integer Long Double Float Boolean Byte Short Character Object Class List Map Set ArrayList HashMap HashSet System Math
    Arrays Collections Exception RuntimeException Thread Override Deprecated SuppressWarnings println print format valueOf toString
    equals hashCode compareTo getClass intValue longValue doubleValue floatValue booleanValue byteValue shortValue charValue size
    isEmpty get set add remove clear sort close put keySet values entrySet iterator next hasNext stream map filter collect of builder
    build orElse isPresent getName setName getValue setValue""".split()
)
KEYWORDS = frozenset("if for while switch catch return throw new synchronized try else do assert super this yield".split())
NOISE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
ITEM = re.compile(
    r"@interface\s+(?P<annotation>\w+)[^{;]*\{|@(?P<mark>[\w.]+)(?:\s*\([^()]*\))?|\b(?P<kind>class|interface|enum|record)\s+(?P<type>\w+)(?P<head>[^{;]*)\{|\bnew\s+(?P<made>[\w.]+)"
    r"|(?<=[\w>\]])\s+(?P<method>\w+)\s*\((?P<given>[^()]*)\)\s*(?:throws\s[\w.,\s]+)?(?P<body>[{;])|\b(?P<called>\w+)\s*\(|(?P<open>\{)|(?P<close>\})"
)
IMPORT = re.compile(r"^\s*import\s+(?:static\s+)?([\w.]+)\s*;", re.M)
PACKAGE = re.compile(r"^\s*package\s+([\w.]+)\s*;", re.M)
OUTSIDE = re.compile(r"(?P<owner>\w+)(?:\.\w+\([^()]*\))*\.(?P<method>\w+)\s*\([^;\"]*?\"(?P<text>[^\"\n]*)\"")


def _blank(m: re.Match, keep_text: bool) -> str:
    s = m.group()
    return s if keep_text and s[0] in "\"'" else re.sub(r"[^\n]", " ", s)


def _flat(s: str) -> str:
    """s without type parameters."""
    while (bare := re.sub(r"<[^<>]*>", "", s)) != s:
        s = bare
    return s


def _types(given: str) -> str:
    parts = [[w for w in p.split() if w != "final" and w[0] != "@"] for p in _flat(given).split(",")]
    return ",".join(" ".join(p[:-1]) for p in parts if len(p) > 1)


def _outside(text: str) -> Iterator[tuple[int, str, str]]:
    for m in OUTSIDE.finditer(text):
        owner, method = m["owner"].lower(), m["method"]
        if "resttemplate" in owner or "webclient" in owner:
            yield m.start(), "calls_service", urlsplit(m["text"]).hostname or m["text"]
        elif ("kafkatemplate" in owner and method == "send") or ("rabbittemplate" in owner and method == "convertAndSend"):
            yield m.start(), "publishes_to", m["text"]


def blanked(path: str, source: str) -> tuple[str, str]:
    """The source without comments, and without strings too."""
    return NOISE.sub(lambda m: _blank(m, True), source), NOISE.sub(lambda m: _blank(m, False), source)


def root(path: str, source: str) -> tuple:
    plain = blanked(path, source)[1]
    package = PACKAGE.search(plain)
    return path, "module", package[1] if package else path.rsplit("/", 1)[-1].removesuffix(".java"), None, 0, plain.count("\n"), None


def walked(path: str, source: str, seen: tuple[str, str]) -> list[tuple]:
    """Types, methods and constructors, and what they extend, implement, import, use and call."""
    plain = seen[1]
    line = lambda at: plain.count("\n", 0, at)
    rows: list[tuple] = [(path, "imports", None, None, line(m.start(1)), line(m.start(1)), m[1].rsplit(".", 1)[-1]) for m in IMPORT.finditer(plain)]
    # Each open brace: the type it opens, the callable it is in, and the place of its row, if any.
    stack: list[tuple[str | None, str | None, int | None]] = []

    def entity(kind: str, name: str, at: int, open_type: str | None, inside: str | None, opens: bool = True) -> None:
        rows.append((path, kind, name, stack[-1][0] if stack else None, line(at), line(at), None))
        if opens:
            stack.append((open_type, inside, len(rows) - 1))

    for m in ITEM.finditer(plain):
        owner, inside = (stack[-1][0], stack[-1][1]) if stack else (None, None)
        related = lambda kind, target, name=None: rows.append((path, kind, name or inside, None, line(m.start()), line(m.start()), target))  # noqa: B023, E731
        if m["annotation"]:
            entity("annotation", m["annotation"], m.start(), m["annotation"], None)
        elif m["kind"]:
            entity(m["kind"], m["type"], m.start(), m["type"], None)
            for word, names in re.findall(r"\b(extends|implements)\s+(.*?)(?=\b(?:extends|implements|permits)\b|$)", _flat(m["head"]), re.S):
                for x in names.split(","):
                    related(word, x.strip().rsplit(".", 1)[-1], m["type"])
        elif m["method"] and owner and not inside and m["method"] not in KEYWORDS:
            kind, name = ("constructor", "<init>") if m["method"] == owner else ("method", m["method"])
            full = f"{owner}.{name}({_types(m['given'])})"
            entity(kind, full, m.start("method"), owner, full, m["body"] == "{")
        elif name := m["made"] or m["called"] or m["method"]:
            name = name.rsplit(".", 1)[-1]
            if inside and name not in PLATFORM and name not in KEYWORDS:
                related("uses" if m["made"] else "calls", name)
            if m["body"] == "{":
                stack.append((owner, inside, None))
        elif m["open"]:
            stack.append((owner, inside, None))
        elif m["close"] and stack:
            *_, at = stack.pop()
            if at is not None:
                rows[at] = (*rows[at][:5], line(m.start()), None)
    return rows


def outside(path: str, source: str, seen: tuple[str, str]) -> list[tuple]:
    """Services and topics that calls reach."""
    line = lambda at: seen[1].count("\n", 0, at)
    return [(path, kind, path, None, line(at), line(at), target) for at, kind, target in _outside(seen[0])]


def _parsed(path: str, source: str) -> list[tuple]:
    seen = blanked(path, source)
    return [root(path, source), *walked(path, source, seen), *outside(path, source, seen)]


def java_entities(files: DataFrame) -> DataFrame:
    """Packages, types, methods and constructors, and what they extend, implement, import, use, call and reach, of (path, content).

    Methods are named Type.name(parameter types). Comments and strings count for nothing but the addresses and topics of
    known clients. Wildcard imports and common platform names are left out; null contents give no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for p, c in zip(b["path"], b["content"], strict=True) if c is not None for r in _parsed(p, bytes(c).decode("utf-8", "replace"))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in ENTITIES.split(", ")])

    return files.select("path", "content").mapInPandas(run, ENTITIES)
