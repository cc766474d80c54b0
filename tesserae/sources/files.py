"""Files as rows, and Python source files as entities and relations."""

from __future__ import annotations

import ast
import builtins
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED = ("__pycache__", ".git", "node_modules", "venv", "build", "dist")
LARGEST = 5 << 20
# Modules of HTTP clients and methods of message producers.
HTTP_CLIENTS, PRODUCERS = ("requests", "httpx"), ("send", "publish")
ENTITIES = "file_path string, kind string, name string, parent string, start_line int, end_line int, target string"


def scan(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".py", ".md"), skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, content) of files below root with one of the suffixes; parts named in skipped and files over 5 MB are left out."""
    glob = "*{" + ",".join(suffixes) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    parts = F.split("path", "/")
    return found.where(~F.arrays_overlap(parts, F.array(*map(F.lit, skipped))) & (F.col("length") <= LARGEST)).select("path", "content")


def _static(x: ast.AST) -> str:
    """The text of a string literal, of an f-string its static parts; empty for anything else."""
    if isinstance(x, ast.Constant) and isinstance(x.value, str):
        return x.value
    return "".join(_static(v) for v in x.values) if isinstance(x, ast.JoinedStr) else ""


def _outside(call: ast.Call) -> tuple[str, str] | None:
    """("calls_service", host) of an HTTP client's call, ("publishes_to", topic) of a producer's, else None."""
    target = next((t for t in map(_static, call.args) if t), "")
    if not target or not isinstance(call.func, ast.Attribute):
        return None
    owner = call.func.value
    owner = owner.attr if isinstance(owner, ast.Attribute) else getattr(owner, "id", "")
    if owner in HTTP_CLIENTS:
        return "calls_service", urlsplit(target).hostname or target
    return ("publishes_to", target) if owner and call.func.attr in PRODUCERS else None


def root(path: str, text: str) -> tuple:
    return path, "module", path.rsplit("/", 1)[-1].removesuffix(".py"), None, 0, text.count("\n"), None


def tree(path: str, text: str) -> ast.Module:
    return ast.parse(text)


def walked(path: str, text: str, module: ast.Module) -> list[tuple]:
    """Classes and functions, and what they extend, import and call."""
    rows: list[tuple] = []

    def visit(node: ast.AST, inside: str | None, owner: str | None) -> None:
        for x in (x for x in ast.iter_child_nodes(node) if x not in getattr(node, "decorator_list", ())):
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(x, ast.ClassDef) else "function"
                if owner is not None:
                    visit(x, inside, owner)
                    continue
                name = f"{inside}.{x.name}" if inside else x.name
                rows.append((path, kind, name, inside, x.lineno - 1, x.end_lineno - 1, ast.get_docstring(x)))
                rows.extend((path, "decorated_by", name, None, d.lineno - 1, d.lineno - 1, ast.unparse(d)) for d in x.decorator_list)
                rows.extend((path, "extends", name, None, x.lineno - 1, x.lineno - 1, ast.unparse(b).rsplit(".", 1)[-1]) for b in getattr(x, "bases", []))
                visit(x, name if kind == "class" else inside, None if kind == "class" else name)
            elif isinstance(x, ast.Import | ast.ImportFrom):
                rows.extend((path, "imports", owner or inside, None, x.lineno - 1, x.lineno - 1, a.name.rsplit(".", 1)[-1]) for a in x.names)
            else:
                if isinstance(x, ast.Call) and owner is not None:
                    called = x.func.attr if isinstance(x.func, ast.Attribute) else getattr(x.func, "id", "")
                    if len(called) > 2 and not hasattr(builtins, called):
                        rows.append((path, "calls", owner, None, x.lineno - 1, x.lineno - 1, called))
                visit(x, inside, owner)

    visit(module, None, None)
    return rows


def outside(path: str, text: str, module: ast.Module) -> list[tuple]:
    """Services and topics that calls reach."""
    reached = [(x.lineno - 1, *found) for x in ast.walk(module) if isinstance(x, ast.Call) and (found := _outside(x))]
    return [(path, kind, root(path, text)[2], None, line, line, target) for line, kind, target in reached]


def _parsed(path: str, text: str) -> list[tuple]:
    try:
        module = tree(path, text)
    except (SyntaxError, ValueError):
        return [root(path, text)]
    return [root(path, text), *walked(path, text, module), *outside(path, text, module)]


def python_entities(files: DataFrame, decorators: bool = False) -> DataFrame:
    """Modules, classes and functions, the names they extend and import and functions call, and services and topics they reach, of (path, content) rows.

    With decorators also rows of kind decorated_by. A file that does not parse gives its module row alone; null contents give none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for p, c in zip(b["path"], b["content"], strict=True) if c is not None for r in _parsed(p, bytes(c).decode("utf-8", "replace")) if decorators or r[1] != "decorated_by"]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in ENTITIES.split(", ")])

    return files.select("path", "content").mapInPandas(run, ENTITIES)
