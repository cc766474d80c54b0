"""Source files of several languages as entities and relations, by one template.

A reader has a root row and three steps: a scan that gives what the others need, a walk over declarations, and the calls that
leave the program. A step that fails ends the file's reading: its root row and what the steps before gave are kept, and
a row of kind parse_error says why.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from . import files, java

Rows = list[tuple]


@dataclass(frozen=True)
class Reader:
    suffix: str
    root: Callable[[str, str], tuple]
    scan: Callable[[str, str], object]
    walk: Callable[[str, str, object], Rows]
    outside: Callable[[str, str, object], Rows]


def read(reader: Reader, path: str, text: str) -> Rows:
    """The rows of one file; an error gives (path, parse_error, type of the error, ...) behind those read so far."""
    rows = [reader.root(path, text)]
    try:
        seen = reader.scan(path, text)
        rows += reader.walk(path, text, seen)
        rows += reader.outside(path, text, seen)
    except Exception as e:  # noqa: BLE001  whatever a reader raises for a file must not end the others
        rows.append((path, "parse_error", type(e).__name__, None, 0, text.count("\n"), str(e).split("\n", 1)[0]))
    return rows


PYTHON = Reader(".py", files.root, files.tree, files.walked, files.outside)
JAVA = Reader(".java", java.root, java.blanked, java.walked, java.outside)


def entities(sources: DataFrame, readers: tuple[Reader, ...] = (PYTHON, JAVA)) -> DataFrame:
    """Rows as ENTITIES says of sources (path, content), by the reader of each path's suffix; other files and null contents give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for p, c in zip(b["path"], b["content"], strict=True) if c is not None for x in readers if p.endswith(x.suffix) for r in read(x, p, bytes(c).decode("utf-8", "replace"))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in files.ENTITIES.split(", ")])

    return sources.where("path is not null").select("path", "content").mapInPandas(run, files.ENTITIES)
