"""Vectors of texts from an injected model: batches, a fallback to single texts, zeros for what fails."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts in a batch, and places of a vector where no text has given one yet (fixed values).
BATCH, PLACES = 10, 384


class EmbeddingError(RuntimeError):
    """No text of a batch could be embedded."""


@dataclass(frozen=True)
class Embedder:
    """call gets a list of texts and gives a vector for each, or raises. It runs in the tasks and must be picklable."""

    call: Callable[[list[str]], list[list[float]]]
    places: int | None = None
    batch: int = BATCH

    def _batch(self, texts: list[str], places: int) -> list[list[float]]:
        try:
            return self._checked(texts)
        except Exception as e:  # noqa: BLE001  whatever a model raises
            out, good = [], 0
            for t in texts:
                try:
                    out += self._checked([t])
                    good += 1
                except Exception:  # noqa: BLE001
                    out.append([0.0] * places)
            if not good:
                raise EmbeddingError(f"no text of {len(texts)} could be embedded: {e}") from e
            return out

    def _checked(self, texts: list[str]) -> list[list[float]]:
        found = self.call(texts)
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
        return [[float(x) for x in v] for v in found]

    def vectors(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """(key, vector) for every row of df; a null text counts as empty.

        A task's texts go to the model in batches. Where a batch fails its texts go one by one; one that fails alone gets
        zeros, as many as the task's vectors so far have places. A batch of which every text fails raises EmbeddingError.
        """
        kind = df.schema[key].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            places, keys, texts = self.places, [], []

            def made() -> pa.RecordBatch:
                nonlocal places
                found = self._batch(texts, places or PLACES)
                places = places or max(map(len, found))
                return pa.RecordBatch.from_arrays([pa.array(keys, of), pa.array(found, pa.list_(pa.float64()))], [key, "vector"])

            of = None
            for b in batches:
                of = b.schema.field(0).type
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    keys.append(k)
                    texts.append(t or "")
                    if len(texts) == self.batch:
                        yield made()
                        keys, texts = [], []
            if texts:
                yield made()

        return df.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, vector array<double>")
