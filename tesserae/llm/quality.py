"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Indicators of byte 1- to 3-grams and of runs of the same word are hashed to fixed slots. Each is scaled by the log ratio
of its smoothed counts in the two classes; a linear model with hinge loss is fitted to the scaled rows by dual coordinate
descent, and a logistic curve fitted to margins of held-back rows turns margins into scores.

The model is fitted on a bounded sample, FIT labelled rows at most, those of the smallest hash of their key; all
documents are scored, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 1 << 18
#: Labelled rows that the model is fitted on, at most; their texts are read whole.
FIT = 8_000
FOLDS, THRESHOLD = 5, 0.3
#: Runs of the same word are told apart up to this length; a row is divided by its number of indicators to this power.
RUNS, POWER = 12, 0.3


def _slots(codes: np.ndarray, salt: int) -> np.ndarray:
    return ((codes.astype(np.uint32) + np.uint32(salt)) * np.uint32(2654435761)) >> np.uint32(14)


def indicators(text: str | None) -> np.ndarray:
    """The distinct slots of a text's n-grams, sorted; none for an empty text."""
    data = (text or "").encode()
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    found = [_slots(a, 1 << 25)]
    if len(a) > 1:
        found.append(_slots(a[:-1] << 8 | a[1:], 1 << 26))
    if len(a) > 2:
        found.append(_slots(a[:-2] << 16 | a[1:-1] << 8 | a[2:], 0))
    words = data.split()
    # n-grams over "the same word again": runs of equal words
    same = np.array([x == y for x, y in zip(words[:-1], words[1:], strict=True)], bool)
    runs, k = same, 2
    while k <= RUNS and runs.any():
        found.append(_slots(np.array([k]), 1 << 27))
        runs, k = runs[:-1] & same[k - 1 :], k + 1
    return np.unique(np.concatenate(found))


@dataclass
class Model:
    weights: np.ndarray
    slope: float
    shift: float

    def margin(self, slots: np.ndarray) -> float:
        return float(self.weights[slots].sum() / max(1, len(slots)) ** POWER)

    def score(self, slots: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(slots) + self.shift, -30, 30))))


def _ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log ratios of the classes' smoothed and normalised indicator counts."""
    counts = np.ones((2, SLOTS))
    for r, label in zip(rows, y, strict=True):
        counts[int(label > 0), r] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def _descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of the linear hinge-loss model, without a bias, by dual coordinate descent; classes weigh alike."""
    n, w = len(rows), np.zeros(SLOTS)
    scaled = [ratio[r] / max(1, len(r)) ** POWER for r in rows]
    norm = np.array([v @ v + 1e-9 for v in scaled])
    top = np.where(y > 0, cost * n / (2 * max(1, (y > 0).sum())), cost * n / (2 * max(1, (y < 0).sum())))
    alpha, order = np.zeros(n), np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(n):
            grad = y[i] * (scaled[i] @ w[rows[i]]) - 1
            new = min(max(alpha[i] - grad / norm[i], 0.0), top[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * scaled[i]
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def _curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margins to the probability of class 1, by Newton steps."""
    high, low = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (high + 1) / (high + 2), 1 / (low + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - t) * margins).sum() + 1e-3 * a, (p - t).sum()])
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * margins**2).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step /= max(1.0, np.abs(step).max() / 2)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: list[int]) -> Model:
    """A model of labelled rows; with rows of one class or none, a constant score."""
    y = np.where(np.array(labels, dtype=np.int64) > 0, 1.0, -1.0) if len(labels) else np.zeros(0)
    if not (y > 0).any() or not (y < 0).any():
        sure = 4.0 if (y > 0).any() else -4.0 if len(y) else 0.0
        return Model(np.zeros(SLOTS, np.float32), 0.0, sure)
    back = np.arange(len(rows)) % FOLDS == 0
    if len({*y[back]}) == 2 and len({*y[~back]}) == 2:
        part = [r for r, x in zip(rows, back, strict=True) if not x]
        ratio = _ratios(part, y[~back])
        w = _descend(part, y[~back], ratio)
        half = Model(w * ratio, 1.0, 0.0)
        curve = _curve(np.array([half.margin(r) for r, x in zip(rows, back, strict=True) if x]), y[back])
    else:
        curve = (1.0, 0.0)
    ratio = _ratios(rows, y)
    w = _descend(rows, y, ratio)
    return Model((w * ratio).astype(np.float32), *curve)


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit on at most FIT labelled rows that are not held out; null keys, labels and keys without a document are left out.

    A key counts once: with its smallest label, and with the text of the smallest hash. Spark picks them, so no more
    than FIT rows of indicators reach the driver.
    """
    usable = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).where(F.col("_key").isNotNull() & F.col("_label").isNotNull() & ~held_out(F.col("_key")))
    sample = usable.groupBy("_key").agg(F.min("_label").alias("_label")).withColumn("_h", F.xxhash64("_key")).orderBy("_h", "_key").limit(FIT)
    texts = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text"))
    joined = texts.join(F.broadcast(sample), F.col("_doc") == F.col("_key")).select("_key", "_h", "_label", "_text")
    one = joined.withColumn("_r", F.row_number().over(Window.partitionBy("_key").orderBy(F.xxhash64("_text")))).where("_r = 1").select("_h", "_label", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([indicators(x).astype("<i4").tobytes() for x in b.column(2).to_pylist()], pa.binary())], ["h", "label", "slots"])

    found = sorted((r.h, r.label, bytes(r.slots)) for r in one.mapInArrow(run, "h long, label int, slots binary").toLocalIterator())
    return fit([np.frombuffer(s, "<i4") for _, _, s in found], [x for _, x, _ in found])


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """(key, held_out, score, predicted) for every row of docs, or, with keep, the rows of docs predicted as 1.

    A null text counts as empty; empty texts are scored by the curve's shift alone. A null key is carried along and counts as
    not held out. Repeated rows are scored alike. Empty labels give every document the score 0.5; an empty table gives
    an empty table. Only the text is an input of a score.
    """
    model = train(docs, labels, key, text)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(indicators(x)) for x in b.column(1).to_pylist()], pa.float64())], [key, "score"])

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.score(indicators(x)) >= THRESHOLD for x in b.column(b.schema.get_field_index(text)).to_pylist()], pa.bool_()))

    if keep:
        return docs.mapInArrow(good, docs.schema)
    out = docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, score double")
    return out.select(key, F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
