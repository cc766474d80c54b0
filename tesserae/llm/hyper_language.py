"""Language identification by hyperdimensional profiles.

Each letter, and the gap between words, is a random vector of +1 and -1. An n-gram is the product (binding) of its letters'
vectors, each rotated (permuted) by its distance from the n-gram's end; a text is the sum (bundle) of its n-grams' vectors,
and a language the sum of its training texts'. A text is of the language whose vector has the largest cosine with its own.

Vectors are made of a letter's code point and a seed alone, so that all tasks have the same ones without sharing a table.
Languages' vectors are sums of whole numbers, added up in tasks and then by Spark, so they do not depend on any order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES, N, SEED = 1_024, 3, 7_919
#: N-grams a worker remembers the vectors of; beyond it, it starts afresh.
REMEMBERED = 40_000
#: Documents whose bundles are computed together, and the n-grams that all of them may hold.
TOGETHER, GRAMS = 64, 12_000
#: Languages whose vectors the driver hands to the executors at most: 80 MB.
LANGUAGES = 10_000
GAP, UNKNOWN = 32, "und"


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point the code point of its lower-case letter, or GAP if it is none."""
    out = np.full(0x110000, GAP, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@lru_cache(100_000)
def letter_vector(code: int) -> np.ndarray:
    return np.random.default_rng([SEED, code]).integers(0, 2, PLACES, dtype=np.int8) * np.int8(2) - np.int8(1)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, 21 bits a letter, and how often each occurs; none if it has no letter.

    Letters count in lower case, whatever stands between two words is one gap, and so are the text's beginning and end.
    """
    c = letters()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")]
    c = np.concatenate(([GAP], c, [GAP])).astype(np.int64)
    c = c[np.append(True, (c[1:] != GAP) | (c[:-1] != GAP))]
    if len(c) < N:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.unique(sum(c[k : len(c) - N + 1 + k] << 21 * (N - 1 - k) for k in range(N)), return_counts=True)


class Profiles:
    """Vectors of n-grams, kept while they are few."""

    def __init__(self):
        self.place: dict[int, int] = {}
        self.rows = np.empty((1_024, PLACES), np.float32)

    def places(self, known: np.ndarray) -> np.ndarray:
        """Rows of these n-grams, which are made if they are new."""
        found = np.fromiter((self.place.get(g, -1) for g in known.tolist()), np.int64, len(known))
        new = known[found < 0]
        if len(new):
            if len(self.place) + len(new) > REMEMBERED:
                self.place.clear()
                new = known
            first = len(self.place)
            if first + len(new) > len(self.rows):
                self.rows = np.concatenate((self.rows[:first], np.empty((first + 2 * len(new) + 1_024, PLACES), np.float32)))
            for s in range(0, len(new), 2_048):
                part = new[s : s + 2_048]
                bound = np.ones((len(part), PLACES), np.int8)
                for k in range(N):
                    codes, at = np.unique(part >> 21 * (N - 1 - k) & 0x1FFFFF, return_inverse=True)
                    bound *= np.stack([np.roll(letter_vector(c), N - 1 - k) for c in codes.tolist()])[at]
                self.rows[first + s : first + s + len(part)] = bound
            self.place.update(zip(new.tolist(), range(first, first + len(new)), strict=True))
            found = np.fromiter((self.place[g] for g in known.tolist()), np.int64, len(known))
        return found

    def bundles(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The sum of each text's n-gram vectors, in double precision; whole numbers, and so the same in every order."""
        out = np.zeros((len(texts), PLACES))
        begin = 0
        while begin < len(texts):
            end, n = begin + 1, len(texts[begin][0])
            while end < len(texts) and end - begin < TOGETHER and n + len(texts[end][0]) <= TOGETHER * GRAMS // 8:
                n += len(texts[end][0])
                end += 1
            each, at = np.unique(np.concatenate([g for g, _ in texts[begin:end]]), return_inverse=True)
            row = np.repeat(np.arange(end - begin), [len(g) for g, _ in texts[begin:end]])
            times = np.concatenate([n for _, n in texts[begin:end]])
            for s in range(0, len(each), GRAMS):
                part = each[s : s + GRAMS]
                here = (at >= s) & (at < s + GRAMS)
                counts = np.zeros((end - begin, len(part)), np.float32)
                counts[row[here], at[here] - s] = times[here]
                # Sums of 32 bits are exact up to 2^24; longer texts are summed in 64.
                exact = counts.sum(axis=1).max(initial=0) >= 1 << 24
                at_row = self.places(part)
                vectors = self.rows[at_row]
                out[begin:end] += counts.astype(np.float64) @ vectors.astype(np.float64) if exact else counts @ vectors
            begin = end
        return out


@lru_cache(1)
def profiles() -> Profiles:
    """One a worker, kept between tasks."""
    return Profiles()


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def prototypes(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> dict[str, np.ndarray]:
    """The sum of the texts' bundles by language, over all rows that are not held out and have a key and a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, total = profiles(), {}
        for whole in batches:
            for b in (whole.slice(k, 1_024) for k in range(0, whole.num_rows, 1_024)):
                parts: dict[str, list] = {}
                for lang, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    parts.setdefault(lang, []).append(grams(x.as_py()))
                for lang, found in parts.items():
                    # A language's texts of a batch make one bundle.
                    g, n = (np.concatenate(x) for x in zip(*found, strict=True))
                    each, at = np.unique(g, return_inverse=True)
                    if len(each):
                        times = np.zeros(len(each), np.int64)
                        np.add.at(times, at, n)
                        total[lang] = total.get(lang, 0) + np.rint(by.bundles([(each, times)])[0]).astype(np.int64)
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * PLACES, pa.string()), pa.array(np.arange(PLACES, dtype=np.int32)), pa.array(v)], ["lang", "place", "value"])

    usable = docs.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    sums = usable.select(F.col(label).cast("string").alias("lang"), F.col(text)).mapInArrow(run, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    found: dict[str, np.ndarray] = {}
    for r in sums.toLocalIterator():
        if r.lang not in found and len(found) == LANGUAGES:
            raise ValueError(f"more than {LANGUAGES} languages")
        found.setdefault(r.lang, np.zeros(PLACES))[r.place] = r.value
    return {x: found[x] for x in sorted(found) if found[x].any()}


def predicted(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score) for every row of docs: the language of the largest cosine, ties to the smaller name, and that cosine, 0 at least.

    A null text, one without a letter, and every text where no language was learned, are und with the score 0. A null key
    is carried along, counts as not held out and is not learned from. Texts of any length count whole; repeated rows are
    predicted alike and learned from as often; an empty table gives an empty table. Only the text is an input of a
    prediction; other columns are not read.
    """
    known = prototypes(docs, key, text, label)
    names = [*known, UNKNOWN]
    unit = np.stack([v / math.sqrt(v @ v) for v in known.values()]) if known else np.zeros((0, PLACES))
    shared = docs.sparkSession.sparkContext.broadcast((names, unit))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, (names, unit) = profiles(), shared.value
        for whole in batches:
            for b in (whole.slice(k, 1_024) for k in range(0, whole.num_rows, 1_024)):
                v = by.bundles([grams(x.as_py()) for x in b.column(1)])
                size = np.sqrt((v * v).sum(axis=1))
                best, score = np.full(len(v), len(unit)), np.zeros(len(v))
                if len(unit):
                    cosine = v @ unit.T / np.maximum(size, 1)[:, None]
                    some = size > 0
                    best[some], score[some] = cosine.argmax(axis=1)[some], np.clip(cosine.max(axis=1)[some], 0, 1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([names[k] for k in best.tolist()], pa.string()), pa.array(score)], [key, "lang_pred", "score"])

    out = docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, lang_pred string, score double")
    return out.select(key, F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"), "lang_pred", "score")
