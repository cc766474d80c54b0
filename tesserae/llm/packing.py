"""Packing by concatenation: two passes of prefix sums give each document its global offset, fixed windows cut it.

Pass one tokenises and keeps, per partition, a running offset; its table is written to the shared folder. The totals of
partitions, one row each, are summed up into the partitions' global offsets. Pass two reads the table and cuts each
document where a window ends; a document's pieces are its boundary records. No document is moved between executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Words a worker remembers; beyond it, it starts afresh.
REMEMBERED = 900_000
#: Words that are longer are not remembered.
LONG = 64
END = 2
#: New words that go to the tokenizer as one text, with one of its special tokens between them.
TOGETHER = 100


#: Texts that a tokenizer must encode as it does their words, tried once a worker.
PROBES = ("a b", " a  b\nc ", "it's 1,000.5 (x)\tÜber\r\nnaïve", "end. Start\n\n- item", "")


class WordTokens:
    """Ids of a tokenizers file that drops white space, word by word: neither merges nor patterns reach over a space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        special = sorted((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special)
        self.specials = [x for _, x in special]
        self.cut, self.between = special[0] if special else (-1, "")
        self.known: dict[str, bytes] = {}
        self.marks = {x[0] for x in self.specials}
        for text in PROBES:
            if self.tokenizer.encode(text, add_special_tokens=False).ids != np.frombuffer(self.ids([text])[0], "<u4").tolist():
                raise ValueError("the tokenizer does not work word by word")

    def _encoded(self, words: list[str]) -> list[bytes]:
        """Ids of each word. A special token is cut out of a text before anything else, so words beside one stay apart."""
        lists = self.tokenizer.encode_batch_fast(words, add_special_tokens=False) if not self.between else []
        if lists:
            return [np.array(e.ids, "<u4").tobytes() for e in lists]
        out = []
        parts = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([self.between.join(x) for x in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            raw, cuts = ids.tobytes(), [-1, *np.flatnonzero(ids == self.cut).tolist(), len(ids)]
            if len(cuts) != len(part) + 1:
                raise RuntimeError("words ran together")
            out += [raw[4 * s + 4 : 4 * e] for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        known = self.known
        split = [(x or "").replace("\n", " ").split(" ") for x in texts]
        if len(known) > REMEMBERED:
            known.clear()
        new = set().union(*split).difference(known)
        odd = [w for w in new if not self.marks.isdisjoint(w) and any(x in w for x in self.specials)]
        once = {w: np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in odd}
        plain = list(new.difference(odd))
        for at in range(0, len(plain), 5_000):
            part = plain[at : at + 5_000]
            for w, x in zip(part, self._encoded(part), strict=True):
                (known if len(w) <= LONG else once)[w] = x
        if once:
            return [b"".join([known[w] if w in known else once[w] for w in ws]) for ws in split]
        return [b"".join(map(known.__getitem__, ws)) for ws in split]


@lru_cache(2)
def word_tokens(path: str) -> WordTokens:
    """One tokenizer a worker, kept between tasks."""
    return WordTokens(path)


def tokenised(docs: DataFrame, tokenizer: str, key: str, text: str) -> DataFrame:
    """Pass one: (key, part, local_start, doc_tokens, ids) with ids as 32-bit numbers, the end id included."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, at = word_tokens(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([END], "<u4").tobytes()
        for whole in batches:
            for b in (whole.slice(k, 500) for k in range(0, whole.num_rows, 500)):
                ids = [x + end for x in words.ids(b.column(1).to_pylist())]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())], [key, "part", "local_start", "doc_tokens", "ids"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, part int, local_start long, doc_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds the ids.

    Every sequence but the last is full. A null or empty text is its end id alone; null keys are carried along; of
    repeated rows each is packed; an empty table gives no pieces; other columns are not read. A text longer than a
    sequence goes on in the next ones.
    """
    kind = docs.schema[key].dataType.simpleString()
    table = materialise(tokenised(docs, tokenizer, key, text))
    totals = table.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    # A row per partition of the input: its size is fixed by the number of tasks, not by that of documents.
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before")).fillna(0, ["before"])
    placed = table.join(F.broadcast(before), "part").select(F.col(key), (F.col("before") + F.col("local_start")).alias("at"), "doc_tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(k, 500) for k in range(0, whole.num_rows, 500)):
                rows: list[list] = [[] for _ in range(8)]
                for d, at, n, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    done = 0
                    while done < n:
                        here = at + done
                        many = min(n - done, size - here % size)
                        piece = ids[4 * done : 4 * (done + many)]
                        for r, v in zip(rows, (d, done, many, zlib.crc32(piece), n, here // size, here % size, piece), strict=True):
                            r.append(v)
                        done += many
                arrays = [pa.array(rows[0], b.schema.field(0).type), *(pa.array(r, pa.int64()) for r in rows[1:7])] + [pa.array(rows[7], pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(arrays, [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids)

    return placed.mapInArrow(run, f"{key} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)
