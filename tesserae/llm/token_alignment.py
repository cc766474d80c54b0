"""Alignment of two tokenizers' tokens by the bytes that they cover.

The ends of B's tokens are a static index of intervals; for each token of A two bisections in it find the list of B tokens
that it overlaps. A gap between two B tokens that no A token spans is an end of tokens of both and becomes a boundary of
groups. Both tokenizers always end a token before a space that follows no space and precedes no white space, which the
constructor proves from B's vocabulary and which A's pattern says of its own; so a text is aligned chunk by chunk, and
every worker keeps the chunks it has aligned, up to a bound.

What depends on the corpus, how often an A id and a B id are linked, takes two steps. Documents are read in blocks; a block
is one row of a written table, with its documents as lists of chunks, its chunks as lists of id pairs and its id pairs
with their numbers of links. Pairs are summed over blocks and handed back to each block's pairs, so that what is shuffled
is a row per block and pair and a row per block, never a row per token.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

MARK = "▁"
#: A block is full with this many characters, or with so many distinct chunks that the worker knows.
BLOCK, REMEMBERED = 2_000_000, 160_000
#: Chunks that a worker may keep between tasks: it stays beside the later stages' memory.
KEPT = 60_000
#: New chunks that go to the tokenizers as one text, and the characters of one that goes alone.
TOGETHER, LONG = 20_000, 1_000
#: A block's row has megabytes: pages and row groups are closed by their bytes after any row, not after a hundred, and a
#: row group, which is read as a whole, is small.
WRITTEN = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1}
#: Where both tokenizers end a token: before a space between a character that is no space and one that is no white space,
#: and before a line break between two that are none.
CUT = re.compile(r"(?<=[^ ])(?= \S)|(?<=\S)(?=\n\S)")
#: The pattern of byte-level tokenizers with use_regex (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters below it are letters, numbers or neither in all versions of Unicode; only they go to the faster library.
LATIN = "\u0250"
LOW = (1 << 32) - 1


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


def aligned(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the ends of A's and B's tokens over the same bytes: the first and last B token that each A token overlaps, and the A tokens that end a group."""
    first = np.searchsorted(b_end, np.concatenate(([0], a_end[:-1])), "right")
    last = np.searchsorted(b_end, a_end, "left")
    # No token of A spans the gap behind B token last[k] if the next one begins with another B token.
    return first, last, np.flatnonzero(np.append(first[1:] > last[:-1], True))


def regular(chunk: str) -> bool:
    """Whether a chunk without its leading space begins, but for one line break, and ends with no white space, so that others may stand beside it."""
    inner = chunk[1:] if chunk.startswith("\n") else chunk
    return bool(inner) and inner == inner.strip() and len(chunk) <= LONG


class Aligner:
    """A byte-level tokenizers file (A) and a SentencePiece model (B), and the chunks that have been aligned."""

    def __init__(self, byte_file: str, piece_model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=piece_model)
        byte = byte_of()
        entries = {bytes(byte[c] for c in t): i for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
            raise ValueError("a piece spans words or lines")
        self.a_bytes = {i: t for t, i in entries.items()}
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_size = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.a_size[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.decimal = [str(i) for i in range(max(len(self.a_size), len(self.b_size)))]
        # The file's merges in the order of their entries' ids are ranks, which the faster library reads.
        with open(byte_file, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        made = [entries[bytes(byte[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in merges]
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=entries, special_tokens={}) if made == list(range(256, 256 + len(made))) and len(entries) == 256 + len(made) else None
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        #: By chunk: tokens of A and of B, groups (0: the bytes differ), the groups' text, and where its links begin.
        self.n_a, self.n_b, self.n_groups, self.groups, self.first = array("q"), array("q"), array("q"), [], array("q", [0])
        #: The links of all chunks, A id in the upper 32 bits.
        self.links = array("q")

    def rest(self) -> None:
        """Forget the chunks if they are more than a worker may keep between tasks."""
        if len(self.known) > KEPT:
            self.clear()

    def learn(self, chunks: list[str]) -> None:
        """Align chunks that are not known yet: regular ones many at a time, as the one text that they make."""
        plain = [x for x in chunks if regular(x)]
        latin = [x for x in plain if x.isascii() or max(x) < LATIN]
        for part in (latin, [x for x in plain if not (x.isascii() or max(x) < LATIN)]):
            for k in range(0, len(part), TOGETHER):
                self._align(part[k : k + TOGETHER], part is latin)
        for x in chunks:
            if x not in self.known:
                self._align([x])

    def _align(self, chunks: list[str], latin: bool = False) -> None:
        # A first word that every chunk can follow; SentencePiece sets its own space before it.
        parts = [" x", *[x if x[0] in " \n" else " " + x for x in chunks]]
        text = "".join(parts)
        a = self.fast.encode_ordinary(text) if self.fast and latin else self.a.encode(text, add_special_tokens=False).ids
        b = self.b.encode(text[1:])
        raw = [x.encode() for x in parts]
        joined = b"".join(raw)
        if b"".join(map(self.a_bytes.__getitem__, a)) != joined or b"".join(map(self.b_bytes.__getitem__, b)) != joined:
            if len(chunks) > 1:
                for x in chunks:
                    self._align([x], latin)
            else:
                self._keep(chunks, [""], np.zeros((3, 1), np.int64), np.empty(0, np.int64), [0])
            return
        ids, others = np.array(a, np.int64), np.array(b, np.int64)
        a_end, b_end = np.cumsum(self.a_size[ids]), np.cumsum(self.b_size[others])
        first, last, cuts = aligned(a_end, b_end)
        ends = np.cumsum([len(x) for x in raw])
        group = np.searchsorted(a_end[cuts], ends)
        if not np.array_equal(a_end[cuts][group], ends):
            raise RuntimeError("a token spans chunks")
        # By chunk, the first one left out: where its groups, tokens and links end.
        group = group + 1
        n_a, n_b = cuts[group - 1] + 1, last[cuts[group - 1]] + 1
        size = last - first + 1
        links = np.concatenate(([0], np.cumsum(size)))
        pairs = np.repeat(ids << 32, size) | others[np.repeat(first - links[:-1], size) + np.arange(links[-1])]
        texts, s, t, word = [], 0, 0, self.decimal
        for u, v in zip((cuts + 1).tolist(), (last[cuts] + 1).tolist(), strict=True):
            texts.append(f"{word[a[s]]}|{word[b[t]]}" if u - s == 1 == v - t else ",".join([word[i] for i in a[s:u]]) + "|" + ",".join([word[i] for i in b[t:v]]))
            s, t = u, v
        g = group.tolist()
        self._keep(chunks, [";".join(texts[i:j]) for i, j in zip(g[:-1], g[1:], strict=True)], np.diff([n_a, n_b, group]), pairs[links[n_a[0]] :], (links[n_a[1:]] - links[n_a[0]]).tolist())

    def _keep(self, chunks: list[str], texts: list[str], sizes: np.ndarray, links: np.ndarray, ends: list[int]) -> None:
        begin = len(self.links)
        self.known.update(zip(chunks, range(len(self.groups), len(self.groups) + len(chunks)), strict=True))
        self.groups += texts
        for have, new in zip((self.n_a, self.n_b, self.n_groups), sizes, strict=True):
            have.frombytes(np.ascontiguousarray(new, np.int64).tobytes())
        self.links.frombytes(links.astype(np.int64).tobytes())
        self.first.extend([begin + x for x in ends])

    def chunks(self, text: str) -> list[int]:
        """The chunks of a space and the text, by their places; a chunk's leading space is left out of its name if it is regular."""
        known = self.known
        words = text.replace("\n", " \n").split(" ")
        found = list(map(known.get, words))
        if None in found:
            new = dict.fromkeys([w for w, k in zip(words, found, strict=True) if k is None])
            if all(map(regular, new)):
                self.learn(list(new))
            else:
                cut = CUT.split(" " + text)
                words = [x[1:] if x[0] == " " and regular(x[1:]) and x[1] != "\n" else x for x in cut]
                self.learn([x for x in dict.fromkeys(words) if x not in known])
            found = list(map(known.__getitem__, words))
        return found


@lru_cache(1)
def aligner(byte_file: str, piece_model: str) -> Aligner:
    """One a worker, kept between tasks."""
    return Aligner(byte_file, piece_model)


def _spread(first: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the lists of which first has the beginnings, one list after the other, and where each begins there."""
    size = first[of + 1] - first[of]
    begins = np.concatenate(([0], np.cumsum(size)))
    return np.repeat(first[of] - begins[:-1], size) + np.arange(begins[-1]), begins


def _numbers(x: array) -> np.ndarray:
    return np.array(x, np.int64)


class Block:
    """Documents that make one row."""

    def __init__(self, by: Aligner):
        self.by, self.keys, self.chunks, self.chars = by, [], [], 0

    def full(self) -> bool:
        return self.chars >= BLOCK or len(self.by.known) >= REMEMBERED

    def add(self, key: object, text: str | None) -> None:
        self.keys.append(key)
        self.chunks.append(np.array(self.by.chunks(text) if text else [], np.int64))
        self.chars += len(text or "") + 1

    def columns(self) -> list:
        by = self.by
        n_a, n_b, n_groups, first, links = map(_numbers, (by.n_a, by.n_b, by.n_groups, by.first, by.links))
        # Texts whose bytes differ have no tokens.
        chunks = [c if len(c) and n_groups[c].all() else c[:0] for c in self.chunks]
        sizes = [(len(c), n_a[c].sum(), n_b[c].sum(), n_groups[c].sum(), (first[c + 1] - first[c]).sum()) for c in chunks]
        digests = [hashlib.sha256(";".join(map(by.groups.__getitem__, c.tolist())).encode()).hexdigest() if len(c) else "" for c in chunks]
        mine = np.unique(np.concatenate(chunks))
        at, begins = _spread(first, mine)
        pairs, place = np.unique(links[at], return_inverse=True)
        doc, chunk, times = [], [], []
        uses = np.zeros(len(mine), np.int64)
        for k, c in enumerate(chunks):
            if len(c):
                each, n = np.unique(np.searchsorted(mine, c), return_counts=True)
                doc.append(np.full(len(each), k, np.int32))
                chunk.append(each.astype(np.int32))
                times.append(n.astype(np.int32))
                uses[each] += n
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, place, np.repeat(uses, np.diff(begins)))
        raw = [(np.concatenate(x) if x else np.empty(0, np.int32)).tobytes() for x in (doc, chunk, times)]
        return [self.keys, *map(list, zip(*[map(int, s[1:]) for s in sizes], strict=True)), digests, *raw, begins.astype(np.int32).tobytes(), place.astype(np.int32).tobytes(), pairs, total]


PER_DOC = ["n_a", "n_b", "n_groups", "n_links"]
RAW = ["doc", "chunk", "times", "begins", "place"]


def _blocks(docs: DataFrame, key: str, text: str, byte_file: str, piece_model: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    names = ["block", "keys", *PER_DOC, "digests", *RAW, "pairs", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, seq, block, of_key = aligner(byte_file, piece_model), TaskContext.get().partitionId() << 32, None, pa.int64()

        def row() -> pa.RecordBatch:
            keys, *rest = block.columns()
            per_doc, digests, raw, pairs, links = rest[:4], rest[4], rest[5:10], rest[10], rest[11]
            longs = pa.list_(pa.int64())
            data = [pa.array([seq], pa.int64()), pa.array([keys], pa.list_(of_key)), *[pa.array([x], longs) for x in per_doc], pa.array([digests], pa.list_(pa.string())), *[pa.array([x], pa.binary()) for x in raw], pa.array([pairs], longs), pa.array([links], longs)]
            return pa.RecordBatch.from_arrays(data, names)

        for b in batches:
            of_key = b.schema.field(0).type
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if block is None:
                    if len(by.known) >= REMEMBERED:
                        by.clear()
                    block = Block(by)
                block.add(k, t.as_py())
                if block.full():
                    yield row()
                    block, seq = None, seq + 1
        if block is not None:
            yield row()
            block = None
        by.rest()

    made = f"block long, keys array<{kind}>, {', '.join(f'{c} array<long>' for c in PER_DOC)}, digests array<string>, {', '.join(f'{c} binary' for c in RAW)}, pairs array<long>, links array<long>"
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, made)


def _counted(found: dict, begins: np.ndarray, place: np.ndarray, doc: np.ndarray, chunk: np.ndarray, times: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n documents of a block its links that are the best of their B id, and the sum of its links' counts."""
    out = np.zeros((2, n), np.int64)
    if len(doc):
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        for k, name in enumerate(("best", "count")):
            value = np.zeros(len(found["at"]), np.int64)
            value[found["at"]] = found[name]
            by_chunk = np.add.reduceat(value[place], begins[:-1])
            out[k, doc[starts]] = np.add.reduceat(by_chunk[chunk] * times, starts)
    return out[0], out[1]


def align(docs: DataFrame, byte_file: str, piece_model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: tokens of A and B, groups, links, links that are their B id's most frequent, the sum of the links' counts over the corpus, and a digest of the groups.

    A encodes a space and the text, B the text, both whole. A null or empty text, and one whose tokens' bytes are not a
    space and the text (it holds the space mark of B), has no tokens: zeros and an empty digest, and no links to count.
    Keys are carried along, null ones too; repeated rows give repeated rows and count as often; an empty table gives an
    empty table; other columns are not read. The count of an id pair is that of all its links in the corpus; ties at the
    top are all best.
    """
    blocks = materialise(_blocks(docs, key, text, byte_file, piece_model), **WRITTEN)
    each = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "links")).alias("at", "x")).select("block", "at", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links"))
    counts = each.groupBy("pair").agg(F.sum("links").alias("count")).withColumn("b", F.col("pair").bitwiseAND(LOW))
    top = counts.groupBy("b").agg(F.max("count").alias("most"))
    counts = materialise(counts.join(top, "b").select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best")))
    found = each.select("block", "at", "pair").join(counts, "pair").groupBy("block").agg(F.collect_list(F.struct("at", "count", "best")).alias("found"))
    kind = docs.schema[key].dataType.simpleString()

    def run(block: pa.Table) -> pa.Table:
        row = block.combine_chunks().to_batches()[0]
        col = lambda c: row.column(row.schema.get_field_index(c))
        keys, per_doc, digests = col("keys").flatten(), [col(c).flatten() for c in PER_DOC], col("digests").flatten()
        raw = {c: np.frombuffer(col(c)[0].as_py(), np.int32) for c in RAW}
        x = col("found").flatten()
        got = {c: x.field(c).to_numpy(zero_copy_only=False) for c in ("at", "count", "best")} if len(x) else {}
        best, total = _counted(got, raw["begins"], raw["place"], raw["doc"], raw["chunk"], raw["times"], len(keys))
        return pa.table([keys, *per_doc, pa.array(best), pa.array(total), digests], [key, *PER_DOC, "n_best", "count_sum", "groups_sha256"])

    # By groups, a batch that goes to Python is one block, however many of them a task has.
    both = blocks.drop("pairs", "links").join(found, "block", "left").groupBy("block")
    return both.applyInArrow(run, f"{key} {kind}, {', '.join(f'{c} long' for c in PER_DOC)}, n_best long, count_sum long, groups_sha256 string")
