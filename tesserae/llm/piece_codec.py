"""SentencePiece BPE encoding by backtracking, and decoding.

The longest piece at a position comes from an Aho-Corasick automaton. It is taken if it is compatible with the piece
before it: merging the two pieces' text again, by the model's scores, must give just these two. If not, the next
shorter piece is tried, and where none is left the last piece is taken back and the position marked in a bitfield, so
that no position fails twice. A sequence in which all neighbours are compatible is the one that merging gives.

No piece holds the space mark after another character, nor a line break, which the constructor checks, so the words of
a text, each with the mark before it, are encoded alone; every worker keeps the encodings of words it has seen, up to a bound.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Words a worker remembers; beyond it, it starts afresh.
REMEMBERED = 700_000
NORMAL, BYTE, USER_DEFINED = 1, 6, 4


class Codec:
    """A SentencePiece BPE model with byte fallback, no normalisation and a leading space mark."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        n = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not model.trainer_spec.byte_fallback:
            raise ValueError("only BPE with byte fallback, without normalisation")
        self.ids, self.score, self.byte_ids, self.surface = {}, {}, {}, []
        for i, p in enumerate(model.pieces):
            if p.type == USER_DEFINED:
                raise ValueError("user-defined pieces are not supported")
            self.surface.append(bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else p.piece.replace(MARK, " ").encode() if p.type == NORMAL else b"")
            if p.type == BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
            elif p.type == NORMAL:
                self.ids[p.piece], self.score[p.piece] = i, p.score
                if MARK in p.piece.lstrip(MARK) or "\n" in p.piece:
                    raise ValueError("a piece spans words or lines")
        self.eos, self.longest = model.trainer_spec.eos_id, max(map(len, self.ids))
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.compatible: dict[tuple[str, str], bool] = {}
        self.words: dict[str, tuple[str, bytes, int]] = {}

    def merged(self, text: str) -> list[str]:
        """text by merging: again and again the adjacent parts that make the best piece, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fit(self, a: str, b: str) -> bool:
        """Whether merging leaves a next to b; no merge can cross a boundary where no piece spans it."""
        found = self.merged(a + b) == [a, b]
        if len(self.compatible) > 2_000_000:
            self.compatible.clear()
        self.compatible[a, b] = found
        return found

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text whose characters are all pieces themselves."""
        n, ids, compatible, longest = len(text), self.ids, self.compatible, self.automaton.longest_prefix
        failed, out, at = bytearray(n // 8 + 1), [], 0
        size = longest(text[: self.longest])
        while at < n:
            taken = False
            while size:
                piece, end = text[at : at + size], at + size
                if piece in ids and not failed[end >> 3] >> (end & 7) & 1:
                    if not out or ((ok := compatible.get((out[-1], piece))) is None and self._fit(out[-1], piece)) or ok:
                        taken = True
                        break
                size -= 1
            if taken:
                out.append(piece)
                at = end
                size = longest(text[at : at + self.longest])
            else:
                failed[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                at -= len(last)
                size = len(last) - 1
        return out

    def encode_word(self, text: str) -> list[int]:
        """Ids of a text with space marks; characters that are no piece become bytes, and no merge reaches over them."""
        ids, out, start = self.ids, [], 0
        for k, c in enumerate(text):
            if c not in ids:
                if k > start:
                    out += [ids[p] for p in self.pieces(text[start:k])]
                out += [self.byte_ids[b] for b in c.encode()]
                start = k + 1
        return out + [ids[p] for p in self.pieces(text[start:])] if start < len(text) else out

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.surface[i] for i in ids])

    def _word(self, word: str) -> tuple[str, bytes, int]:
        ids = self.encode_word(word)
        found = " ".join(map(str, ids)), self.decode_bytes(ids), len(ids)
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        if len(word) < 100:
            self.words[word] = found
        return found

    def split(self, text: str) -> list[str]:
        """The words of a text, each with the space marks before it; a line break starts a word too."""
        text = MARK + text.replace(" ", MARK)
        return re.findall(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*|[^{MARK}\n]+", text)

    def encoded(self, text: str) -> tuple[str, bytes, int]:
        """Ids in decimal joined by spaces, the decoded bytes, and the number of ids, each with the end id."""
        words, known = self.split(text) if text else [], self.words
        found = [known.get(w) or self._word(w) for w in words]
        ids = " ".join([x[0] for x in found] + [str(self.eos)])
        return ids, b"".join([x[1] for x in found])[1:], sum([x[2] for x in found]) + 1


@lru_cache(2)
def codec(path: str) -> Codec:
    """One codec a worker, kept between tasks."""
    return Codec(path)


def encode_decode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row of docs: the number of ids with the end id, digests of the ids and of the text decoded from them.

    A null or empty text has the end id alone and decodes to an empty text; keys are carried along, null ones too;
    repeated rows give repeated rows; an empty table gives an empty table; other columns are not read. Texts of any
    length are encoded whole. with_ids adds ids (decimal, joined by spaces) and decoded.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            ns, hi, hd, ii, dd = [], [], [], [], []
            for x in b.column(1).to_pylist():
                ids, decoded, n = c.encoded(x or "")
                plain = decoded.decode("utf-8", "replace").encode() if decoded else b""
                ns.append(n)
                hi.append(hashlib.sha256(ids.encode()).hexdigest())
                hd.append(hashlib.sha256(plain).hexdigest())
                if with_ids:
                    ii.append(ids)
                    dd.append(plain.decode())
            extra = [pa.array(ii, pa.string()), pa.array(dd, pa.string())] if with_ids else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), pa.array(hi, pa.string()), pa.array(hd, pa.string()), *extra], [key, "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"][: len(extra)]])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * with_ids)
