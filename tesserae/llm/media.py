"""Baseline JPEG columns: payload bytes stored as quantised coefficients, and a decoder for DC-only thumbnails.

A baseline JPEG keeps quantised DCT coefficients without loss, so a byte is stored as the coefficient byte - 108. An
image has three components of one 8x8 block each in an MCU, that is 192 coefficients, and a restart after each MCU. The
codes are those of the tables that the format's specification gives as typical for luminance.

Scans are decoded by their Huffman codes: a table of all 16-bit prefixes gives the length and symbol of the code that
starts there, and the restart segments of many images advance together, one symbol a step, in numpy arrays.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 192
#: A byte less this is its coefficient: about the middle of small letters, so that those of texts are short.
MIDDLE = 108
#: Units (MCUs) that are coded together, restart segments that are decoded together, and bytes of payload in a group.
CODED, TOGETHER, GROUP = 500, 5_000, 1 << 20

# The specification's typical luminance tables, as numbers of codes of 1 to 16 bits and their symbols. The
# symbols of AC codes of 16 bits are, but for the first, all the others in order.
DC_COUNTS, DC_SYMBOLS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))
AC_COUNTS = bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125])
AC_FIRST = bytes.fromhex("01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82")
AC_SYMBOLS = AC_FIRST + bytes(sorted({r << 4 | s for r in range(16) for s in range(1, 11)} - set(AC_FIRST)))
#: DC is quantised by 8, so that a pixel of the thumbnail is the first byte of its block, brightened.
QUANT = b"\x08" + b"\x01" * 63
END_OF_BLOCK, SKIP_16 = 0x00, 0xF0

_BITS = np.array([k.bit_length() for k in range(2048)], np.int64)
_MASK = (1 << np.arange(17, dtype=np.int64)) - 1
_HALF = (1 << np.arange(17, dtype=np.int64)) >> 1


def _codes(counts: bytes, symbols: bytes) -> Iterator[tuple[int, int, int]]:
    """(length, code, symbol) of a table, shortest first."""
    code, k = 0, 0
    for length, c in enumerate(counts, 1):
        for _ in range(c):
            yield length, code, symbols[k]
            code, k = code + 1, k + 1
        code <<= 1


@lru_cache(64)
def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16-bit prefix the code's length times 256 plus its symbol, or zero where no code starts so."""
    out = np.zeros(1 << 16, np.int64)
    for length, code, symbol in _codes(counts, symbols):
        at = code << (16 - length)
        if at >= 1 << 16:
            raise ValueError("more codes than fit")
        out[at : at + (1 << (16 - length))] = length << 8 | symbol
    return out


def _by_symbol(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    code, size = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for length, c, s in _codes(counts, symbols):
        code[s], size[s] = c, length
    return code, size


_DC_CODE, _DC_SIZE = _by_symbol(DC_COUNTS, DC_SYMBOLS)
_AC_CODE, _AC_SIZE = _by_symbol(AC_COUNTS, AC_SYMBOLS)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def padded(data: bytes) -> bytes:
    return data + b" " * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def _coded(units: np.ndarray, marks: np.ndarray) -> list[bytes]:
    """The entropy-coded bytes of each unit (a row of 192 coefficients), each followed by its marker."""
    v, n = units.reshape(-1).astype(np.int64), len(units)
    at = np.flatnonzero((v != 0) | (np.arange(len(v)) % 64 == 0))
    x, dc = v[at], at % 64 == 0
    size = _BITS[np.abs(x)]
    run = np.where(dc, 0, np.diff(at, prepend=0) - 1)
    symbol = (run & 15) << 4 | size
    word = np.where(dc, _DC_CODE[size], _AC_CODE[symbol]) << size | np.where(x < 0, x + _MASK[size], x)
    bits = np.where(dc, _DC_SIZE[size], _AC_SIZE[symbol]) + size
    # Runs of 16 zeros and ends of blocks are codes of their own, before and after the coefficients that they belong to.
    far, last = np.flatnonzero(run > 15), np.flatnonzero(np.append(dc[1:], True) & (at % 64 != 63))
    order = at * 8 + 4
    if len(far) or len(last):
        skips = np.repeat(far, run[far] >> 4)
        nth = np.arange(len(skips)) - np.repeat(np.cumsum(run[far] >> 4) - (run[far] >> 4), run[far] >> 4)
        order = np.concatenate((order, at[skips] * 8 + nth, at[last] * 8 + 5))
        word = np.concatenate((word, np.full(len(skips), _AC_CODE[SKIP_16]), np.full(len(last), _AC_CODE[END_OF_BLOCK])))
        bits = np.concatenate((bits, np.full(len(skips), _AC_SIZE[SKIP_16]), np.full(len(last), _AC_SIZE[END_OF_BLOCK])))
        sort = np.argsort(order, kind="stable")
        order, word, bits = order[sort], word[sort], bits[sort]
    unit, ends = order // (8 * UNIT), np.cumsum(bits)
    first = np.searchsorted(unit, np.arange(n))
    from_bit = (ends - bits)[first]
    n_bits = np.append(from_bit[1:], ends[-1]) - from_bit
    n_bytes = -(-n_bits // 8)
    starts = np.cumsum(n_bytes) - n_bytes
    bit = ends - bits - from_bit[unit]
    byte, placed = starts[unit] + (bit >> 3), word << (40 - (bit & 7) - bits)
    total = int(n_bytes.sum())
    raw = np.zeros(total + 5)
    for k in range(5):
        # Bits of different codes never meet, so their sum is their union.
        raw += np.bincount(byte + k, weights=(placed >> (32 - 8 * k)) & 255, minlength=total + 5)
    raw = raw[:total].astype(np.uint8)
    raw[starts + n_bytes - 1] |= _MASK[-n_bits % 8].astype(np.uint8)
    # 0xFF in the data is followed by a zero byte.
    full = np.flatnonzero(raw == 0xFF)
    more = np.bincount(np.searchsorted(starts, full, "right") - 1, minlength=n)
    data, cuts = np.insert(raw, full + 1, 0).tobytes(), np.concatenate(([0], np.cumsum(n_bytes + more))).tolist()
    return [data[s:e] + bytes([0xFF, m]) for s, e, m in zip(cuts[:-1], cuts[1:], marks.tolist(), strict=True)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """A baseline JPEG for each payload, a positive multiple of 192 bytes; spare MCUs hold zeros."""
    sizes = []
    for p in payloads:
        units = len(p) // UNIT
        wide = math.isqrt(units - 1) + 1
        if wide > 8191:
            raise ValueError("over 12 GB do not fit one image")
        sizes.append((wide, -(-units // wide)))
    data = b"".join([p + bytes([MIDDLE]) * (w * h * UNIT - len(p)) for p, (w, h) in zip(payloads, sizes, strict=True)])
    units = np.frombuffer(data, np.uint8).reshape(-1, UNIT).astype(np.int16) - MIDDLE
    ends = np.cumsum([w * h for w, h in sizes])
    marks = 0xD0 + (np.arange(len(units)) - np.repeat(ends - [w * h for w, h in sizes], [w * h for w, h in sizes])) % 8
    marks[ends - 1] = 0xD9
    coded = [x for k in range(0, len(units), CODED) for x in _coded(units[k : k + CODED], marks[k : k + CODED])]
    out = []
    for p, (w, h), end in zip(payloads, sizes, ends.tolist(), strict=True):
        frame = b"\x08" + (8 * h).to_bytes(2, "big") + (8 * w).to_bytes(2, "big") + b"\x03" + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3))
        tables = _segment(0xC4, b"\x00" + DC_COUNTS + DC_SYMBOLS + b"\x10" + AC_COUNTS + AC_SYMBOLS)
        head = [_segment(0xFE, b"payload %d" % len(p)), _segment(0xDB, b"\0" + QUANT), _segment(0xC0, frame), tables, _segment(0xDD, (1).to_bytes(2, "big")), _segment(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00")]
        out.append(b"\xff\xd8" + b"".join(head) + b"".join(coded[end - w * h : end]))
    return out


class Image:
    """A parsed baseline JPEG: its size, tables and scan, and, once decoded, blocks of coefficients in zigzag order."""

    def __init__(self, data: bytes):
        self.comment, self.restart, self.quant, self.tables, self.parts = b"", 0, {}, {}, []
        if data[:2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at = 2
        while True:
            while at + 1 < len(data) and data[at] == data[at + 1] == 0xFF:
                at += 1
            if at + 4 > len(data) or data[at] != 0xFF:
                raise ValueError("marker expected")
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if size < 2 or at > len(data):
                raise ValueError("a segment is cut short")
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                while body:
                    n = 128 if body[0] >> 4 else 64
                    if len(body) <= n:
                        raise ValueError("a segment is cut short")
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if n == 128 else np.uint8).astype(np.int64)
                    body = body[1 + n :]
            elif marker == 0xC0:
                if len(body) < 6 or len(body) < 6 + 3 * body[5]:
                    raise ValueError("a segment is cut short")
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                self.parts = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
            elif marker == 0xC4:
                while body:
                    counts, n = body[1:17], sum(body[1:17])
                    if len(body) < 17 + n:
                        raise ValueError("a segment is cut short")
                    self.tables[body[0]] = (counts, body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif marker == 0xDA:
                use = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
                break
            elif marker in (0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF):
                raise ValueError("only baseline images are read")
        if not self.parts or not self.height or not self.width or any(not (p[1] and p[2] and p[3] in self.quant and p[0] in use) for p in self.parts):
            raise ValueError("no whole frame before the scan")
        sampled = len(self.parts) > 1
        hmax, vmax = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        self.mcus = (-(-self.width // (8 * (hmax if sampled else 1))), -(-self.height // (8 * (vmax if sampled else 1))))
        self.order = [(k, i, j) for k, p in enumerate(self.parts) for j in range(p[2] if sampled else 1) for i in range(p[1] if sampled else 1)]
        try:
            coding = [(self.tables[use[p[0]] >> 4], self.tables[0x10 | use[p[0]] & 15]) for p in self.parts]
        except KeyError:
            raise ValueError("a table is missing") from None
        #: Images with equal kinds are decoded together: components of an MCU's blocks and their tables.
        self.kind = (tuple(k for k, _, _ in self.order), tuple(coding))
        self._find_segments(data, at)
        self.blocks = np.zeros((self.mcus[0] * self.mcus[1], len(self.order), 64), np.int16)

    def _find_segments(self, data: bytes, at: int) -> None:
        """The scan without stuffed bytes, where its restart segments start and end there, and the MCUs in each."""
        raw = np.frombuffer(data, np.uint8)[at:]
        after = np.flatnonzero(raw[:-1] == 0xFF)
        kinds = raw[after + 1]
        ends = after[(kinds != 0) & (kinds != 0xFF) & ((kinds < 0xD0) | (kinds > 0xD7))]
        stop = int(ends[0]) if len(ends) else len(raw)
        inside = after < stop
        cuts, stuffed = after[inside & (kinds >= 0xD0) & (kinds <= 0xD7)], after[inside & (kinds == 0)] + 1
        n, each = self.mcus[0] * self.mcus[1], self.restart or self.mcus[0] * self.mcus[1]
        self.many = np.minimum(each, n - np.arange(0, n, each))
        if len(cuts) + 1 != len(self.many):
            raise ValueError("the scan is cut short")
        starts, lasts = np.concatenate(([0], cuts + 2)), np.append(cuts, stop)
        self.starts, self.ends = starts - np.searchsorted(stuffed, starts), lasts - np.searchsorted(stuffed, lasts)
        self.scan = np.delete(raw[:stop], stuffed[stuffed < stop])

    def thumbnail(self) -> np.ndarray:
        """Luminance by the DC coefficients alone: a pixel for each 8x8 block of the first component."""
        across, down = self.mcus
        h, v = (self.parts[0][1], self.parts[0][2]) if len(self.parts) > 1 else (1, 1)
        out = np.zeros((down, v, across, h))
        for b, (k, i, j) in enumerate(self.order):
            if k == 0:
                out[:, j, :, i] = self.blocks[:, b, 0].reshape(down, across)
        light = out.reshape(down * v, across * h) * self.quant[self.parts[0][3]][0] / 8 + 128
        return np.clip(np.rint(light), 0, 255).astype(np.uint8)



def _decode_alike(images: list[Image]) -> None:
    """Fill the blocks of images of one kind, TOGETHER restart segments at a time."""
    parts, coding = images[0].kind
    tables = {t: k for k, t in enumerate(dict.fromkeys(t for pair in coding for t in pair))}
    lookup = np.concatenate([_lookup(*t) for t in tables])
    part = np.array(parts)
    dc_at, ac_at = (np.array([tables[coding[k][which]] << 16 for k in parts]) for which in (0, 1))
    per = len(parts)
    for image in images:
        image.flat = image.blocks.reshape(-1)
    todo = [(image, k) for image in images for k in range(0, len(image.many), TOGETHER)]
    group: list[tuple[Image, int]] = []
    held = 0
    for n, (image, k) in enumerate(todo):
        group.append((image, k))
        held += min(TOGETHER, len(image.many) - k)
        if held < TOGETHER and n + 1 < len(todo):
            continue
        cut = [slice(a, a + TOGETHER) for _, a in group]
        sizes = [len(i.many[c]) for (i, _), c in zip(group, cut, strict=True)]
        lows = [int(i.starts[a]) for i, a in group]
        pieces = [i.scan[low : int(i.ends[c][-1])] for (i, _), c, low in zip(group, cut, lows, strict=True)]
        offsets = np.cumsum([0, *(len(p) for p in pieces)])
        data = np.concatenate([*pieces, np.zeros(8, np.uint8)]).astype(np.int64)
        window = data[:-4] << 32 | data[1:-3] << 24 | data[2:-2] << 16 | data[3:-1] << 8 | data[4:]
        shift = [o - low for o, low in zip(offsets, lows, strict=False)]
        at = 8 * np.concatenate([i.starts[c] + s for (i, _), c, s in zip(group, cut, shift, strict=True)])
        end = 8 * np.concatenate([i.ends[c] + s for (i, _), c, s in zip(group, cut, shift, strict=True)])
        left = per * np.concatenate([i.many[c] for (i, _), c in zip(group, cut, strict=True)])
        to = 64 * (np.cumsum(left) - left)
        found = np.zeros(64 * int(left.sum()), np.int16)
        _step(lookup, part, dc_at, ac_at, window, at, end, left, to, found)
        done = 0
        for (i, a), size, c in zip(group, sizes, cut, strict=True):
            many = 64 * per * int(i.many[c].sum())
            before = 64 * per * int(i.many[:a].sum())
            i.flat[before : before + many] = found[done : done + many]
            done += many
        group, held = [], 0


def _step(lookup: np.ndarray, part: np.ndarray, dc_at: np.ndarray, ac_at: np.ndarray, window: np.ndarray, at: np.ndarray, end: np.ndarray, left: np.ndarray, to: np.ndarray, found: np.ndarray) -> None:
    """Advance all segments symbol by symbol: at is a segment's bit, left its blocks to come, to its place in found."""
    per, n = len(part), len(at)
    nth, k = np.zeros(n, np.int64), np.zeros(n, np.int64)
    last = np.zeros((n, int(part.max()) + 1), np.int64)
    while n:
        dc = k == 0
        byte = at >> 3
        if byte.max() >= len(window):
            raise ValueError("the scan is cut short")
        w, used = window[byte], at & 7
        code = lookup[np.where(dc, dc_at[nth], ac_at[nth]) + ((w >> (24 - used)) & 0xFFFF)]
        length, size = code >> 8, code & 15
        if not length.all():
            raise ValueError("no such code")
        run = np.where(dc, 0, (code >> 4) & 15)
        at = at + length + size
        x = (w >> (40 - used - length - size)) & _MASK[size]
        x -= np.where(x < _HALF[size], _MASK[size], 0)
        k += run
        if (k > 63).any():
            if (k[(size > 0) | (run == 15)] > 63).any():
                raise ValueError("too many coefficients")
            k = np.minimum(k, 63)
        here = np.flatnonzero(dc)
        if len(here):
            c = part[nth[here]]
            last[here, c] += x[here]
            x[here] = last[here, c]
        # Codes without a size write the zero that is there already.
        found[to + k] = x
        k = np.where(~dc & (size == 0) & (run < 15), 64, k + 1)
        over = k > 63
        if over.any():
            k[over] = 0
            to = to + 64 * over
            left = left - over
            nth = (nth + over) % per
            keep = left > 0
            if not keep.all():
                if (at > end)[~keep].any():
                    raise ValueError("the scan is cut short")
                at, end, left, to, nth, k, last = at[keep], end[keep], left[keep], to[keep], nth[keep], k[keep], last[keep]
                n = len(at)


def decode(media: list[bytes]) -> list[Image]:
    """Parsed and decoded images; a malformed one raises ValueError."""
    images, kinds = [Image(m) for m in media], {}
    for i in images:
        kinds.setdefault(i.kind, []).append(i)
    for alike in kinds.values():
        _decode_alike(alike)
    return images


def payload_of(image: Image) -> bytes:
    """The bytes that encode() stored."""
    n = int(image.comment.split()[1])
    return (image.blocks.reshape(-1)[:n] + MIDDLE).astype(np.uint8).tobytes()


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64 bits in hex: the thumbnail averaged to 8x8 cells, a bit for each cell above the mean of all."""
    rows = np.array_split(np.arange(pixels.shape[0]), 8) if pixels.shape[0] >= 8 else [np.array([r * pixels.shape[0] // 8]) for r in range(8)]
    cols = np.array_split(np.arange(pixels.shape[1]), 8) if pixels.shape[1] >= 8 else [np.array([c * pixels.shape[1] // 8]) for c in range(8)]
    small = np.add.reduceat(np.add.reduceat(pixels.astype(np.int64), [r[0] for r in rows], 0), [c[0] for c in cols], 1) if min(pixels.shape) >= 8 else pixels[np.ix_([r[0] for r in rows], [c[0] for c in cols])].astype(np.int64)
    weight = np.outer([len(r) for r in rows], [len(c) for c in cols])
    mean = small / weight
    return f"{int(''.join('1' if x else '0' for x in (mean > mean.mean()).reshape(-1)), 2):016x}"


def _feature(image: Image) -> str:
    return f"{image.width}x{image.height}:{thumbnail_hash(image.thumbnail())}"


def _groups(sizes: list[int]) -> Iterator[slice]:
    """Slices of rows whose sizes add up to about GROUP; a larger row is alone or last."""
    start, held = 0, 0
    for k, n in enumerate(sizes):
        held += n
        if held >= GROUP:
            yield slice(start, k + 1)
            start, held = k + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


def store(docs: DataFrame, key: str = "doc_id", text: str = "text", with_media: bool = False) -> DataFrame:
    """Store each text's UTF-8 bytes in a JPEG, read the image back, and return sizes, digests and thumbnail features.

    A null text counts as empty and is stored as one MCU of spaces; keys are carried along, null ones too; repeated
    rows give repeated rows; an empty table gives an empty table; other columns are not read. with_media adds the
    column media with the image itself.
    """
    kind = docs.schema[key].dataType.simpleString()
    fields = [("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")] + [("media", "binary")] * with_media
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def row(data: bytes, media: bytes, image: Image) -> tuple:
        back = payload_of(image)
        return (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), _feature(image)) + (media,) * with_media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, 500) for at in range(0, whole.num_rows, 500)):
                data = [(x or "").encode() for x in b.column(1).to_pylist()]
                for part in _groups([len(x) for x in data]):
                    media = encode([padded(x) for x in data[part]])
                    cols = list(zip(*(row(*x) for x in zip(data[part], media, decode(media), strict=True)), strict=True))
                    keys = b.column(0).slice(part.start, part.stop - part.start)
                    yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, types[t]) for c, (_, t) in zip(cols, fields, strict=True))], [key, *(n for n, _ in fields)])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, ", ".join([f"{key} {kind}", *(f"{n} {t}" for n, t in fields)]))


def described(images: DataFrame, key: str = "key", media: str = "media") -> DataFrame:
    """(key, width, height, thumbnail_hash, error) for every row of a column of baseline JPEGs of any encoder.

    An image that cannot be read has its reason in error and nulls in the rest; a null image has nulls alone. Keys are
    carried along, repeated rows repeated, other columns not read; an empty table gives an empty table.
    """
    kind = images.schema[key].dataType.simpleString()

    def one(data: bytes) -> Image | str:
        try:
            return decode([data])[0]
        except ValueError as e:
            return str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            given = b.column(1).to_pylist()
            for part in _groups([len(x or b"") for x in given]):
                whole = [x for x in given[part] if x is not None]
                try:
                    read: list = decode(whole)
                except ValueError:
                    read = [one(x) for x in whole]
                each = iter(read)
                for i in (None if x is None else next(each) for x in given[part]):
                    rows.append((i.width, i.height, thumbnail_hash(i.thumbnail()), None) if isinstance(i, Image) else (None, None, None, i))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True))], [key, "width", "height", "thumbnail_hash", "error"])

    return images.select(F.col(key), F.col(media)).mapInArrow(run, f"{key} {kind}, width int, height int, thumbnail_hash string, error string")
