"""WARC derivatives: response records become linked metadata and plain-text conversion records.

Both records of a response refer to its identifier, address and date (WARC-Refers-To, -Target-URI and -Date), repeat its
source headers, and carry the digest of its payload; their own identifiers are derived from it, so that a repeated run
writes the same records.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_template import BLOCKS, events

DATE = "1970-01-01T00:00:00Z"
#: Headers of a response that both derivatives repeat, every one of them as often as the response has it.
KEPT = frozenset(x.lower() for x in ("WARC-Target-URI", "WARC-Date", "WARC-IP-Address", "WARC-Warcinfo-ID", "WARC-Concurrent-To"))
#: Compressed bytes that are unpacked at once.
SLICE = 1 << 16
HREF = re.compile(r"<(a|img|link|script|iframe)\b[^>]*?\b(?:href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
META = re.compile(r"<meta\b([^>]*)>", re.I)
PAIR = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>/]+))")
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.I | re.S)
CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([^\s;\"'>]+)", re.I)
MARKUP = re.compile(r"^(text/html|application/xhtml\+xml)?$")
TEXTUAL = re.compile(r"^(text/.*|application/(json|xml|javascript|.*\+(json|xml)))$")
GAP, END = re.compile(rb"[\r\n]*"), re.compile(rb"\r?\n\r?\n")

Headers = list[tuple[str, str]]


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uuid(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def record(headers: Headers, block: bytes) -> bytes:
    lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(lines: list[str]) -> Headers:
    """Names and values of header lines; lines that begin with white space go on with the one before."""
    out: Headers = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def value(headers: Headers, name: str, default: str = "") -> str:
    """The first value of a header; names are equal in any case."""
    return next((v for k, v in headers if k.lower() == name.lower()), default)


def _head(data: bytes, at: int = 0) -> tuple[list[str], int]:
    """The lines from there to the first empty one, and where what follows begins; line ends may lack their carriage return."""
    m = END.search(data, at)
    end, after = (m.start(), m.end()) if m else (len(data), len(data))
    return data[at:end].decode("utf-8", "replace").replace("\r\n", "\n").split("\n"), after


def parse(data: bytes, at: int = 0) -> tuple[Headers, bytes, int]:
    """Headers and block of the record that begins there, and its end; malformed records raise ValueError."""
    if not data.startswith(b"WARC/", at):
        raise ValueError("no WARC record")
    lines, start = _head(data, at)
    headers = fields(lines[1:])
    size = value(headers, "Content-Length")
    if not size.isdecimal():
        raise ValueError("no content length")
    end = start + int(size)
    if end > len(data):
        raise ValueError("the record is cut short")
    return headers, data[start:end], end


def response(url: str | None, page: str | None, name: str, date: str = DATE) -> bytes:
    """A response record that holds one page; line breaks in an address become %0A and %0D."""
    payload = (page or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", _uuid(f"{name}|{target}|{hashlib.sha1(payload).hexdigest()}")), ("WARC-Date", date), ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", sha1(payload)), ("WARC-Block-Digest", sha1(block))]
    return record(headers, block)


def plain_text(page: str) -> str:
    """All visible text of a page, a line for each block."""
    blocks, run = [], []
    for kind, node, raw in events(page):
        if kind == "text":
            if node.tag != "title":
                run.append(raw)
        elif kind == "break" or node.tag in BLOCKS:
            blocks.append("".join(run))
            run = []
        elif node.tag == "br":
            run.append(" ")
    return "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in [*blocks, "".join(run)]) if x)


def _described(headers: Headers, status: str, http: Headers, page: str) -> dict:
    links = [{"path": f"{m[1].upper()}@/{'href' if m[1].lower() in ('a', 'link') else 'src'}", "url": html.unescape(m[2] or m[3] or m[4] or "")} for m in HREF.finditer(page)]
    metas = [{k.lower(): html.unescape(a or b or c) for k, a, b, c in PAIR.findall(m[1])} for m in META.finditer(page)]
    title = TITLE.search(page)
    return {"Envelope": {"Format": "WARC", "WARC-Header-Metadata": headers, "Payload-Metadata": {"Actual-Content-Type": "application/http; msgtype=response", "HTTP-Response-Metadata": {"Response-Message": status, "Headers": http, "HTML-Metadata": {"Head": {"Title": " ".join(html.unescape(title[1]).split()) if title else "", "Metas": metas}, "Links": links}}}}}


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip()
        if end < 0 or not re.fullmatch(rb"[0-9a-fA-F]+", size):
            return body
        if not int(size, 16):
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + int(size, 16)])
        at = end + 4 + int(size, 16)


def _coding(http: Headers) -> str:
    return value(http, "Content-Encoding").lower()


def _readable(http: Headers) -> bool:
    return _coding(http) in ("", "identity", "gzip", "x-gzip", "deflate")


def _decoded(http: Headers, body: bytes) -> str:
    """The payload as text: without transfer and content coding where they hold, in its character set if that is known, else UTF-8."""
    if value(http, "Transfer-Encoding").lower() == "chunked":
        body = _unchunked(body)
    coding = _coding(http)
    if coding in ("gzip", "x-gzip", "deflate"):
        try:
            body = zlib.decompress(body, 47)
        except zlib.error:
            pass
    named = CHARSET.search(value(http, "Content-Type")) or CHARSET.search(body[:1024].decode("latin-1"))
    try:
        charset = codecs.lookup(named[1]).name if named else "utf-8"
        return body.decode(charset, "replace")
    except (LookupError, ValueError):
        return body.decode("utf-8", "replace")


Row = tuple[str | None, str | None, str | None, str | None, str | None, bytes | None, str | None]


def derive(data: bytes) -> list[Row]:
    """(type, record id, refers to, target, source payload digest, record, error) of a response's derivatives.

    Other types of records have none. A payload that is no text, or whose coding cannot be undone, has only the metadata.
    """
    headers, block, _ = parse(data)
    if value(headers, "WARC-Type").lower() != "response":
        return []
    source = value(headers, "WARC-Record-ID")
    if not source:
        raise ValueError("no record id")
    (status, *lines), start = _head(block)
    http, payload = fields(lines), block[start:]
    digest = value(headers, "WARC-Payload-Digest") or sha1(payload)
    kind = value(http, "Content-Type").partition(";")[0].strip().lower()
    text = bool(_readable(http) and (MARKUP.match(kind) or TEXTUAL.match(kind)))
    page = _decoded(http, payload) if text else ""
    made = {"metadata": ("application/json", json.dumps(_described(headers, status, http, page if MARKUP.match(kind) else ""), ensure_ascii=False, sort_keys=True).encode("utf-8", "replace"))}
    if text:
        made["conversion"] = ("text/plain; charset=utf-8", (plain_text(page) if MARKUP.match(kind) else page).encode("utf-8", "replace"))
    target, date = value(headers, "WARC-Target-URI"), value(headers, "WARC-Date")
    out: list[Row] = []
    for name, (content, body) in made.items():
        own = _uuid(f"{source}|{name}")
        kept = [(k, v) for k, v in headers if k.lower() in KEPT and v]
        refers = [("WARC-Refers-To", source), *((k, v) for k, v in (("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date)) if v)]
        lines = [("WARC-Type", name), ("WARC-Record-ID", own), *refers, *kept, ("WARC-Source-Payload-Digest", digest), ("Content-Type", content), ("WARC-Block-Digest", sha1(body))]
        out.append((name, own, source, target, digest, record(lines, body), None))
    return out


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", date: str = DATE) -> DataFrame:
    """(key, record): a response record for every row of pages; null pages are empty, null addresses too.

    Repeated rows have records with identifiers of their own: a row's place in the table is part of its identifier, which
    stays the same as long as the table is read in the same pieces.
    """
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(k, 500) for k in range(0, whole.num_rows, 500)):
                rows = zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([response(u, p, f"{k}|{n}", date) for k, u, p, n in rows], pa.binary())], [key, "record"])

    return pages.select(F.col(key), F.col(url), F.col(page), F.monotonically_increasing_id()).mapInArrow(run, f"{key} {kind}, record binary")


def _members(content: bytes) -> Iterator[bytes]:
    """The gzip members of a file, each unpacked, or the file itself if it is none; what lies behind the last one is left out."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at = memoryview(content), 0
    while view[at : at + 2] == b"\x1f\x8b":
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(view):
                raise ValueError("the file is cut short")
            piece = view[at : at + SLICE]
            parts.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
        yield b"".join(parts)


def _split(content: bytes) -> Iterator[tuple[bytes | None, str | None]]:
    """(record, None) for the records of a file in order, and (None, error) where it cannot be read on."""
    try:
        for data in _members(content):
            at = GAP.match(data).end()
            while at < len(data):
                _, _, end = parse(data, at)
                yield data[at:end] + b"\r\n\r\n", None
                at = GAP.match(data, end).end()
    except (ValueError, zlib.error) as e:
        yield None, str(e)


def records(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, position, record, error): the records of WARC files, plain or with a gzip member each, in order.

    A file that cannot be read to its end has its reason in the last row. Null and empty files give no rows.
    """
    kind = files.schema[path].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                held = 0
                for k, (x, error) in enumerate(_split(data or b"")):
                    rows.append((p, k, x, error))
                    held += len(x or b"")
                    if held > 8 << 20:
                        yield batch(rows, b.schema.field(0).type)
                        rows, held = [], 0
                if rows:
                    yield batch(rows, b.schema.field(0).type)

    def batch(rows: list[tuple], of: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (of, pa.int64(), pa.binary(), pa.string()), strict=True)], [path, "position", "record", "error"])

    return files.select(F.col(path), F.col(content)).mapInArrow(run, f"{path} {kind}, position long, record binary, error string")


def derivatives(records: DataFrame, key: str = "page_id", column: str = "record") -> DataFrame:
    """Rows for each response record: (key, warc_type, record_id, refers_to, target_uri, source_digest, record, error).

    A response with text gives two rows, metadata and conversion; other payloads give their metadata, other types of
    records and null records nothing. A malformed record gives one row with its error and nulls. Null keys are carried
    along, repeated rows repeated, other columns not read; an empty table gives an empty table. Records of any length
    are read whole.
    """
    kind = records.schema[key].dataType.simpleString()
    names = ["warc_type", "record_id", "refers_to", "target_uri", "source_digest", "record", "error"]

    def made(data: bytes) -> list[Row]:
        try:
            return derive(data)
        except ValueError as e:
            return [(None,) * 6 + (str(e),)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(k, 500) for k in range(0, whole.num_rows, 500)):
                rows = [(k, *r) for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in made(data)]
                cols = list(zip(*rows, strict=True)) or [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), *(pa.array(c, pa.binary() if n == "record" else pa.string()) for c, n in zip(cols[1:], names, strict=True))], [key, *names])

    return records.select(F.col(key), F.col(column)).where(F.col(column).isNotNull()).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{n} {'binary' if n == 'record' else 'string'}" for n in names))
