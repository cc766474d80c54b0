"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust their scores."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "secret", "ssn")
#: A span of an added kind is kept from this score on; the four base kinds are always kept.
KEEP = 0.5
BASE = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "secret": 0.3, "ssn": 0.3}
#: Words in the languages of the documents (English, German, French, Spanish) that make a span of the kind likelier.
CONTEXT = {
    "email": ("mail", "contact", "write", "kontakt", "courriel", "correo"), "ip": ("ip", "host", "server", "address", "adresse", "serveur", "servidor", "dirección"),
    "card": ("card", "visa", "credit", "pay", "karte", "kreditkarte", "carte", "tarjeta", "crédito"), "phone": ("phone", "tel", "call", "mobile", "telefon", "anruf", "téléphone", "teléfono", "llame"),
    "iban": ("iban", "account", "bank", "konto", "compte", "banque", "cuenta", "banco"), "secret": ("token", "secret", "password", "api_key", "apikey", "key", "passwort", "schlüssel", "clé", "contraseña", "clave"),
    "ssn": ("ssn", "social", "security", "sozialversicherung", "sécurité", "seguridad"),
}
NEAR, RAISE = 40, 0.3

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried once, from its start: a start inside it would fail or succeed alike, at quadratic cost.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b")
SECRET = re.compile(r"\b(?:[0-9a-f]{32,64}|[A-Za-z]{2,5}[_-][A-Za-z0-9]{16,64}|AKIA[0-9A-Z]{16})\b")
SSN = re.compile(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b")
NOT_DIGIT = re.compile(r"[^0-9]+")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\W\d]+")

Span = tuple[str, int, int, float]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod_97(iban: str) -> bool:
    s = iban.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the email pattern, found from each @ outwards so that long runs cost linear time."""
    past, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            past = m.end()
        past = max(past, at + 1)
        at = text.find("@", past)


def _part(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) < 4 and int(s or "0") <= 255


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        for s, e in _emails(text):
            yield "email", s, e
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        if all(_part(p) for p in m.group().split(".")):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                yield "phone", m.start(), m.end()
    for m in IBAN.finditer(text):
        if mod_97(m.group()):
            yield "iban", m.start(), m.end()
    for m in SECRET.finditer(text):
        if DIGIT.search(m.group()):
            yield "secret", m.start(), m.end()
    for m in SSN.finditer(text):
        yield "ssn", m.start(), m.end()


def find(text: str | None) -> list[Span]:
    """All spans (kind, start, end, score) of one text, by kind as in KINDS, then start; code points, end exclusive."""
    out = []
    for kind, s, e in _proposed(text or ""):
        near = f"{text[max(0, s - NEAR) : s]} {text[e : e + NEAR]}".lower()
        words = set(WORD.findall(near))
        score = min(1.0, BASE[kind] + (RAISE if words & set(CONTEXT[kind]) else 0.0))
        if kind in KINDS[:4] or score >= KEEP:
            out.append((kind, s, e, score))
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


def mask(text: str | None) -> str | None:
    """The text with each span, overlapping ones merged, replaced by its first kind in brackets; null stays null."""
    spans = sorted(find(text), key=lambda x: (x[1], -x[2]))
    if not spans:
        return text
    out, past = [], 0
    for kind, s, e, _ in spans:
        if s >= past:
            out += [text[past:s], f"<{kind.upper()}>"]
        past = max(past, e)
    return "".join([*out, text[past:]])


def _written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans)


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: its key, counts of the base kinds, the base spans' digest, all spans and their scores.

    A null or empty text has no spans; a null key is carried along; repeated rows give repeated rows; an empty table
    gives an empty table; other columns are not read. Texts of any length are searched whole, in linear time.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"]
        for b in batches:
            rows: dict[str, list] = {n: [] for n in names}
            for x in b.column(1).to_pylist():
                spans = find(x)
                base = [s for s in spans if s[0] in KINDS[:4]]
                for k in KINDS[:4]:
                    rows[f"n_{k}"].append(sum(s[0] == k for s in base))
                rows["base_sha256"].append(hashlib.sha256(_written(base).encode()).hexdigest())
                rows["spans"].append(_written(spans))
                rows["scores"].append(",".join(f"{s[3]:.2f}" for s in spans))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(rows[n], pa.int64() if n[:2] == "n_" else pa.string()) for n in names)], [key, *names])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string")


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every personal span of text replaced by its kind in brackets; all other columns unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(text)
            yield b.set_column(i, b.schema.field(i), pa.array([mask(x) for x in b.column(i).to_pylist()], b.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)
