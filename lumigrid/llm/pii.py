"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score (operator 10).

Base kinds (leftmost, non-overlapping, no retries): email, ip (parts at most 255), card (16 to 19 digits,
Luhn), phone (+ and 8 to 15 digits). These always stay. The method's own kinds: iban (mod 97), card15 (15
digits, Luhn, a card word nearby), ssn and key (a token of 32 hex digits or more, or 16 characters or more after a known beginning, near a secret word). Each pattern has a prior, a
passed checksum adds to it, context words within ``NEAR`` characters before or behind the span raise it (to 1 at most), and a span of
the method's own kinds counts from ``ACCEPT`` on; base spans stay whatever their score. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

NEAR, ACCEPT = 40, 0.5

#: The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOCALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_KEY = re.compile(r"(?<![A-Za-z0-9_-])(?:[0-9a-f]{32,}+|(?:sk|pk|ghp|AKIA)[A-Za-z0-9_-]{16,}+)(?![A-Za-z0-9_-])")
_KEY_INSIDE = "[0-9a-f]{32}|(?:sk|pk|ghp|AKIA)[A-Za-z0-9_-]{16}"  # what a text with a key holds, digits or not

#: Words that speak for a kind.
CONTEXT = {
    "iban": re.compile(r"(?i)iban|account|konto|compte|cuenta|bank"),
    "card15": re.compile(r"(?i)card|amex|credit|karte|carte|tarjeta"),
    "ssn": re.compile(r"(?i)ssn|social|security|insurance"),
    "key": re.compile(r"(?i)token|secret|key|password|passwd|pwd|bearer|auth"),
    "email": re.compile(r"(?i)mail|contact|write|courriel|correo"),
    "ip": re.compile(r"(?i)\bip|address|host|server|login|adresse"),
    "card": re.compile(r"(?i)card|visa|master|credit|karte|carte|tarjeta"),
    "phone": re.compile(r"(?i)phone|call|tel|mobile|fax|contact"),
}
PRIOR = {"iban": 0.2, "card15": 0.0, "ssn": 0.3, "key": 0.2, "email": 0.6, "ip": 0.4, "card": 0.1, "phone": 0.4}
CHECKED = {"iban": 0.5, "card15": 0.35, "card": 0.45}
RAISE = 0.35

BASE = ("email", "ip", "card", "phone")
OWN = ("card15", "iban", "key", "ssn")

_DOUBLED = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def luhn(digits: str) -> bool:
    d = [ord(c) - 48 for c in reversed(digits)]
    return (sum(d[::2]) + sum(_DOUBLED[x] for x in d[1::2])) % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """All matches of ``[A-Za-z0-9._%+-]+@domain``, in linear time: an address begins where its run of local characters does."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCALS:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        free = end
        at = text.find("@", end)
    return out


def base_spans(text: str, has_digit: bool = True) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {"email": emails(text) if "@" in text else [], "ip": [], "card": [], "phone": []}
    if has_digit:
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out["card"] = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def score(text: str, kind: str, start: int, end: int) -> float:
    """Of a span whose checksum, if its kind has one, is right."""
    words, before, behind = CONTEXT[kind], max(0, start - NEAR), min(len(text), end + NEAR)
    near = words.search(text, before, start) or words.search(text, end, behind)
    return min(1.0, PRIOR[kind] + CHECKED.get(kind, 0.0) + (RAISE if near else 0.0))


def own_spans(text: str, taken: list[tuple[int, int]]) -> list[tuple[str, int, int, float]]:
    """The method's further spans with scores; none overlaps a base span or an earlier one of its own."""
    found = []

    def propose(kind: str, start: int, end: int, checked: bool | None) -> None:
        if checked is not False and (s := score(text, kind, start, end)) >= ACCEPT:
            found.append((kind, start, end, s))

    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 15 and len(d := _digits(m[0])) == 15:
            propose("card15", *m.span(), luhn(d))
    for m in _IBAN.finditer(text):
        propose("iban", *m.span(), mod97(m[0]))
    for m in _KEY.finditer(text):
        propose("key", *m.span(), None)
    for m in _SSN.finditer(text):
        propose("ssn", *m.span(), None)
    base = sorted(taken)
    starts, furthest = [a for a, _ in base], list(accumulate((b for _, b in base), max))
    out, free = [], 0
    for s in sorted(found, key=lambda s: (s[1], -s[2])):
        before = bisect_left(starts, s[2])  # base spans that begin before it ends
        if s[1] >= free and not (before and furthest[before - 1] > s[1]):
            out.append(s)
            free = s[2]
    return out


def _text_of(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(text: str, has_digit: bool = True, has_key: bool = True) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, float]]]:
    """Base spans by kind and start, and the method's own."""
    base = [(k, a, b) for k, spans in base_spans(text, has_digit).items() for a, b in spans]
    return base, own_spans(text, [s[1:] for s in base]) if has_digit or has_key else []


def _candidates(texts: pa.Array) -> tuple[list, list, list]:
    """Which texts have a digit, an @ or what may be a key at all."""
    digit = pc.match_substring_regex(texts, "[0-9]").to_pylist()
    return digit, pc.match_substring(texts, "@").to_pylist(), pc.match_substring_regex(texts, _KEY_INSIDE).to_pylist()


COLUMNS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string"
_COLUMNS = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string()), ("scores", pa.string())])
_NONE = hashlib.sha256(b"").hexdigest()


def scan(docs: DataFrame) -> DataFrame:
    """Spans of every whole text and their scores (two places, in the same order).

    Null and empty texts have none: counts 0, digest of the empty string, empty spans. Repeated rows get equal rows; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.chunks(batches):
            digit, at, key = _candidates(part.column(1))
            counts: list[list[int]] = [[], [], [], []]
            shas, spans, scores = [], [], []
            for text, d, a, k in zip(part.column(1), digit, at, key, strict=True):
                if not d and not a and not k:
                    for c in counts:
                        c.append(0)
                    shas.append(_NONE)
                    spans.append("")
                    scores.append("")
                    continue
                whole = text.as_py()
                base, own = find(whole, d, k)
                for kind, c in zip(BASE, counts, strict=True):
                    c.append(sum(s[0] == kind for s in base))
                listed = _text_of(base)
                shas.append(hashlib.sha256(listed.encode()).hexdigest())
                scored = [*((*s, score(whole, *s)) for s in base), *sorted(own, key=lambda s: (OWN.index(s[0]), s[1]))]
                spans.append(_text_of([s[:3] for s in scored]))
                scores.append(",".join(f"{s[3]:.2f}" for s in scored))
            yield common.batch_of(_COLUMNS, part.column(0), *counts, shas, spans, scores)

    return common.texts(docs).mapInArrow(run, COLUMNS)


def redact(docs: DataFrame) -> DataFrame:
    """The documents, columns unchanged, each span in ``text`` replaced by ``[KIND]``; ``n_chars`` follows (null texts stay null)."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        for part in common.chunks(batches):
            column = part.schema.get_field_index("text")
            digit, at, key = _candidates(part.column(column))
            out = []
            for text, d, a, k in zip(part.column(column).to_pylist(), digit, at, key, strict=True):
                if text and (d or a or k):
                    base, own = find(text, d, k)
                    pieces, free = [], 0
                    for kind, lo, hi in sorted([*base, *(s[:3] for s in own)], key=lambda s: (s[1], -s[2])):
                        if hi > free:
                            pieces += [text[free : max(lo, free)], f"[{kind.upper()}]"]
                            free = hi
                    text = "".join(pieces) + text[free:]
                out.append(text)
            part = part.set_column(column, part.schema.field(column), pa.array(out, part.schema.field(column).type))
            if (n := part.schema.get_field_index("n_chars")) >= 0:
                part = part.set_column(n, part.schema.field(n), pa.array([len(t or "") for t in out], pa.int64()).cast(part.schema.field(n).type))
            yield part

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir))
