"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds in output order. Those of BASE are fixed by pattern and checksum alone and
# always stay; the others need a score of THRESHOLD.
BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "ssn", "local")
KINDS = BASE + EXTRA
THRESHOLD = 0.5
WINDOW = 48  # code points before and after a span that are searched for context words

_LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Starting at the head of a run of digits gives the same matches as starting anywhere.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
_IBAN_NEXT = re.compile(r" ?[A-Z0-9]")
_IBAN_END = re.compile(r"(?![A-Za-z0-9])")
# Characters of an IBAN by country, from the registry.
_IBAN_LENGTHS = {c: int(n) for c, n in re.findall(r"([A-Z]{2})([0-9]{2})", """
AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18
FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20
LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24
SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30""")}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_DIGIT = re.compile(r"[0-9]")
# Score of a confirmed match, words that raise it, words that lower it.
SCORES = {
    "email": (0.9, r"\b(?:e-?mail|contact|write|reply)\b", r"\bexample\b"),
    "ip": (0.6, r"\b(?:ip|address|host|server|login|client)\b", r"\bversion\b"),
    "card": (0.7, r"\b(?:card|visa|master(?:card)?|amex|credit|debit|payment)\b", r"\b(?:order|invoice|isbn|serial)\b"),
    "phone": (0.7, r"\b(?:phone|tel|call|mobile|fax|whatsapp)\b", r"\b(?:order|invoice|serial)\b"),
    "iban": (0.7, r"\b(?:iban|bank|account|konto|transfer)\b", r"\b(?:serial|part|model)\b"),
    "ssn": (0.3, r"\b(?:ssn|social security|tax id)\b", r"\b(?:order|part|serial|model)\b"),
    "local": (0.3, r"\b(?:phone|tel|call|mobile|fax)\b", r"\b(?:order|part|serial|model)\b"),
}
_CONTEXT = {k: (s, re.compile(up, re.I), re.compile(down, re.I)) for k, (s, up, down) in SCORES.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += (v * 2 - 9 if v > 4 else v * 2) if i % 2 else v
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str):
    """Leftmost matches in one pass: the run before an at sign, then the domain behind it."""
    pos, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in _LOCAL_PART:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        pos = at + 1
        if m:
            pos = m.end()
            yield start, pos
        at = text.find("@", pos)


def ibans(text: str):
    """Confirmed IBANs in one pass; the search goes on behind a confirmed one, else behind the four characters tried.

    The country gives the length. For other countries every token end from 15 to 34
    characters is tried, the longest first.
    """
    m = _IBAN.search(text)
    while m:
        start, at = m.span()
        country = _IBAN_LENGTHS.get(m[0][:2])
        ends, most = [], country or 34
        for n in range(5, most + 1):
            more = _IBAN_NEXT.match(text, at)
            if not more:
                break
            at = more.end()
            if n >= (country or 15) and _IBAN_END.match(text, at):
                ends.append(at)
        end = next((e for e in reversed(ends) if mod97(text[start:e].replace(" ", ""))), None)
        if end:
            yield start, end
        m = _IBAN.search(text, end or m.end())


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def proposals(text: str):
    """Confirmed spans ``(kind, start, end)`` of every kind, in no order."""
    if "@" in text:
        yield from (("email", s, e) for s, e in emails(text))
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(map(_byte, m[0].split("."))):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", *m.span()
    yield from (("iban", s, e) for s, e in ibans(text))
    for m in _SSN.finditer(text):
        yield "ssn", *m.span()
    for m in _LOCAL.finditer(text):
        yield "local", *m.span()


def score(text: str, kind: str, start: int, end: int) -> float:
    value, up, down = _CONTEXT[kind]
    near = text[max(0, start - WINDOW):start] + "\n" + text[end:end + WINDOW]
    return round(min(1.0, max(0.0, value + 0.3 * bool(up.search(near)) - 0.3 * bool(down.search(near)))), 3)


def spans(text: str | None) -> list[dict]:
    """Spans by start, then kind; one of an extra kind must score enough and touch no span kept before.

    A confirmed IBAN stays beside a base span that it touches, such as digits that pass for a card.
    """
    found = sorted(proposals(text or ""), key=lambda s: (s[1], KINDS.index(s[0])))
    kept = [s for s in found if s[0] in BASE]
    more, reach = [], -1
    for s in found:
        if s[0] in EXTRA and s[1] >= reach and score(text, *s) >= THRESHOLD:
            if s[0] == "iban" or not any(b[1] < s[2] and s[1] < b[2] for b in kept):
                more.append(s)
                reach = s[2]
    kept = sorted(kept + more, key=lambda s: (s[1], KINDS.index(s[0])))
    return [{"kind": k, "start": a, "end": b, "score": score(text, k, a, b)} for k, a, b in kept]


def redact(text: str | None, found: list[dict]) -> str | None:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""
    if text is None or not found:
        return text
    out, at = [], 0
    for s in found:
        if s["start"] >= at:
            out += [text[at:s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join(out) + text[at:]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
_DDL = "array<struct<kind string, start bigint, end bigint, score double>>"


def personal_data(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``doc_id, spans`` per row; spans hold kind, start, end (code points, end exclusive) and score.

    A null or empty text has no spans. Rows that repeat come back as often; other
    columns play no part. Every text is searched whole, in time linear in its length.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("spans", _SPANS)])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([spans(t.as_py()) for t in b.column(1)], _SPANS)], schema=schema)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, spans {_DDL}")


def redacted(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with the spans of the text replaced; all columns and rows stay."""

    def run(batches):
        for b in batches:
            texts = [t.as_py() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([redact(t, spans(t)) for t in texts], pa.string()), *b.columns[1:]], names=b.schema.names)

    at = docs.columns.index(text_column)
    order = [at, *[i for i in range(len(docs.columns)) if i != at]]
    moved = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).select(*[f"c{i}" for i in order])
    out = moved.mapInArrow(run, moved.schema)
    return out.select(*[F.col(f"c{i}").alias(docs.columns[i]) for i in range(len(docs.columns))])
