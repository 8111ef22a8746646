"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Four base kinds (email, ip, card, phone) are always reported. The other kinds
need a score of at least ``ACCEPT``, which a checksum or a context word gives
and other words, like those of order numbers, take away.
Every expression reads a text in time proportional to its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import numbered, pick, struct_udf

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "pan", "tel", "secret")
BASE = KINDS[:4]

#: Least score of a span that is not of a base kind.
ACCEPT = 0.5

#: Characters on either side in which context words are looked for.
NEARBY = 48

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_TEL = re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])")
# Numbers of these shapes are found again where a base match ran on into the next number and failed.
_FOUR_FOURS = re.compile(r"(?<![0-9])[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")
_ABROAD = re.compile(r"\+[0-9]{1,3}\x20?(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[-.\x20])[0-9]{3,4}[-.\x20][0-9]{3,4}(?![0-9])")
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
_PASSWORD = re.compile(r"(?<![A-Za-z])(?:password|passwd|secret|api_key|apikey|token)\x20?[=:]\x20?[\"']?[^\s,;\"']{6,}+[\"']?", re.IGNORECASE)
_IBAN_LENGTH = {
    v[:2]: int(v[2:])
    for v in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 "
        "LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
}
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")

_CONTEXT = {
    "email": re.compile(r"mail|contact|write", re.IGNORECASE),
    "ip": re.compile(r"\bip\b|address|host|server", re.IGNORECASE),
    "card": re.compile(r"card|visa|credit|debit|carte|karte|tarjeta", re.IGNORECASE),
    "phone": re.compile(r"phone|call|\btel|mobil|fax", re.IGNORECASE),
    "iban": re.compile(r"iban|bank|account|konto|compte|cuenta", re.IGNORECASE),
    "ssn": re.compile(r"\bssn\b|social|security|\btax\b", re.IGNORECASE),
    "secret": re.compile(r"key|secret|token|password|login", re.IGNORECASE),
}
_CONTEXT["pan"], _CONTEXT["tel"] = _CONTEXT["card"], _CONTEXT["phone"]
# Words that speak against a number of a kind with a weak validator.
_AGAINST = re.compile(r"\border\b|invoice|serial|\bpart\b|version|\bisbn\b|tracking|\bsku\b", re.IGNORECASE)
_WEAK = ("ssn", "pan", "tel")

#: Score of a span that its validator has confirmed, before context; of the shapes above, which need none.
_SHAPED = 0.6
_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "pan": 0.3, "tel": 0.3, "secret": 0.7}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest proposal may run on into what follows, so the country's own length is tried first, if mod-97 agrees.

    An end is never within a word or number. After a failure the search goes on
    within the proposal, which has a bounded length.
    """
    at = 0
    while m := _IBAN.search(text, at):
        at, n = m.start() + 1, len(m[0].replace(" ", ""))
        ends = {}
        for end in range(m.end(), m.start(), -1):
            if text[end - 1] != " ":
                if n >= 15 and not (text[end : end + 1].isascii() and text[end : end + 1].isalnum()):
                    ends[n] = end
                n -= 1
        own = ends.get(_IBAN_LENGTH.get(m[0][:2]))
        for end in (own, *list(ends.values())[:1]):
            if end and mod97(text[m.start() : end].replace(" ", "")):
                at = end
                yield m.start(), end
                break


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards, so that a long run without one is never searched again and again."""
    over, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > over and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            over = found.end()
            yield start, over
        else:
            over = at + 1
        at = text.find("@", max(over, at + 1))


def _base(text: str) -> Iterator[tuple[str, int, int]]:
    yield from (("email", *span) for span in _emails(text))
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 64:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield "phone", *m.span()


def _more(text: str) -> Iterator[tuple]:
    """Proposals of the further kinds whose own validator agrees: kind, start, end and, if not the kind's own, score."""
    if _DIGIT.search(text):
        yield from (("iban", *span) for span in _ibans(text))
        for m in _SSN.finditer(text):
            if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
                yield "ssn", *m.span()
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 40:
                digits = _NOT_DIGIT.sub("", m[0])
                if 13 <= len(digits) <= 15 and luhn(digits):
                    yield "pan", *m.span()
        for m in _FOUR_FOURS.finditer(text):
            if luhn(_NOT_DIGIT.sub("", m[0])):
                yield "pan", *m.span(), _SHAPED
        yield from (("tel", *m.span()) for m in _TEL.finditer(text))
        yield from (("tel", *m.span(), _SHAPED) for m in _ABROAD.finditer(text))
    yield from (("secret", *m.span()) for m in _KEY.finditer(text))
    if "=" in text or ":" in text:
        yield from (("secret", *m.span()) for m in _PASSWORD.finditer(text))


def _scored(text: str, kind: str, start: int, end: int, score: float | None = None) -> Span:
    near = text[max(0, start - NEARBY) : start] + " " + text[end : end + NEARBY]
    held = (score or _SCORE[kind]) + (0.3 if _CONTEXT[kind].search(near) else 0.0) - (0.2 if kind in _WEAK and _AGAINST.search(near) else 0.0)
    return Span(kind, start, end, min(1.0, held))


def find(text: str) -> list[Span]:
    """All spans by kind as in ``KINDS``, then start; offsets in code points, end exclusive.

    A span of a further kind gives way to a base span, or an earlier one, that it overlaps.
    """
    spans = [_scored(text, *s) for s in _base(text)]
    taken = sorted((s.start, s.end) for s in spans)
    more = sorted((s for s in (_scored(text, *p) for p in _more(text)) if s.score >= ACCEPT), key=lambda s: (s.start, -s.end))
    over, i = 0, 0
    for s in more:
        while i < len(taken) and taken[i][0] < s.end:
            over = max(over, taken[i][1])
            i += 1
        if s.start >= over:
            spans.append(s)
            over = s.end
    return sorted(spans, key=lambda s: (KINDS.index(s.kind), s.start))


def mask(text: str, spans: list[Span]) -> str:
    """The text with each stretch of overlapping spans replaced by the kind of its first, like [EMAIL]."""
    out, done = [], 0
    for s in sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind))):
        if s.start >= done:
            out += [text[done : s.start], f"[{s.kind.upper()}]"]
        done = max(done, s.end)
    return "".join([*out, text[done:]])


def shown(spans: Iterable[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores) of each row's whole text.

    The counts and the digest are of the base kinds, ``spans`` of all kinds,
    ``scores`` their scores in the same order, with two decimals. A
    null text has no spans. Repeated rows each give a row; an empty table gives
    none; other columns are ignored. ``mask_documents`` replaces the spans.
    """

    def rows(batch: Iterable[str | None]) -> Iterator[tuple]:
        for text in batch:
            spans = find(text or "")
            base = [s for s in spans if s.kind in BASE]
            counts = [sum(s.kind == k for s in base) for k in BASE]
            yield *counts, hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans), ",".join(f"{s.score:.2f}" for s in spans)

    fields = {f"n_{k}": "bigint" for k in BASE} | {"base_sha256": "string", "spans": "string", "scores": "string"}
    found = struct_udf(fields, rows)("text").alias("d")
    return pick(docs, "doc_id", "text").select("doc_id", found).select("doc_id", F.col("d.*"))


def masked(text: Column) -> Column:
    """The text column with personal data replaced; null stays null."""

    def rows(batch: Iterable[str | None]) -> Iterator[tuple]:
        for t in batch:
            yield (t and (mask(t, spans) if (spans := find(t)) else t),)

    return struct_udf({"t": "string"}, rows)(text)["t"]


def mask_documents(docs: DataFrame) -> DataFrame:
    """The documents with personal data in ``text`` replaced and ``n_chars`` counted anew; every row stays."""
    frame, col, back = numbered(docs)
    at = {n: f"c{docs.columns.index(n)}" for n in ("text", "n_chars") if n in docs.columns}
    frame = frame.withColumn(at["text"], masked(col("text")))
    if "n_chars" in at:
        kind = docs.schema[docs.columns.index("n_chars")].dataType
        frame = frame.withColumn(at["n_chars"], F.length(at["text"]).cast(kind))
    return back(frame)
