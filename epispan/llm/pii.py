"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds (email, ip, card, phone) always count when their rule holds. Further kinds (IBAN, national number) count when
their score reaches ``threshold``: a checksum gives most of it, a word such as "iban" close by gives the rest, and a word
that speaks against it ("order", "version") takes some away from kinds without a checksum. An IBAN ends where the length of
its country ends, whatever follows; a code of no known country ends at the last word end at which its checksum holds. Spans
are code points, end exclusive.

Defined results: a null text is empty and has no spans; rows are never joined, so repeated and null ids stay as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispan.llm.common import Batches, record, texts

#: The kinds in the order in which they are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn")
KINDS = BASE_KINDS + ADDED_KINDS

#: Patterns of the base kinds. The look-behinds and possessive repeats keep long digit runs linear and
#: change no match: a match never starts inside a run of digits that it could have taken whole.
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])))")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
NOT_DIGITS = re.compile(r"[^0-9]+")

#: Signs of an IBAN by country.
IBAN_LENGTHS = {
    code: int(length)
    for length, codes in (row.split(":") for row in (
        "15:NO", "16:BE", "18:DK FI FK FO GL NL SD", "19:MK SI", "20:AT BA EE KZ LT LU MN XK", "21:CH HR LI LV",
        "22:BG BH CR DE GB GE IE ME RS VA", "23:AE GI IL IQ OM SO TL", "24:AD CZ ES MD PK RO SA SE SK TN VG", "25:LY PT ST",
        "26:IS TR", "27:BI DJ FR GR IT MC MR SM", "28:AL AZ BY CY DO GT HN HU LB NI PL SV", "29:BR EG PS QA UA",
        "30:JO KW MU YE", "31:MT SC", "32:LC", "33:RU",
    ))
    for code in codes.split()
}

#: Words that raise or lower the score of an added kind, as whole words within ``REACH`` code points.
FOR_WORDS = {
    "iban": frozenset(("iban", "bank", "account", "konto", "cuenta", "compte", "bic", "swift")),
    "ssn": frozenset(("ssn", "social", "security", "taxpayer", "identification")),
}
AGAINST_WORDS = frozenset(("order", "version", "isbn", "serial", "model", "part", "sku", "invoice"))
REACH = 40
#: Kinds whose spans have passed a checksum that no word nearby overrules.
CONFIRMED_KINDS = ("iban",)
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3}
CONTEXT_STEP = 0.3
THRESHOLD = 0.6
WORD = re.compile(r"[^\W\d_]+")

SCHEMA = "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
SPAN_SCHEMA = pa.schema([("doc_id", pa.int64()), ("spans", SPAN_TYPE)])


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Sum of digits, every second from the right doubled (and 9 taken off above 9), divisible by 10."""
    total = sum(int(d) for d in digits[-1::-2])
    total += sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Country and check digits moved to the end, letters as 10..35: the number leaves 1 when divided by 97."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their @ signs so that other text costs nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = NOT_DIGITS.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 10 <= len(NOT_DIGITS.sub("", m[0])) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    free = 0
    for m in IBAN.finditer(text):
        start, run = m.start(), m[1]
        if start < free:
            continue
        for end in iban_ends(run):
            if mod97(run[:end].replace(" ", "")):
                free = start + end
                yield start, free
                break


def iban_ends(run: str) -> Iterator[int]:
    """Where the IBAN at the start of a run may end: after its country's length, else with the run; without one, at any word."""
    places = [k for k, c in enumerate(run, 1) if c != " "]
    ends = [end for n, end in enumerate(places, 1) if n >= 15 and not run[end : end + 1].strip()]
    length = IBAN_LENGTHS.get(run[:2])
    if length is None:
        yield from reversed(ends)
        return
    if length <= len(places) and places[length - 1] in ends:
        yield places[length - 1]
    yield len(run)


def ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans, "ssn": ssns}


def score(text: str, kind: str, start: int, end: int) -> float:
    near = {w.lower() for w in WORD.findall(text[max(0, start - REACH) : start] + " " + text[end : end + REACH])}
    value = PRIOR[kind]
    if near & FOR_WORDS.get(kind, frozenset()):
        value += CONTEXT_STEP
    if near & AGAINST_WORDS and kind not in CONFIRMED_KINDS:
        value -= CONTEXT_STEP
    return min(1.0, max(0.0, value))


def find_spans(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """All spans of a text by start, then kind as listed. Base kinds stay whatever their score."""
    found = []
    for kind in KINDS:
        for start, end in FINDERS[kind](text):
            value = score(text, kind, start, end)
            if kind in BASE_KINDS or value >= threshold:
                found.append(Span(kind, start, end, value))
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def find_pii(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, spans) per row of ``docs``; spans as structs of kind, start, end and score."""

    def work(batches: Batches) -> Batches:
        for batch in batches:
            spans = [[s._asdict() for s in find_spans(t, threshold)] for t in texts(batch)]
            yield record(SPAN_SCHEMA, batch.column("doc_id"), pa.array(spans, SPAN_TYPE))

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(work, SCHEMA)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, done = [], 0
    for s in spans:
        if s.end <= done:
            continue
        if s.start >= done:
            out += [text[done : s.start], f"[{s.kind}]"]
        done = s.end
    return "".join([*out, text[done:]])


def digest(spans: DataFrame) -> DataFrame:
    """Counts of base kinds, the hash of the base spans and all spans as text, from the result of ``find_pii``."""
    as_text = lambda kinds: F.array_join(
        F.transform(
            F.filter("spans", lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
        ),
        ",",
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return spans.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(as_text(BASE_KINDS), 256).alias("base_sha256"),
        as_text(KINDS).alias("spans"),
    )


def base_digest(spans: list[Span]) -> str:
    return hashlib.sha256(listed([s for s in spans if s.kind in BASE_KINDS]).encode()).hexdigest()
