"""Personal data by anchor expansion (operator 1).

An Aho-Corasick automaton finds the anchors: at-signs, plus signs, digits,
schemes and the cue words of identifiers.  From each anchor a deterministic
local parser expands to the boundaries of one kind and validates what it found.
Within a kind spans run from left to right and do not overlap; a candidate that
fails validation uses up its characters and is not tried again.

Kinds: ``email``, ``ip``, ``card`` (Luhn), ``phone``; the method adds ``url`` and
``account`` (a value behind a cue such as ``password=`` or ``IBAN:``; IBANs by
their check digits, SSNs by their groups).  Places are code points, ends
exclusive.  A null or empty text has no spans.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.llm.common import code, give_back, map_rows
from rosterloom.session import ship_package

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")
ROWS = 256
CUES = ("password", "passwd", "token", "secret", "api_key", "apikey", "account", "acct", "iban", "ssn")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT_DOTS = re.compile(r"[0-9]+(?:\.[0-9]+){0,3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
URL = re.compile(r"[^\s<>\"'`{}|\\^]+")
GAP = re.compile(r"(?: ?(?:number|no\.?|id))?\s{0,3}[=:#]\s{0,3}[\"']?|\s(?=[A-Z]{2}[0-9]{2})")
VALUE = re.compile(r"[A-Za-z0-9_./+-]{6,}")
IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}")
SSN = re.compile(r"([0-9]{3})-?([0-9]{2})-?([0-9]{4})(?![0-9])")


def luhn(number: str) -> bool:
    total = 0
    for place, char in enumerate(reversed(number)):
        digit = int(char) << (place & 1)
        total += digit - 9 if digit > 9 else digit
    return total % 10 == 0


def valid_iban(text: str) -> bool:
    packed = text.replace(" ", "").upper()
    return 15 <= len(packed) <= 34 and int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


#: A parser gets the text, the anchor's first place and the place up to which its
#: kind has been read.  It returns start and end of a valid span or None, and how
#: far its kind has been read now.
Parsed = tuple[tuple[int, int] | None, int]


def email(text: str, at: int, read: int) -> Parsed:
    start = at
    while start > read and text[start - 1] in LOCAL:
        start -= 1
    domain = DOMAIN.match(text, at + 1) if start < at else None
    return ((start, domain.end()), domain.end()) if domain else (None, read)


def ip(text: str, at: int, read: int) -> Parsed:
    if at < read:
        return None, read
    run = DIGIT_DOTS.match(text, at)
    parts = run.group().split(".")
    if len(parts) < 4:
        return None, run.end()
    end = at + sum(map(len, parts[:4])) + 3
    return ((at, end) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts[:4]) else None), end


def card(text: str, at: int, read: int) -> Parsed:
    if at < read:
        return None, read
    run = CARD.match(text, at)
    if run is None:
        return None, at + 1
    digits = run.group().replace(" ", "").replace("-", "")
    return ((at, run.end()) if 13 <= len(digits) <= 19 and luhn(digits) else None), run.end()


def phone(text: str, at: int, read: int) -> Parsed:
    run = PHONE.match(text, at) if at >= read else None
    if run is None:
        return None, read
    return ((at, run.end()) if 9 <= sum(c.isdigit() for c in run.group()) <= 15 else None), run.end()


def url(text: str, at: int, read: int) -> Parsed:
    start = at
    while start > read and text[start - 1] in SCHEME:
        start -= 1
    while start < at and not text[start].isalpha():
        start += 1
    rest = URL.match(text, at + 3) if start < at else None
    end = at + 3 + len(rest.group().rstrip(".,;:!?)]")) if rest else 0
    return ((start, end), end) if end > at + 3 else (None, read)


def account(text: str, at: int, read: int, cue: str) -> Parsed:
    if at < read or at and (text[at - 1].isalnum() or text[at - 1] == "_"):
        return None, read
    gap = GAP.match(text, at + len(cue))
    if gap is None:
        return None, read
    place = gap.end()
    found = IBAN.match(text, place)
    if found:  # the longest valid one, as words may follow it
        for end in range(found.end(), place + 14, -1):
            if valid_iban(text[place:end]) and text[end - 1] != " " and not text[end : end + 1].isalnum():
                return (place, end), end
    if cue.lower() == "ssn":
        found = SSN.match(text, place)
        area, group, serial = found.groups() if found else ("000", "", "")
        good = area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
        return ((place, found.end()), found.end()) if good else (None, read)
    found = VALUE.match(text, place)
    if cue.lower() == "iban" or found is None or not any(c.isdigit() for c in found.group()):
        return None, read
    return (place, found.end()), found.end()


@functools.cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    anchors: dict[str, tuple[tuple[str, Callable], ...]] = {"@": (("email", email),), "+": (("phone", phone),), "://": (("url", url),)}
    anchors |= dict.fromkeys("0123456789", (("ip", ip), ("card", card)))
    for word in CUES:
        for cue in {word, word.capitalize(), word.upper()}:
            anchors[cue] = (("account", functools.partial(account, cue=cue)),)
    for anchor, parsers in anchors.items():
        found.add_word(anchor, (len(anchor), parsers))
    found.make_automaton()
    return found


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans, by kind in the order of ``KINDS`` and then by start."""
    if not text:
        return []
    read = dict.fromkeys(KINDS, 0)
    spans: dict[str, list] = {kind: [] for kind in KINDS}
    for last, (length, parsers) in automaton().iter(text):
        for kind, parse in parsers:
            span, read[kind] = parse(text, last - length + 1, read[kind])
            if span:
                spans[kind].append((kind, *span))
    return [span for kind in KINDS for span in spans[kind]]


def detect(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``spans``, an array of kind, start and end.  No shuffle."""

    def found(rows):
        for i, value in rows:
            yield i, [{"kind": k, "start": s, "end": e} for k, s, e in find_spans(value)]

    kind = df.schema[key].dataType.simpleString()
    source = df.select(F.col(key).alias("_key"), code(F.col(text)).alias("_text"))
    return map_rows(source, ["_key", "_text"], found, f"`{key}` {kind}, spans array<struct<kind:string,start:int,end:int>>")


def written(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """Spans as ``kind:start:end``, comma-joined, in their order."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def masked(text: str, kinds: tuple[str, ...] = KINDS) -> str:
    """The text with each span of these kinds replaced by its kind; overlapping
    ones as one, by the kind that starts first."""
    parts, place = [], 0
    for kind, start, end in sorted(find_spans(text), key=lambda s: (s[1], -s[2])):
        if kind not in kinds:
            continue
        if start >= place:
            parts += [text[place:start], f"[{kind.upper()}]"]
        place = max(place, end)
    return "".join([*parts, text[place:]])


def redact(df: DataFrame, text: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Replace the spans in a column; null stays null, other columns stay.  Some
    rows at a time are Python texts, all else passes through as it came."""
    ship_package(df.sparkSession)
    place = df.columns.index(text)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                values = [None if v is None else masked(v, kinds) for v in part.column(place).to_pylist()]
                own = batch.schema.field(place)
                yield part.set_column(place, own, pa.array(values, type=own.type))
        give_back()

    return df.mapInArrow(cleaned, df.schema)
