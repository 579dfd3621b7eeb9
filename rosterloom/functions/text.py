"""String scalars.  All of them are native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterloom.schema import SENTINEL

# White space as Unicode-aware string trimming sees it.
WHITESPACE = " \t\n\r\x0b\x0c" + "".join(
    chr(c)
    for c in [0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)


def strip(value: Column) -> Column:
    """Trim every kind of white space (``trim`` alone removes only blanks)."""
    return F.btrim(value, F.lit(WHITESPACE))


# NUL cannot occur in stored text, and as ASCII it keeps case mapping on its fast path.
_BREAK = "\x00 "


def title_case(value: Column) -> Column:
    """Capital after every non-letter: ``o'brien`` -> ``O'Brien``.

    ``initcap`` sees words only between blanks, so a marked blank is put before
    each letter that follows a non-letter and taken out again."""
    parted = F.regexp_replace(value, r"([^\p{L} ])(?=\p{L})", "$1" + _BREAK)
    return F.replace(F.initcap(parted), F.lit(_BREAK), F.lit(""))


def is_sentinel(value: Column) -> Column:
    return F.lower(strip(value)) == SENTINEL.lower()


def is_blank(value: Column) -> Column:
    return F.coalesce(strip(value), F.lit("")) == ""


def is_missing(value: Column) -> Column:
    return missing_word(strip(value))


def missing_word(trimmed: Column) -> Column:
    """The same of a text that is trimmed already.  Only a text as long as the
    sentinel is lower-cased."""
    same = F.when(F.length(trimmed) == len(SENTINEL), F.lower(trimmed) == SENTINEL.lower()).otherwise(trimmed == "")
    return F.coalesce(same, F.lit(True))


def null_words(value: Column) -> Column:
    """Trimmed value, with the words a model writes for "nothing" as NULL."""
    trimmed = strip(value)
    return F.when(~F.lower(trimmed).isin("null", "none", "n/a", "na"), trimmed)


def strip_tags(html: Column) -> Column:
    """Markup replaced by single blanks."""
    return strip(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " "))


def contains_any(value: Column, terms: list[str]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(value, F.lit(term))
    return found


def split_line(line: Column) -> Column:
    """Cells of a text line, cut at the first separator kind that occurs in it."""
    cuts = F.when(F.contains(line, F.lit("\t")), F.split(line, "\t"))
    for needle, pattern in [("  ", "  "), (" | ", r" \| "), ("|", r"\|"), (",", ",")]:
        cuts = cuts.when(F.contains(line, F.lit(needle)), F.split(line, pattern))
    return F.transform(cuts.otherwise(F.split(strip(line), r"\s{2,}")), strip)


def strip_fence(response: Column) -> Column:
    """Model answer without its Markdown code fence."""
    return strip(F.regexp_replace(F.regexp_replace(strip(response), "^```json", ""), "```$", ""))


def json_object_text(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; NULL without such a span."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def mask_pii(value: Column, npi: bool = True, phone: bool = True, email: bool = True) -> Column:
    """Mask identifiers, phones and mail addresses, in that order."""
    if npi:
        value = F.regexp_replace(value, r"\b\d{10}\b", "NPI_****")
    if phone:
        value = F.regexp_replace(value, r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", "PHONE_****")
    if email:
        value = F.regexp_replace(
            value, r"\b[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Za-z]{2,})\b", "***@$1"
        )
    return value


def last_wins_map(entries: Column) -> Column:
    """Map from ``array<struct<key,value>>``; a repeated key keeps its last value."""
    none = F.array().cast("array<string>")
    return F.aggregate(
        entries,
        F.map_from_arrays(none, none),
        lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.create_map(e["key"], e["value"])),
    )


def object_key(prefix: str, name: Column, at: Column) -> Column:
    """``prefix/yyyy/MM/dd/HHmmss/name``."""
    return F.concat_ws("/", F.lit(prefix), F.date_format(at, "yyyy/MM/dd/HHmmss"), name)
