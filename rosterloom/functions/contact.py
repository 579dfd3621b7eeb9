"""Phones, mail addresses and postal addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterloom.functions.text import contains_any, strip
from rosterloom.schema import EMAIL_PATTERN, PHONE_PATTERNS


# North American number: optional country code, area, exchange, line, extension.
_NUMBER = r"^\s*(?:\+?1[\s./-]*)?\(?([2-9]\d{2})\)?[\s./-]*([2-9]\d{2})[\s./-]*(\d{4})\s*"
NANP = _NUMBER + "$"
NANP_EXTENSION = _NUMBER + r"(?i)(?:ext\.?|x|#)\s*(\d{1,7})\s*$"


def national_phone(value: Column) -> Column:
    """``(AAA) BBB-CCCC``, with ``ext. N`` if the number has one; NULL if the text
    is no North American number."""
    return F.when(value.rlike(NANP), F.regexp_replace(value, NANP, "($1) $2-$3")).when(
        value.rlike(NANP_EXTENSION), F.regexp_replace(value, NANP_EXTENSION, "($1) $2-$3 ext. $4")
    )


def e164(national: Column) -> Column:
    """``+1`` and ten digits of a number in national form."""
    return F.concat(F.lit("+1"), F.substring(F.regexp_replace(national, "[^0-9]", ""), 1, 10))


def few_digits(value: Column) -> Column:
    """Too few digits for any number."""
    return F.length(F.regexp_replace(value, "[^0-9]", "")) < 3


def normalize_phone(value: Column) -> Column:
    """National form, or the text itself when it is no such number."""
    return F.coalesce(national_phone(value), value)


def is_phone(value: Column) -> Column:
    return value.rlike("|".join(PHONE_PATTERNS))


def is_email(value: Column) -> Column:
    return value.rlike(EMAIL_PATTERN)


def normalize_email(value: Column) -> Column:
    return F.lower(strip(value))


# --- fixed values: written forms of street parts ------------------------------
DIRECTIONS = "N|S|E|W|NE|NW|SE|SW|North|South|East|West|Northeast|Northwest|Southeast|Southwest"
STREET_TYPES = (
    "St|Street|Ave|Avenue|Rd|Road|Blvd|Boulevard|Dr|Drive|Ln|Lane|Ct|Court|Pl|Place|Way|Pkwy|Parkway"
    "|Cir|Circle|Ter|Terrace|Hwy|Highway|Sq|Square|Trl|Trail"
)
UNITS = "Suite|Ste|Apt|Apartment|Unit|Room|Rm|Floor|Fl|Bldg|Building"
# --- end of fixed values ------------------------------------------------------

ADDRESS_PATTERN = (
    rf"(?is)^\s*(\d+[A-Za-z]?)\s+((?:(?:{DIRECTIONS})\.?\s+)?[A-Za-z0-9][A-Za-z0-9'\- ]*?\s+(?:{STREET_TYPES}))\b\.?"
    rf"(?:\s*,)?(?:\s*({UNITS})\.?\s*#?\s*([A-Za-z0-9\-]+))?"
)
# City, state and postal code at the end of an address.
PLACE_PATTERN = r"([A-Za-z .'\-]+,\s*[A-Z]{2}\s+\d{5}(?:-\d{4})?)\s*$"


def normalize_address(value: Column, keep_place: bool = False) -> Column:
    """Number, street and unit joined by ``, ``; NULL when the text does not look
    like a street address.  The place is dropped unless ``keep_place``."""
    parts = F.regexp_replace(value, ADDRESS_PATTERN + ".*$", "$1, $2, $3 $4")
    street = F.regexp_replace(parts, r",\s*$", "")
    if keep_place:
        place = F.nullif(strip(F.regexp_extract(value, PLACE_PATTERN, 1)), F.lit(""))
        street = F.concat_ws(", ", street, place)
    return F.when(value.rlike(ADDRESS_PATTERN), street)


def low_confidence_address(value: Column) -> Column:
    return (
        (F.length(value) < 10)
        | ~F.contains(value, F.lit(","))
        | ~value.rlike("[0-9]")
        | contains_any(F.lower(value), ["unknown", "n/a", "tbd"])
    )
