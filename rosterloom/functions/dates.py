"""Month-first dates, in plain forms and in free ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterloom.functions.text import strip

MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"


# A month by name with the day before or after it.
NAMED_DATE = rf"(?i)^(?:(\d{{1,2}}) )?({MONTHS})[a-z]*\.?(?: (\d{{1,2}}))?,? (\d{{4}})$"
_DAY, _MONTH = r"(?:0?[1-9]|[12]\d|3[01])", r"(?:0?[1-9]|1[0-2])"
READABLE = rf"^(?:{_MONTH}/{_DAY}/\d{{4}}|\d{{4}}/{_MONTH}/{_DAY}|[A-Z][a-z]{{2}} {_DAY} \d{{4}})$"


def parse_date(value: Column) -> Column:
    """DATE of a written date, NULL when no form fits.

    The text is brought to one of three shapes first.  A parser that fails throws
    inside the JVM, so only a text of a readable shape gets to it.
    """
    named = F.when(value.rlike("[A-Za-z]"), F.initcap(F.regexp_replace(strip(value), NAMED_DATE, "$2 $1$3 $4")))
    shaped = F.regexp_replace(named.otherwise(strip(value)), "[-.]", "/")
    parsed = F.try_to_timestamp(shaped, F.lit("[M/d/yyyy][yyyy/M/d][MMM d yyyy]"))
    return F.when(shaped.rlike(READABLE), parsed).cast("date")


# Words of a free date that say nothing about it.
_FILLER = rf"(?i)\b(?:(?:mon|tue|tues|wed|wednes|thu|thur|thurs|fri|sat|satur|sun)(?:day)?\b\.?|the\b|of\b|on\b)"
_ORDINAL = r"(?i)\b(\d{1,2})(?:st|nd|rd|th)\b"
_TOKEN = r"\d+|[A-Za-z]+"
_MONTH_WORDS = (
    "(?i)^(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)$"
)
_FREE = r"^[\dA-Za-z\s,./'-]+$"


def parse_free_date(value: Column) -> Column:
    """DATE of three tokens, a day, a month and a year, in any of the orders people
    write; NULL otherwise.

    Week days, ordinal endings and filler words go first.  A month in words settles
    which number is the day; of a day and a two-digit year the year comes last.
    Numbers alone are month, day, year, or year, month, day if the first has four
    digits.  Two-digit years are of 1969 to 2068."""
    plain = F.regexp_replace(F.regexp_replace(strip(value), _ORDINAL, "$1"), _FILLER, " ")
    tokens = F.when(plain.rlike(_FREE), F.regexp_extract_all(plain, F.lit(_TOKEN), F.lit(0)))
    # A lambda names the tokens, so that they are cut once.
    written = F.get(F.transform(F.array(tokens), _resolved), F.lit(0))
    # Only a real month and day get to the parser, which throws where it fails.
    return F.when(written.rlike(r"^\d{4}/(?:0[1-9]|1[0-2])/(?:0[1-9]|[12]\d|3[01])$"), F.try_to_timestamp(written, F.lit("yyyy/MM/dd"))).cast("date")


def _resolved(tokens: Column) -> Column:
    """``yyyy/MM/dd`` of a day, a month and a year in some order."""
    one, two, three = (F.get(tokens, F.lit(i)) for i in range(3))
    worded = lambda t: t.rlike(_MONTH_WORDS)
    long_year = lambda t: t.rlike(r"^\d{4}$")
    number = lambda t: F.when(t.rlike(r"^\d{1,2}$"), t.try_cast("int"))
    named = F.array(*[F.lit(m) for m in MONTHS.split("|")])
    place = lambda t: F.array_position(named, F.lower(F.substring(t, 1, 3))).cast("int")
    year = lambda t: F.when(long_year(t), t.try_cast("int")).when(
        t.rlike(r"^\d{2}$"), t.try_cast("int") + F.when(t.try_cast("int") < 69, 2000).otherwise(1900)
    )

    def shown(y: Column, m: Column, d: Column) -> Column:
        return F.concat_ws("/", *[F.lpad(c.cast("string"), n, "0") for c, n in ((y, 4), (m, 2), (d, 2))])

    chosen = (
        F.when(worded(one), shown(year(three), place(one), number(two)))
        .when(worded(two) & long_year(one), shown(year(one), place(two), number(three)))
        .when(worded(two), shown(year(three), place(two), number(one)))
        .when(worded(three) & long_year(one), shown(year(one), place(three), number(two)))
        .when(long_year(one), shown(year(one), number(two), number(three)))
        .otherwise(shown(year(three), number(one), number(two)))
    )
    return F.when(F.size(tokens) == 3, chosen)


def normalize_free_date(value: Column) -> Column:
    """``MM/dd/yyyy`` of a plain or a free date, or the value itself."""
    return F.coalesce(F.date_format(F.coalesce(parse_date(value), parse_free_date(value)), "MM/dd/yyyy"), value)


def normalize_date(value: Column) -> Column:
    """``MM/dd/yyyy``, or the value itself when it is no date."""
    return F.coalesce(F.date_format(parse_date(value), "MM/dd/yyyy"), value)


def is_day_first_date(value: Column) -> Column:
    """Strict day/month/year with a real calendar day."""
    shaped = value.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$")
    parsed = F.when(shaped, F.try_to_timestamp(value, F.lit("d/M/yyyy")))
    return parsed.isNotNull()
