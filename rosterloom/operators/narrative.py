"""Field values from running text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions.classify import canonical_transaction, transaction_type
from rosterloom.functions.text import contains_any, last_wins_map, strip
from rosterloom.operators.skew import explode_rows
from rosterloom.operators.tables import delimited_arrays, with_defaults
from rosterloom.schema import (
    NARRATIVE_PATTERNS,
    NARRATIVE_SENTINEL_FIELDS,
    PHRASES,
    SENTINEL,
    TOKEN_PATTERNS,
    column_name,
)


def possessive(pattern: str) -> str:
    """The same pattern without recursion: nothing follows its last repeated
    group, so the group never has to give anything back, and a text with any
    number of repeats cannot exhaust the stack."""
    return pattern.removesuffix(")*)") + ")*+)" if pattern.endswith(")*)") else pattern


def leading_words(pattern: str) -> list[str]:
    """The words, in lower case, of which a match has to begin with one; none if
    the pattern does not begin with letters."""
    found = re.match(r"\(\?:([^()]*)\)|([A-Za-z]+)", pattern)
    heads = [re.match("[A-Za-z ]*", part)[0].lower() for part in (found[1] or found[2]).split("|")] if found else []
    return heads if all(heads) else []


def pattern_fields(text: Column, mode: str = "strict", lowered: Column | None = None) -> dict[str, Column]:
    """First match of each pattern, NULL without one.  All patterns ignore case;
    in ``strict`` mode the name pattern does not, because it would otherwise take
    any two words for a name.  A pattern is only tried where the text, in lower
    case (``lowered``, if at hand), holds a word that a match begins with."""
    lowered = F.lower(text) if lowered is None else lowered
    found = {}
    for field, pattern in NARRATIVE_PATTERNS.items():
        flag = "" if mode == "strict" and field == "Provider Name" else "(?i)"
        match = F.regexp_extract(text, flag + possessive(pattern), 1)
        heads = leading_words(pattern)
        found[field] = strip(F.nullif(F.when(contains_any(lowered, heads), match) if heads else match, F.lit("")))
    return found


def phrase_fields(text: Column) -> dict[str, Column]:
    """Last dictionary phrase of each kind in the text."""
    found = {}
    for field, phrases in PHRASES.items():
        longest_first = sorted(phrases, key=len, reverse=True)
        hits = F.regexp_extract_all(text, F.lit(rf"\b({'|'.join(longest_first)})\b"), F.lit(1))
        found[field] = F.try_element_at(hits, F.lit(-1))
    found["Transaction Type"] = canonical_transaction(found["Transaction Type"])
    return found


def tokens(text: Column, holding: str | None = None) -> Column:
    """Words cut at white space, without the punctuation around them.  With
    ``holding``, a pattern of one character, only words that hold such a one, read
    off in one pass; a word is looked through once, from its start."""
    if holding is None:
        words = F.split(text, r"\s+")
    else:
        words = F.regexp_extract_all(text, F.lit(rf"(?<!\S)\S*?{holding}\S*+"), F.lit(0))
    return F.transform(words, lambda w: F.btrim(w, F.lit(".,;:()[]{}\"'!?#*")))


def digit_tokens(text: Column) -> Column:
    return tokens(text, r"\d")


def _fitting(words: Column, pattern: str) -> Column:
    return F.filter(words, lambda w: w.rlike(pattern))


def token_fields(text: Column, words: Column | None = None) -> dict[str, Column]:
    """Values recognised by the shape of a whole token, all of which hold a digit.  The last one wins, but
    the first phone is the phone and the last further one the fax.  ``words`` are
    the ``digit_tokens`` of the text, if a projection before has them: lambdas over
    them are no common expressions, so each would work them out again."""
    words = digit_tokens(text) if words is None else words
    hits = {kind: _fitting(words, pattern) for kind, pattern in TOKEN_PATTERNS.items()}
    phones = hits.pop("phone")
    found = {field: F.try_element_at(values, F.lit(-1)) for field, values in hits.items()}
    found["Phone Number"] = F.try_element_at(phones, F.lit(1))
    found["Fax Number"] = F.when(F.size(phones) > 1, F.try_element_at(phones, F.lit(-1)))
    return found


def narrative_columns(df: DataFrame, text: str = "text", mode: str = "strict") -> DataFrame:
    """Pattern fields as typed columns, one narrow projection."""
    lowered = df.withColumn("_lowered", F.lower(F.col(text)))
    found = pattern_fields(F.col(text), mode, F.col("_lowered"))
    return lowered.select(*df.columns, *[value.alias(column_name(f)) for f, value in found.items()])


def narrative_rows(
    df: DataFrame, text: str = "text", mode: str = "strict", dictionaries: bool = False, defaults: dict | None = None
) -> DataFrame:
    """One row per text that yields a field.  With ``dictionaries`` the phrase and
    token taggers come first and the patterns only fill what they left open."""
    gathered = _with_hits(df, text, mode, dictionaries)
    rows = explode_rows(gathered.drop(text), "_hits", "_hit").withColumn("data", F.map_from_entries("_hit"))
    return (
        _completed(rows, "data", defaults)
        .withColumns({"row_idx": F.lit(0), "confidence": F.lit(0.6), "extraction_method": F.lit("narrative_text")})
        .drop("_kind", "_hit")
    )


def _with_hits(df: DataFrame, text: str, mode: str, dictionaries: bool) -> DataFrame:
    """Adds ``_kind``, the transaction type of a text, and ``_hits``, an array of
    the one list of fields found in it, or an empty one."""
    # A text of a single line makes no row, so nothing is looked for in it.
    many_lines = F.contains(strip(F.col(text)), F.lit("\n"))
    source, words = F.col("_source"), F.col("_words")
    begun = df.withColumn("_source", F.when(many_lines, F.col(text)))
    begun = begun.withColumns({"_lowered": F.lower(source)} | ({"_words": digit_tokens(source)} if dictionaries else {}))
    found = pattern_fields(source, mode, F.col("_lowered"))
    if dictionaries:
        tagged = token_fields(source, words)
        for field, value in phrase_fields(source).items():
            tagged[field] = F.coalesce(value, tagged[field]) if field in tagged else value
        for field, value in tagged.items():
            found[field] = F.coalesce(value, found[field]) if field in found else value
    fields = {f: f"_f_{column_name(f)}" for f in found}
    read = begun.withColumns({fields[f]: value for f, value in found.items()} | {"_kind": transaction_type(source)})
    hits = F.array_compact(
        F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(f).alias("key"), F.col(c).alias("value"))) for f, c in fields.items()])
    )
    # No hit makes no row: an empty array explodes to nothing.
    return read.select(
        *df.columns, "_kind", F.when(source.isNotNull(), F.filter(F.array(hits), lambda h: F.size(h) > 0)).alias("_hits")
    )


def _completed(rows: DataFrame, data: str, defaults: dict | None) -> DataFrame:
    """Fill what a narrative row lacks: its type, its attribute and sentinels."""
    kind = F.coalesce(F.try_element_at(data, F.lit("Transaction Type")), F.col("_kind"))
    context = F.create_map(
        F.lit("Transaction Type"),
        F.col("_kind"),
        F.lit("Transaction Attribute"),
        F.when(F.col("_kind").isin("Add", "Term"), "Provider").otherwise("Not Applicable"),
    )
    extra = {f: SENTINEL for f in NARRATIVE_SENTINEL_FIELDS} | (defaults or {})
    return (
        rows.withColumn("_kind", kind)
        .withColumn(data, F.map_concat(F.map_filter(context, lambda k, v: ~F.map_contains_key(data, k)), F.col(data)))
        .withColumn(data, with_defaults(F.col(data), extra))
    )


def text_rows(
    df: DataFrame, text: str = "text", mode: str = "strict", dictionaries: bool = False, defaults: dict | None = None
) -> DataFrame:
    """Structured rows of a text if it has any, narrative rows otherwise.

    The choice is made inside each text, which is read and split once: a text
    with structured rows is null for the narrative patterns, and one explode
    yields the rows of either kind."""
    structured = F.coalesce(F.size("_rows") > 0, F.lit(False))
    split = delimited_arrays(df, text).withColumn("_structured", structured)
    read = _with_hits(split.withColumn(text, F.when(~F.col("_structured"), F.col(text))), text, mode, dictionaries)
    named = F.transform(
        "_rows",
        lambda r: F.struct(
            r["row_idx"].alias("row_idx"),
            F.zip_with(
                "_names",
                F.slice(r["values"], F.lit(1), F.size("_names")),
                lambda n, v: F.struct(n.alias("key"), v.alias("value")),
            ).alias("entries"),
        ),
    )
    found = F.transform("_hits", lambda h: F.struct(F.lit(0).alias("row_idx"), h.alias("entries")))
    kept = [c for c in df.columns if c != text]
    chosen = read.select(*kept, "_kind", "_structured", F.when(F.col("_structured"), named).otherwise(found).alias("_all"))
    rows = explode_rows(chosen, "_all", "_one").withColumns(
        {"row_idx": F.col("_one.row_idx"), "_own": last_wins_map(F.col("_one.entries"))}
    )
    filled = _completed(rows.withColumn("_told", F.col("_own")), "_told", defaults)
    either = lambda a, b: F.when(F.col("_structured"), a).otherwise(b)
    return filled.select(
        *kept,
        "row_idx",
        either(F.col("_own"), F.col("_told")).alias("data"),
        either(F.lit(0.7), F.lit(0.6)).alias("confidence"),
        either(F.lit("plain_text_structured"), F.lit("narrative_text")).alias("extraction_method"),
    )
