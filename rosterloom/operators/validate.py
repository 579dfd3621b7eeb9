"""Validation rules as data, and the issues they find."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions.contact import is_email, is_phone, low_confidence_address
from rosterloom.functions.dates import parse_date
from rosterloom.functions.identifiers import npi_format, npi_luhn
from rosterloom.functions.text import is_missing, strip
from rosterloom.operators.skew import explode_rows, flag_repeats

FIELD_NPI = "Provider NPI"
ISSUE_TYPE = "struct<field: string, level: string, message: string>"


@dataclass(frozen=True)
class Rule:
    """A finding: where, how bad, when and what to say.

    ``applies`` and ``message`` read the prepared columns that :func:`value`,
    :func:`day` and :func:`flag` name."""

    field: str
    level: str
    applies: Callable[[], Column]
    message: Callable[[], Column]
    needs: tuple[str, ...] = ()
    days: tuple[str, ...] = ()


def value(name: str) -> Column:
    """Trimmed text of a column, empty for NULL."""
    return F.col(f"_value_{name}")


def day(name: str) -> Column:
    """Date a column holds, NULL if unreadable."""
    return F.col(f"_day_{name}")


def flag(name: str) -> Column:
    """State of the identifier: ``given``, ``format`` or ``luhn``."""
    return F.col(f"_npi_{name}")


def _given(name: str) -> Column:
    return value(name) != ""


def _say(text: str, name: str, after: str = "") -> Column:
    return F.concat(F.lit(text), value(name), F.lit(after))


def default_rules(as_of: str) -> list[Rule]:
    """Rule set for the target schema; ``as_of`` (yyyy-MM-dd) stands for today."""
    today = F.lit(as_of).cast("date")
    oldest = F.add_months(today, -1440)
    npi, dob, effective, term = "provider_npi", "dob", "effective_date", "term_date"

    def both() -> Column:
        return _given(effective) & _given(term)

    def unreadable() -> Column:
        bad = F.when(day(effective).isNull(), value(effective)).otherwise(value(term))
        return F.concat(F.lit("Could not validate date range: Unknown string format: "), bad)

    def wrong_order() -> Column:
        return F.concat(
            F.lit("Term date ("), value(term),
            F.lit(") must be after or equal to effective date ("), value(effective), F.lit(")"),
        )

    return [
        Rule("Provider Name", "error", lambda: is_missing(value("provider_name")),
             lambda: F.lit("Required field 'Provider Name' is missing or empty"), ("provider_name",)),
        Rule(FIELD_NPI, "error", lambda: flag("given") & ~flag("format"),
             lambda: _say("Invalid NPI format: ", npi, " (must be 10 digits)"), (npi,)),
        Rule(FIELD_NPI, "warning", lambda: flag("given") & flag("format") & ~flag("luhn"),
             lambda: _say("NPI checksum validation failed: ", npi), (npi,)),
        Rule(FIELD_NPI, "warning", lambda: F.col("is_repeat"),
             lambda: _say("Duplicate NPI found: ", npi), (npi, "is_repeat")),
        Rule("DOB", "error", lambda: _given(dob) & day(dob).isNull(),
             lambda: _say("Invalid date format: ", dob), (dob,), (dob,)),
        Rule("DOB", "error", lambda: day(dob) > today,
             lambda: _say("Date of birth cannot be in the future: ", dob), (dob,), (dob,)),
        Rule("DOB", "warning", lambda: day(dob) < oldest,
             lambda: _say("Date of birth seems unusually old: ", dob), (dob,), (dob,)),
        Rule("Term Date", "error", lambda: both() & (day(effective) > day(term)),
             wrong_order, (effective, term), (effective, term)),
        Rule("Term Date", "warning", lambda: both() & (day(effective).isNull() | day(term).isNull()),
             unreadable, (effective, term), (effective, term)),
        Rule("Email", "warning", lambda: _given("email") & ~is_email(value("email")),
             lambda: _say("Invalid email format: ", "email"), ("email",)),
        Rule("Phone Number", "warning", lambda: _given("phone_number") & ~is_phone(value("phone_number")),
             lambda: _say("Invalid phone format: ", "phone_number"), ("phone_number",)),
        Rule("Complete Address", "warning",
             lambda: _given("complete_address") & low_confidence_address(value("complete_address")),
             lambda: _say("Address may have low confidence: ", "complete_address"), ("complete_address",)),
    ]


def edit_rules() -> list[Rule]:
    """Rule set of an edited record under the older column names."""
    required = [("NPI", "npi"), ("Provider Name", "provider_name"), ("Specialty", "specialty"),
                ("Effective Date", "effective_date")]
    rules = [
        Rule(label, "error", lambda n=name: ~_given(n),
             lambda t=label: F.lit(f"Required field '{t}' is missing"), (name,))
        for label, name in required
    ]
    rules.append(
        Rule("NPI", "error", lambda: _given("npi") & ~npi_format(value("npi")),
             lambda: _say("Invalid NPI format: ", "npi"), ("npi",))
    )
    return rules


def legacy_type_rules() -> list[Rule]:
    """Type checks on the oldest schema."""
    return [
        Rule("NPI", "error", lambda: _given("npi") & ~npi_format(value("npi")),
             lambda: F.lit("NPI must be 10 digits"), ("npi",)),
        Rule("ZIP", "error", lambda: _given("zip") & ~value("zip").rlike("^[0-9]+$"),
             lambda: F.lit("ZIP must be numeric"), ("zip",)),
        Rule("Email", "error", lambda: _given("email") & ~F.contains(value("email"), F.lit("@")),
             lambda: F.lit("Email must contain @"), ("email",)),
    ]


def prepare(df: DataFrame, names: set[str], days: set[str] = frozenset(), prefix: str = "") -> DataFrame:
    """Trimmed texts, then dates and identifier states, each worked out once."""
    texts = df.withColumns({f"_value_{n}": F.coalesce(strip(F.col(n)), F.lit("")) for n in sorted(names)})
    states = {f"_day_{n}": parse_date(value(n)) for n in sorted(days)}
    if "provider_npi" in names:
        npi = value("provider_npi")
        states |= {"_npi_given": ~is_missing(npi), "_npi_format": npi_format(npi), "_npi_luhn": npi_luhn(npi, prefix)}
    return texts.withColumns(states) if states else texts


def apply_rules(df: DataFrame, rules: list[Rule], prefix: str = "") -> DataFrame:
    """Adds ``issues`` in rule order and ``is_valid``.  Rules on columns the frame
    lacks do not apply."""
    usable = [r for r in rules if set(r.needs) <= set(df.columns)]
    names = {n for r in usable for n in r.needs} - {"is_repeat"}
    prepared = prepare(df, names, {n for r in usable for n in r.days}, prefix)
    found = [
        F.when(
            r.applies(),
            F.struct(F.lit(r.field).alias("field"), F.lit(r.level).alias("level"), r.message().alias("message")),
        )
        for r in usable
    ]
    issues = F.array_compact(F.array(*found)) if found else F.array().cast(f"array<{ISSUE_TYPE}>")
    checked = prepared.select(*df.columns, issues.alias("issues"))
    return checked.withColumn("is_valid", ~F.exists("issues", lambda i: i["level"] == "error"))


def flag_duplicates(df: DataFrame, job: str = "job_id", order: str = "row_idx", prefix: str = "") -> DataFrame:
    """Adds ``is_repeat``: a trusted identifier seen earlier in the same job.

    Format and checksum are properties of the text, so equal identifiers are
    equally trusted and only those enter the look-up."""
    npi = prepare(df, {"provider_npi"}, prefix=prefix).withColumn("_trusted", flag("given") & flag("luhn"))
    identifier = F.when(F.col("_trusted"), value("provider_npi")).otherwise("")
    kept = npi.select(*df.columns, identifier.alias("_npi"), "_trusted")
    flagged = flag_repeats(kept, [job, "_npi"], [order], applies=F.col("_trusted"))
    return flagged.drop("_npi", "_trusted")


def validate(
    df: DataFrame, as_of: str, job: str = "job_id", order: str = "row_idx", prefix: str = "", rules=None
) -> DataFrame:
    """Validated rows with ``issues`` and ``is_valid``."""
    flagged = flag_duplicates(df, job, order, prefix)
    return apply_rules(flagged, rules or default_rules(as_of), prefix).drop("is_repeat")


def issue_table(df: DataFrame, key: list[str]) -> DataFrame:
    """One row per issue, numbered in rule order."""
    return explode_rows(df.select(*key, "issues"), "issues", "i", "issue_no").select(*key, "issue_no", "i.*")


def validation_statistics(df: DataFrame, job: list[str]) -> DataFrame:
    """Row and issue counts per job with the review flag and status."""
    of_level = lambda level: F.sum(F.size(F.filter("issues", lambda i: i["level"] == level)))
    counted = df.groupBy(*job).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("is_valid")).alias("valid_rows"),
        F.count_if(~F.col("is_valid")).alias("invalid_rows"),
        F.sum(F.size("issues")).alias("total_issues"),
        of_level("error").alias("error_count"),
        of_level("warning").alias("warning_count"),
    )
    review = F.col("error_count") > 0
    return counted.select(
        "*", review.alias("needs_review"), F.when(review, "needs_review").otherwise("ready").alias("status")
    )


def explain_issue(field: Column, level: Column, message: Column) -> Column:
    return F.when(
        level == "error",
        F.concat(F.lit("There's a problem with the "), field, F.lit(" field: "), message),
    ).otherwise(F.concat(F.lit("Warning for "), field, F.lit(": "), message))


def review_rows(df: DataFrame) -> DataFrame:
    """Per record: its issue count and the colour class of its worst issue."""
    worst = (
        F.when(F.exists("issues", lambda i: i["level"] == "error"), "error")
        .when(F.size("issues") > 0, "warning")
        .otherwise("clean")
    )
    return df.select("*", F.size("issues").alias("issue_count"), worst.alias("row_class"))
