"""Field normalization with a change log (deltas).

The work is laid out in three narrow projections: what is read from the raw
text, the new values, the change log.  Each reads plain columns of the one
before, so no pattern runs twice and no generated method grows without bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions.contact import (
    e164,
    few_digits,
    is_email,
    national_phone,
    normalize_address,
    normalize_email,
)
from rosterloom.functions.dates import parse_date
from rosterloom.functions.identifiers import digits_only, npi_luhn
from rosterloom.functions.text import missing_word, strip, title_case
from rosterloom.operators.skew import explode_rows
from rosterloom.schema import FIELDS, column_name

DELTA_TYPE = (
    "struct<field: string, original_value: string, normalized_value: string, e164_value: string,"
    " change_type: string, validation_passed: boolean, confidence: string, message: string>"
)

# How each field is treated; every other field is trimmed and title-cased.
TREATMENTS = {
    "Effective Date": "date",
    "Term Date": "date",
    "Provider Name": "name",
    "Provider NPI": "npi",
    "Complete Address": "address",
    "Phone Number": "phone",
}


def delta(field, original, value, change, passed, message, e164_value=None, confidence=None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(field).alias("field"),
        original.alias("original_value"),
        value.alias("normalized_value"),
        (none if e164_value is None else e164_value).alias("e164_value"),
        change.alias("change_type"),
        passed.alias("validation_passed"),
        (none if confidence is None else confidence).alias("confidence"),
        message.alias("message"),
    )


def _said(text: str, value: Column) -> Column:
    return F.concat(F.lit(text), value)


def _read(kind: str, raw: Column, keep_place: bool) -> Column:
    """What a field's treatment takes from the raw text, for names and plain texts
    from the trimmed one; NULL if it cannot."""
    if kind == "date":
        return F.date_format(parse_date(raw), "MM/dd/yyyy")
    if kind == "npi":
        return digits_only(raw)
    if kind == "phone":
        return national_phone(raw)
    if kind == "address":
        return normalize_address(raw, keep_place)
    return title_case(raw)


def _change(field: str, kind: str, raw: Column, new: Column, read: Column) -> Column:
    """Log entry of one field from plain columns, NULL without a change."""
    good, changed = read.isNotNull(), new != raw
    normalized = F.lit("normalized")
    if kind == "date":
        entry = delta(
            field, raw, new, F.when(good, "normalized").otherwise("parsing_failed"), good,
            F.when(good, _said("Date normalized to MM/DD/YYYY: ", new)).otherwise(_said("Date parsing failed: ", raw)),
        )
        return F.when(~good | changed, entry)
    if kind == "name":
        return F.when(
            changed, delta(field, raw, new, normalized, F.lit(True), _said("Name normalized to title case: ", new))
        )
    if kind == "npi":
        passed = F.col("_npi_passed")
        message = _said("NPI normalized to digits only, validation: ", F.when(passed, "passed").otherwise("failed"))
        return F.when(changed | ~passed, delta(field, raw, new, normalized, passed, message))
    if kind == "address":
        return delta(
            field, raw, new, F.when(good, "normalized").otherwise("low_confidence"), good,
            F.when(good, _said("Address standardized: ", new)).otherwise("Address type not recognized: Ambiguous"),
            confidence=F.when(good, "high").otherwise("low"),
        )
    few = F.col("_phone_few")
    entry = delta(
        field, raw, new, F.when(good, "normalized").when(few, "parsing_failed").otherwise("validation_failed"), good,
        F.when(good, _said("Phone normalized to national format: ", new))
        .when(few, _said("Phone parsing failed: ", raw))
        .otherwise(_said("Invalid phone number format: ", raw)),
        e164_value=e164(read),
    )
    return F.when(~good | changed, entry)


def normalize(df: DataFrame, fields: list[str] | None = None, keep_place: bool = False) -> DataFrame:
    """Normalize typed columns and add ``deltas``, an array in field order.

    Missing values and the sentinel are left as they are and make no delta.
    """
    chosen = [f for f in FIELDS if f in (fields or FIELDS)]
    name = {f: column_name(f) for f in chosen}
    kind = {f: TREATMENTS.get(f, "text") for f in chosen}
    logged = [f for f in chosen if kind[f] != "text"]

    held = df.withColumnsRenamed({name[f]: f"_raw_{name[f]}" for f in chosen})
    raw = {f: F.col(f"_raw_{name[f]}") for f in chosen}
    bare = {f: F.col(f"_bare_{name[f]}") for f in chosen}
    trimmed = held.withColumns({f"_bare_{name[f]}": strip(raw[f]) for f in chosen})
    read = trimmed.withColumns(
        {f"_read_{name[f]}": _read(kind[f], bare[f] if kind[f] in ("name", "text") else raw[f], keep_place) for f in chosen}
        | {f"_skip_{name[f]}": missing_word(bare[f]) for f in chosen}
    )

    values = {
        name[f]: F.when(F.coalesce(raw[f], F.lit("")) == "", "")
        .when(F.col(f"_skip_{name[f]}"), raw[f])
        .otherwise(F.coalesce(F.col(f"_read_{name[f]}"), raw[f]))
        for f in chosen
    }
    if "Provider NPI" in chosen:
        values["_npi_passed"] = npi_luhn(F.col("_read_provider_npi"))
    if "Phone Number" in chosen:
        values["_phone_few"] = few_digits(raw["Phone Number"])
    valued = read.withColumns(values)

    logs = [
        F.when(
            ~F.col(f"_skip_{name[f]}"),
            _change(f, kind[f], raw[f], F.col(name[f]), F.col(f"_read_{name[f]}")),
        )
        for f in logged
    ]
    changes = F.array_compact(F.array(*logs)) if logs else F.array().cast(f"array<{DELTA_TYPE}>")
    return valued.select(*df.columns, changes.alias("deltas"))


def normalize_email_column(df: DataFrame, column: str = "email") -> DataFrame:
    """The same for the optional mail column."""
    raw, out = F.col(f"_raw_{column}"), F.col(column)
    changed, good = out != raw, is_email(out)
    entry = delta(
        "Email", raw, out, F.when(changed, "normalized").otherwise("validation_failed"), good,
        F.concat(F.lit("Email "), F.when(changed, "normalized").otherwise("validation failed"), F.lit(": "), out),
    )
    held = df.withColumnRenamed(column, f"_raw_{column}").withColumn(column, normalize_email(raw))
    log = F.when((F.coalesce(raw, F.lit("")) != "") & (changed | ~good), entry)
    return held.select(*df.columns, log.alias("email_delta"))


def delta_table(df: DataFrame, key: list[str]) -> DataFrame:
    """One row per change.  Rows that know the ``origins`` of their fields also
    tell whether a field was mapped, from which header and how surely."""
    if "origins" not in df.columns:
        return explode_rows(df.select(*key, "deltas"), "deltas", "d").select(*key, "d.*")
    rows = explode_rows(df.select(*key, "deltas", "origins"), "deltas", "d")
    origin = F.try_element_at(F.filter("origins", lambda o: o["field"] == F.col("d.field")), F.lit(1))
    told = rows.withColumn("_origin", origin)
    return told.select(
        *key, "d.*", F.col("_origin").isNotNull().alias("mapped"),
        F.col("_origin.source").alias("source_header"), F.col("_origin.confidence").alias("mapping_confidence"),
    )


def normalized_flag(df: DataFrame, data: str = "data") -> DataFrame:
    """Add ``normalized`` and ``normalization_error``: a row without readable data
    is kept with its error and holds up no other."""
    reason = F.when(F.col(data).isNull(), "no data").when(F.size(data) == 0, "empty data")
    return df.withColumns({"normalized": reason.isNull(), "normalization_error": reason})


def normalization_outcome(df: DataFrame, job: list[str]) -> DataFrame:
    """Rows of each job that could be normalized, and those that could not."""
    counts = df.groupBy(*job).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if("normalized").alias("successful_normalizations"),
        F.count_if(~F.col("normalized")).alias("failed_normalizations"),
    )
    note = F.format_string("Data normalization completed: %s/%s rows normalized", F.col("successful_normalizations").cast("string"), F.col("total_rows").cast("string"))
    return counts.withColumn("note", note)


def normalization_statistics(df: DataFrame, job: list[str]) -> DataFrame:
    """Rows, changed rows and failed fields per job."""
    failed = F.size(F.filter("deltas", lambda d: ~d["validation_passed"]))
    return df.groupBy(*job).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.size("deltas") > 0).alias("changed_rows"),
        F.sum(failed).alias("failed_fields"),
    )
