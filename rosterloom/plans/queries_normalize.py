"""Queries on field normalization and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterloom.functions import contact, dates, identifiers
from rosterloom.functions import text as T
from rosterloom.operators import analytics, normalize, responses, validate
from rosterloom.operators.skew import dense_index
from rosterloom.plans import twins as q
from rosterloom.plans.derive import relation, with_relations
from rosterloom.schema import FIELDS, column_name

AS_OF = "2025-01-01"
KEY = ["job_id", "row_idx"]
# Columns that keep their own rule; all others are trimmed and title-cased.
PLAIN = [
    column_name(f)
    for f in FIELDS
    if f not in ("Provider Name", "Provider NPI", "Phone Number", "Effective Date", "Term Date", "Complete Address")
]


def roster(spark, folder):
    return relation(spark, folder, "roster")


def normalized(spark, folder):
    return normalize.normalize(roster(spark, folder))


def validated(spark, folder):
    return validate.validate(normalized(spark, folder).drop("deltas"), AS_OF)


# --- check side of the normalized roster ---------------------------------------
def _kept(column: str, value: str) -> str:
    return (
        f"CASE WHEN coalesce({column}, '') = '' THEN '' WHEN {q.missing(column)} THEN {column} ELSE {value} END AS {column}"
    )


def _digits(e: str) -> str:
    return f"regexp_replace({e}, '[^0-9]', '', 'g')"


NORMAL_COLUMNS = [_kept(c, q.title(q.strip(c))) for c in [*PLAIN, "provider_name"]] + [
    _kept("provider_npi", _digits("provider_npi")),
    _kept("phone_number", f"coalesce({q.national_text('phone_number')}, phone_number)"),
    _kept("effective_date", q.us_date("effective_date")),
    _kept("term_date", q.us_date("term_date")),
    _kept("complete_address", f"coalesce({q.address('complete_address')}, complete_address)"),
]
NORMAL = with_relations("roster") + ", normal AS (SELECT job_id, row_idx, email, dob, " + ", ".join(NORMAL_COLUMNS) + " FROM roster_t) "
NORMAL = NORMAL.replace(") , normal", "), normal")


def _delta(field: str, changed: str, value: str, e164: str, change: str, passed: str, message: str) -> str:
    c = column_name(field)
    return (
        f"SELECT job_id, row_idx, {q.lit(field)} AS field, {c} AS original_value, {value} AS normalized_value, {e164} AS e164_value,"
        f" {change} AS change_type, {passed} AS validation_passed, {message} AS message FROM roster_t"
        f" WHERE NOT {q.missing(c)} AND ({changed})"
    )


def _date_delta(field: str) -> str:
    c = column_name(field)
    good = f"{q.date(q.strip(c))} IS NOT NULL"
    value = q.us_date(c)
    return _delta(
        field, f"NOT ({good}) OR {value} <> {c}", value, "NULL", f"CASE WHEN {good} THEN 'normalized' ELSE 'parsing_failed' END", good,
        f"CASE WHEN {good} THEN 'Date normalized to MM/DD/YYYY: ' || {value} ELSE 'Date parsing failed: ' || {c} END",
    )


def _deltas() -> str:
    phone, npi, addr, name = "phone_number", "provider_npi", "complete_address", "provider_name"
    ok = f"({q.national(phone)}) IS NOT NULL"
    shown = f"coalesce({q.national_text(phone)}, {phone})"
    enough = f"length({_digits(phone)}) >= 3"
    valid = q.luhn(_digits(npi))
    street = f"({q.address(addr)})"
    named = q.title(q.strip(name))
    return " UNION ALL ".join(
        [
            _date_delta("Effective Date"),
            _date_delta("Term Date"),
            _delta("Provider Name", f"{named} <> {name}", named, "NULL", "'normalized'", "true", f"'Name normalized to title case: ' || {named}"),
            _delta(
                "Provider NPI", f"{_digits(npi)} <> {npi} OR NOT {valid}", _digits(npi), "NULL", "'normalized'", valid,
                f"'NPI normalized to digits only, validation: ' || CASE WHEN {valid} THEN 'passed' ELSE 'failed' END",
            ),
            _delta(
                "Complete Address", "true", f"coalesce({street}, {addr})", "NULL",
                f"CASE WHEN {street} IS NULL THEN 'low_confidence' ELSE 'normalized' END", f"{street} IS NOT NULL",
                f"coalesce('Address standardized: ' || {street}, 'Address type not recognized: Ambiguous')",
            ),
            _delta(
                "Phone Number", f"NOT ({ok}) OR {shown} <> {phone}", shown, f"'+1' || ({q.national(phone)})",
                f"CASE WHEN {ok} THEN 'normalized' WHEN {enough} THEN 'validation_failed' ELSE 'parsing_failed' END", ok,
                f"CASE WHEN {ok} THEN 'Phone normalized to national format: ' || {shown}"
                f" WHEN {enough} THEN 'Invalid phone number format: ' || {phone} ELSE 'Phone parsing failed: ' || {phone} END",
            ),
        ]
    )


# --- check side of the issues --------------------------------------------------
def _issue(no: int, field: str, level: str, when: str, message: str) -> str:
    return (
        f"SELECT job_id, row_idx, {no} AS rule_no, {q.lit(field)} AS field, {q.lit(level)} AS level, {message} AS message"
        f" FROM marked WHERE {when}"
    )


def _issues() -> str:
    v = lambda c: q.strip(f"coalesce({c}, '')")
    npi, dob, eff, term = v("provider_npi"), v("dob"), v("effective_date"), v("term_date")
    ten = f"regexp_full_match({npi}, '[0-9]{{10}}')"
    given = f"NOT {q.missing('provider_npi')}"
    both = f"{eff} <> '' AND {term} <> ''"
    parts = [
        _issue(1, "Provider Name", "error", q.missing("provider_name"), "'Required field ''Provider Name'' is missing or empty'"),
        _issue(2, "Provider NPI", "error", f"{given} AND NOT {ten}", f"'Invalid NPI format: ' || {npi} || ' (must be 10 digits)'"),
        _issue(3, "Provider NPI", "warning", f"{given} AND {ten} AND NOT {q.luhn(npi)}", f"'NPI checksum validation failed: ' || {npi}"),
        _issue(4, "Provider NPI", "warning", f"{given} AND {q.luhn(npi)} AND earlier > 0", f"'Duplicate NPI found: ' || {npi}"),
        _issue(5, "DOB", "error", f"{dob} <> '' AND {q.date(dob)} IS NULL", f"'Invalid date format: ' || {dob}"),
        _issue(6, "DOB", "error", f"{q.date(dob)} > DATE '{AS_OF}'", f"'Date of birth cannot be in the future: ' || {dob}"),
        _issue(7, "DOB", "warning", f"{q.date(dob)} < DATE '{AS_OF}' - INTERVAL 120 YEAR", f"'Date of birth seems unusually old: ' || {dob}"),
        _issue(
            8, "Term Date", "error", f"{both} AND {q.date(eff)} > {q.date(term)}",
            f"'Term date (' || {term} || ') must be after or equal to effective date (' || {eff} || ')'",
        ),
        _issue(
            9, "Term Date", "warning", f"{both} AND ({q.date(eff)} IS NULL OR {q.date(term)} IS NULL)",
            f"'Could not validate date range: Unknown string format: ' || CASE WHEN {q.date(eff)} IS NULL THEN {eff} ELSE {term} END",
        ),
        _issue(10, "Email", "warning", f"{v('email')} <> '' AND NOT {q.is_email(v('email'))}", f"'Invalid email format: ' || {v('email')}"),
        _issue(11, "Phone Number", "warning", f"{v('phone_number')} <> '' AND NOT {q.is_phone(v('phone_number'))}", f"'Invalid phone format: ' || {v('phone_number')}"),
        _issue(
            12, "Complete Address", "warning", f"{v('complete_address')} <> '' AND {q.low_address(v('complete_address'))}",
            f"'Address may have low confidence: ' || {v('complete_address')}",
        ),
    ]
    return " UNION ALL ".join(parts)


ISSUES = (
    NORMAL
    + ", marked AS (SELECT *, row_number() OVER (PARTITION BY job_id, provider_npi ORDER BY row_idx) - 1 AS earlier FROM normal), "
    + f"found AS ({_issues()}) "
)


# --- queries ---------------------------------------------------------------------
def flag_npi(spark, folder):
    rows = roster(spark, folder).select("row_idx", identifiers.digits_only(F.col("provider_npi")).alias("digits"))
    digits = F.col("digits")
    return rows.select(
        "row_idx",
        "digits",
        identifiers.npi_luhn(digits).alias("luhn_plain"),
        identifiers.npi_luhn(digits, "80840").alias("luhn_prefixed"),
    )


def phones(spark, folder):
    phone = F.col("phone_number")
    return roster(spark, folder).select(
        "row_idx",
        contact.normalize_phone(phone).alias("phone"),
        contact.e164(contact.national_phone(phone)).alias("e164"),
        contact.is_phone(phone).alias("known_form"),
    )


def date_forms(spark, folder):
    return roster(spark, folder).select(
        "row_idx",
        dates.normalize_date(F.col("effective_date")).alias("effective_date"),
        dates.normalize_date(F.col("term_date")).alias("term_date"),
    )


def addresses(spark, folder):
    address = F.col("complete_address")
    return roster(spark, folder).select(
        "row_idx",
        F.coalesce(contact.normalize_address(address), address).alias("address"),
        contact.low_confidence_address(address).alias("low_confidence"),
    )


def emails(spark, folder):
    out = normalize.normalize_email_column(roster(spark, folder).select("row_idx", "email"))
    return out.select(
        "row_idx", "email", F.col("email_delta.change_type").alias("change_type"), F.col("email_delta.validation_passed").alias("passed")
    )


def names(spark, folder):
    return roster(spark, folder).select("row_idx", T.title_case(T.strip(F.col("provider_name"))).alias("provider_name"))


def normalized_rows(spark, folder):
    return normalized(spark, folder).drop("deltas", "email", "dob")


def normalization_deltas(spark, folder):
    return normalize.delta_table(normalized(spark, folder), KEY).drop("confidence")


def normalization_statistics(spark, folder):
    return normalize.normalization_statistics(normalized(spark, folder), ["job_id"])


def duplicate_npi(spark, folder):
    rows = normalize.normalize(roster(spark, folder), fields=["Provider NPI"]).select(*KEY, F.col("provider_npi"))
    flagged = validate.flag_duplicates(rows)
    return flagged.where("is_repeat").select(*KEY, "provider_npi")


def issue_rows(spark, folder):
    return validate.issue_table(validated(spark, folder), KEY).drop("issue_no")


def validation_statistics(spark, folder):
    return validate.validation_statistics(validated(spark, folder), ["job_id"])


def roster_quality(spark, folder):
    """Issues per field and level over the normalized, validated roster."""
    return analytics.issue_heat_map(validate.issue_table(validated(spark, folder), KEY))


def edit_issues(spark, folder):
    rows = roster(spark, folder).select(
        "row_idx", F.col("provider_npi").alias("npi"), "provider_name", F.col("provider_specialty").alias("specialty"), "effective_date"
    )
    return validate.issue_table(validate.apply_rules(rows, validate.edit_rules()), ["row_idx"]).drop("issue_no")


def legacy_type_issues(spark, folder):
    rows = roster(spark, folder).select("row_idx", F.col("provider_npi").alias("npi"), F.col("state_license").alias("zip"), "email")
    return validate.issue_table(validate.apply_rules(rows, validate.legacy_type_rules()), ["row_idx"]).drop("issue_no")


def issue_explanations(spark, folder):
    found = validate.issue_table(validated(spark, folder), KEY)
    return found.select(*KEY, validate.explain_issue(F.col("field"), F.col("level"), F.col("message")).alias("explanation"))


def review_rows(spark, folder):
    return validate.review_rows(validated(spark, folder)).select(*KEY, "issue_count", "row_class")


def field_coverage(spark, folder):
    return responses.field_coverage(normalized(spark, folder))


def dense_row_index(spark, folder):
    """Row numbers per job; order keys are spread over chunks of 4,096."""
    rows = roster(spark, folder).select("job_id", F.col("row_idx").alias("position"))
    return dense_index(rows, ["job_id"], [], "position", chunk_rows=4096)


QUERIES = [
    (
        "npi_checksums",
        flag_npi,
        with_relations("roster")
        + f"SELECT row_idx, {_digits('provider_npi')} AS digits, {q.luhn(_digits('provider_npi'))} AS luhn_plain,"
        f" {q.luhn(_digits('provider_npi'), '80840')} AS luhn_prefixed FROM roster_t",
    ),
    (
        "phone_formats",
        phones,
        with_relations("roster")
        + f"SELECT row_idx, coalesce({q.national_text('phone_number')}, phone_number) AS phone, '+1' || ({q.national('phone_number')}) AS e164,"
        f" {q.is_phone('phone_number')} AS known_form FROM roster_t",
    ),
    (
        "date_forms",
        date_forms,
        with_relations("roster")
        + f"SELECT row_idx, {q.us_date('effective_date')} AS effective_date, {q.us_date('term_date')} AS term_date FROM roster_t",
    ),
    (
        "address_parts",
        addresses,
        with_relations("roster")
        + f"SELECT row_idx, coalesce({q.address('complete_address')}, complete_address) AS address,"
        f" {q.low_address('complete_address')} AS low_confidence FROM roster_t",
    ),
    (
        "email_forms",
        emails,
        with_relations("roster")
        + f"SELECT row_idx, e AS email, CASE WHEN e <> email THEN 'normalized' WHEN NOT {q.is_email('e')} THEN 'validation_failed' END AS change_type,"
        f" CASE WHEN e <> email OR NOT {q.is_email('e')} THEN {q.is_email('e')} END AS passed"
        f" FROM (SELECT row_idx, email, lower({q.strip('email')}) AS e FROM roster_t)",
    ),
    (
        "name_titles",
        names,
        with_relations("roster") + f"SELECT row_idx, {q.title(q.strip('provider_name'))} AS provider_name FROM roster_t",
    ),
    ("normalized_rows", normalized_rows, NORMAL + "SELECT * EXCLUDE (email, dob) FROM normal"),
    ("normalization_deltas", normalization_deltas, with_relations("roster") + _deltas()),
    (
        "normalization_statistics",
        normalization_statistics,
        with_relations("roster")
        + f", found AS ({_deltas()}), per_row AS (SELECT job_id, row_idx, count(*) AS n, count(*) FILTER (NOT validation_passed) AS bad FROM found GROUP BY ALL)"
        " SELECT r.job_id, count(*) AS total_rows, count(p.n) AS changed_rows, CAST(coalesce(sum(p.bad), 0) AS BIGINT) AS failed_fields"
        " FROM roster_t r LEFT JOIN per_row p ON r.job_id = p.job_id AND r.row_idx = p.row_idx GROUP BY r.job_id",
    ),
    (
        "duplicate_npi",
        duplicate_npi,
        ISSUES + "SELECT job_id, row_idx, provider_npi FROM marked WHERE earlier > 0 AND " + q.luhn("provider_npi"),
    ),
    ("issue_rows", issue_rows, ISSUES + "SELECT job_id, row_idx, field, level, message FROM found"),
    (
        "validation_statistics",
        validation_statistics,
        ISSUES
        + ", per_row AS (SELECT n.job_id, n.row_idx, count(f.level) AS issues, count(*) FILTER (f.level = 'error') AS errors,"
        " count(*) FILTER (f.level = 'warning') AS warnings FROM normal n LEFT JOIN found f ON n.job_id = f.job_id AND n.row_idx = f.row_idx"
        " GROUP BY n.job_id, n.row_idx)"
        " SELECT job_id, count(*) AS total_rows, count(*) FILTER (errors = 0) AS valid_rows, count(*) FILTER (errors > 0) AS invalid_rows,"
        " CAST(sum(issues) AS BIGINT) AS total_issues, CAST(sum(errors) AS BIGINT) AS error_count, CAST(sum(warnings) AS BIGINT) AS warning_count,"
        " sum(errors) > 0 AS needs_review, CASE WHEN sum(errors) > 0 THEN 'needs_review' ELSE 'ready' END AS status FROM per_row GROUP BY job_id",
    ),
    ("roster_quality", roster_quality, ISSUES + "SELECT field, level, count(*) AS issues FROM found GROUP BY field, level"),
    (
        "edit_issues",
        edit_issues,
        with_relations("roster")
        + " UNION ALL ".join(
            f"SELECT row_idx, {q.lit(f)} AS field, 'error' AS level, 'Required field ''{f}'' is missing' AS message FROM roster_t WHERE {q.blank(c)}"
            for f, c in [("NPI", "provider_npi"), ("Provider Name", "provider_name"), ("Specialty", "provider_specialty"), ("Effective Date", "effective_date")]
        )
        + f" UNION ALL SELECT row_idx, 'NPI', 'error', 'Invalid NPI format: ' || {q.strip('provider_npi')} FROM roster_t"
        f" WHERE NOT {q.blank('provider_npi')} AND NOT regexp_full_match({q.strip('provider_npi')}, '[0-9]{{10}}')",
    ),
    (
        "legacy_type_issues",
        legacy_type_issues,
        with_relations("roster")
        + f"SELECT row_idx, 'NPI' AS field, 'error' AS level, 'NPI must be 10 digits' AS message FROM roster_t"
        f" WHERE NOT {q.blank('provider_npi')} AND NOT regexp_full_match({q.strip('provider_npi')}, '[0-9]{{10}}')"
        f" UNION ALL SELECT row_idx, 'ZIP', 'error', 'ZIP must be numeric' FROM roster_t WHERE NOT {q.blank('state_license')} AND NOT regexp_full_match({q.strip('state_license')}, '[0-9]+')"
        f" UNION ALL SELECT row_idx, 'Email', 'error', 'Email must contain @' FROM roster_t WHERE NOT {q.blank('email')} AND NOT contains(email, '@')",
    ),
    (
        "issue_explanations",
        issue_explanations,
        ISSUES
        + "SELECT job_id, row_idx, CASE WHEN level = 'error' THEN 'There''s a problem with the ' || field || ' field: ' || message"
        " ELSE 'Warning for ' || field || ': ' || message END AS explanation FROM found",
    ),
    (
        "review_rows",
        review_rows,
        ISSUES
        + "SELECT n.job_id, n.row_idx, count(f.level) AS issue_count, CASE WHEN count(*) FILTER (f.level = 'error') > 0 THEN 'error'"
        " WHEN count(f.level) > 0 THEN 'warning' ELSE 'clean' END AS row_class"
        " FROM normal n LEFT JOIN found f ON n.job_id = f.job_id AND n.row_idx = f.row_idx GROUP BY n.job_id, n.row_idx",
    ),
    (
        "field_coverage",
        field_coverage,
        NORMAL
        + " UNION ALL ".join(
            f"SELECT {q.lit(f)} AS field, count(*) FILTER (NOT {q.missing(column_name(f))}) AS filled,"
            f" round(count(*) FILTER (NOT {q.missing(column_name(f))}) / count(*), 4) AS coverage FROM normal"
            for f in FIELDS
        ),
    ),
    (
        "dense_row_index",
        dense_row_index,
        with_relations("roster")
        + "SELECT job_id, row_idx AS position, row_number() OVER (PARTITION BY job_id ORDER BY row_idx) - 1 AS row_idx FROM roster_t",
    ),
]
