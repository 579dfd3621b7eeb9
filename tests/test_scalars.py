"""Vectors for the scalar functions."""

import datetime
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rosterloom.functions import classify, contact, dates, identifiers, rewards
from rosterloom.functions import text as T
from rosterloom.operators.responses import extract_json, parse_model_rows


def test_luhn_plain_and_prefixed(value_of):
    numbers = ["1234567893", "1234567897", "9876543210", "0000000000", "8084012345", "12345", "123456789a", None]
    assert value_of(identifiers.npi_luhn, numbers)[:7] == [False, True, False, True, False, False, False]
    assert value_of(lambda c: identifiers.npi_luhn(c, "80840"), numbers)[:4] == [True, False, False, False]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.from_regex(r"\A[0-9]{10}\Z"), min_size=50, max_size=50), st.sampled_from(["", "80840", "7", "1234"]))
def test_luhn_against_digit_sum(spark, numbers, prefix):
    def expected(number):
        total = 0
        for i, d in enumerate(reversed(prefix + number)):
            d = int(d) * (1 + i % 2)
            total += d // 10 + d % 10
        return total % 10 == 0

    df = spark.createDataFrame([(n,) for n in numbers], "v string")
    for row in df.select("v", identifiers.npi_luhn(F.col("v"), prefix).alias("ok")).collect():
        assert row.ok == expected(row.v)


def test_npi_digits(value_of):
    texts = ["123-456-7893", "123 456 7893", "(123) 456-7893", "abc123def", ""]
    assert value_of(identifiers.digits_only, texts) == ["1234567893"] * 3 + ["123", ""]


def test_phones(value_of):
    good = ["555-123-4567", "555.123.4567", "5551234567", "+1 555 223 4567", "1-555-223-4567", "(555) 223-4567"]
    assert value_of(contact.national_phone, good)[3:] == ["(555) 223-4567"] * 3
    # The exchange of a real number does not start with 0 or 1.
    assert value_of(contact.national_phone, good)[:3] == [None] * 3
    assert value_of(contact.normalize_phone, ["invalid", "+44 20 7946 0958", "555-223-4567 x12"]) == [
        "invalid", "+44 20 7946 0958", "(555) 223-4567 ext. 12",
    ]
    assert value_of(lambda c: contact.e164(contact.national_phone(c)), ["555-223-4567", "nope"]) == ["+15552234567", None]


def test_dates(value_of):
    same = ["1/15/2023", "01-15-2023", "2023-01-15", "January 15, 2023", "Jan 15, 2023", "15 Jan 2023", "2023/01/15", " Jan. 15 2023 "]
    assert value_of(dates.normalize_date, same) == ["01/15/2023"] * len(same)
    kept = ["invalid", "13/01/2023", "02/30/2024", "02/29/2023", "1/2/23", ""]
    assert value_of(dates.normalize_date, kept) == kept
    assert value_of(dates.parse_date, ["02/29/2024", None]) == [datetime.date(2024, 2, 29), None]
    assert value_of(dates.is_day_first_date, ["31/12/2024", "12/31/2024", "31/02/2024", "x"]) == [True, False, False, False]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="abZ '-.9\tçÉ(", max_size=12), min_size=40, max_size=40))
def test_title_case_against_python(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    for row in df.select("v", T.title_case(F.col("v")).alias("t")).collect():
        assert row.t == row.v.title()


def test_strip_takes_all_white_space(value_of):
    assert value_of(T.strip, ["  a b　\n", "\t\x1c", "x"]) == ["a b", "", "x"]


def test_addresses(value_of):
    texts = ["123 N Main St, Suite 4, Springfield, IL 62701", "12 Oak Hill Avenue", "TBD", "Main Street"]
    assert value_of(contact.normalize_address, texts) == ["123, N Main St, Suite 4", "12, Oak Hill Avenue", None, None]
    assert value_of(lambda c: contact.normalize_address(c, True), texts[:1]) == ["123, N Main St, Suite 4, Springfield, IL 62701"]
    assert value_of(contact.low_confidence_address, ["1 A, B", "123 Main St, Town", "Main Street, Town", "123 TBD, Town x"]) == [True, False, True, True]


def test_split_line(value_of):
    lines = ["a\tb  c", "a  b | c", "a | b|c", "a|b", "a,b,", " plain text "]
    assert value_of(T.split_line, lines) == [["a", "b  c"], ["a", "b | c"], ["a", "b|c"], ["a", "b"], ["a", "b", ""], ["plain text"]]


def test_masking_is_chained(value_of):
    text = "NPI 1234567893 call (555) 123-4567 or a.b@x.org"
    assert value_of(T.mask_pii, [text]) == ["NPI NPI_**** call PHONE_**** or ***@x.org"]
    assert value_of(lambda c: T.mask_pii(c, npi=False, phone=False), [text]) == ["NPI 1234567893 call (555) 123-4567 or ***@x.org"]


def test_attachment_kinds(value_of):
    names = ["R.XLSX", "a.csv", "b.pdf", "c.htm", "d.txt", "e.zip", "noending"]
    kinds = value_of(lambda c: classify.attachment_type(c, F.lit("application/octet-stream"))["document_type"], names)
    assert kinds == ["XLSX", "CSV", "PDF_UNKNOWN", "HTML_TABLE", "PLAIN_TEXT", "UNKNOWN", "UNKNOWN"]
    assert value_of(lambda c: classify.attachment_type(F.lit("x"), c)["document_type"], ["text/csv", "TEXT/plain"]) == ["CSV", "PLAIN_TEXT"]


def test_transaction_words(value_of):
    texts = ["Welcome aboard", "please change it", "he will retire", "nothing"]
    assert value_of(classify.transaction_type, texts) == ["Add", "Update", "Term", "Update"]


def test_model_responses(value_of):
    answers = ['```json\n[{"a": "1"}, {"b": 2}]\n```', '{"a": null}', "no json", "[]", '[{"a": "x"}, 3]']
    rows = value_of(parse_model_rows, answers)
    assert rows[0] == [{"a": "1"}, {"b": "2"}] and rows[1] == [{"a": None}] and rows[2] == [] and rows[3] == []
    assert value_of(extract_json, ['x {"a": "b"} y', "{bad", "{bad}", "none"]) == [{"a": "b"}, None, None, None]


@pytest.mark.parametrize(
    "check,field,cases",
    [
        (rewards.name_check, "Provider Name", {"Ann Lee": 1.0, "Dr. Ann": 0.5, "Ann, MD": 0.5, "Information not found": 0.5}),
        (rewards.phone_number_check, "Phone Number", {"555-123-4567": 1.0, "5551234567": 0.0, "Information not found": 1.0}),
        (rewards.npi_format_check, "Provider NPI", {"123-456-7890": 1.0, "12": 0.0}),
        (rewards.line_of_business_check, "Line Of Business", {"Medicare, Commercial": 1.0, "HMO": 0.0, "": 0.0}),
        (rewards.date_check, "Term Date", {"31/12/2024": 1.0, "12/31/2024": 0.0}),
    ],
)
def test_rewards(value_of, check, field, cases):
    scores = value_of(lambda c: check(F.create_map(F.lit(field), c)), list(cases))
    assert scores == list(cases.values())


def test_patterns_compile():
    from rosterloom.schema import NARRATIVE_PATTERNS

    assert all(re.compile(p) for p in NARRATIVE_PATTERNS.values())


def test_no_pattern_overflows_on_a_long_text(spark):
    from rosterloom.operators.narrative import pattern_fields, possessive
    from rosterloom.schema import NARRATIVE_PATTERNS

    rows = [("Address: 1 Main St" + ", x" * 100_000,), ("Location: a, b\nc",), ("a" * 100_000,), (", " * 100_000,)]
    df = spark.createDataFrame(rows, "t string")
    found = df.select(*[v.alias(f"f{i}") for i, v in enumerate(pattern_fields(df["t"]).values())]).collect()
    at = list(NARRATIVE_PATTERNS).index("Complete Address")
    assert [r[at] for r in found] == ["1 Main St" + ", x" * 100_000, "a, b", None, None]
    assert possessive("a(b)*c") == "a(b)*c"
