"""Scores of a model completion against the expected shape of each field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterloom.functions.dates import is_day_first_date
from rosterloom.functions.identifiers import digits_only
from rosterloom.functions.text import strip
from rosterloom.schema import SENTINEL

# --- fixed value: lines of business a completion may name ---
LINES_OF_BUSINESS = ["Medicare", "Medicaid", "Commercial"]
# --- end of fixed value ---


def _field(data: Column, name: str) -> Column:
    return strip(F.try_element_at(data, F.lit(name)))


def _graded(value: Column, absent: float, good: Column, yes: float, no: float) -> Column:
    """0 for a missing field, ``absent`` for the sentinel, else yes or no."""
    return (
        F.when(value.isNull(), 0.0).when(value == SENTINEL, absent).when(good, yes).otherwise(no)
    )


def json_format_reward(data: Column) -> Column:
    return F.when(data.isNotNull(), 1.0).otherwise(-1.0)


def name_check(data: Column) -> Column:
    value = _field(data, "Provider Name")
    low = F.lower(value)
    titled = (
        F.contains(low, F.lit("dr."))
        | F.contains(low, F.lit(", md"))
        | F.contains(low, F.lit(" m.d."))
        | F.endswith(low, F.lit(" md"))
    )
    return _graded(value, 0.5, ~titled, 1.0, 0.5)


def date_check(data: Column) -> Column:
    score = lambda name: _graded(_field(data, name), 1.0, is_day_first_date(_field(data, name)), 1.0, 0.0)
    return score("Effective Date") + score("Term Date")


def line_of_business_check(data: Column) -> Column:
    value = _field(data, "Line Of Business")
    parts = F.filter(F.transform(F.split(value, ","), strip), lambda p: p != "")
    allowed = F.array(*[F.lit(x) for x in LINES_OF_BUSINESS])
    good = (F.size(parts) > 0) & (F.size(F.array_except(parts, allowed)) == 0)
    return _graded(value, 1.0, good, 1.0, 0.0)


def phone_number_check(data: Column) -> Column:
    value = _field(data, "Phone Number")
    return _graded(value, 1.0, value.rlike(r"^[0-9]{3}-[0-9]{3}-[0-9]{4}$"), 1.0, 0.0)


def npi_format_check(data: Column) -> Column:
    value = _field(data, "Provider NPI")
    return _graded(value, 1.0, F.length(digits_only(value)) == 10, 1.0, 0.0)


def full_check(data: Column, answer: Column) -> Column:
    """0.4 for each equal field of the answer, -0.5 for each missing one."""
    points = F.aggregate(
        F.map_entries(answer),
        F.lit(0.0),
        lambda total, e: total
        + F.when(F.coalesce(F.try_element_at(data, e["key"]), F.lit("")) == "", -0.5)
        .when(F.try_element_at(data, e["key"]) == e["value"], 0.4)
        .otherwise(0.0),
    )
    return F.when(data.isNull(), 0.0).otherwise(F.round(points, 6) + F.lit(0.0))
