"""Header to field mapping and application of a mapping to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions.text import strip
from rosterloom.operators.responses import mapping_entries
from rosterloom.operators.skew import salted_lookup
from rosterloom.schema import ALIASES, FIELDS, column_name


def _target_array(targets: list[str] | None) -> Column:
    """Literal array of the fields, in lower case too."""
    names = targets or FIELDS
    return F.array(*[F.struct(F.lit(t).alias("name"), F.lit(t.lower()).alias("low"), F.lit(len(t)).alias("size")) for t in names])


def suggest_header(header: Column, targets: list[str] | None = None, floor: float = 0.3) -> Column:
    """``struct<target, confidence>`` of the most similar field: one text contains
    the other, and the shorter is as long as possible beside the longer.  The
    earlier field wins a tie; NULL at or below the floor."""
    low = F.lower(header)
    size = F.length(header)
    close = F.filter(_target_array(targets), lambda t: F.contains(t["low"], low) | F.contains(low, t["low"]))
    scored = F.transform(
        close,
        lambda t, i: F.struct(
            (F.least(t["size"], size) / F.greatest(t["size"], size)).alias("confidence"), (-i).alias("neg"), t["name"].alias("target")
        ),
    )
    best = F.array_max(F.filter(scored, lambda s: s["confidence"] > floor))
    return F.when(best.isNotNull(), F.struct(best["target"].alias("target"), best["confidence"].alias("confidence")))


def suggest_mapping(df: DataFrame, headers: str = "headers") -> DataFrame:
    """Adds ``mappings``: one entry per header that has a similar field."""
    scored = F.transform(headers, lambda h: F.struct(h.alias("source"), suggest_header(h).alias("best")))
    entries = F.transform(
        F.filter(scored, lambda e: e["best"].isNotNull()),
        lambda e: F.struct(
            e["source"].alias("source"), e["best"]["target"].alias("target"), e["best"]["confidence"].alias("confidence")
        ),
    )
    return df.withColumn("mappings", entries)


def substring_mapping(headers: Column, targets: list[str] | None = None) -> Column:
    """Every pair of header and field where one contains the other, at 0.8."""
    names = F.array(*[F.lit(t) for t in (targets or FIELDS)])
    pairs = F.flatten(
        F.transform(
            headers,
            lambda h: F.transform(
                F.filter(names, lambda t: F.contains(F.lower(t), F.lower(h)) | F.contains(F.lower(h), F.lower(t))),
                lambda t: F.struct(h.alias("source"), t.alias("target"), F.lit(0.8).alias("confidence")),
            ),
        )
    )
    return pairs


def alias_value(data: Column, field: str) -> Column:
    """Value under the field's own name, else under one of its older names."""
    names = [field, *ALIASES.get(field, [])]
    return strip(F.coalesce(*[F.try_element_at(data, F.lit(n)) for n in names]))


def _mapped_entry(data: Column, mappings: Column, field: str) -> Column:
    """The last of the headers mapped to a field that has a value, with the value
    and the mapping's confidence; ``mappings`` is a map from field to entries."""
    entries = F.transform(
        F.coalesce(F.try_element_at(mappings, F.lit(field)), F.array().cast("array<struct<source:string,confidence:double>>")),
        lambda m: F.struct(m["source"].alias("source"), m["confidence"].alias("confidence"), strip(F.try_element_at(data, m["source"])).alias("value")),
    )
    return F.try_element_at(F.filter(entries, lambda m: m["value"].isNotNull() & (m["value"] != "")), F.lit(-1))


def typed_rows(df: DataFrame, data: str = "data", mappings: str | None = None) -> DataFrame:
    """Row maps to the 17 typed columns.

    Mapped headers come first, a later one for the same field overwriting an
    earlier one; older names fill only fields still empty.  With ``mappings``, the
    column ``origins`` tells header and confidence of the mapped fields.
    """
    kept = [c for c in df.columns if c not in (data, mappings, "origins")]
    aliased = {field: alias_value(F.col(data), field) for field in FIELDS}
    if not mappings:
        return df.select(*kept, *[F.coalesce(aliased[f], F.lit("")).alias(column_name(f)) for f in FIELDS])
    # Each entry is worked out once, in a projection of its own.
    entries = df.select("*", *[_mapped_entry(F.col(data), F.col(mappings), f).alias(f"_from_{column_name(f)}") for f in FIELDS])
    columns, origins = [], []
    for field in FIELDS:
        entry = F.col(f"_from_{column_name(field)}")
        columns.append(F.coalesce(entry["value"], aliased[field], F.lit("")).alias(column_name(field)))
        origin = F.struct(F.lit(field).alias("field"), entry["source"].alias("source"), entry["confidence"].alias("confidence"))
        origins.append(F.when(entry.isNotNull(), origin))
    return entries.select(*kept, *columns, F.array_compact(F.array(*origins)).alias("origins"))


def apply_mapping(rows: DataFrame, mappings: DataFrame, job: list[str], spread: list[str]) -> DataFrame:
    """Rows joined to the one mapping of their job, then typed."""
    joined = salted_lookup(rows, mappings.select(*job, headers_by_field("mappings").alias("mappings")), job, spread)
    return typed_rows(joined, mappings="mappings")


def headers_by_field(mappings: str) -> Column:
    """Mapping entries turned into a map from field to its headers with their
    confidence, once per job."""

    def entry(field: str) -> Column:
        mine = F.filter(mappings, lambda m: m["target"] == field)
        return F.struct(F.lit(field), F.transform(mine, lambda m: F.struct(m["source"].alias("source"), m["confidence"].cast("double").alias("confidence"))))

    return F.map_from_entries(F.array(*[entry(f) for f in FIELDS]))


def answered_mapping(response: Column, headers: Column, targets: list[str] | None = None) -> Column:
    """Mapping entries of a model's answer: those of its JSON object, none if that
    does not parse, and every pair that contains one another if there is none."""
    return F.coalesce(mapping_entries(response), substring_mapping(headers, targets))


def row_mappings(rows: DataFrame, unit: list[str], data: str = "data") -> DataFrame:
    """One mapping per unit (an artifact of a job) from the headers of its rows.
    Distinct headers are gathered, not rows."""
    headers = rows.select(*unit, F.explode(F.map_keys(data)).alias("header")).distinct()
    gathered = headers.groupBy(*unit).agg(F.sort_array(F.collect_list("header")).alias("headers"))
    return suggest_mapping(gathered).drop("headers")
