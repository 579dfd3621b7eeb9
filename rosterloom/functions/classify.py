"""Document types of mail bodies and attachments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterloom.functions.text import contains_any, strip


def _present(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def tabular_line_count(text: Column) -> Column:
    """Lines with a run of blanks, a tab or a bar inside."""
    return F.size(F.filter(F.split(text, "\n"), lambda line: strip(line).rlike(r"\s{2,}|\t|\|")))


def table_count(html: Column) -> Column:
    return F.size(F.regexp_extract_all(F.lower(html), F.lit("(<table)"), F.lit(1)))


def table_headers(html: Column) -> Column:
    found = F.regexp_extract_all(html, F.lit(r"(?is)<th[^>]*>(.*?)</th>"), F.lit(1))
    return F.transform(found, lambda h: strip(F.regexp_replace(h, r"<[^>]+>", "")))


def body_type(text: Column, html: Column) -> Column:
    """Classification struct of one mail body."""
    is_table = _present(html) & F.contains(F.lower(html), F.lit("<table"))
    tabular = F.coalesce(tabular_line_count(text), F.lit(0))
    return F.struct(
        F.when(is_table, F.lit("HTML_TABLE")).otherwise(F.lit("PLAIN_TEXT")).alias("document_type"),
        F.when(is_table, F.lit(0.9))
        .when(_present(text) & (tabular > 2), F.lit(0.7))
        .otherwise(F.lit(0.5))
        .alias("confidence"),
        F.lit("rule_based").alias("extraction_method"),
        F.when(is_table, html).when(_present(text), text).otherwise(html).alias("content"),
        F.struct(
            _present(html).alias("has_html"),
            _present(text).alias("has_text"),
            F.when(is_table, table_count(html)).alias("table_count"),
            F.when(is_table, table_headers(html)).alias("headers_found"),
            F.when(~is_table & _present(text), tabular).alias("tabular_lines"),
            F.when(~is_table & _present(text), F.size(F.split(text, "\n"))).alias("total_lines"),
        ).alias("metadata"),
    )


# --- fixed values: kind, file endings, MIME part, confidence; order matters ---
ATTACHMENT_KINDS = [
    ("XLSX", [".xlsx", ".xls"], "spreadsheet", 0.95),
    ("CSV", [".csv"], "csv", 0.95),
    ("PDF_UNKNOWN", [".pdf"], "pdf", 0.9),
    ("HTML_TABLE", [".html", ".htm"], "html", 0.9),
    ("PLAIN_TEXT", [".txt", ".text"], "text/plain", 0.8),
]
# --- end of fixed values ------------------------------------------------------


def attachment_type(filename: Column, mime: Column) -> Column:
    """Classification struct of one attachment, by ending first and MIME type next."""
    name = F.lower(F.coalesce(filename, F.lit("")))
    content_type = F.lower(F.coalesce(mime, F.lit("")))
    kind = score = None
    for label, endings, part, confidence in ATTACHMENT_KINDS:
        hit = F.contains(content_type, F.lit(part))
        for ending in endings:
            hit = hit | F.endswith(name, F.lit(ending))
        kind = F.when(hit, label) if kind is None else kind.when(hit, label)
        score = F.when(hit, confidence) if score is None else score.when(hit, confidence)
    document_type = kind.otherwise("UNKNOWN")
    return F.struct(
        document_type.alias("document_type"),
        score.otherwise(0.3).alias("confidence"),
        F.when(document_type == "UNKNOWN", "vlm_assisted").otherwise("rule_based").alias("extraction_method"),
        F.when(document_type == "CSV", "csv")
        .when(document_type == "PDF_UNKNOWN", "pdf")
        .when(document_type == "PLAIN_TEXT", "txt")
        .otherwise(F.nullif(F.regexp_extract(name, r"\.([^.]*)$", 1), F.lit("")))
        .alias("file_extension"),
    )


def fallback_type(content: Column, headers: Column) -> Column:
    """Type by tags in the content or endings named among the headers."""
    lowered = F.transform(headers, F.lower)
    has = lambda *endings: F.arrays_overlap(lowered, F.array(*[F.lit(e) for e in endings]))
    return (
        F.when(
            contains_any(F.lower(content), ["<table>", "<tr>", "<td>"]),
            _typed("HTML_TABLE", 0.8, "HTML table detected"),
        )
        .when(has(".xlsx", ".xls"), _typed("XLSX", 0.8, "Excel file detected"))
        .when(has(".csv"), _typed("CSV", 0.8, "CSV file detected"))
        .when(has(".pdf"), _typed("PDF_UNKNOWN", 0.6, "PDF file detected"))
        .otherwise(_typed("PLAIN_TEXT", 0.5, "Plain text fallback"))
    )


def _typed(kind: str, confidence: float, reason: str) -> Column:
    return F.struct(
        F.lit(kind).alias("document_type"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reasoning")
    )


def strategy(document_types: Column, methods: Column) -> Column:
    """Processing strategy of one mail from its artifact arrays (no shuffle)."""
    assisted = F.exists(methods, lambda m: m == "vlm_assisted") | F.exists(
        document_types, lambda d: d == "PDF_UNKNOWN"
    )
    return processing_strategy(assisted, F.size(document_types))


def processing_strategy(assisted: Column, artifacts: Column) -> Column:
    empty = F.coalesce(artifacts, F.lit(0)) == 0
    needs = ~empty & F.coalesce(assisted, F.lit(False))
    return F.struct(
        F.when(needs, "vlm_assisted").otherwise("rule_based").alias("extraction_method"),
        needs.alias("requires_vlm"),
        F.when(empty, 0.0).when(needs, 0.7).otherwise(0.9).alias("confidence"),
        artifacts.alias("artifact_count"),
    )


def transaction_type(text: Column) -> Column:
    from rosterloom.schema import TRANSACTION_WORDS

    lowered = F.lower(text)
    kind = None
    for label, words in TRANSACTION_WORDS:
        hit = contains_any(lowered, words)
        kind = F.when(hit, label) if kind is None else kind.when(hit, label)
    return kind.otherwise("Update")


def canonical_transaction(tag: Column) -> Column:
    """Standard type of a tagged phrase."""
    lowered = F.lower(tag)
    return (
        F.when(contains_any(lowered, ["add", "new"]), "Add")
        .when(F.contains(lowered, F.lit("update")), "Update")
        .when(F.contains(lowered, F.lit("term")), "Term")
    )
