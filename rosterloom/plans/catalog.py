"""All queries: name, builder, check SQL (None where SQL cannot say it)."""

from __future__ import annotations

from rosterloom.plans import queries_extract, queries_flow, queries_jobs, queries_normalize, queries_stream

CATALOG = [*queries_normalize.QUERIES, *queries_extract.QUERIES, *queries_jobs.QUERIES, *queries_stream.QUERIES, *queries_flow.QUERIES]

_names = [name for name, _, _ in CATALOG]
assert len(_names) == len(set(_names)), "query names must be unique"
