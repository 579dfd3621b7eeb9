"""Roster-shaped relations derived from the given tables.

The tables hold no rosters, so each relation is a projection of one table,
written in expressions that mean the same in Spark SQL and in standard SQL.
No relation aggregates or limits: its size is that of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Rows of a derived mail or roster row that one task works through.
TASK_ROWS = 50_000


def read(spark: SparkSession, folder: str, table: str, task_rows: int | None = None) -> DataFrame:
    """A table, spread over all cores if its files give too few tasks.

    A table of one small file is one task, which leaves a cluster idle while that
    task works through every pattern.  A table with enough splits is read as it
    is, without a shuffle; where much work hangs on a row, ``task_rows`` bounds the
    rows of a task, since a split of narrow rows may hold millions of them."""
    df = spark.read.parquet(f"{folder}/{table}.parquet")
    parts = spark.sparkContext.defaultParallelism
    if task_rows:
        parts *= max(1, -(-df.count() // (task_rows * parts)))  # whole rounds of tasks
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


K = "o_orderkey"
_TEXT = f"CAST({K} AS STRING)"
_Q = "chr(39)"

_NPI_BASE = (
    f"CASE {K} % 8 WHEN 0 THEN '1234567893' WHEN 1 THEN '1234567897' WHEN 2 THEN '9876543217'"
    f" WHEN 3 THEN '9876543210' WHEN 4 THEN '0000000000' WHEN 5 THEN '12345' WHEN 6 THEN ''"
    f" ELSE concat('1', lpad({_TEXT}, 9, '0')) END"
)
_NPI = (
    f"CASE {K} % 3 WHEN 0 THEN {_NPI_BASE}"
    f" WHEN 1 THEN concat(substr({_NPI_BASE}, 1, 3), '-', substr({_NPI_BASE}, 4, 3), '-', substr({_NPI_BASE}, 7))"
    f" ELSE concat('NPI: ', {_NPI_BASE}) END"
)
_TEN = f"CAST(2005550000 + {K} % 4000000 AS STRING)"
_AREA, _MID, _LAST = f"substr({_TEN}, 1, 3)", f"substr({_TEN}, 4, 3)", f"substr({_TEN}, 7, 4)"
_PHONE = (
    f"CASE {K} % 8 WHEN 0 THEN concat('(', {_AREA}, ') ', {_MID}, '-', {_LAST})"
    f" WHEN 1 THEN concat({_AREA}, '-', {_MID}, '-', {_LAST})"
    f" WHEN 2 THEN concat({_AREA}, '.', {_MID}, '.', {_LAST})"
    f" WHEN 3 THEN {_TEN}"
    f" WHEN 4 THEN concat('1-', {_AREA}, '-', {_MID}, '-', {_LAST})"
    f" WHEN 5 THEN 'invalid' WHEN 6 THEN '+44 20 7946 0958' ELSE '' END"
)
_Y, _M, _D = "year(o_orderdate)", "month(o_orderdate)", "day(o_orderdate)"


def _styled(style: str, year: str) -> str:
    s = lambda e: f"CAST({e} AS STRING)"
    return (
        f"CASE ({style}) % 7 WHEN 0 THEN concat({s(_M)}, '/', {s(_D)}, '/', {s(year)})"
        f" WHEN 1 THEN concat(lpad({s(_M)}, 2, '0'), '-', lpad({s(_D)}, 2, '0'), '-', {s(year)})"
        f" WHEN 2 THEN concat({s(year)}, '-', lpad({s(_M)}, 2, '0'), '-', lpad({s(_D)}, 2, '0'))"
        f" WHEN 3 THEN concat({s(year)}, '/', lpad({s(_M)}, 2, '0'), '/', lpad({s(_D)}, 2, '0'))"
        f" WHEN 4 THEN concat(CASE {_M} WHEN 1 THEN 'January' WHEN 2 THEN 'Feb' WHEN 3 THEN 'March' WHEN 4 THEN 'Apr'"
        f" WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'Jul' WHEN 8 THEN 'August' WHEN 9 THEN 'Sep'"
        f" WHEN 10 THEN 'October' WHEN 11 THEN 'Nov' ELSE 'December' END, ' ', {s(_D)}, ', ', {s(year)})"
        f" WHEN 5 THEN 'soon' ELSE concat('13/', {s(_D)}, '/', {s(year)}) END"
    )


ROSTER = {
    "job_id": "o_custkey",
    "row_idx": K,
    "transaction_type": f"CASE {K} % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'UPDATE' WHEN 2 THEN 'Information not found' ELSE 'term' END",
    "transaction_attribute": "lower(o_orderpriority)",
    "effective_date": _styled(K, _Y),
    "term_date": f"CASE WHEN {K} % 11 = 0 THEN '' ELSE {_styled(f'{K} + 2', f'{_Y} + {K} % 3 - 1')} END",
    "term_reason": f"CASE {K} % 3 WHEN 0 THEN 'retired' WHEN 1 THEN 'contract ended' ELSE '' END",
    "provider_name": f"CASE {K} % 7 WHEN 0 THEN '' WHEN 1 THEN 'Information not found'"
    f" ELSE concat(' dr. o', {_Q}, 'neil-', lower(o_orderpriority), ' ', {_TEXT}, 'x ') END",
    "provider_npi": _NPI,
    "provider_specialty": f"CASE {K} % 3 WHEN 0 THEN 'internal medicine' WHEN 1 THEN 'CARDIOLOGY' ELSE '' END",
    "state_license": f"concat('a', {_TEXT})",
    "organization_name": f"CASE WHEN {K} % 5 = 0 THEN 'Information not found' ELSE concat('group ', CAST(o_custkey AS STRING)) END",
    "tin": f"concat('82-', lpad({_TEXT}, 7, '0'))",
    "group_npi": "''",
    "complete_address": f"CASE {K} % 5 WHEN 0 THEN concat({_TEXT}, ' N Main St, Suite ', CAST({K} % 90 AS STRING), ', Springfield, IL 62701')"
    f" WHEN 1 THEN concat({_TEXT}, ' Oak Hill Avenue Apt 4B') WHEN 2 THEN 'TBD' WHEN 3 THEN 'Main Street, Springfield'"
    f" ELSE 'Information not found' END",
    "phone_number": _PHONE,
    "fax_number": "''",
    "ppg_id": f"concat('p', CAST({K} % 90 AS STRING))",
    "line_of_business": f"CASE {K} % 4 WHEN 0 THEN 'Medicare' WHEN 1 THEN 'Medicare, Commercial' WHEN 2 THEN 'HMO' ELSE '' END",
    "email": f"CASE {K} % 3 WHEN 0 THEN concat('user', {_TEXT}, '@example.com') WHEN 1 THEN concat(' User.', {_TEXT}, '@EXAMPLE.com ')"
    f" ELSE concat('user', {_TEXT}, ' at example') END",
    "dob": f"CASE {K} % 6 WHEN 0 THEN '' WHEN 1 THEN '1/15/1890' WHEN 2 THEN '2040-01-01' WHEN 3 THEN 'unknown'"
    f" ELSE concat('0', CAST({K} % 9 + 1 AS STRING), '/11/1980') END",
}

_ROWS = [
    ("concat('Ann ', {t}, ' Lee')", "lpad({t}, 10, '1')", "'Cardiology'", "concat('8/', CAST({k} % 28 + 1 AS STRING), '/2025')"),
    ("concat('Bob ', {t}, ' Ray')", "'n/k'", "'Pediatrics'", "''"),
]


def _html_row(tag: str, cells: list[str]) -> str:
    inside = ", ".join(f"'<{tag}>', {c}, '</{tag}>'" for c in cells)
    return f"'<tr>', {inside}, '</tr>'"


def _roster_table() -> str:
    heads = [
        "CASE {k} % 3 WHEN 0 THEN 'Provider Name:' WHEN 1 THEN 'Physician' ELSE 'Column A' END",
        "CASE {k} % 3 WHEN 0 THEN 'NPI#:' WHEN 1 THEN 'National Provider' ELSE 'Column B' END",
        "CASE {k} % 3 WHEN 0 THEN 'Specialty:' WHEN 1 THEN 'Specialization' ELSE 'Column C' END",
        "CASE {k} % 3 WHEN 0 THEN 'Term Date:' WHEN 1 THEN 'End Date' ELSE 'Column D' END",
    ]
    fill = lambda e: e.replace("{k}", K).replace("{t}", _TEXT)
    tag = f"CASE WHEN {K} % 2 = 0 THEN 'th' ELSE 'td' END"
    head = ", ".join(f"'<', {tag}, '>', {fill(h)}, '</', {tag}, '>'" for h in heads)
    body = ", ".join(_html_row("td", [fill(c) for c in row]) for row in _ROWS)
    return f"'<TABLE border=1><tr>', {head}, '</tr>\n', {body}, '</TABLE>'"


MAIL = {
    "mail_id": K,
    "html": "concat('<html><style>td {x}</style><body><p>Hi &amp; bye</p><table><tr><td>note</td></tr></table>', "
    + _roster_table()
    + f", CASE WHEN {K} % 4 = 0 THEN '<table><tr><td> a<br>b </td><td>&lt;c&gt;</td></tr></table>' ELSE '' END, '</body></html>')",
    "text": f"CASE {K} % 4 WHEN 0 THEN concat('Roster ', {_TEXT}, '\nName | NPI | Phone\nAnn Lee | ', lpad({_TEXT}, 10, '1'), ' | 555-123-4567\n\nshort\nBob Ray | 2 | 3 | 4')"
    f" WHEN 1 THEN concat('Name\tNPI\tNPI\nAnn\t', {_TEXT}, '\tx\nBob\t7\t \n')"
    f" WHEN 2 THEN concat('Hello,\nEffective 09/', CAST({K} % 28 + 1 AS STRING), '/2025, Paul Stone, MD will move. NPI: ', lpad({_TEXT}, 10, '1'),"
    f" '\nPhone: 555-123-4567\nTIN: 82-1111113\nLicense: A', {_TEXT}, '\nReason: retired.')"
    f" ELSE concat('Please Terminate the provider in Internal Medicine\nMedicare Advantage PPG P', lpad(CAST({K} % 90 AS STRING), 2, '0'), ', call 555.123.4567 or 555.765.', lpad(CAST({K} % 9000 AS STRING), 4, '0'), ' A', lpad({_TEXT}, 6, '0')) END",
}

ATTACHMENT = {
    "mail_id": "p_partkey - p_partkey % 4",
    "attachment_id": "p_partkey",
    "filename": "concat(p_name, ' ', p_brand, CASE p_size % 9 WHEN 0 THEN '.XLSX' WHEN 1 THEN '.xls' WHEN 2 THEN '.csv' WHEN 3 THEN '.pdf'"
    " WHEN 4 THEN '.htm' WHEN 5 THEN '.txt' WHEN 6 THEN '.zip' ELSE '' END)",
    "content_type": "CASE p_partkey % 6 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'application/PDF' WHEN 2 THEN 'application/octet-stream'"
    " WHEN 3 THEN 'text/csv' WHEN 4 THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' ELSE 'application/octet-stream' END",
}

HEADER = {
    "header_id": "p_partkey",
    "header": "concat(CASE p_size % 25 WHEN 0 THEN 'Provider Name:' WHEN 1 THEN 'NPI#' WHEN 2 THEN 'Group NPI' WHEN 3 THEN 'Practice Group'"
    " WHEN 4 THEN 'State License' WHEN 5 THEN 'Organization Name' WHEN 6 THEN 'Tax ID' WHEN 7 THEN 'Street' WHEN 8 THEN 'Telephone'"
    " WHEN 9 THEN 'FAX' WHEN 10 THEN 'PPG ID' WHEN 11 THEN 'LOB' WHEN 12 THEN 'Effective Date' WHEN 13 THEN 'Term Date'"
    " WHEN 14 THEN 'Term Reason' WHEN 15 THEN 'Transaction Type' WHEN 16 THEN 'Transaction Attribute' WHEN 17 THEN 'Specialty'"
    " WHEN 18 THEN 'Provider Type' WHEN 19 THEN 'Phone' WHEN 20 THEN 'Address' WHEN 21 THEN 'TIN' WHEN 22 THEN 'Line of Business'"
    " WHEN 23 THEN 'Attribute' ELSE p_type END, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE ':' END)",
}

JOB = {
    "job_id": K,
    "email_id": "o_custkey",
    "status": f"CASE {K} % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'needs_review' WHEN 3 THEN 'ready'"
    f" WHEN 4 THEN 'exported' ELSE 'failed' END",
    "current_version_id": K,
    "created_at": "o_orderdate",
    "updated_at": f"o_orderdate + INTERVAL '1' MINUTE * (CAST({K} % 50 AS INT))",
}

EMAIL = {
    "id": "c_custkey",
    "message_id": "concat('<', CAST(c_custkey - c_custkey % 3 AS STRING), '@mail.example>')",
    "from_addr": "concat('sender', CAST(c_nationkey AS STRING), '@example.com')",
    "subject": "c_name",
    "received_at": "CAST(round(c_acctbal * 100) AS BIGINT)",
    "hash": "concat('h', CAST(c_custkey - c_custkey % 2 AS STRING))",
}

# Sixteen versions to a job, each the parent of the next.
VERSION = {
    "version_id": K,
    "job_id": f"{K} - {K} % 16",
    "parent_version_id": f"CASE WHEN {K} % 16 = 0 THEN NULL ELSE {K} - 1 END",
    "author": f"CASE WHEN {K} % 3 = 0 THEN 'system' ELSE 'user' END",
    "created_at": "o_orderdate",
}

RECORD = {"version_id": "l_orderkey", "row_idx": "l_linenumber", "part": "l_partkey", "quantity": "l_quantity"}
ISSUE = {
    "version_id": "l_orderkey",
    "row_idx": "l_linenumber",
    "field": "CASE l_linenumber % 3 WHEN 0 THEN 'Provider NPI' WHEN 1 THEN 'Phone Number' ELSE 'Term Date' END",
    "level": "CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'warning' ELSE 'info' END",
}
EXPORT = {
    "job_id": "l_orderkey",
    "version_id": "l_orderkey",
    "file_uri": "concat('roster_export_job_', CAST(l_orderkey AS STRING), '_v', CAST(l_partkey AS STRING), '.xlsx')",
    "created_at": "l_shipdate",
}
EDIT = {
    "row_idx": "l_orderkey",
    "field": "CASE l_linenumber % 3 WHEN 0 THEN 'Provider NPI' WHEN 1 THEN 'Phone Number' ELSE 'Term Reason' END",
    "value": "concat('edit ', CAST(l_partkey AS STRING))",
    "seq": "l_partkey",
}
STAGE_EVENT = {
    "event_id": "event_id",
    "ts": "ts",
    "job_id": "user_id",
    "agent": "event_type",
    "status": "CASE event_id % 5 WHEN 0 THEN 'started' WHEN 1 THEN 'error' ELSE 'success' END",
    "duration_s": "value",
}

_DAY, _MON = "lpad(CAST(day(o_orderdate) AS STRING), 2, '0')", "lpad(CAST(month(o_orderdate) AS STRING), 2, '0')"
_PAIR = lambda name, value: f"'\"{name}\": \"', {value}, '\"'"
_OBJECT = ", ', ', ".join(
    [
        _PAIR("Provider Name", f"CASE {K} % 4 WHEN 0 THEN 'Dr. Ann Lee' WHEN 1 THEN 'Ann Lee, MD' WHEN 2 THEN 'Information not found' ELSE ' Ann Lee ' END"),
        _PAIR("Effective Date", f"CASE {K} % 3 WHEN 0 THEN concat({_DAY}, '/', {_MON}, '/2024') WHEN 1 THEN '2024-01-02' ELSE 'Information not found' END"),
        _PAIR("Term Date", f"CASE {K} % 5 WHEN 0 THEN '31/02/2024' WHEN 1 THEN 'n/a' ELSE '01/12/2025' END"),
        _PAIR("Line Of Business", f"CASE {K} % 4 WHEN 0 THEN 'Medicare, Commercial' WHEN 1 THEN 'HMO' WHEN 2 THEN 'Information not found' ELSE '' END"),
        _PAIR("Phone Number", f"CASE {K} % 3 WHEN 0 THEN '555-123-4567' WHEN 1 THEN '(555) 123-4567' ELSE 'None' END"),
        _PAIR("Provider NPI", f"CASE {K} % 3 WHEN 0 THEN lpad({_TEXT}, 10, '1') WHEN 1 THEN {_TEXT} ELSE 'Information not found' END"),
    ]
)
COMPLETION = {
    "completion_id": K,
    "prompt_id": f"{K} - {K} % 4",
    "completion": f"CASE {K} % 7 WHEN 0 THEN 'no object here' WHEN 1 THEN concat('{{\"Provider Name\": ', {_TEXT})"
    f" ELSE concat('Here it is: {{', {_OBJECT}, '}} done') END",
    "answer": "'{\"Provider Name\": \"Ann Lee, MD\", \"Effective Date\": \"2024-01-02\", \"Phone Number\": \"555-123-4567\", \"Group NPI\": \"1\"}'",
}
RESPONSE = {
    "mail_id": K,
    "response": f"CASE {K} % 5 WHEN 0 THEN concat('```json\n[{{', {_OBJECT}, '}}, {{\"Provider NPI\": null, \"TIN\": \" NA \"}}, {{\"TIN\": \"', {_TEXT}, '\"}}]\n```')"
    f" WHEN 1 THEN concat('{{', {_OBJECT}, '}}') WHEN 2 THEN 'sorry, nothing' WHEN 3 THEN '[]' ELSE concat('[{{\"TIN\": \"', {_TEXT}, '\"}}]') END",
}

TABLES = {
    "roster": ("orders", ROSTER),
    "mail": ("orders", MAIL),
    "attachment": ("part", ATTACHMENT),
    "header": ("part", HEADER),
    "job": ("orders", JOB),
    "email": ("customer", EMAIL),
    "version": ("orders", VERSION),
    "record": ("lineitem", RECORD),
    "issue": ("lineitem", ISSUE),
    "export": ("lineitem", EXPORT),
    "edit": ("lineitem", EDIT),
    "stage_event": ("events", STAGE_EVENT),
    "completion": ("orders", COMPLETION),
    "model_response": ("orders", RESPONSE),
}
for _name in ("completion", "model_response"):
    _source, _columns = TABLES[_name]
    TABLES[_name] = (_source, {c: e.replace("{{", "{").replace("}}", "}") for c, e in _columns.items()})


#: Relations with long patterns to work through in every row.
HEAVY = {"roster", "mail", "completion", "model_response"}


def relation(spark: SparkSession, folder: str, name: str) -> DataFrame:
    source, columns = TABLES[name]
    rows = read(spark, folder, source, TASK_ROWS if name in HEAVY else None)
    return rows.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def relation_sql(name: str) -> str:
    """The same relation as a SELECT."""
    source, columns = TABLES[name]
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {source}"


def with_relations(*names: str) -> str:
    """WITH clause that binds each relation to its name plus ``_t``."""
    return "WITH " + ", ".join(f"{n}_t AS ({relation_sql(n)})" for n in names) + " "
