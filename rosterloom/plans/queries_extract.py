"""Queries on classification, extraction and mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterloom.functions import classify
from rosterloom.functions import text as T
from rosterloom.operators import classification, mapping, narrative, responses, tables
from rosterloom.operators.skew import explode_rows
from rosterloom.plans import twins as q
from rosterloom.plans.derive import read, relation, with_relations
from rosterloom.schema import (
    FIELDS,
    HEADER_HINTS,
    HEADER_RULES,
    NARRATIVE_PATTERNS,
    PHRASES,
    ROSTER_TERMS,
    TABLE_SENTINEL_FIELDS,
    TRANSACTION_WORDS,
    column_name,
)

VISION_FIELDS = ["NPI", "Provider Name", "Specialty", "Phone", "Email", "Address"]


def mail(spark, folder):
    return relation(spark, folder, "mail")


def texts(spark, folder):
    """Trimmed document texts and derived mail texts, one id space each."""
    documents = read(spark, folder, "documents").select("doc_id", T.strip(F.col("text")).alias("text"))
    mails = mail(spark, folder).select((-F.col("mail_id") - 1).alias("doc_id"), T.strip(F.col("text")).alias("text"))
    return documents.unionAll(mails)


TEXTS = (
    with_relations("mail")
    + f", texts AS (SELECT doc_id, {q.strip('text')} AS text FROM documents UNION ALL SELECT -mail_id - 1, {q.strip('text')} FROM mail_t) "
).replace(") , texts", "), texts")


def entries(df, key):
    """Row maps as one line per field."""
    pairs = df.select(*key, "row_idx", F.map_entries("data").alias("_e"))
    return explode_rows(pairs, "_e", "e").select(*key, "row_idx", F.col("e.key").alias("field"), F.col("e.value").alias("value"))


# --- classification ------------------------------------------------------------
def body_types(spark, folder):
    out = classification.classify_bodies(mail(spark, folder).select("mail_id", "html", F.col("text")))
    return out.select("mail_id", "document_type", "confidence", "table_count", F.concat_ws("|", "headers_found").alias("headers"))


def text_body_types(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text", F.lit(None).cast("string").alias("html"))
    out = classification.classify_bodies(docs)
    return out.select("doc_id", "document_type", "confidence", "tabular_lines", "total_lines", "has_html", "has_text")


def page_types(spark, folder):
    pages = read(spark, folder, "pages").select("page_id", "html", F.lit("").alias("text"))
    kind = classify.fallback_type(F.col("html"), F.array(F.lit("Name"), F.lit(".CSV")))
    out = classification.classify_bodies(pages.withColumn("fallback", kind["document_type"]))
    return out.select("page_id", "document_type", "confidence", F.length("content").alias("size"), "fallback")


def attachment_types(spark, folder):
    out = classification.classify_attachments(relation(spark, folder, "attachment"))
    return out.select("attachment_id", "document_type", "confidence", "extraction_method", "file_extension")


def mail_strategies(spark, folder):
    return classification.mail_strategy(
        classification.classify_attachments(relation(spark, folder, "attachment")), ["mail_id"]
    )


KINDS = (
    "SELECT *, CASE WHEN n LIKE '%.xlsx' OR n LIKE '%.xls' OR m LIKE '%spreadsheet%' THEN 'XLSX' WHEN n LIKE '%.csv' OR m LIKE '%csv%' THEN 'CSV'"
    " WHEN n LIKE '%.pdf' OR m LIKE '%pdf%' THEN 'PDF_UNKNOWN' WHEN n LIKE '%.html' OR n LIKE '%.htm' OR m LIKE '%html%' THEN 'HTML_TABLE'"
    " WHEN n LIKE '%.txt' OR n LIKE '%.text' OR m LIKE '%text/plain%' THEN 'PLAIN_TEXT' ELSE 'UNKNOWN' END AS document_type"
    " FROM (SELECT *, lower(filename) AS n, lower(content_type) AS m FROM attachment_t)"
)


# --- tables ----------------------------------------------------------------------
_SKIP = "(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>"
_CELL_TEXT = (
    "regexp_replace("
    + q.strip(
        "replace(replace(replace(replace(replace(replace(regexp_replace(c, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'),"
        " '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
    )
    + ", '[\\r\\n]+|\\s{2,}', ' ', 'g')"
)
CELLS = (
    with_relations("mail")
    + f", t0 AS (SELECT mail_id, regexp_extract_all(regexp_replace(html, '{_SKIP}', '', 'g'), '(?is)<table\\b[^>]*>(.*?)</table\\s*>', 1) AS ts FROM mail_t)"
    ", t1 AS (SELECT mail_id, ti, ts[ti] AS t FROM (SELECT mail_id, ts, unnest(range(1, len(ts) + 1)) AS ti FROM t0))"
    ", r0 AS (SELECT mail_id, ti, list_filter(regexp_extract_all(t, '(?is)<tr\\b[^>]*>(.*?)</tr\\s*>', 1), lambda r: regexp_matches(r, '(?i)<t[dh]\\b')) AS rs FROM t1)"
    ", r1 AS (SELECT mail_id, ti, ri, rs[ri] AS r, regexp_matches(rs[1], '(?i)<th\\b') AND NOT regexp_matches(rs[1], '(?i)<td\\b') AS has_th"
    " FROM (SELECT mail_id, ti, rs, unnest(range(1, len(rs) + 1)) AS ri FROM r0))"
    ", c0 AS (SELECT mail_id, ti, ri, has_th, regexp_extract_all(r, '(?is)<t[dh]\\b[^>]*>(.*?)</t[dh]\\s*>', 1) AS cs FROM r1)"
    f", cells AS (SELECT mail_id, ti, ri, ci, has_th, {_CELL_TEXT} AS cell FROM (SELECT *, cs[ci] AS c FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS ci FROM c0)))"
    ", body AS (SELECT * FROM cells WHERE NOT (has_th AND ri = 1))"
    ", width AS (SELECT mail_id, ti, max(ci) AS w FROM cells GROUP BY ALL)"
    ", sized AS (SELECT b.mail_id, b.ti, count(DISTINCT ri) AS n, any_value(w.w) AS w, lower(string_agg(cell, ' ' ORDER BY ri, ci)) AS content"
    " FROM body b JOIN width w ON b.mail_id = w.mail_id AND b.ti = w.ti GROUP BY b.mail_id, b.ti)"
    ", scored AS (SELECT *, n * w + 5 * ("
    + " + ".join(f"CAST(contains(content, {q.lit(t)}) AS INT)" for t in ROSTER_TERMS)
    + ") + CASE WHEN n > 1 THEN 10 ELSE 0 END + CASE WHEN w BETWEEN 3 AND 10 THEN 5 ELSE 0 END AS score FROM sized)"
    ", best AS (SELECT * FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY mail_id ORDER BY score DESC, ti) = 1) "
)


def html_cells(spark, folder):
    return tables.html_cells(mail(spark, folder).select("mail_id", "html"))


def best_tables(spark, folder):
    best = tables.select_best_table(tables.parse_tables(F.col("html")))
    out = mail(spark, folder).select("mail_id", best.alias("b"))
    return out.select(
        "mail_id", F.col("b.score").alias("score"), (-F.col("b.neg_idx")).alias("table_idx"), F.size("b.table.grid").alias("grid_rows")
    )


def table_rows(spark, folder):
    rows = tables.table_rows(mail(spark, folder).select("mail_id", "html"))
    return entries(rows, ["mail_id"])


def _rule_case(h: str, rules=HEADER_RULES) -> str:
    return "CASE " + " ".join(f"WHEN {q.has_any(h, terms)} THEN {q.lit(f)}" for f, terms in rules) + " END"


_CLEAN = lambda h: q.strip(f"regexp_replace(lower({h}), '[:#]', '', 'g')")
TABLE_ROWS = (
    CELLS
    + ", grid AS (SELECT b.*, s.w FROM cells b JOIN best s ON b.mail_id = s.mail_id AND b.ti = s.ti)"
    ", tops AS (SELECT mail_id, has_th, max(w) AS w, count(DISTINCT ri) AS n, lower(string_agg(cell, ' ' ORDER BY ci) FILTER (ri = 1)) AS top FROM grid GROUP BY mail_id, has_th)"
    f", heads AS (SELECT *, has_th OR (n > 1 AND {q.has_any('top', HEADER_HINTS)}) AS named FROM tops)"
    f", names AS (SELECT g.mail_id, ci, {_rule_case(_CLEAN('cell'))} AS field FROM grid g JOIN heads h ON g.mail_id = h.mail_id WHERE named AND ri = 1)"
    ", rows0 AS (SELECT g.mail_id, ri - CASE WHEN named THEN 2 ELSE 1 END AS row_idx, ci, cell, g.w FROM grid g JOIN heads h ON g.mail_id = h.mail_id WHERE NOT named OR ri > 1)"
    ", hits AS (SELECT r.mail_id, row_idx, field, cell AS value FROM rows0 r JOIN names n ON r.mail_id = n.mail_id AND r.ci = n.ci"
    " WHERE field IS NOT NULL AND lower(cell) NOT IN ('', 'nan', 'none'))"
    ", blind AS (SELECT mail_id, row_idx, list(cell ORDER BY ci) FILTER (cell <> '') AS v FROM rows0 r"
    " WHERE w >= 3 AND NOT EXISTS (SELECT 1 FROM names n WHERE n.mail_id = r.mail_id AND field IS NOT NULL) GROUP BY ALL HAVING count(*) FILTER (cell <> '') >= 3)"
    ", placed AS (SELECT mail_id, row_idx, 'Provider Name' AS field, v[1] AS value FROM blind"
    " UNION ALL SELECT mail_id, row_idx, 'Provider Specialty', CASE WHEN regexp_full_match(v[2], '[0-9]{10}') THEN v[3] ELSE v[2] END FROM blind"
    " UNION ALL SELECT mail_id, row_idx, 'Provider NPI', CASE WHEN regexp_full_match(v[2], '[0-9]{10}') THEN v[2] WHEN regexp_full_match(v[3], '[0-9]{10}') THEN v[3] ELSE '' END FROM blind)"
    ", found AS (SELECT * FROM hits UNION ALL SELECT * FROM placed)"
    ", base AS (SELECT DISTINCT mail_id, row_idx FROM found)"
    ", extra AS (SELECT unnest(["
    + ", ".join(q.lit(f) for f in TABLE_SENTINEL_FIELDS)
    + "]) AS field)"
    " SELECT * FROM found UNION ALL SELECT b.mail_id, b.row_idx, e.field, 'Information not found' FROM base b, extra e"
    " WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.mail_id = b.mail_id AND f.row_idx = b.row_idx AND f.field = e.field)"
)


def schema_rows(spark, folder):
    """Of every table of every mail."""
    every = F.transform(tables.parse_tables(F.col("html")), lambda t: t["grid"])
    grids = explode_rows(mail(spark, folder).select("mail_id", every.alias("_grids")), "_grids", "grid", "table_idx")
    return entries(tables.schema_rows(grids, VISION_FIELDS), ["mail_id", "table_idx"])


_FITS = lambda h, w: f"(contains(lower({h}), lower({w})) OR contains(lower({w}), lower({h})))"
SCHEMA_ROWS = (
    CELLS
    + ", wanted AS (SELECT unnest(["
    + ", ".join(q.lit(f) for f in VISION_FIELDS)
    + "]) AS field)"
    f", picks AS (SELECT mail_id, ti, field, min(ci) AS ci FROM cells, wanted WHERE ri = 1 AND {_FITS('cell', 'field')} GROUP BY ALL)"
    " SELECT s.mail_id, s.ti - 1 AS table_idx, s.ri - 2 AS row_idx, field, cell AS value FROM cells s JOIN picks p ON s.mail_id = p.mail_id AND s.ti = p.ti AND s.ci = p.ci WHERE ri > 1 AND cell <> ''"
)


def spaced_rows(spark, folder):
    return entries(tables.spaced_text_rows(texts(spark, folder), VISION_FIELDS), ["doc_id"])


SPACED_ROWS = (
    TEXTS
    + ", ws AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l: list_filter(string_split_regex(l, '\\s+'), lambda w: w <> '')) AS ls FROM texts)"
    ", hs AS (SELECT doc_id, ls, list_filter(ls, lambda l: len(l) >= 2)[1] AS h FROM ws WHERE len(ls) >= 2 AND len(list_filter(ls, lambda l: len(l) >= 2)) > 0)"
    ", wanted AS (SELECT unnest(["
    + ", ".join(q.lit(f) for f in VISION_FIELDS)
    + "]) AS field), heads AS (SELECT doc_id, i, h[i] AS name FROM (SELECT doc_id, h, unnest(range(1, len(h) + 1)) AS i FROM hs))"
    f", picks AS (SELECT doc_id, field, min(i) AS i FROM heads, wanted WHERE {_FITS('name', 'field')} GROUP BY ALL)"
    ", sizes AS (SELECT doc_id, count(*) AS n FROM picks GROUP BY doc_id)"
    ", lines AS (SELECT doc_id, r, ls[r] AS l FROM (SELECT doc_id, ls, unnest(range(2, len(ls) + 1)) AS r FROM hs))"
    " SELECT l.doc_id, l.r - 2 AS row_idx, field, l.l[p.i] AS value FROM lines l JOIN picks p ON l.doc_id = p.doc_id JOIN sizes s ON s.doc_id = l.doc_id"
    " WHERE len(l.l) > 0 AND len(l.l) >= s.n AND len(l.l) >= p.i"
)


def grid_rows(spark, folder):
    """Cell grids: a line item is a cell; its order is the document, its line the row."""
    cells = read(spark, folder, "lineitem").groupBy(
        (F.col("l_orderkey") - F.col("l_orderkey") % 8).alias("doc"),
        (F.col("l_orderkey") % 2).alias("page"),
        F.lit(0).alias("table"),
        (F.col("l_linenumber") - 1).alias("row"),
        (F.col("l_orderkey") % 4).alias("col"),
    ).agg(F.max(F.when(F.col("l_partkey") % 5 != 0, F.concat(F.lit(" p"), F.col("l_partkey") % 7))).alias("text"))
    out = tables.grid_to_rows(cells, ["doc"])
    return explode_rows(out.select("doc", "row_key", F.map_entries("data").alias("_e")), "_e", "e").select(
        "doc", "row_key", F.col("e.key").alias("field"), F.col("e.value").alias("value")
    )


GRID_ROWS = (
    "WITH g AS (SELECT l_orderkey - l_orderkey % 8 AS doc, l_orderkey % 2 AS page, 0 AS tab, l_linenumber - 1 AS r, l_orderkey % 4 AS c,"
    " max(CASE WHEN l_partkey % 5 <> 0 THEN ' p' || CAST(l_partkey % 7 AS VARCHAR) END) AS t FROM lineitem GROUP BY ALL)"
    ", h AS (SELECT doc, page, c, CASE WHEN coalesce(t, '') = '' THEN 'col_' || c ELSE trim(t) END AS field FROM g WHERE r = 0)"
    " SELECT doc, row_key, field, value FROM (SELECT g.doc, g.page || '_0_' || g.r AS row_key, field, trim(t) AS value,"
    " row_number() OVER (PARTITION BY g.doc, g.page, g.r, field ORDER BY g.c DESC) AS n"
    " FROM g JOIN h ON g.doc = h.doc AND g.page = h.page AND g.c = h.c WHERE r > 0 AND t IS NOT NULL) WHERE n = 1"
)


def page_kinds(spark, folder):
    pages = read(spark, folder, "conversations").select(
        F.col("conv_id").alias("doc"), (F.col("turn") + 1).alias("page"), "text"
    )
    return tables.page_kind(pages, ["doc"])


def page_statistics(spark, folder):
    talk = read(spark, folder, "conversations")
    pages = talk.select(F.col("conv_id").alias("doc"), (F.col("turn") + 1).alias("page"), "text")
    kinds = tables.page_kind(pages, ["doc"])
    return tables.page_statistics(kinds, talk.where("role <> 'system'"), talk.where("role = 'system'"))


PAGE_KINDS = (
    f"SELECT conv_id AS doc, CASE WHEN length({q.strip("string_agg(text, '' ORDER BY turn)")}) > 100"
    " THEN 'PDF_NATIVE' ELSE 'PDF_SCANNED' END AS document_type FROM conversations WHERE turn < 3 GROUP BY conv_id"
)


# --- headers -----------------------------------------------------------------------
def header_fields(spark, folder):
    clean = relation(spark, folder, "header").select("header_id", tables.clean_header(F.col("header")).alias("clean"))
    return clean.select(
        "header_id",
        "clean",
        tables.map_header(F.col("clean")).alias("field"),
        tables.map_header(F.col("clean"), tables.strict_rules()).alias("strict_field"),
    )


def _strict_sql(h: str) -> str:
    pairs = sorted(((f, t) for f, ts in HEADER_RULES for t in ts), key=lambda p: -len(p[1]))
    return _rule_case(h, [(f, [t]) for f, t in pairs])


def header_suggestions(spark, folder):
    best = relation(spark, folder, "header").select("header_id", mapping.suggest_header(T.strip(F.col("header"))).alias("s"))
    return best.select("header_id", F.col("s.target").alias("target"), F.round("s.confidence", 6).alias("confidence"))


def header_pairs(spark, folder):
    pairs = relation(spark, folder, "header").select(
        "header_id", mapping.substring_mapping(F.array(T.strip(F.col("header")))).alias("_p")
    )
    return explode_rows(pairs, "_p", "p").select("header_id", "p.source", "p.target", "p.confidence")


_TARGETS = "(VALUES " + ", ".join(f"({q.lit(f)}, {i})" for i, f in enumerate(FIELDS)) + ") f(target, pos)"
_LONG = lambda fn: f"{fn}(length(h), length(target))"
HEADER_PAIRS = with_relations("header") + (
    f", named AS (SELECT header_id, {q.strip('header')} AS h FROM header_t)"
    f", pairs AS (SELECT header_id, h, target, pos, {_LONG('least')} / {_LONG('greatest')} AS score FROM named, {_TARGETS} WHERE {_FITS('h', 'target')}) "
)


def mapped_rows(spark, folder):
    """A mapping per job applied to rows whose headers only resemble the fields."""
    headers = ["Provider Nam", "NPI", "Phone", "Number", "Organization", "Term"]
    columns = ["provider_name", "provider_npi", "phone_number", "tin", "organization_name", "term_date"]
    rows = relation(spark, folder, "roster")
    tin = F.when(F.col("row_idx") % 2 == 0, F.col("tin")).otherwise("")
    cells = [tin if c == "tin" else F.col(c) for c in columns]
    data = F.create_map(*[x for h, c in zip(headers, cells) for x in (F.lit(h), c)])
    jobs = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    mappings = mapping.suggest_mapping(jobs.withColumn("headers", F.array(*[F.lit(h) for h in headers])))
    out = mapping.apply_mapping(rows.select("job_id", "row_idx", data.alias("data")), mappings, ["job_id"], ["row_idx"])
    return out.select("row_idx", "provider_name", "provider_npi", "group_npi", "phone_number", "organization_name", "term_date", "fax_number")


def aliased_rows(spark, folder):
    rows = relation(spark, folder, "roster")
    old = {"NPI": "provider_npi", "Specialty": "provider_specialty", "Phone": "phone_number", "LOB": "line_of_business",
           "Reason": "term_reason", "Type": "transaction_type", "Term Date": "term_date"}
    data = F.create_map(*[x for h, c in old.items() for x in (F.lit(h), F.col(c))])
    return mapping.typed_rows(rows.select("row_idx", data.alias("data")))


# --- text --------------------------------------------------------------------------
def delimited_rows(spark, folder):
    return entries(tables.delimited_rows(texts(spark, folder)), ["doc_id"])


DELIMITED = (
    TEXTS
    + ", ls AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM texts)"
    f", ln AS (SELECT doc_id, len(ls) AS n, i, ls[i] AS line, {q.strip('ls[i]')} AS bare FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM ls))"
    ", hd AS (SELECT doc_id, i AS h, bare FROM ln WHERE n > 1 AND regexp_matches(bare, '\\S\\s+\\S') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1)"
    f", nm AS (SELECT doc_id, h, {q.split_line('bare')} AS names FROM hd)"
    f", dl AS (SELECT l.doc_id, l.i - h - 1 AS row_idx, names, {q.split_line('line')} AS vs FROM ln l JOIN nm ON l.doc_id = nm.doc_id WHERE l.i > h AND l.bare <> '' AND len(names) >= 2)"
    ", dr AS (SELECT *, unnest(range(1, len(names) + 1)) AS j FROM dl WHERE len(vs) >= len(names))"
    ", structured AS (SELECT doc_id, row_idx, names[j] AS field, vs[j] AS value FROM dr QUALIFY row_number() OVER (PARTITION BY doc_id, row_idx, names[j] ORDER BY j DESC) = 1) "
)


def line_cells(spark, folder):
    lines = texts(spark, folder).select("doc_id", F.split("text", "\n").alias("_l"))
    out = explode_rows(lines, "_l", "line", "line_no").withColumn("cells", T.split_line(F.col("line")))
    return out.select("doc_id", "line_no", F.size("cells").alias("cells"), F.col("cells")[0].alias("first"), F.element_at("cells", -1).alias("last"))


def narrative_fields(spark, folder):
    return narrative.narrative_columns(texts(spark, folder)).drop("text")


def _pattern(field: str, strict: bool = True) -> str:
    flag = "" if strict and field == "Provider Name" else "(?i)"
    return q.strip(f"nullif(regexp_extract(text, {q.lit(flag + NARRATIVE_PATTERNS[field])}, 1), '')")


def narrative_rows(spark, folder):
    return entries(narrative.text_rows(texts(spark, folder)), ["doc_id"])


_TYPE_CASE = "CASE " + " ".join(f"WHEN {q.has_any('lower(text)', ws)} THEN {q.lit(k)}" for k, ws in TRANSACTION_WORDS) + " ELSE 'Update' END"
NARRATIVE = (
    DELIMITED
    + ", bare AS (SELECT * FROM texts WHERE contains(text, chr(10)) AND doc_id NOT IN (SELECT doc_id FROM structured))"
    + ", hit AS ("
    + " UNION ALL ".join(f"SELECT doc_id, {q.lit(f)} AS field, {_pattern(f)} AS value FROM bare" for f in NARRATIVE_PATTERNS)
    + "), got AS (SELECT * FROM hit WHERE value IS NOT NULL)"
    + f", kind AS (SELECT doc_id, {_TYPE_CASE} AS kind FROM bare WHERE doc_id IN (SELECT doc_id FROM got))"
    + ", sure AS (SELECT * FROM got UNION ALL SELECT doc_id, 'Transaction Type', kind FROM kind"
    " UNION ALL SELECT doc_id, 'Transaction Attribute', CASE WHEN kind IN ('Add', 'Term') THEN 'Provider' ELSE 'Not Applicable' END FROM kind)"
    + ", extra AS (SELECT unnest(["
    + ", ".join(
        q.lit(f)
        for f in ["Effective Date", "Term Date", "Term Reason", "Provider NPI", "State License", "TIN", "Group NPI",
                  "Complete Address", "Phone Number", "Fax Number", "PPG ID", "Line Of Business"]
    )
    + "]) AS field)"
    " SELECT doc_id, row_idx, field, value FROM structured UNION ALL SELECT doc_id, 0, field, value FROM sure"
    " UNION ALL SELECT k.doc_id, 0, e.field, 'Information not found' FROM kind k, extra e"
    " WHERE NOT EXISTS (SELECT 1 FROM sure s WHERE s.doc_id = k.doc_id AND s.field = e.field)"
)


def phrase_tags(spark, folder):
    found = narrative.phrase_fields(F.col("text"))
    return texts(spark, folder).select("doc_id", *[v.alias(column_name(f)) for f, v in found.items()])


def _phrase(field: str) -> str:
    longest = sorted(PHRASES[field], key=len, reverse=True)
    return f"regexp_extract_all(text, '\\b({'|'.join(longest)})\\b', 1)[-1]"


def token_values(spark, folder):
    found = narrative.token_fields(F.col("text"), F.col("words"))
    cut = texts(spark, folder).select("doc_id", narrative.digit_tokens(F.col("text")).alias("words"))
    return cut.select("doc_id", *[v.alias(column_name(f)) for f, v in found.items()])


_WORDS = "list_filter(list_transform(string_split_regex(text, '\\s+'), lambda w: trim(w, '.,;:()[]{}\"''!?#*')), lambda w: w <> '')"
_MATCHES = lambda p: f"list_filter(ws, lambda w: regexp_full_match(w, '{p}'))"
TOKENS = (
    TEXTS
    + f", tk AS (SELECT doc_id, {_WORDS} AS ws FROM texts), ph AS (SELECT *, {_MATCHES('[0-9]{3}[-.]?[0-9]{3}[-.]?[0-9]{4}')} AS ps FROM tk)"
    f" SELECT doc_id, {_MATCHES('[0-9]{10}')}[-1] AS provider_npi, {_MATCHES('[0-9]{2}-?[0-9]{7}')}[-1] AS tin,"
    f" {_MATCHES('[A-Z]{1,3}[0-9]{4,8}')}[-1] AS state_license, {_MATCHES('P[0-9]{2,3}|[0-9]{3,4}')}[-1] AS ppg_id,"
    " ps[1] AS phone_number, CASE WHEN len(ps) > 1 THEN ps[-1] END AS fax_number FROM ph"
)


def transaction_types(spark, folder):
    return texts(spark, folder).select("doc_id", classify.transaction_type(F.col("text")).alias("transaction_type"))


# --- model text ---------------------------------------------------------------------
def prompts_of(spark, folder):
    """The prompt of each page, in full."""
    pages = read(spark, folder, "pages")
    names = F.when(F.col("page_id") % 2 == 0, F.array(F.lit("a.txt"), F.lit("b.txt")))
    content = responses.prompt_text(F.col("url"), F.col("html"), names, F.lit("HTML_TABLE"))
    return pages.select("page_id", responses.user_prompt(content).alias("prompt"))


def prompts(spark, folder):
    around = sum(map(len, responses.REQUEST))
    return prompts_of(spark, folder).select("page_id", F.sha2("prompt", 256).alias("prompt_hash"), (F.length("prompt") - around).alias("size"))


_BARE = q.strip("regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')")
_PROMPT = (
    f"concat_ws(chr(10) || chr(10), 'HTML Table Content: ' || {_BARE}, 'HTML Content: ' || {_BARE}, 'Plain Text: ' || url,"
    " CASE WHEN page_id % 2 = 0 THEN 'Attachment: a.txt' END, CASE WHEN page_id % 2 = 0 THEN 'Attachment: b.txt' END)"
)


def model_rows(spark, folder):
    return responses.clean_model_rows(relation(spark, folder, "model_response")).drop("extraction_method")


_BODY = (
    "CASE WHEN response LIKE '```json%```' THEN substr(response, 8, length(response) - 10) ELSE response END"
)
MODEL_ROWS = (
    with_relations("model_response")
    + f", b AS (SELECT mail_id, {q.strip(_BODY)} AS body FROM model_response_t)"
    ", l AS (SELECT mail_id, CASE WHEN NOT json_valid(body) THEN [] WHEN body LIKE '[%' THEN json_extract(body, '$[*]') ELSE [CAST(body AS JSON)] END AS os FROM b)"
    ", r AS (SELECT mail_id, os[i] AS o, i FROM (SELECT mail_id, os, unnest(range(1, len(os) + 1)) AS i FROM l))"
    ", v AS (SELECT mail_id, i, "
    + ", ".join(
        f"CASE WHEN lower(trim(json_extract_string(o, '$.\"{f}\"'))) NOT IN ('', 'null', 'none', 'n/a', 'na') THEN trim(json_extract_string(o, '$.\"{f}\"')) END AS {column_name(f)}"
        for f in FIELDS
    )
    + " FROM r WHERE json_type(o) = 'OBJECT')"
    " SELECT * EXCLUDE (i), row_number() OVER (PARTITION BY mail_id ORDER BY i) - 1 AS row_idx, 0.9::DOUBLE AS confidence FROM v"
    f" WHERE coalesce({', '.join(column_name(f) for f in FIELDS)}) IS NOT NULL"
)


def json_spans(spark, folder):
    out = relation(spark, folder, "completion").select("completion_id", responses.extract_json(F.col("completion")).alias("o"))
    return out.select(
        "completion_id",
        F.col("o").isNotNull().alias("parsed"),
        F.try_element_at("o", F.lit("Provider Name")).alias("provider_name"),
        F.try_element_at("o", F.lit("Term Date")).alias("term_date"),
    )


# --- source choice ---------------------------------------------------------------------
def _sourced(spark, folder):
    source = F.when((F.col("job_id") % 2 == 0) & (F.col("row_idx") % 3 == 0), "model").otherwise("rule")
    return relation(spark, folder, "roster").select("job_id", "row_idx", source.alias("source"))


def preferred_rows(spark, folder):
    return responses.prefer_source(_sourced(spark, folder), ["job_id"], "source", ["model", "rule"], ["row_idx"])


def merged_rows(spark, folder):
    return responses.merge_by_coverage(_sourced(spark, folder), ["job_id"], "source", "rule", "model", ["row_idx"])


SOURCED = (
    with_relations("roster")
    + ", s AS (SELECT job_id, row_idx, CASE WHEN job_id % 2 = 0 AND row_idx % 3 = 0 THEN 'model' ELSE 'rule' END AS source FROM roster_t) "
)


def extraction_statistics(spark, folder):
    methods = F.when(F.col("source") == "model", "llm").otherwise("html_table")
    rows = _sourced(spark, folder).select(
        "job_id", methods.alias("extraction_method"), F.when(F.col("source") == "model", 0.9).otherwise(0.7).alias("confidence")
    )
    return responses.extraction_statistics(rows, ["job_id"])


def assistance(spark, folder):
    artifacts = relation(spark, folder, "attachment").select(F.col("mail_id").alias("job_id"), F.col("attachment_id").alias("artifact_id"))
    rows = read(spark, folder, "lineitem").select((F.col("l_partkey") * 2).alias("artifact_id"))
    flags = responses.needs_assistance(artifacts, rows, ["job_id"], ["artifact_id"])
    routed = classification.route(flags.withColumn("needs_review", F.col("total_rows") % 2 == 0))
    return routed.select("job_id", "needs_assistance", "total_rows", "after_extraction", "after_validation")


QUERIES = [
    (
        "body_types",
        body_types,
        with_relations("mail")
        + "SELECT mail_id, 'HTML_TABLE' AS document_type, 0.9::DOUBLE AS confidence, CAST((length(html) - length(replace(lower(html), '<table', ''))) / 6 AS INT) AS table_count,"
        " array_to_string(list_transform(regexp_extract_all(html, '(?is)<th[^>]*>(.*?)</th>', 1), lambda h: trim(regexp_replace(h, '<[^>]+>', '', 'g'))), '|') AS headers FROM mail_t",
    ),
    (
        "text_body_types",
        text_body_types,
        f"SELECT doc_id, 'PLAIN_TEXT' AS document_type, CASE WHEN n > 2 AND text <> '' THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence, n AS tabular_lines,"
        f" len(string_split(text, chr(10))) AS total_lines, false AS has_html, true AS has_text FROM"
        f" (SELECT doc_id, text, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches({q.strip('l')}, '\\s{{2,}}|\\t|\\|'))) AS n FROM documents)",
    ),
    (
        "page_types",
        page_types,
        "SELECT page_id, CASE WHEN contains(lower(html), '<table') THEN 'HTML_TABLE' ELSE 'PLAIN_TEXT' END AS document_type,"
        " CASE WHEN contains(lower(html), '<table') THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS confidence, length(html) AS size,"
        f" CASE WHEN {q.has_any('lower(html)', ['<table>', '<tr>', '<td>'])} THEN 'HTML_TABLE' ELSE 'CSV' END AS fallback FROM pages",
    ),
    (
        "attachment_types",
        attachment_types,
        with_relations("attachment")
        + f"SELECT attachment_id, document_type, CAST(CASE document_type WHEN 'XLSX' THEN 0.95 WHEN 'CSV' THEN 0.95 WHEN 'PDF_UNKNOWN' THEN 0.9 WHEN 'HTML_TABLE' THEN 0.9 WHEN 'PLAIN_TEXT' THEN 0.8 ELSE 0.3 END AS DOUBLE) AS confidence,"
        " CASE WHEN document_type = 'UNKNOWN' THEN 'vlm_assisted' ELSE 'rule_based' END AS extraction_method,"
        " CASE document_type WHEN 'CSV' THEN 'csv' WHEN 'PDF_UNKNOWN' THEN 'pdf' WHEN 'PLAIN_TEXT' THEN 'txt' ELSE CASE WHEN contains(n, '.') THEN string_split(n, '.')[-1] END END AS file_extension"
        f" FROM ({KINDS})",
    ),
    (
        "mail_strategies",
        mail_strategies,
        with_relations("attachment")
        + "SELECT mail_id, CASE WHEN a THEN 'vlm_assisted' ELSE 'rule_based' END AS extraction_method, a AS requires_vlm, CASE WHEN a THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END AS confidence, n AS artifact_count"
        f" FROM (SELECT mail_id, bool_or(document_type IN ('UNKNOWN', 'PDF_UNKNOWN')) AS a, count(*) AS n FROM ({KINDS}) GROUP BY mail_id)",
    ),
    ("html_cells", html_cells, CELLS + "SELECT mail_id, ti - 1 AS table_idx, ri - 1 AS row_idx, ci - 1 AS col_idx, cell FROM cells"),
    (
        "best_tables",
        best_tables,
        CELLS + "SELECT b.mail_id, score, b.ti - 1 AS table_idx, (SELECT max(ri) FROM cells c WHERE c.mail_id = b.mail_id AND c.ti = b.ti) AS grid_rows FROM best b",
    ),
    ("table_rows", table_rows, TABLE_ROWS),
    ("schema_rows", schema_rows, SCHEMA_ROWS),
    ("spaced_text_rows", spaced_rows, SPACED_ROWS),
    ("grid_rows", grid_rows, GRID_ROWS),
    ("page_kinds", page_kinds, PAGE_KINDS),
    (
        "page_statistics",
        page_statistics,
        f"WITH k AS ({PAGE_KINDS}) SELECT count(*) AS pdfs_processed, count(*) FILTER (document_type = 'PDF_NATIVE') AS native_pdfs,"
        " count(*) FILTER (document_type = 'PDF_SCANNED') AS scanned_pdfs, (SELECT count(*) FROM conversations WHERE role <> 'system') AS rows_extracted,"
        " (SELECT count(*) FROM conversations WHERE role = 'system') AS vlm_pages FROM k",
    ),
    (
        "header_fields",
        header_fields,
        with_relations("header")
        + f"SELECT header_id, h AS clean, {_rule_case('h')} AS field, {_strict_sql('h')} AS strict_field FROM (SELECT header_id, {_CLEAN('header')} AS h FROM header_t)",
    ),
    (
        "header_suggestions",
        header_suggestions,
        HEADER_PAIRS
        + "SELECT n.header_id, target, round(score, 6) AS confidence FROM named n LEFT JOIN (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY header_id ORDER BY score DESC, pos) = 1) p"
        " ON n.header_id = p.header_id AND score > 0.3",
    ),
    ("header_pairs", header_pairs, HEADER_PAIRS + "SELECT header_id, h AS source, target, 0.8::DOUBLE AS confidence FROM pairs"),
    (
        "mapped_rows",
        mapped_rows,
        with_relations("roster")
        + f"SELECT row_idx, {q.strip('provider_name')} AS provider_name, {q.strip('provider_npi')} AS provider_npi, {q.strip('provider_npi')} AS group_npi,"
        f" {q.strip('phone_number')} AS phone_number, {q.strip('organization_name')} AS organization_name,"
        f" {q.strip('term_date')} AS term_date, CASE WHEN row_idx % 2 = 0 THEN tin ELSE '' END AS fax_number FROM roster_t",
    ),
    (
        "aliased_rows",
        aliased_rows,
        with_relations("roster")
        + "SELECT row_idx, "
        + ", ".join(
            f"{q.strip(c)} AS {c}" if c in ("provider_npi", "provider_specialty", "phone_number", "line_of_business", "term_reason", "transaction_type", "term_date") else f"'' AS {c}"
            for c in (column_name(f) for f in FIELDS)
        )
        + " FROM roster_t",
    ),
    ("delimited_rows", delimited_rows, DELIMITED + "SELECT * FROM structured"),
    (
        "line_cells",
        line_cells,
        TEXTS
        + f", ls AS (SELECT doc_id, i - 1 AS line_no, {q.split_line('l')} AS cs FROM (SELECT doc_id, i, string_split(text, chr(10))[i] AS l FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM texts)))"
        " SELECT doc_id, line_no, len(cs) AS cells, cs[1] AS first, cs[-1] AS last FROM ls",
    ),
    (
        "narrative_fields",
        narrative_fields,
        TEXTS + "SELECT doc_id, " + ", ".join(f"{_pattern(f)} AS {column_name(f)}" for f in NARRATIVE_PATTERNS) + " FROM texts",
    ),
    ("text_rows", narrative_rows, NARRATIVE),
    (
        "phrase_tags",
        phrase_tags,
        TEXTS
        + "SELECT doc_id, "
        + ", ".join(f"{_phrase(f)} AS {column_name(f)}" for f in PHRASES if f != "Transaction Type")
        + ", CASE WHEN contains(lower(t), 'add') OR contains(lower(t), 'new') THEN 'Add' WHEN contains(lower(t), 'update') THEN 'Update' WHEN contains(lower(t), 'term') THEN 'Term' END AS transaction_type"
        + f" FROM (SELECT *, {_phrase('Transaction Type')} AS t FROM texts)",
    ),
    ("token_values", token_values, TOKENS),
    ("transaction_types", transaction_types, TEXTS + f"SELECT doc_id, {_TYPE_CASE} AS transaction_type FROM texts"),
    (
        "prompts",
        prompts,
        "SELECT page_id, sha256('Please extract provider roster information from the following email content:' || chr(10) || chr(10) || p || chr(10) || chr(10) || 'Return the data in the exact JSON format specified in the system prompt.') AS prompt_hash,"
        f" length(p) AS size FROM (SELECT page_id, {_PROMPT} AS p FROM pages)",
    ),
    ("model_rows", model_rows, MODEL_ROWS),
    (
        "json_spans",
        json_spans,
        with_relations("completion")
        + f"SELECT completion_id, o IS NOT NULL AS parsed, json_extract_string(o, '$.\"Provider Name\"') AS provider_name, json_extract_string(o, '$.\"Term Date\"') AS term_date"
        f" FROM (SELECT completion_id, {q.json_object('completion')} AS o FROM completion_t)",
    ),
    (
        "preferred_rows",
        preferred_rows,
        SOURCED + "SELECT job_id, row_idx, source FROM (SELECT *, min(source) OVER (PARTITION BY job_id) AS m FROM s) WHERE source = m",
    ),
    (
        "merged_rows",
        merged_rows,
        SOURCED
        + "SELECT job_id, row_idx, source FROM (SELECT *, count(*) FILTER (source = 'model') OVER (PARTITION BY job_id) AS a, count(*) FILTER (source = 'rule') OVER (PARTITION BY job_id) AS b FROM s)"
        " WHERE source = CASE WHEN a > b THEN 'model' ELSE 'rule' END",
    ),
    (
        "extraction_statistics",
        extraction_statistics,
        SOURCED
        + "SELECT job_id, CASE WHEN source = 'model' THEN 'llm' ELSE 'html_table' END AS extraction_method, count(*) AS rows, CASE WHEN source = 'model' THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS avg_confidence FROM s GROUP BY job_id, source",
    ),
    (
        "assistance_routes",
        assistance,
        with_relations("attachment")
        + ", c AS (SELECT l_partkey * 2 AS a, count(*) AS n FROM lineitem GROUP BY 1)"
        ", f AS (SELECT mail_id AS job_id, bool_or(n IS NULL) AS needs_assistance, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_rows FROM attachment_t LEFT JOIN c ON a = attachment_id GROUP BY 1)"
        " SELECT *, CASE WHEN needs_assistance THEN 'assist' ELSE 'normalize' END AS after_extraction, CASE WHEN total_rows % 2 = 0 THEN 'review' ELSE 'version' END AS after_validation FROM f",
    ),
]
QUERIES = [(n, f, s.replace(") , ", "), ")) for n, f, s in QUERIES]
