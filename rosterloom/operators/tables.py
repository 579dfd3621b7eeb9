"""HTML tables, cell grids and delimited text to rows.

Everything here works on arrays inside one artifact row: a mail is bounded by
the intake size limit, so finding the tables, choosing the best one, naming its
columns and cutting it into rows needs no shuffle at all.
"""

from __future__ import annotations

from html import entities, unescape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions.text import contains_any, last_wins_map, split_line, strip
from rosterloom.operators.skew import explode_rows, salted_lookup
from rosterloom.schema import (
    HEADER_HINTS,
    HEADER_RULES,
    ROSTER_TERMS,
    SENTINEL,
    TABLE_SENTINEL_FIELDS,
)

_SKIPPED = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
# A tag with its attributes; a quoted value may hold ">", and an open quote ends nothing.
_TAG = r"""<(/?[A-Za-z][A-Za-z0-9]*+)\b[^<>"']*+(?:"[^"<]*+"[^<>"']*+|'[^'<]*+'[^<>"']*+)*+>"""
_TABLE_TAG = r"(?i)(?=</?table\b)"
_ROW_TAG = r"(?i)</?tr\b[^>]*>"
# A cell: its opening tag as far as the next one, and the text before whatever ends it.
# Nothing here goes back, so a cell of any length is read in one pass.
_CELL = r"(?is)<t[dh]\b(?:(?!<t[dh]\b)[^>])*+>?+((?:(?!</?(?:t[dhr]|thead|tbody|tfoot|caption)\b).)*+)"
# Anything that the steps of a cell's text would change: tags, entities, line ends, blanks
# at an end or beside each other, and all that is not visible ASCII.
_ROUGH = r"[^ -%'-;=-~]|^ | $|  "
_FIRST_TAG = r"^<[^>]*>"
_ENTITY = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def _entity_map() -> Column:
    """Literal map of the named entities and of the numbers that do not mean
    their own code point; non-breaking blanks become plain ones."""
    known = {name[:-1]: chars for name, chars in entities.html5.items() if name.endswith(";")}
    known |= {f"#{n}": unescape(f"&#{n};") for n in range(128, 160)} | {"nbsp": " ", "#160": " "}
    joined = lambda values: F.split(F.lit("\u0001".join(values)), "\u0001")
    return F.map_from_arrays(joined(known), joined(known.values()))


def decode_entities(text: Column) -> Column:
    """Named, decimal and hexadecimal entities, each decoded once; anything else
    behind an ampersand stays as written."""
    known = _entity_map()

    def char(name: Column) -> Column:
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10).cast("bigint")).when(
            F.startswith(name, F.lit("#")), F.substring(name, 2, 7).cast("bigint")
        )
        found = F.try_element_at(known, F.coalesce(F.concat(F.lit("#"), number), name))
        real = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        decoded = F.when(real, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("�")
        return F.when(found.isNotNull(), found).when(number.isNotNull(), decoded).otherwise(F.concat(F.lit("&"), name, F.lit(";")))

    parts = F.transform(
        F.split(text, "&"), lambda p, i: F.struct(p.alias("raw"), F.when(i > 0, F.regexp_extract(p, _ENTITY, 1)).alias("name"))
    )
    plain = F.transform(
        parts,
        lambda p: F.when(p["name"].isNull(), p["raw"])
        .when(p["name"] == "", F.concat(F.lit("&"), p["raw"]))
        .otherwise(F.concat(char(p["name"]), F.substr(p["raw"], F.length(p["name"]) + 2))),
    )
    return F.array_join(plain, "")


def cell_text(cell: Column) -> Column:
    """Text of a cell; most cells are plain already and pass one pattern only."""
    text = F.regexp_replace(cell, r"<[^>]+>", "")
    decoded = F.when(F.contains(cell, F.lit("&")), decode_entities(text)).otherwise(text)
    return F.when(cell.rlike(_ROUGH), F.regexp_replace(strip(decoded), r"[\r\n]+|\s{2,}", " ")).otherwise(cell)


def _table_texts(html: Column) -> Column:
    """Content of each table in the order of their opening tags, without that of
    the tables inside it.  The text is cut at table tags only, and a stack of the
    open tables says whose piece each one is; an end tag may be missing."""
    pieces = F.split(F.regexp_replace(F.regexp_replace(html, _SKIPPED, ""), _TAG, "<$1>"), _TABLE_TAG)
    start = F.struct(
        F.lit(0).alias("seen"),
        F.array().cast("array<int>").alias("open"),
        F.array().cast("array<struct<table:int,text:string>>").alias("out"),
    )

    def step(state: Column, piece: Column) -> Column:
        opens = piece.rlike(r"(?i)^<table\b")
        seen = state["seen"] + opens.cast("int")
        around = F.slice(state["open"], F.lit(1), F.greatest(F.size(state["open"]) - 1, F.lit(0)))
        stack = (
            F.when(opens, F.array_append(state["open"], seen))
            .when(piece.rlike(r"(?i)^</table\b"), around)
            .otherwise(state["open"])
        )
        mine = F.struct(F.coalesce(F.try_element_at(stack, F.lit(-1)), F.lit(0)).alias("table"), piece.alias("text"))
        return F.struct(seen.alias("seen"), stack.alias("open"), F.array_append(state["out"], mine).alias("out"))

    def gathered(state: Column) -> Column:
        numbers = F.when(state["seen"] > 0, F.sequence(F.lit(1), state["seen"])).otherwise(F.array().cast("array<int>"))
        inside = lambda n: F.filter(state["out"], lambda p: p["table"] == n)
        return F.transform(
            numbers, lambda n: F.array_join(F.transform(inside(n), lambda p: F.regexp_replace(p["text"], _FIRST_TAG, "")), "")
        )

    return F.aggregate(pieces, start, step, gathered)


def parse_tables(html: Column) -> Column:
    """``array<struct<has_th, grid array<array<string>>>>`` of all tables, nested
    ones as tables of their own.

    Rows and cells are cut at their opening tags, so end tags may be left out.
    Inside a lambda nothing is shared between two uses of an expression, so each
    step is a transform of its own over the step before."""
    rows = F.transform(
        _table_texts(html), lambda t: F.filter(F.split(t, _ROW_TAG), lambda r: r.rlike(r"(?i)<t[dh]\b"))
    )

    def cells_of(row: Column) -> Column:
        return F.transform(F.regexp_extract_all(row, F.lit(_CELL), F.lit(1)), cell_text)

    def to_table(rows: Column) -> Column:
        first = F.coalesce(F.try_element_at(rows, F.lit(1)), F.lit(""))
        return F.struct(first.rlike(r"(?is)^(?!.*<td\b).*<th\b").alias("has_th"), F.transform(rows, cells_of).alias("grid"))

    return F.transform(rows, to_table)


def html_cells(df: DataFrame, html: str = "html") -> DataFrame:
    """One row per cell of every table: ``table_idx, row_idx, col_idx, cell``."""
    tables = df.withColumn("_tables", parse_tables(F.col(html))).drop(html)
    rows = explode_rows(tables, "_tables", "_table", "table_idx").withColumn("_grid", F.col("_table.grid"))
    cells = explode_rows(rows.drop("_table"), "_grid", "_cells", "row_idx")
    return explode_rows(cells, "_cells", "cell", "col_idx")


def body_rows(table: Column) -> Column:
    grid = table["grid"]
    return F.when(table["has_th"], F.slice(grid, F.lit(2), F.greatest(F.size(grid) - 1, F.lit(0)))).otherwise(grid)


def table_width(table: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(table["grid"], F.size)), F.lit(0))


def table_score(rows: Column, columns: Column, content: Column) -> Column:
    """Cells, plus points for roster words, several rows and a usual width."""
    terms = sum((F.contains(content, F.lit(t)).cast("int") for t in ROSTER_TERMS), F.lit(0))
    score = (
        rows * columns
        + terms * 5
        + F.when(rows > 1, 10).otherwise(0)
        + F.when(columns.between(3, 10), 5).otherwise(0)
    )
    return F.when((rows > 0) & (columns > 0), score).otherwise(0)


def select_best_table(tables: Column) -> Column:
    """Highest score wins, the first one on a tie; NULL without a scoring table.
    ``struct<score, neg_idx, width, table>``."""
    bodied = F.transform(tables, lambda t: F.struct(t.alias("table"), body_rows(t).alias("body"), table_width(t).alias("width")))
    measured = F.transform(
        bodied,
        lambda t: F.struct(
            t["table"].alias("table"),
            t["width"].alias("width"),
            F.size(t["body"]).alias("rows"),
            F.lower(F.array_join(F.flatten(t["body"]), " ")).alias("content"),
        ),
    )
    scored = F.transform(
        measured,
        lambda t, i: F.struct(
            table_score(t["rows"], t["width"], t["content"]).alias("score"),
            (-i).alias("neg_idx"),
            t["width"].alias("width"),
            t["table"].alias("table"),
        ),
    )
    return F.array_max(F.filter(scored, lambda t: t["score"] > 0))


def looks_like_header(cells: Column) -> Column:
    return contains_any(F.lower(F.array_join(cells, " ")), HEADER_HINTS)


def clean_header(header: Column) -> Column:
    return strip(F.regexp_replace(F.lower(header), "[:#]", ""))


def map_header(header: Column, rules=None) -> Column:
    """Target field of one cleaned header by ordered keyword rules."""
    chain = None
    for field, terms in rules or HEADER_RULES:
        hit = contains_any(header, terms)
        chain = F.when(hit, field) if chain is None else chain.when(hit, field)
    return chain


def strict_rules() -> list[tuple[str, list[str]]]:
    """The same terms as one-term rules, longest first: ``group npi`` before ``npi``."""
    single = [(field, term) for field, terms in HEADER_RULES for term in terms]
    return [(field, [term]) for field, term in sorted(single, key=lambda p: -len(p[1]))]


def positional_fields(values: Column) -> Column:
    """Fields by position for a table whose headers say nothing (three or more
    columns): name, then NPI and specialty in either order, then the wider forms."""
    count = F.size(values)

    def cell(i: int) -> Column:
        return F.coalesce(F.try_element_at(values, F.lit(i + 1)), F.lit(""))

    npi = r"^[0-9]{10}$"
    npi_second = cell(1).rlike(npi)
    entries = [
        (3, "Provider Name", cell(0)),
        (3, "Provider NPI", F.when(npi_second, cell(1)).when(cell(2).rlike(npi), cell(2)).otherwise("")),
        (3, "Provider Specialty", F.when(npi_second, cell(2)).otherwise(cell(1))),
        (6, "Transaction Type", F.when(cell(3) != "", cell(3)).otherwise("Update")),
        (6, "Effective Date", cell(4)),
        (6, "Term Date", cell(5)),
        (8, "State License", cell(6)),
        (8, "Organization Name", cell(7)),
        (10, "TIN", cell(8)),
        (10, "Complete Address", cell(9)),
    ]
    return F.array_compact(
        F.array(
            *[
                F.when(count >= need, F.struct(F.lit(field).alias("key"), value.alias("value")))
                for need, field, value in entries
            ]
        )
    )


def with_defaults(data: Column, defaults: dict[str, str]) -> Column:
    """Fill fields a row does not carry."""
    if not defaults:
        return data
    base = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(data, k)), data)


def table_defaults(**values: str) -> dict[str, str]:
    """Sentinel for the fields a table may lack.  Anything else, such as an
    organization known from the sender, is the caller's to give."""
    return {field: SENTINEL for field in TABLE_SENTINEL_FIELDS} | values


def table_rows(df: DataFrame, html: str = "html", rules=None, promote_over_th: bool = False, defaults=None) -> DataFrame:
    """Rows of the best table of each artifact: ``row_idx, data MAP, confidence,
    extraction_method``.  Headers are mapped once per table, not once per row."""
    best = df.withColumn("_best", select_best_table(parse_tables(F.col(html))))
    bodied = best.withColumn("_all", body_rows(F.col("_best.table")))
    has_th = F.col("_best.table.has_th")
    promote = (F.size("_all") > 1) & looks_like_header(F.col("_all")[0])
    if not promote_over_th:
        promote = promote & ~has_th
    decided = bodied.withColumn("_promote", promote)
    header = (
        F.when(F.col("_promote"), F.col("_all")[0])
        .when(has_th, F.col("_best.table.grid")[0])
        .otherwise(F.array().cast("array<string>"))
    )
    cleaned = F.transform(header, clean_header)
    shaped = decided.withColumns(
        {
            "_fields": F.transform(cleaned, lambda h: map_header(h, rules)),
            "_body": F.when(F.col("_promote"), F.slice("_all", F.lit(2), F.size("_all"))).otherwise(F.col("_all")),
            "_width": F.col("_best.width"),
        }
    )
    wide = shaped.withColumn("_blind", ~F.exists("_fields", lambda f: f.isNotNull()) & (F.col("_width") >= 3))

    def named(cells: Column) -> Column:
        return F.filter(
            F.zip_with("_fields", cells, lambda f, v: F.struct(f.alias("key"), v.alias("value"))),
            lambda e: e["key"].isNotNull() & e["value"].isNotNull() & ~F.lower(e["value"]).isin("", "nan", "none"),
        )

    filled = F.transform(
        "_body",
        lambda cells, i: F.struct(
            i.alias("row_idx"), cells.alias("cells"), F.filter(cells, lambda v: v != "").alias("values")
        ),
    )
    entries = F.transform(
        filled,
        lambda r: F.struct(
            r["row_idx"].alias("row_idx"),
            F.when(F.col("_blind") & (F.size(r["values"]) >= 3), positional_fields(r["values"]))
            .otherwise(named(r["cells"]))
            .alias("entries"),
        ),
    )
    kept = F.filter(entries, lambda r: F.size(r["entries"]) > 0)
    shaped = wide
    rows = explode_rows(shaped.select(*[c for c in df.columns if c != html], kept.alias("_rows")), "_rows", "_row")
    data = last_wins_map(F.col("_row.entries"))
    return (
        rows.withColumns({"row_idx": F.col("_row.row_idx"), "data": data})
        .withColumn("data", with_defaults(F.col("data"), table_defaults() if defaults is None else defaults))
        .withColumns({"confidence": F.lit(0.9), "extraction_method": F.lit("html_table")})
        .drop("_row")
    )


def delimited_arrays(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_names``, the header cells of a delimited text, and ``_rows``, its
    data lines; ``_rows`` is NULL or empty for a text without such rows."""
    lines = df.withColumn("_lines", F.split(strip(F.col(text)), "\n"))
    found = F.filter(
        F.transform("_lines", lambda line, i: F.struct(i.alias("at"), strip(line).alias("line"))),
        lambda e: e["line"].rlike(r"\S\s+\S"),
    )
    headed = lines.withColumn("_head", F.try_element_at(found, F.lit(1)))
    named = headed.withColumn("_names", split_line(F.col("_head.line")))
    below = F.slice("_lines", F.col("_head.at") + 2, F.size("_lines"))
    kept = F.filter(
        F.transform(
            below,
            lambda line, i: F.struct(i.alias("row_idx"), (strip(line) == "").alias("blank"), split_line(line).alias("values")),
        ),
        lambda r: ~r["blank"] & (F.size(r["values"]) >= F.size("_names")),
    )
    structured = F.when((F.size("_names") >= 2) & (F.size("_lines") > 1), kept)
    return named.select(*df.columns, "_names", structured.alias("_rows"))


def delimited_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows of delimited text under its first line of two or more words."""
    entries = F.zip_with(
        "_names",
        F.slice("_row.values", F.lit(1), F.size("_names")),
        lambda n, v: F.struct(n.alias("key"), v.alias("value")),
    )
    return (
        explode_rows(delimited_arrays(df, text).drop(text), "_rows", "_row")
        .withColumns({"row_idx": F.col("_row.row_idx"), "data": last_wins_map(entries)})
        .withColumns({"confidence": F.lit(0.7), "extraction_method": F.lit("plain_text_structured")})
        .drop("_names", "_row")
    )


def grid_to_rows(cells: DataFrame, doc: list[str], confidence: float = 0.8) -> DataFrame:
    """Rows from a ``cells(doc…, page, table, row, col, text)`` relation.

    Row 0 of a table names its columns.  Cells meet their header by a salted
    equi-join, as one long table repeats its header keys for every row, and are
    gathered per grid row, which is as wide as the table and no more.
    """
    place = [*doc, "page", "table"]
    headers = cells.where("row = 0").select(
        *place,
        "col",
        F.when(F.coalesce(F.col("text"), F.lit("")) == "", F.concat(F.lit("col_"), F.col("col")))
        .otherwise(strip(F.col("text")))
        .alias("_name"),
    )
    filled = cells.where((F.col("row") > 0) & (F.coalesce(F.col("text"), F.lit("")) != ""))
    joined = salted_lookup(filled, headers, [*place, "col"], spread=["row"], how="inner")
    entries = F.array_sort(F.collect_list(F.struct("col", "_name", "text")))
    pairs = F.transform(entries, lambda e: F.struct(e["_name"].alias("key"), strip(e["text"]).alias("value")))
    return joined.groupBy(*place, "row").agg(last_wins_map(pairs).alias("data")).select(
        *doc,
        F.concat_ws("_", "page", "table", "row").alias("row_key"),
        "page",
        "table",
        "row",
        "data",
        F.lit(confidence).alias("confidence"),
    )


def pick_columns(header: Column, wanted: list[str]) -> Column:
    """Index of the first header for each wanted name, -1 without one.  A header
    fits when it contains the name or the name contains it, case aside."""
    lowered = F.transform(header, F.lower)

    def first(name: str) -> Column:
        low = name.lower()
        hits = F.transform(
            lowered, lambda h, i: F.when(F.contains(h, F.lit(low)) | F.contains(F.lit(low), h), i)
        )
        return F.coalesce(F.array_min(hits), F.lit(-1))

    return F.create_map(*[x for name in wanted for x in (F.lit(name), first(name))])


def _picked_rows(df: DataFrame, keep: list[str], body: str, fits) -> DataFrame:
    """Rows of ``body`` (arrays of cells) reduced to the columns in ``_pick``."""

    def cells_of(cells: Column) -> Column:
        return F.map_filter(
            F.transform_values("_pick", lambda k, i: strip(F.try_element_at(cells, i + 1))),
            lambda k, v: v.isNotNull() & (v != ""),
        )

    rows = F.filter(
        F.transform(body, lambda c, i: F.struct(i.alias("row_idx"), fits(c).alias("fits"), cells_of(c).alias("data"))),
        lambda r: r["fits"] & (F.size(r["data"]) > 0),
    )
    out = explode_rows(df.select(*keep, rows.alias("_rows")), "_rows", "_row")
    return out.select(*keep, F.col("_row.row_idx").alias("row_idx"), F.col("_row.data").alias("data"))


def schema_rows(df: DataFrame, wanted: list[str], grid: str = "grid") -> DataFrame:
    """Rows of a grid restricted to the wanted names, empty cells left out."""
    header = F.transform(F.coalesce(F.try_element_at(grid, F.lit(1)), F.array().cast("array<string>")), strip)
    picked = df.withColumns(
        {
            "_pick": F.map_filter(pick_columns(header, wanted), lambda k, i: i >= 0),
            "_body": F.when(F.size(grid) >= 2, F.slice(grid, F.lit(2), F.size(grid))),
        }
    )
    return _picked_rows(picked, [c for c in df.columns if c != grid], "_body", lambda c: F.lit(True))


def spaced_text_rows(df: DataFrame, wanted: list[str], text: str = "text") -> DataFrame:
    """The same for blank-separated text: the header is the first line of two or
    more words, and every line but the first one of the text is data."""
    lines = F.split(strip(F.col(text)), "\n")
    words = F.transform(lines, lambda line: F.filter(F.split(strip(line), r"\s+"), lambda w: w != ""))
    split = df.withColumn("_words", words)
    header = split.withColumn("_header", F.try_element_at(F.filter("_words", lambda w: F.size(w) >= 2), F.lit(1)))
    picked = header.withColumns(
        {
            "_pick": F.map_filter(pick_columns(F.col("_header"), wanted), lambda k, i: i >= 0),
            "_body": F.when(
                (F.size("_words") >= 2) & F.col("_header").isNotNull(), F.slice("_words", F.lit(2), F.size("_words"))
            ),
        }
    )
    return _picked_rows(
        picked,
        [c for c in df.columns if c != text],
        "_body",
        lambda c: (F.size(c) > 0) & (F.size(c) >= F.size("_pick")),
    )


def page_kind(pages: DataFrame, doc: list[str]) -> DataFrame:
    """Native or scanned per document: over 100 characters on its first three
    pages.  ``pages(doc…, page, text)``, pages counted from 1."""
    first = [F.max(F.when(F.col("page") == p, F.col("text"))).alias(f"_p{p}") for p in (1, 2, 3)]
    head = pages.where("page <= 3").groupBy(*doc).agg(*first)
    return head.select(
        *doc,
        F.when(F.length(strip(F.concat_ws("", "_p1", "_p2", "_p3"))) > 100, "PDF_NATIVE")
        .otherwise("PDF_SCANNED")
        .alias("document_type"),
    )


def page_statistics(kinds: DataFrame, rows: DataFrame, scanned_pages: DataFrame) -> DataFrame:
    """Counts over all documents, one row, in one pass over the union."""
    none = F.lit(0).cast("bigint")

    def tally(df: DataFrame, **hits: Column) -> DataFrame:
        names = ["pdfs_processed", "native_pdfs", "scanned_pdfs", "rows_extracted", "vlm_pages"]
        return df.select(*[hits.get(n, none).cast("bigint").alias(n) for n in names])

    native = F.col("document_type") == "PDF_NATIVE"
    parts = (
        tally(kinds, pdfs_processed=F.lit(1), native_pdfs=native, scanned_pdfs=~native)
        .unionAll(tally(rows, rows_extracted=F.lit(1)))
        .unionAll(tally(scanned_pages, vlm_pages=F.lit(1)))
    )
    return parts.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in parts.columns])
