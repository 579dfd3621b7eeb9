"""Delimited attachments in column expressions.

A text is cut at line ends that have an even number of quotes before them, and a
line at commas likewise, so quoted cells may hold both.  The patterns are
possessive: time is linear, and no depth grows with the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions.text import last_wins_map
from rosterloom.sources.spreadsheets import MISSING

_RECORD = r'[^"\r\n]*+(?:"[^"]*+(?:"|\z)[^"\r\n]*+)*+(?:\r\n|\r|\n|\z)'
_CELL = r',([^",]*+(?:"[^"]*+(?:"|\z)[^",]*+)*+)'


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 if they are that, else Latin-1, which takes any byte."""
    plain = content.cast("string")
    text = F.when(F.is_valid_utf8(plain), plain).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿", "")


def records(text: Column) -> Column:
    """Lines of a text without their ends, an open quote running on to the end."""
    lines = F.regexp_extract_all(text, F.lit(_RECORD), F.lit(0))
    # The pattern also matches the empty rest behind the last line end.
    kept = F.when(text.rlike(r"[^\r\n]\z"), F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    kept = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(kept)
    return F.transform(kept, lambda line: F.regexp_replace(line, r"(?:\r\n|\r|\n)\z", ""))


def cells(line: Column) -> Column:
    """Cells of a line: quotes around a part go, doubled ones stand for one."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), F.lit(1))
    bare = lambda c: F.array_join(F.transform(F.split(c, '""'), lambda part: F.replace(part, F.lit('"'), F.lit(""))), '"')
    whole = lambda c: F.when(F.startswith(c, F.lit('"')) & F.endswith(c, F.lit('"')) & (F.length(c) > 1), F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(c)
    return F.transform(raw, lambda c: F.when(F.contains(c, F.lit('"')), bare(whole(c))).otherwise(c))


def column_names(header: Column) -> Column:
    """Names of a header's cells: blanks are numbered, repeats get a suffix."""
    filled = F.transform(header, lambda name, i: F.when(name == "", F.concat(F.lit("Unnamed: "), i.cast("string"))).otherwise(name))

    def suffixed(name: Column, i: Column) -> Column:
        earlier = F.size(F.filter(F.slice(filled, F.lit(1), i), lambda other: other == name))
        return F.when(earlier > 0, F.concat(name, F.lit("."), earlier.cast("string"))).otherwise(name)

    return F.transform(filled, suffixed)


def read_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per line behind the header that is not blank: the columns of
    ``df``, ``line_no`` (from 1, quoted line ends do not count), ``row_idx`` (lines
    behind the header, from 0), ``line``, ``cells``, and the header's ``names``."""
    kept = [c for c in df.columns if c != text]
    lines = df.select(*kept, records(F.col(text)).alias("_lines"))
    first = F.get(F.filter("_lines", lambda line: line != ""), F.lit(0))
    headed = lines.select(*kept, "_lines", column_names(cells(first)).alias("names"), F.array_position("_lines", first).cast("int").alias("_first"))
    rows = headed.select(*kept, "names", "_first", F.posexplode_outer("_lines").alias("_pos", "line")).where("line <> ''")
    below = rows.where("_pos >= _first").withColumns({"line_no": F.col("_pos") + 1, "row_idx": F.col("_pos") - F.col("_first")})
    return below.select(*kept, "line_no", "row_idx", "line", "names", cells(F.col("line")).alias("cells"))


def graded_lines(lines: DataFrame) -> DataFrame:
    """Every line as a row with ``data``, its cells by name without those that mean
    no value, or, with more cells than the header has, as refused: ``read_error``
    holds it whole."""
    kept = [c for c in lines.columns if c not in ("line", "names", "cells")]
    fits = F.size("cells") <= F.size("names")
    count = F.least(F.size("cells"), F.size("names"))
    pairs = F.zip_with(
        F.slice("names", F.lit(1), count), F.slice("cells", F.lit(1), count), lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    )
    data = last_wins_map(F.filter(pairs, lambda e: ~e["value"].isin(*sorted(MISSING))))
    told = F.concat(F.lit("Line with "), F.size("cells").cast("string"), F.lit(" cells: "), F.col("line"))
    return lines.select(*kept, F.when(fits, data).alias("data"), F.when(~fits, told).alias("read_error"))


def read_csv_attachments(df: DataFrame, content: str = "content") -> DataFrame:
    """Rows of CSV files, and a row with ``read_error`` for each line that is
    refused, with its number, and for each file without a header.  Lines without
    any value give no row."""
    kept = [c for c in df.columns if c != content]
    texts = df.select(*kept, decoded(F.col(content)).alias("_text"))
    rows = graded_lines(read_lines(texts, "_text")).where("read_error IS NOT NULL OR size(data) > 0")
    bare = texts.where(~F.coalesce(F.col("_text").rlike(r"[^\r\n]"), F.lit(False)))
    told = bare.select(*kept, F.lit(-1).alias("row_idx"), F.lit("Unreadable CSV: no header").alias("read_error"))
    both = rows.unionByName(told, allowMissingColumns=True)
    return both.withColumns({"sheet": F.lit(None).cast("string"), "confidence": F.lit(0.95), "extraction_method": F.lit("csv")})
