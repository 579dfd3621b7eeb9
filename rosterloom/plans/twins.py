"""SQL text builders for the check queries.  They state each rule a second time,
in the check engine's own functions, and share no code with the Spark side."""

from __future__ import annotations

from rosterloom.functions.text import WHITESPACE


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(e: str) -> str:
    return f"trim({e}, {lit(WHITESPACE)})"


def blank(e: str) -> str:
    return f"({e} IS NULL OR {strip(e)} = '')"


def sentinel(e: str) -> str:
    return f"coalesce(lower({strip(e)}) = 'information not found', false)"


def missing(e: str) -> str:
    return f"({blank(e)} OR {sentinel(e)})"


def title(e: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({e}, '(\\p{{L}}+|[^\\p{{L}}]+)'), "
        "lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '')"
    )


def has_any(e: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({e}, {lit(w)})" for w in words) + ")"


def luhn(e: str, prefix: str = "") -> str:
    """Sum of digits from the right, every second one doubled."""
    number = f"('{prefix}' || {e})"
    size = 10 + len(prefix)
    digit = f"CAST(substr({number}, {size} + 1 - CAST(i AS INT), 1) AS INT)"
    doubled = f"CASE WHEN i % 2 = 0 THEN (2 * {digit}) // 10 + (2 * {digit}) % 10 ELSE {digit} END"
    return (
        f"(CASE WHEN regexp_full_match({e}, '[0-9]{{10}}') THEN "
        f"list_sum(list_transform(range(1, {size + 1}), lambda i: {doubled})) % 10 = 0 ELSE false END)"
    )


def date(e: str) -> str:
    formats = ["%m/%d/%Y", "%m-%d-%Y", "%Y-%m-%d", "%Y/%m/%d", "%B %d, %Y", "%b %d, %Y", "%d %B %Y", "%d %b %Y"]
    return f"CAST(try_strptime({e}, [{', '.join(lit(f) for f in formats)}]) AS DATE)"


def us_date(e: str) -> str:
    return f"coalesce(strftime({date(strip(e))}, '%m/%d/%Y'), {e})"


def national(e: str) -> str:
    """Ten digits of a North American number or NULL."""
    digits = f"regexp_replace({e}, '[^0-9]', '', 'g')"
    ten = f"CASE WHEN length({digits}) = 11 AND {digits}[1] = '1' THEN substr({digits}, 2) ELSE {digits} END"
    plain = f"regexp_full_match({e}, '[0-9() .+-]*') AND NOT regexp_matches({e}, '^\\s*\\+[^1]')"
    return f"CASE WHEN {plain} AND regexp_full_match({ten}, '[2-9][0-9]{{2}}[2-9][0-9]{{6}}') THEN {ten} END"


def national_text(e: str) -> str:
    n = f"({national(e)})"
    return f"'(' || substr({n}, 1, 3) || ') ' || substr({n}, 4, 3) || '-' || substr({n}, 7)"


EMAIL = "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}"
PHONE = "\\([0-9]{3}\\) [0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\\.[0-9]{3}\\.[0-9]{4}|[0-9]{10}|\\+1[0-9]{10}"


def is_email(e: str) -> str:
    return f"regexp_full_match({e}, {lit(EMAIL)})"


def is_phone(e: str) -> str:
    return f"regexp_full_match({e}, {lit(PHONE)})"


def low_address(e: str) -> str:
    return (
        f"(length({e}) < 10 OR NOT contains({e}, ',') OR NOT regexp_matches({e}, '[0-9]')"
        f" OR {has_any(f'lower({e})', ['unknown', 'n/a', 'tbd'])})"
    )


ADDRESS = (
    "(?i)^\\s*(\\d+[A-Za-z]?)\\s+((?:(?:N|S|E|W|NE|NW|SE|SW|North|South|East|West|Northeast|Northwest|Southeast|Southwest)\\.?\\s+)?"
    "[A-Za-z0-9][A-Za-z0-9''\\- ]*?\\s+(?:St|Street|Ave|Avenue|Rd|Road|Blvd|Boulevard|Dr|Drive|Ln|Lane|Ct|Court|Pl|Place|Way|Pkwy|Parkway"
    "|Cir|Circle|Ter|Terrace|Hwy|Highway|Sq|Square|Trl|Trail))\\b\\.?(?:\\s*,)?"
    "(?:\\s*(Suite|Ste|Apt|Apartment|Unit|Room|Rm|Floor|Fl|Bldg|Building)\\.?\\s*#?\\s*([A-Za-z0-9\\-]+))?"
)


def address(e: str) -> str:
    part = lambda i: f"regexp_extract({e}, '{ADDRESS}', {i})"
    unit = f"CASE WHEN {part(3)} <> '' THEN {part(3)} || ' ' || {part(4)} END"
    return f"CASE WHEN {part(1)} <> '' THEN concat_ws(', ', {part(1)}, {part(2)}, {unit}) END"


def split_line(e: str) -> str:
    cells = (
        f"CASE WHEN contains({e}, chr(9)) THEN string_split({e}, chr(9))"
        f" WHEN contains({e}, '  ') THEN string_split({e}, '  ')"
        f" WHEN contains({e}, ' | ') THEN string_split({e}, ' | ')"
        f" WHEN contains({e}, '|') THEN string_split({e}, '|')"
        f" WHEN contains({e}, ',') THEN string_split({e}, ',')"
        f" ELSE string_split_regex({strip(e)}, '\\s{{2,}}') END"
    )
    return f"list_transform({cells}, lambda c: {strip('c')})"


def json_object(e: str) -> str:
    """Object between the outermost braces as JSON, NULL if it does not parse."""
    text = f"nullif(regexp_extract({e}, '(?s)\\{{.*\\}}', 0), '')"
    return f"CASE WHEN json_valid({text}) THEN CAST({text} AS JSON) END"
