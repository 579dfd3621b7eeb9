"""The registered queries of this folder: name, builder, check SQL (None where
SQL cannot say it or is too slow on whole tables; tests then use brute force)."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.llm import (
    bpe, exact_dedup, jaccard_join, language_id, lexical, packing, pii, quality, runs, simhash, token_counts, topk, warc,
)
from rosterloom.llm.common import code, table

TOKEN_LIMIT = 4096


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    found = pii.detect(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[pii.count_kind(spans, kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.written(spans, pii.BASE_KINDS), 256).alias("base_sha256"),
        pii.written(spans).alias("spans"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select(
        "doc_id",
        F.octet_length(code(F.col("text"))).cast("bigint").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_round_trip(table(spark, sf_dir, "pages"), min_bytes=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), digest="text_sha256")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(documents.where(~held_out))
    texts = documents.select("doc_id", held_out.alias("held_out"), "text")
    return language_id.predict(texts, model, carry=("held_out",))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(documents, table(spark, sf_dir, "labels"))
    return quality.rate(documents, model).select("doc_id", "expected_grade", "p_good", quality.selected().alias("kept"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(topk.divisible_queries(vectors), vectors)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_texts(table(spark, sf_dir, "documents"))
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def periodised(key: Column, text: Column) -> Column:
    """The text, or for every tenth key (by hash) its words with a part of them
    in place of all that follow."""
    words = F.array_remove(F.split(code(text), r"[\x20\x09-\x0D]+"), "")
    drawn = F.crc32(key.cast("string").cast("binary"))
    n, g = F.greatest(F.size(words), F.lit(1)), F.floor(drawn / 10)
    start = (g % n).cast("int")
    period = (1 + F.floor((n - start) / (3 + g % 8))).cast("int")
    part = F.array_repeat(F.slice(words, start + 1, period), F.ceil((n - start) / period).cast("int"))
    rewritten = F.slice(F.concat(F.slice(words, F.lit(1), start), F.flatten(part)), F.lit(1), n)
    return F.when((drawn % 10 == 0) & (F.size(words) > 0), F.array_join(rewritten, " ")).otherwise(text)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    texts = documents.select("doc_id", periodised(F.col("doc_id"), F.col("text")).alias("text"))
    found = runs.periodic_runs(texts)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("*", longest.alias("_longest")).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("_longest.col2")).alias("start"),
        F.col("_longest.length").alias("length"),
        (-F.col("_longest.col3")).alias("period"),
        F.expr("1000 * _longest.length div -_longest.col3").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("mark"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


_BITS = " || ".join(f"lpad(bin(('0x' || substr(h, {1 + 2 * i}, 2))::INT), 8, '0')" for i in range(20))
OP3_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
     b AS (SELECT *, {_BITS} AS bits FROM p),
     d AS (SELECT *, list_reduce(list_transform(range(0, 160, 5),
               lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ('0b' || substr(bits, 1 + i, 5))::INT, 1)),
               lambda x, y: x || y) AS payload_digest,
           min(page_id) OVER (PARTITION BY h) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

OP4_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS n
           FROM documents),
     g AS (SELECT *, max(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM g
"""

OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP9_SQL = r"""
WITH RECURSIVE w AS (
       SELECT doc_id, string_split_regex(trim(lower(coalesce(text, '')), E' \n\t\r'), '\s+') AS words FROM documents),
     g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN words = [''] THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
              ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS gram FROM w),
     n AS (SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id),
     c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b USING (gram)
           WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
     l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
           WHERE common * 5 >= (x.size + y.size - common) * 4),
     r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other),
     k AS (SELECT doc_id, min(other) AS class_id, count(*) AS class_size FROM r GROUP BY doc_id)
SELECT doc_id, class_id, class_size, (SELECT count(*) FROM l WHERE l.a = k.doc_id) AS n_links FROM k
"""

_TERMS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
     c AS (SELECT count(*) FILTER (len(t) > 0)::BIGINT AS docs, sum(len(t))::BIGINT AS terms FROM d),
     p AS (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d),
     f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p GROUP BY r, doc_id, n, term),
     w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, c GROUP BY term),
     q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
     s AS (SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
           FROM q JOIN f USING (term) JOIN w USING (term), c GROUP BY item_id, r, doc_id),
     k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""

QUERIES = [
    ("op1_pii", op1_pii, None),
    ("op2_token_counts", op2_token_counts, None),
    ("op3_warc", op3_warc, OP3_SQL),
    ("op4_exact_dedup", op4_exact_dedup, OP4_SQL),
    ("op5_language_id", op5_language_id, None),
    ("op6_quality", op6_quality, None),
    ("op7_packing", op7_packing, None),
    ("op8_topk", op8_topk, OP8_SQL),
    ("op9_jaccard_join", op9_jaccard_join, OP9_SQL),
    ("op10_bpe", op10_bpe, None),
    ("op11_runs", op11_runs, None),
    ("op12_simhash", op12_simhash, None),
    ("op13_lexical", op13_lexical, OP13_SQL),
]
