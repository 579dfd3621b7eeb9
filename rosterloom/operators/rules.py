"""Rules kept as tables: phrases of any number, found in texts by a join.

Texts and phrases are cut into the same words, and every run of words in a text
that is as long as some phrase is looked for.  The first rule of a text counts, so
the phrases of the first rules, a bounded number, are looked for in all texts
first: a text that holds one of them needs no other rule.  In the texts left a
bitmap of all phrases' hashes, of a fixed size, keeps most runs from leaving their
task, and the rest meet the phrases.  Nothing is broadcast but bitmaps and the
first rules, so the table may have any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterloom.operators.known import BITS
from rosterloom.operators.skew import salted_lookup
from rosterloom.session import stored

MAX_WORDS = 8
#: Phrases looked for before all others.
FIRST = 1 << 16


def _plain(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case, with a blank between them.
    The pattern's named class is one table look-up a character."""
    return F.lower(F.trim(F.array_join(F.split(F.coalesce(text, F.lit("")), r"\P{Alnum}+"), " ")))


def _listed(plain: Column) -> Column:
    return F.when(plain != "", F.split(plain, " ")).otherwise(F.array().cast("array<string>"))


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case."""
    return _listed(_plain(text))


def _phrases(plain: Column, size: int) -> Column:
    """All runs of ``size`` words of a plain text.  A match is empty and stands
    where a word begins, so runs may overlap."""
    if size == 1:
        return _listed(plain)
    run = r"\w++" + r" \w++" * (size - 1)
    return F.regexp_extract_all(plain, F.lit(rf"(?<!\w)(?=({run}))"), F.lit(1))


def _bits(hashes: DataFrame, column: str, bits: int) -> DataFrame:
    """Hashes marked in a bitmap: at most ``bits / 64`` rows of 64 bits."""
    place = F.pmod(F.col(column), F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))
    return hashes.select(F.shiftright(place, 6).alias("_at"), one.alias("_bit")).groupBy("_at").agg(F.bit_or("_bit").alias("_bits"))


def _marked(df: DataFrame, column: str, bitmap: DataFrame, bits: int) -> DataFrame:
    """Rows whose hash is marked, and others by chance."""
    place = F.pmod(F.col(column), F.lit(bits))
    met = df.withColumn("_at", F.shiftright(place, 6)).join(F.broadcast(bitmap), "_at")
    return met.where(F.getbit("_bits", place.bitwiseAND(F.lit(63)).cast("int")) == 1).drop("_at", "_bits")


def match_rules(
    texts: DataFrame, rules: DataFrame, key: str, text: str, order: str = "rule_order", term: str = "term", value: str = "value",
    bits: int = BITS, first: int = FIRST,
) -> DataFrame:
    """The first rule, by ``order``, whose phrase is in a text: key, ``rule_order``
    and ``value``, for texts with any.  A phrase has at most ``MAX_WORDS`` words;
    one without words matches nothing.  Of rules with the same order, the smallest
    value counts.  ``first`` bounds the phrases that are looked for before the
    others and changes no result."""
    phrase = rules.select(F.col(order).alias("rule_order"), F.col(value).alias("value"), _plain(F.col(term)).alias("_phrase"))
    best = F.min(F.struct("rule_order", "value")).alias("_rule")
    size = F.size(_listed(F.col("_phrase"))).alias("_size")
    # The phrases serve several steps below.
    named = stored(phrase.groupBy("_phrase").agg(best).select("_phrase", "_rule", size).where(F.col("_size").between(1, MAX_WORDS)))
    sizes = sorted(r["_size"] for r in named.select("_size").distinct().collect())  # at most MAX_WORDS of them

    def runs(df: DataFrame) -> DataFrame:
        plain = df.select(key, _plain(F.col(text)).alias("_plain"))
        found = F.concat(*[_phrases(F.col("_plain"), n) for n in sizes]) if sizes else F.array().cast("array<string>")
        return plain.select(key, F.explode(found).alias("_phrase"))

    # A number in place of the rule keeps the minimum a hash aggregate.
    place = F.row_number().over(Window.orderBy("_rule")).alias("_nth")
    early = named.orderBy("_rule").limit(first).select("_phrase", "_rule", place)
    nth = F.min("_nth").alias("_nth")
    met = stored(runs(texts).join(F.broadcast(early.drop("_rule")), "_phrase").groupBy(key).agg(nth))
    sure = met.join(F.broadcast(early.drop("_phrase")), "_nth").select(key, "_rule")
    # Texts without an early rule, and others by chance, which changes no minimum.
    same = F.struct(key).alias("_key")
    rest = texts.select(same).join(met.select(same), "_key", "left_anti").select(F.xxhash64("_key").alias("_hash"))
    open_texts = _marked(texts.select(key, text, F.xxhash64(F.struct(key)).alias("_hash")), "_hash", _bits(rest, "_hash", bits), bits)
    grams = runs(open_texts).withColumn("_hash", F.xxhash64("_phrase"))
    index = _bits(named.select(F.xxhash64("_phrase").alias("_hash")), "_hash", bits)
    likely = stored(_marked(grams, "_hash", index, bits).select(key, "_phrase").distinct())
    late = salted_lookup(likely, named.select("_phrase", "_rule"), ["_phrase"], [key], how="inner").select(key, "_rule")
    return sure.unionByName(late).groupBy(key).agg(F.min("_rule").alias("_rule")).select(key, "_rule.*")
