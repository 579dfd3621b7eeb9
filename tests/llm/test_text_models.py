"""Personal data, language, quality, the queries' SQL and the pipeline."""

import glob
import hashlib
import itertools
import os
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rosterloom.llm import language_id, pii, quality, queries
from tests.conftest import SF_DIR
from tests.llm.conftest import ODD

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    draw = random.Random(1)
    parts = [*"0123456789", "@", ".", "-", " ", "+", "(", ")", "a", "b.c", "a@b.c", "1.2.3.4", "255", "0000", "4111111111111111", "+1 (988) 555-2485", "é", "password=", "IBAN GB82 WEST 1234 5698 7654 32", "http://x.y/z?q", "ssn: 123-45-6789", "://"]
    for _ in range(20_000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 30)))
        assert [s for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS] == brute_spans(text), text


@pytest.mark.parametrize("text,kind,found", [
    ("pay to IBAN GB82 WEST 1234 5698 7654 32 today", "account", "GB82 WEST 1234 5698 7654 32"),
    ("IBAN: GB82WEST12345698765433", "account", None),
    ("see https://u:p@h.org/x?y=1, ok", "url", "https://u:p@h.org/x?y=1"),
    ("password=b7db7aa4a5 x", "account", "b7db7aa4a5"),
    ('token = "0cab398dc11d1a2a"', "account", "0cab398dc11d1a2a"),
    ("SSN: 123-45-6789.", "account", "123-45-6789"),
    ("SSN: 000-45-6789.", "account", None),
    ("the password is lost", "account", None),
    ("a :// b", "url", None),
])
def test_added_kinds(text, kind, found):
    assert [text[a:b] for k, a, b in pii.find_spans(text) if k == kind] == ([found] if found else [])


def test_address_with_more_zeros_than_int_reads():
    zeros = "0" * 5000
    assert ("ip", 0, 5006) in pii.find_spans(zeros + ".0.0.0")
    assert not [s for s in pii.find_spans(zeros + "256.0.0.0") if s[0] == "ip"]


def test_pii_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = queries.op1_pii(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in BASE]
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in pii.find_spans(texts[r.doc_id]))


def test_pii_of_odd_texts_and_masks(odd, documents):
    assert pii.detect(odd).count() == len(ODD) and pii.detect(odd.where("false")).count() == 0
    rows = documents([(1, None), (2, "mail a@b.co now"), (3, "+1 (988) 555-2485"), (4, "nothing here")])
    assert [r.text for r in pii.redact(rows).orderBy("doc_id").collect()] == [None, "mail [EMAIL] now", "[PHONE]", "nothing here"]


def all_cuts(word):
    for marks in itertools.product([0, 1], repeat=len(word) - 1):
        cut, parts = 0, []
        for i, mark in enumerate(marks, 1):
            if mark:
                parts.append(word[cut:i])
                cut = i
        yield [*parts, word[cut:]]


def test_forward_sums_all_segmentations():
    names = ["▁", "▁a", "a", "b", "ab", "ba", "aba"]
    lattice = language_id.Lattice(names)
    weights = np.random.default_rng(1).random((len(names) + 1, 2))
    for word in ["a", "ab", "abab", "bax", "xx"]:
        total = np.zeros(2)
        for cut in all_cuts("▁" + word):
            if all(p in names or p == "x" for p in cut):
                total += np.prod([weights[names.index(p) if p in names else -1] for p in cut], axis=0)
        alpha = language_id.forward([word], lattice.arcs([word]), weights)
        assert np.allclose(alpha[0, len(word) + 1], total)
        model = language_id.Model(["p", "q"], weights, public_tokenizers.path(language_id.VOCABULARY))
        scorer = language_id.Scorer(model)
        scorer.lattice = lattice
        assert np.allclose(scorer.long_word(word), np.log(total))


def test_expectation_counts_pieces():
    names = ["▁", "a", "b", "ab"]
    lattice = language_id.Lattice(names)
    weights = np.array([[0.3], [0.2], [0.1], [0.4], [1e-7]])
    found = language_id.expected(["ab"], np.array([2.0]), lattice, weights)
    one, two = 0.3 * 0.2 * 0.1, 0.3 * 0.4
    assert np.allclose(found[:4], [2, 2 * one / (one + two), 2 * one / (one + two), 2 * two / (one + two)])


def test_language_query_on_held_out_texts(spark):
    labels = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = queries.op5_language_id(spark, SF_DIR).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(labels) and 0 < len(held) < len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([labels[r.doc_id] == r.lang_pred for r in held]) >= 0.95


def test_languages_of_odd_texts(documents):
    learn = documents([(i, "the cat and the dog ran home") for i in range(5)]).unionByName(
        documents([(i, "der hund und die katze gehen heim") for i in range(5, 10)], lang="de")
    ).unionByName(documents([(10, "ni hao")], lang=None))
    model = language_id.fit(learn)
    assert model.languages == ["de", "en"]
    rows = documents([*ODD, (20, "12 34 !?"), (21, "hund und katze"), (22, "²½")])
    found = {r.doc_id: r for r in language_id.predict(rows, model).collect()}
    assert found[21].lang_pred == "de" and {found[i].lang_pred for i in (1, 2, 3, 20, 22)} == {"und"}
    assert found[20].score == 0
    nothing = language_id.fit(learn.where("false"))
    assert {r.lang_pred for r in language_id.predict(rows, nothing).collect()} == {"und"}


def test_slopes_of_the_ordinal_likelihood():
    draw = np.random.default_rng(2)
    score, cuts, grades = draw.normal(size=30), np.array([-0.5, 0.7]), draw.integers(0, 3, 30)

    def loss(s, c):
        below = 1 / (1 + np.exp(s[:, None] - c))
        upper = np.c_[below, np.ones(30)][np.arange(30), grades]
        lower = np.c_[np.zeros(30), below][np.arange(30), grades]
        return -np.log(upper - lower).sum()

    pull, rise = quality.grade_slopes(score, cuts, grades)
    step = 1e-6
    for i in range(30):
        moved = score + step * (np.arange(30) == i)
        assert abs((loss(moved, cuts) - loss(score, cuts)) / step - pull[i]) < 1e-4
    for k in range(2):
        assert abs((loss(score, cuts + step * (np.arange(2) == k)) - loss(score, cuts)) / step - rise[k]) < 1e-3


def test_quality_on_rows_not_fitted():
    path = "/root/testdata/sf0.1"
    rows = duckdb.sql(
        f"SELECT text, quality, toxic FROM '{path}/documents.parquet' JOIN '{path}/labels.parquet' USING (doc_id) ORDER BY doc_id"
    ).fetchall()
    random.Random(1).shuffle(rows)
    grades = np.array([0 if toxic else 1 if not good else 2 for _, good, toxic in rows])
    sets = [np.array(sorted(quality.features(t)), dtype="<u4") for t, _, _ in rows]
    half = len(rows) // 2
    model = quality.regress(sets[:half], grades[:half])
    assert list(model.thresholds) == sorted(model.thresholds)
    good = np.array([1 - 1 / (1 + np.exp(model.score(t) - model.thresholds[-1])) for t, _, _ in rows[half:]]) >= quality.MIN_TAIL
    assert good[grades[half:] == 2].mean() >= 0.98
    assert 1 - good[grades[half:] == 0].mean() >= 0.7
    assert 1 - good[grades[half:] == 1].mean() >= 0.8


def test_toxic_recall_of_each_language_on_rows_not_fitted():
    path = "/root/testdata/sf0.1"
    rows = duckdb.sql(
        f"SELECT text, lang, quality, toxic FROM '{path}/documents.parquet' JOIN '{path}/labels.parquet' USING (doc_id) ORDER BY doc_id"
    ).fetchall()
    grades = np.array([0 if toxic else 1 if not good else 2 for *_, good, toxic in rows])
    langs = np.array([lang for _, lang, *_ in rows])
    sets = [np.array(sorted(quality.features(r[0])), dtype="<u4") for r in rows]
    for half in range(2):
        fitted = np.arange(len(rows)) % 2 == half
        model = quality.regress([s for s, on in zip(sets, fitted) if on], grades[fitted])
        score = np.array([sum(model.weights.get(f, 0.0) for f in s.tolist()) for s in sets])
        kept = 1 - 1 / (1 + np.exp(score - model.thresholds[-1])) >= quality.MIN_TAIL
        for lang in set(langs):
            rated = ~fitted & (langs == lang)
            assert kept[rated & (grades == 0)].mean() <= 0.15, lang
            assert kept[rated & (grades == 2)].mean() >= 0.97, lang


def test_stems_count_forms_of_a_word_once_and_twice():
    stem, twice = quality.bucket("stem abcde"), quality.bucket("stem abcde") ^ quality.TWICE
    one, same, two = (quality.features(t) for t in ("Abcdefg", "abcdefg, ABCDEFG abcde", "abcdefg abcdeee"))
    assert stem in one & same & two and twice in two and twice not in one | same


def test_quality_of_odd_texts(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (9, 1, 1), (7, None, None), (None, 1, 0), (77, 0, 0)], "doc_id bigint, quality int, toxic int")
    rows = quality.rate(odd, quality.fit(odd, labels)).collect()
    assert len(rows) == len(ODD) and all(0 <= r.p_good <= 1 and 0 <= r.expected_grade <= 2 for r in rows)
    empty = quality.fit(odd, labels.where("false"))
    assert len({r.p_good for r in quality.rate(odd, empty).collect()}) == 1
    assert quality.rate(odd.where("false"), empty).count() == 0


@pytest.mark.parametrize("name,build,sql", [q for q in queries.QUERIES if q[2]], ids=[q[0] for q in queries.QUERIES if q[2]])
def test_queries_match_their_sql(spark, name, build, sql):
    duck = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = build(spark, SF_DIR)
    columns = sorted(df.columns)
    answer = duck.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(map(repr, answer))


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = docs.columns
    good = corpus_pipeline.keep_good(spark, docs, SF_DIR).cache()
    marks = {r.doc_id: r.toxic or not r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert np.mean([i in kept for i, bad in marks.items() if not bad]) >= 0.95
    once = corpus_pipeline.drop_copies(spark, good, SF_DIR).cache()
    largest = {}
    for r in good.collect():
        text = re.sub("[A-Z]", lambda m: m.group().lower(), r.text)
        largest[text] = max(largest.get(text, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in once.collect()) == sorted(largest.values())
    apart = corpus_pipeline.drop_near_copies(spark, once, SF_DIR).cache()
    from tests.llm.test_dedup import brute_classes

    classes = brute_classes([(r.doc_id, r.text) for r in once.collect()])
    assert sorted(r.doc_id for r in apart.collect()) == sorted({c for _, c, _, _ in classes})
    masked = corpus_pipeline.mask_personal_data(spark, apart, SF_DIR)
    assert {(r.doc_id, r.text, r.n_chars) for r in masked.collect()} == {(r.doc_id, pii.masked(r.text), len(pii.masked(r.text))) for r in apart.collect()}
    for stage in (good, once, apart, masked):
        assert stage.columns == names
    packed = corpus_pipeline.pack(spark, masked, SF_DIR)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in apart.collect()}


def test_pipeline_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
    ids = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF_DIR).select("doc_id").collect()} == ids
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "PII", "best-fit packing"]


def test_stages_take_odd_rows(spark, documents, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, SF_DIR).count() > 0
        assert stage(spark, docs.where("false"), SF_DIR).count() == 0
