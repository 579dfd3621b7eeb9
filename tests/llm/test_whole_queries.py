"""Whole queries that SQL cannot say, against brute force; limits of time and memory."""

import math
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rosterloom.llm import language_id, pii, quality, queries
from tests.conftest import SF_DIR
from tests.llm.test_dedup import brute_classes, lowered


def test_language_query_equals_a_plain_forward_pass(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = language_id.fit(documents.where(~language_id.held_out(F.col("doc_id"))))
    names = language_id.lattice_of(model.path)
    import sentencepiece

    file = sentencepiece.SentencePieceProcessor(model_file=model.path)
    pieces = [file.id_to_piece(i) for i in range(file.get_piece_size())]
    pieces = [p for p in pieces if p == language_id.START or language_id.LETTERS.fullmatch(p.removeprefix(language_id.START))]
    number = {p: i for i, p in enumerate(pieces)}
    known: dict[str, np.ndarray] = {}

    def log_forward(word):
        if word not in known:
            text = language_id.START + word
            alpha = [np.ones(len(model.languages))] + [np.zeros(len(model.languages)) for _ in text]
            for end in range(1, len(text) + 1):
                for start in range(max(0, end - names.longest), end):
                    piece = number.get(text[start:end])
                    if piece is not None:
                        alpha[end] = alpha[end] + alpha[start] * model.weights[piece]
                    elif end == start + 1:
                        alpha[end] = alpha[end] + alpha[start] * model.weights[-1]
            known[word] = np.log(np.maximum(alpha[-1], 1e-300))
        return known[word]

    texts = {r.doc_id: r.text for r in documents.collect()}
    for row in queries.op5_language_id(spark, SF_DIR).collect():
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
        words = language_id.LETTERS.findall((texts[row.doc_id] or "").lower())
        if not words:
            assert (row.lang_pred, row.score) == ("und", 0.0)
        elif max(map(len, words)) <= language_id.LONG_WORD:
            total = sum(log_forward(w) for w in words)
            best = int(np.argmax(total))
            assert row.lang_pred == model.languages[best]
            assert row.score == pytest.approx(1 / np.exp(total - total[best]).sum(), abs=1e-9)


def test_words_of_any_length_keep_their_sums(monkeypatch):
    pieces = ["▁", "a", "b", "ab", "ba", "aba", "▁a"]
    weights = np.random.default_rng(1).random((len(pieces) + 1, 2)) / 4
    scorer = language_id.Scorer(language_id.Model(["p", "q"], weights, public_tokenizers.path(language_id.VOCABULARY)))
    scorer.lattice = language_id.Lattice(pieces)
    word = "abaabbac" * 40
    whole = scorer.long_word(word)
    for window in (3, 7, 64):
        monkeypatch.setattr(language_id, "WINDOW", window)
        assert scorer.long_word(word) == pytest.approx(whole, rel=1e-12)
    monkeypatch.setattr(language_id, "WINDOW", 4096)
    import tracemalloc

    tracemalloc.start()
    assert np.isfinite(scorer.long_word("日" * 300_000)).all()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000  # far below that of all arcs at once


def test_quality_query_equals_its_definition(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    model = quality.fit(documents, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    logistic = lambda x: 1 / (1 + math.exp(-x))
    for row in queries.op6_quality(spark, SF_DIR).collect():
        latent = sum(model.weights.get(f, 0.0) for f in quality.features(texts[row.doc_id]))
        tails = [logistic(latent - cut) for cut in model.thresholds]
        assert row.p_good == pytest.approx(tails[-1], abs=1e-9)
        assert row.expected_grade == pytest.approx(sum(tails), abs=1e-9)
        assert row.kept == (row.p_good >= quality.MIN_TAIL)


def test_dotted_runs_take_linear_time():
    spans = pii.find_spans("1." * 500_000)  # load
    start = time.perf_counter()
    pii.find_spans("1." * 50_000)
    small = time.perf_counter() - start
    start = time.perf_counter()
    spans = pii.find_spans("1." * 500_000)
    assert time.perf_counter() - start < 30 * small + 0.5
    assert len([s for s in spans if s[0] == "ip"]) == 125_000


def test_pipeline_equals_its_stages_by_brute_force(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = quality.fit(documents, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    good = quality.rate(documents, model).where(quality.selected()).select("doc_id", "text").collect()
    last = defaultdict(int)
    for r in good:
        last[lowered(r.text)] = max(last[lowered(r.text)], r.doc_id)
    rows = [(r.doc_id, r.text) for r in good if last[lowered(r.text)] == r.doc_id]
    kept = [(i, t) for (i, t), c in zip(rows, brute_classes(rows)) if c[1] == i]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = {i: [*tokenizer.encode(pii.masked(t), add_special_tokens=False).ids, 2] if t else [2] for i, t in kept}

    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in corpus_pipeline.run(spark, SF_DIR).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == wanted.keys()
    for i, ids in wanted.items():
        place = 0
        for r in sorted(pieces[i], key=lambda r: r.piece):
            part = np.array(ids[r.start : r.start + r.length], dtype="<u4")
            assert r.start == place and r.ids_crc32 == zlib.crc32(part.tobytes())
            place += r.length
        assert place == len(ids)
    for parts in sequences.values():
        place = 0
        for offset, length in sorted(parts):
            assert offset == place
            place += length
        assert place <= 1024
