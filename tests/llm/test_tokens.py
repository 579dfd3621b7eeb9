"""Token counts, encoding and packing against the public libraries."""

import hashlib
import json
import random
import zlib
from array import array
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from rosterloom.llm import bpe, packing, queries, token_counts
from tests.conftest import SF_DIR
from tests.llm.conftest import ODD


def library(name):
    found = tokenizers.Tokenizer.from_file(public_tokenizers.path(name))
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def fuzz(count, parts, longest=25, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice(parts) for _ in range(draw.randint(0, longest))) for _ in range(count)]


PARTS = ["a", "E", "th", "ing", " ", " ", "  ", "\n", "\n ", "12", "é", "日", "😀", "\t", ".", "!!", "'s", "x" * 5, "\x00", "Σ", "<|endoftext|>", "<|", "▁", "\xa0", "____"]


def test_transducer_counts_as_the_library(pieces):
    machine = token_counts.load(public_tokenizers.path("piece_bpe_32k.model"))
    words = [p.replace("▁", " ") for p in list(machine.scores)[::97]]
    for text in [*fuzz(3000, PARTS), *fuzz(3000, words, 12), *fuzz(1000, list("abcdefgh "), 60), "ab" * 20_000, " " * 5_000]:
        for chunk in (3, 7, 1 << 16):
            assert machine.count(text, chunk) == len(pieces.encode(text)), text[:200]


def test_transducer_forgets_states_without_harm(pieces):
    machine = token_counts.Transducer(token_counts.load(public_tokenizers.path("piece_bpe_32k.model")).scores, 50, 20)
    for text in fuzz(400, PARTS):
        assert machine.count(text) == len(pieces.encode(text))


def test_state_maps_compose_in_any_order():
    machine = token_counts.load(public_tokenizers.path("piece_bpe_32k.model"))
    for text in fuzz(200, ["ab", " ", "c", "the", "  "], 40):
        a, b, c = (machine.state_map(t) for t in (text[:7], text[7:15], text[15:]))
        left = machine.compose(machine.compose(a, b), c)
        right = machine.compose(a, machine.compose(b, c))
        assert (left.head, left.body) == (right.head, right.body) and left.exit is right.exit


def test_token_count_query(spark, pieces):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = queries.op2_token_counts(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(pieces.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


def test_token_counts_of_odd_texts(odd, pieces):
    rows = token_counts.count_tokens(odd, name="source").collect()
    assert sorted(r.source for r in rows) == sorted(len(pieces.encode(t or "")) for _, t in ODD)
    assert token_counts.count_tokens(odd.where("false")).count() == 0


def expected_bpe(tool, text):
    ids = tool.encode(text or "", add_special_tokens=False).ids
    return len(ids), array("I", ids).tobytes(), tool.decode(ids, skip_special_tokens=False)


def test_codec_encodes_as_the_library():
    codec, tool = bpe.load(public_tokenizers.path("word_bpe_49k.json")), library("word_bpe_49k.json")
    for text in [*fuzz(4000, PARTS), "ab" * 20_000]:
        ids, decoded = codec.encode(text)
        assert (len(ids) // 4, ids, decoded) == expected_bpe(tool, text)


def test_merges_take_the_best_rank_first():
    """Merges work on ids; the plain form works on the file's own strings."""
    path = public_tokenizers.path("word_bpe_49k.json")
    codec = bpe.load(path)
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    vocab, end = model["vocab"], model["end_of_word_suffix"]
    ranks = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): rank for rank, m in enumerate(model["merges"])}

    def plain(symbols):
        while True:
            ranked = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
            if not ranked:
                return symbols
            i = min(ranked)[1]
            symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]

    for word in fuzz(500, list("abcdefghinorst"), 20):
        if word:
            symbols = [*word[:-1], word[-1] + end]
            assert codec.merge([vocab[s] for s in symbols]) == [vocab[s] for s in plain(symbols)]


def test_bpe_of_odd_texts_and_decoding(odd):
    tool = library("word_bpe_49k.json")
    encoded = bpe.encode_texts(odd)
    rows = encoded.collect()
    assert sorted((r.n_tokens, bytes(r.ids), r.decoded) for r in rows) == sorted(expected_bpe(tool, t) for _, t in ODD)
    again = bpe.decode_ids(encoded).collect()
    assert sorted(r.decoded for r in again) == sorted(r.decoded for r in rows)
    assert bpe.encode_texts(odd.where("false")).count() == 0


def test_bpe_query(spark):
    tool = library("word_bpe_49k.json")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in queries.op10_bpe(spark, SF_DIR).collect():
        n, ids, decoded = expected_bpe(tool, texts[r.doc_id])
        assert r.n_tokens == n
        assert r.ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_fast_ids_are_the_library_s():
    encoder = packing.load(public_tokenizers.path(packing.VOCABULARY), public_tokenizers.path(packing.RANKS))
    tool = library("byte_bpe_50k.json")
    for text in [*fuzz(4000, PARTS), "a" + " " * 6000 + "b", "ab" * 20_000]:
        assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == tool.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("blank", ["\n", "\t"])
def test_long_blanks_inside_a_word_go_to_the_library(blank):
    encoder = packing.load(public_tokenizers.path(packing.VOCABULARY), public_tokenizers.path(packing.RANKS))
    tool = library("byte_bpe_50k.json")
    for text in ["a" + blank * 2_000_000 + "b", "to a" + blank * 2_000_000 + "b"]:
        assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == tool.encode(text, add_special_tokens=False).ids


def check_packing(rows, texts, capacity=1024):
    tool = library("byte_bpe_50k.json")
    wanted = []
    for text in texts:
        ids = [*tool.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(min(first, len(ids)), len(ids) + 1, capacity)]
        wanted += [(n, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(wanted)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
        assert sum(parts[-1]) <= capacity
    return len(bins), sum(r.length for r in rows)


def test_packing_query(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    used, total = check_packing(queries.op7_packing(spark, SF_DIR).collect(), texts)
    assert used <= 1.03 * -(-total // 1024) + 1


def test_packing_of_odd_texts(odd):
    check_packing(packing.pack_documents(odd).collect(), [t for _, t in ODD])
    assert packing.pack_documents(odd.where("false")).count() == 0


def test_packed_ids_come_back(odd):
    parts = packing.token_pieces(odd, with_ids=True)
    packed = packing.pack(parts, ["doc_id", "piece", "start", "ids_crc32"])
    held = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert held[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)


def best_sum(lengths, slack):
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums if s + n <= slack}
    return max(sums)


def test_filling_is_the_fullest():
    draw = random.Random(3)
    for _ in range(200):
        counts = {draw.randint(1, 40): draw.randint(1, 4) for _ in range(6)}
        slack = draw.randint(0, 90)
        found = packing.fullest(sorted(counts, reverse=True), counts, slack)
        assert all(n <= counts[length] for length, n in found)
        assert sum(length * n for length, n in found) == best_sum([length for length, n in counts.items() for _ in range(n)], slack)


def test_plan_places_every_piece():
    draw = random.Random(4)
    for _ in range(50):
        histogram = {draw.randint(1, 100): draw.choice([1, 2, 10, 10**9]) for _ in range(20)}
        used = defaultdict(int)
        for pattern in packing.plan_sequences(histogram, 100):
            assert sum(length * n for length, n in pattern.lengths) <= 100
            for length, n in pattern.lengths:
                used[length] += n * pattern.sequences
        assert dict(used) == histogram


def test_ranks_are_dense_when_one_length_owns_all(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(7).cast("bigint").alias("length"))
    ranks = [r["rank"] for r in packing.ranked(rows, ["doc_id"]).collect()]
    assert sorted(ranks) == list(range(5000))


def test_ids_are_packed_as_little_endian_32_bit():
    for ids in ([], [0], [1, 50_000, 2**32 - 1]):
        assert packing.packed(ids) == b"".join(i.to_bytes(4, "little") for i in ids)
