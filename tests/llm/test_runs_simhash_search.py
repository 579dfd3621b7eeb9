"""Periodic runs, SimHash components and ranked search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from rosterloom.llm import lexical, queries, runs, simhash
from tests.llm.conftest import ODD

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def fibonacci(n):
    a, b = "x", "xy"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def random_words(r):
    letters, n = r.randint(1, 4), r.choice([0, 1, 5, 6, 7, 30, 90, 200])
    kind = r.randrange(4)
    if kind == 0:
        return [r.randrange(letters) for _ in range(n)]
    if kind == 1:
        return fibonacci(n)
    if kind == 2:
        return [bin(i).count("1") % 2 for i in range(n)]
    words = []
    while len(words) < n:
        unit = [r.randrange(letters) for _ in range(r.randint(1, 9))]
        words += (unit * r.randint(1, 8))[: r.randint(1, 60)]
    return words


def test_runs_equal_brute_force():
    r = random.Random(11)
    for _ in range(1200):
        texts = [random_words(r) for _ in range(r.randint(1, 5))]
        assert runs.find_runs(texts) == [brute_runs(w) for w in texts]


def test_runs_of_nested_and_long_texts():
    block = ["a"] * 9 + ["b"]
    assert runs.find_runs([block * 5]) == [brute_runs(block * 5)]
    assert runs.find_runs([["a"] * 100_000]) == [[(0, 100_000, 1)]]
    unit = [f"w{i}" for i in range(7_000)]
    assert runs.find_runs([["z"] + unit * 5 + ["z"]]) == [[(1, 35_000, 7_000)]]
    assert runs.find_runs([["a"] * 30_000 + ["b"] + ["a"] * 30_000]) == [[(0, 30_000, 1), (30_001, 30_000, 1)]]


def test_runs_do_not_depend_on_rounds_or_batches(monkeypatch, documents):
    r = random.Random(2)
    texts = [random_words(r) for _ in range(60)]
    wanted = [brute_runs(w) for w in texts]
    for rounds in (0, 1, 3):
        monkeypatch.setattr(runs, "ROUNDS", rounds)
        monkeypatch.setattr(runs, "BATCH_PERIODS", 50 + rounds)
        assert runs.find_runs(texts) == wanted


def rewritten(key, words):
    drawn = zlib.crc32(str(key).encode()) if key is not None else 1
    if drawn % 10 or not words:
        return words
    g = drawn // 10
    start = g % len(words)
    period = 1 + (len(words) - start) // (3 + g % 8)
    return [words[i] if i < start else words[start + (i - start) % period] for i in range(len(words))]


def test_run_query_equals_brute_force(spark, tmp_path, documents):
    r = random.Random(4)
    rows = [(i, " \n".join(f"w{r.randrange(3)}" for _ in range(r.choice([0, 1, 7, 60, 150])))) for i in range(150)]
    rows += [(i, t) for i, t in ODD if t is None or len(t) < 100] + [(None, "a " * 8)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    wanted = []
    for key, text in rows:
        words = rewritten(key, WORDS.findall(text or ""))
        found = brute_runs(words)
        best = max(found, key=lambda f: (f[1], -f[0], -f[2]), default=None)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        wanted.append((
            key, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
        ))
    got = [tuple(x) for x in queries.op11_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert sum(w[1] > 0 for w in wanted) > 15
    empty = documents([])
    assert runs.periodic_runs(empty).count() == 0


def brute_mark(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    marks = [brute_mark(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if (marks[a] ^ marks[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    out = []
    for a, (key, _) in enumerate(rows):
        keys = [k for b, (k, _) in enumerate(rows) if find(b) == find(a) and k is not None]
        out.append((key, f"{marks[a]:016x}", min(keys) if keys else None))
    return out


def test_simhash_query_equals_brute_force(spark, tmp_path, documents):
    r = random.Random(7)
    base = [f"w{r.randrange(5000)}" for _ in range(300)]
    rows = [(100 + i, " ".join(f"v{r.randrange(5000)}" for _ in range(r.choice([1, 2, 3, 4, 40])))) for i in range(80)]
    for i in range(120):
        words = list(base)
        for _ in range(r.randint(0, 4)):
            words[r.randrange(300)] = f"x{i}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(5000 + i, "the same text for a third of all") for i in range(100)] + ODD
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(x) for x in queries.op12_simhash(spark, str(tmp_path)).collect()]
    wanted = brute_components(rows)
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert len({w[2] for w in wanted}) < len({w[1] for w in wanted})
    assert simhash.simhash_components(documents([])).count() == 0


@pytest.mark.parametrize("tile", [64, 4096])
def test_links_connect_all_near_fingerprints(spark, tile):
    r = random.Random(tile)
    centre = r.getrandbits(64)
    marks = {0, (1 << 64) - 1, 7, 15, 31}
    for _ in range(700):
        x = centre if r.random() < 0.6 else r.getrandbits(64)
        marks.add(x)
        for b in r.sample(range(64), r.randint(1, 6)):
            x ^= 1 << b
        marks.add(x)
    signed = sorted(m - (1 << 64) if m >> 63 else m for m in marks)
    got = [tuple(x) for x in simhash.linked(spark.createDataFrame([(m,) for m in signed], "mark bigint"), tile=tile).collect()]
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in got)
    assert classes(signed, got) == classes(signed, near)


def classes(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_every_home_is_among_the_anchors_of_its_neighbours(spark):
    r = random.Random(9)
    points = [r.getrandbits(32) for _ in range(40)]
    rows = [(p,) for p in points] + [(p ^ 1 << b,) for p in points for b in range(32)]
    got = simhash.anchored(spark.createDataFrame(rows, "mark bigint").distinct()).where("anchor < (1L << 32)").collect()
    home, all_ = {}, {}
    for row in got:
        all_.setdefault(row.mark, set()).add(row.anchor)
        if row.home:
            assert home.setdefault(row.mark, row.anchor) == row.anchor
    for p in points:
        assert len(all_[p]) <= 17
        assert all(home[p] in all_[p ^ 1 << b] and home[p ^ 1 << b] in all_[p] for b in range(32))


def brute_search(items, rows, best=20):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    terms = lambda t: pattern.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    documents = [(key, Counter(terms(t))) for key, t in rows]
    count = sum(bool(c) for _, c in documents)
    total = sum(sum(c.values()) for _, c in documents)
    df = Counter(t for _, c in documents for t in c)
    out = []
    for item, text in items:
        asked = terms(text)
        scored = []
        for key, c in documents:
            m = 75 + 25 * sum(c.values()) * count // max(1, total)
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t in asked if t in c
            )
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scored)[:best])]
    return sorted(out, key=repr)


def zipf_text(r, words):
    return " ".join(f"w{int(r.paretovariate(0.6)) % 400}" for _ in range(words))


@pytest.mark.parametrize("cells", [2_000_000, 60])
def test_search_equals_brute_force(spark, documents, monkeypatch, cells):
    """With one block of queries and with several."""
    r = random.Random(13)
    rows = [(i, zipf_text(r, r.choice([1, 5, 40, 40, 200]))) for i in range(150)] + ODD
    items = [(i, zipf_text(r, 8)) for i in range(12)] + [(50, None), (51, "..."), (52, "Hello, HELLO naïve 日本語 word")]
    monkeypatch.setattr(lexical.query_blocks, "__defaults__", (cells,))
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    assert (len(list(lexical.query_blocks(asked, "item_id", "text"))) == 1) == (cells > 60)
    got = [tuple(x) for x in lexical.search(asked, documents(rows)).collect()]
    assert sorted(got, key=repr) == brute_search(items, rows)


def test_windows_and_lots_of_a_searcher(monkeypatch):
    """Small windows and lots give the same best documents as one dense pass."""
    import numpy as np

    r = random.Random(5)
    weights = np.array([[r.choice([0, 0, 3, 9]) for _ in range(30)] for _ in range(6)])
    rows = []
    for i in range(400):
        held = sorted(r.sample(range(30), r.randint(1, 9)))
        times = [r.randint(1, 5) for _ in held]
        rows.append((i, r.choice([75, 76, 90, 140]), np.array(held, dtype=np.int32).tobytes(), np.array(times, dtype=np.int32).tobytes()))
    rows.sort(key=lambda x: x[1])
    wanted = []
    for w in weights:
        scores = []
        for i, m, held, times in rows:
            s = sum(int(w[t]) * (10**9 * int(f) // (1000 * int(f) + 12 * m)) for t, f in zip(np.frombuffer(held, np.int32), np.frombuffer(times, np.int32)))
            scores.append((-s, i))
        wanted.append([(-s, i) for s, i in sorted(scores)[:20] if s < 0])
    for window, lot, cells in ((400, 512, 2_000_000), (37, 5, 100), (64, 1, 31)):
        monkeypatch.setattr(lexical, "LOT", lot)
        monkeypatch.setattr(lexical, "CELLS", cells)
        searcher = lexical.Searcher(weights, 20)
        for first in range(0, 400, window):
            searcher.window(rows[first : first + window])
        assert searcher.kept == wanted


def test_search_without_rows(spark, documents):
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert lexical.search(items, documents([])).count() == 0
    assert lexical.search(items.where("false"), documents(ODD)).count() == 0
    assert lexical.search(items, documents([(1, None), (2, "..")])).count() == 0
