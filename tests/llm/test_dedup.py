"""Exact groups, near-duplicate classes, WARC and top-k against brute force."""

import base64
import hashlib
import io
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterloom.llm import exact_dedup, jaccard_join, topk, warc
from rosterloom.llm.common import fold_bitmap, shared_folder, with_bitmap_flag, without
from tests.llm.conftest import ODD


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact_groups_of_odd_texts(odd):
    groups = defaultdict(list)
    for i, t in ODD:
        groups[lowered(t)].append(i)
    wanted = []
    for i, t in ODD:
        ids = [x for x in groups[lowered(t)] if x is not None]
        keep = max(ids) if ids else None
        wanted.append((i, keep, len(groups[lowered(t)]), i == keep, hashlib.sha256(lowered(t).encode()).hexdigest()))
    rows = exact_dedup.exact_groups(odd, digest="sha", prefix_chars=2).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.sha) for r in rows), key=key) == sorted(wanted, key=key)
    assert exact_dedup.exact_groups(odd.where("false")).count() == 0


@pytest.mark.parametrize("share", [0, 0.33, 1])
def test_exact_groups_with_a_hot_text(documents, share):
    rows = [(i, "same text" if i < 600 * share else f"text {i:05d}") for i in range(600)]
    found = exact_dedup.exact_groups(documents(rows)).collect()
    hot = int(600 * share)
    assert sum(r.kept for r in found) == 600 - max(0, hot - 1)
    assert {r.group_size for r in found} == ({hot} if hot else set()) | ({1} if hot < 600 else set())


def test_bitmap_never_misses(spark):
    rows = spark.range(3000).withColumn("k", F.col("id") * 7)
    flagged = with_bitmap_flag(rows, "k", fold_bitmap(rows.where("id % 3 = 0"), "k", 1 << 16), 1 << 16, "on")
    got = flagged.select("id", "on").collect()
    assert len(got) == 3000 and all(r.on for r in got if r.id % 3 == 0)
    assert sum(r.on for r in got if r.id % 3) < 150


def test_without_drops_only_what_is_listed(spark):
    rows = spark.createDataFrame([(1, 10), (1, 11), (None, 10), (2, None)], "doc_id bigint, m bigint")
    dropped = spark.createDataFrame([(1, 10), (None, 10), (2, None)], "doc_id bigint, m bigint")
    assert [tuple(r) for r in without(rows, dropped, "doc_id", "m").collect()] == [(1, 11)]


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_classes(rows):
    sets = [grams(t) for _, t in rows]
    links = [[b for b in range(len(rows)) if b != a and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])] for a in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        for a, near in enumerate(links):
            root[a] = min([root[a], *(root[b] for b in near)])
    out = []
    for a, (i, _) in enumerate(rows):
        same = [b for b in range(len(rows)) if root[b] == root[a]]
        ids = [rows[b][0] for b in same if rows[b][0] is not None]
        out.append((i, min(ids) if ids else None, len(same), len(links[a])))
    return out


def near_rows(copies=60, seed=5):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(150)]
    passage = " ".join(word() for _ in range(20))
    rows = []
    for i in range(copies):
        words = list(base)
        for _ in range(draw.randint(0, 5)):
            words[draw.randrange(150)] = word()
        rows.append((i, " ".join(words)))
    rows += [(100 + i, passage + " " + " ".join(word() for _ in range(draw.randint(30, 200)))) for i in range(60)]
    rows += [(200, "one two"), (201, "One TWO"), (202, "three"), (203, ""), (204, None), (205, " \n"), (None, "one two"), (206, base and " ".join(base)), (206, " ".join(base))]
    return rows


@pytest.mark.parametrize("leaf,tile,depth", [(1024, 1024, 3), (16, 8, 3), (16, 1024, 2)])
def test_classes_and_links(documents, leaf, tile, depth):
    rows = near_rows()
    found = jaccard_join.jaccard_classes(documents(rows), recall=0.9999999, leaf=leaf, tile=tile, depth=depth).collect()
    key = lambda r: tuple(map(repr, r))
    got = sorted(((r.doc_id, r.class_id, r.class_size, r.n_links) for r in found), key=key)
    assert got == sorted(brute_classes(rows), key=key)


def test_links_of_more_near_copies_than_a_leaf_holds(documents):
    draw = random.Random(190)  # with these words, the paths of 15 runs miss pairs
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(98)]
    rows = []
    for i in range(1300):
        at = draw.randrange(98)
        rows.append((i, " ".join([*base[:at], word(), *base[at + 1 :]])))
    sets = [grams(t) for _, t in rows]
    place = {g: k for k, g in enumerate(set().union(*sets))}
    held = np.zeros((len(rows), len(place)), dtype=np.float32)
    for i, s in enumerate(sets):
        held[i, [place[g] for g in s]] = 1
    common, sizes = held @ held.T, held.sum(axis=1)
    links = (5 * common >= 4 * (sizes[:, None] + sizes - common)).sum(axis=1) - 1
    found = {r.doc_id: (r.class_id, r.class_size, r.n_links) for r in jaccard_join.jaccard_classes(documents(rows)).collect()}
    assert links.min() > jaccard_join.LEAF and found == {i: (0, 1300, links[i]) for i, _ in rows}


def test_runs_below_miss_as_rarely_as_at_the_first_level():
    miss = lambda runs, depth: (1 - jaccard_join.survival(depth)) ** runs
    for depth in (1, 2, 3):
        runs = jaccard_join.runs_for(0.999, depth)
        below = jaccard_join.runs_below(runs, depth)
        assert miss(below, depth) <= miss(runs, 1) * 1.000001 and (depth > 1 or below == runs)


def test_classes_of_an_empty_table(odd):
    assert jaccard_join.jaccard_classes(odd.where("false")).count() == 0


def test_runs_reach_the_recall():
    draw = np.random.default_rng(1)
    start, hits, trials = jaccard_join.roots(7), 0, 400
    for _ in range(trials):
        tokens = draw.integers(0, 2**63, 220, dtype=np.uint64)
        x, y = np.sort(tokens[:200]), np.sort(tokens[20:])
        hits += bool(len(np.intersect1d(jaccard_join.children(start, x, 1.25), jaccard_join.children(start, y, 1.25))))
    assert jaccard_join.runs_for(0.999, 1) == 7 and hits / trials >= 0.99


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r.node, r.root) for r in jaccard_join.components(edges).collect()} == {(i, 0) for i in range(1, 201)}


PAGES = [
    (3, "http://a", "<p>same</p>"), (1, None, "<p>same</p>"), (2, "http://c\r\nX: y", "<p>same</p>"), (4, "http://d", None), (5, "http://e", ""),
    (None, "http://f", "<p>same</p>"), (6, "http://g", "é😀" * 40_000), (1, None, "<p>same</p>"), (7, "h", "\x1f\x08 WARC/1.0\r\n\r\n"),
]


def page_results(rows, least=0):
    groups = defaultdict(list)
    for i, _, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, _, t in rows:
        data = (t or "").encode()
        first = min(x for x in groups[t or ""] if x is not None)
        again = i != first and len(groups[t or ""]) > 1 and len(data) >= least
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split,least", [(1 << 26, 0), (997, 0), (64, 5)])
def test_archives_round_trip(spark, split, least):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    rows = warc.archive_round_trip(pages, least, split).collect()
    assert all(r.intact for r in rows)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr) == page_results(PAGES, least)


def test_archives_keep_payloads_and_roll(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>" * 30) for i in range(50)], "page_id bigint, url string, html string")
    manifest = warc.write_archives(pages.coalesce(1), shared_folder(spark, "warc"), roll_bytes=3000)
    assert manifest.count() > 1 and manifest.agg(F.sum("records")).first()[0] == 50
    assert {(r.page_id, bytes(r.payload).decode(), r.target) for r in warc.read_archives(manifest, with_payload=True).collect()} == {(i, f"<p>{i}</p>" * 30, f"http://x/{i}") for i in range(50)}
    assert warc.archive_round_trip(pages.where("false")).count() == 0


@pytest.mark.parametrize("chunk", [1, 3, 70, 100, 150, 1000])
def test_reader_does_not_depend_on_its_chunks(monkeypatch, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    draw = random.Random(chunk)
    pages = [" ".join(str(draw.random()) for _ in range(draw.randint(1, 60))).encode() for _ in range(40)]
    data = b"".join(warc.member(i, f"http://x/{i}", p, warc.base32_sha1(p), False, None) for i, p in enumerate(pages))
    found = [warc.parse(r)[2] for r in warc.records_in(io.BytesIO(data), 0, len(data))]
    assert found == pages


def test_reader_passes_damage_and_owns_each_record_once():
    members = [warc.member(i, None, f"page {i}".encode() * 99, "D", False, None) for i in range(20)]
    data = bytearray(b"".join(members))
    sizes = np.cumsum([0, *map(len, members)])
    whole = list(warc.records_in(io.BytesIO(bytes(data)), 0, len(data)))
    assert len(whole) == 20
    for step in (1, 50, 333):
        parts = [r for a in range(0, len(data), step) for r in warc.records_in(io.BytesIO(bytes(data)), a, min(a + step, len(data)))]
        assert parts == whole
    data[sizes[7] + 40] ^= 0xFF
    assert 18 <= len(list(warc.records_in(io.BytesIO(bytes(data)), 0, len(data)))) <= 19


def brute_top(rows, k=5):
    good = [(i, [int(np.floor(x * 256.0)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    queries = {}
    for i, v in good:
        if i % 50 == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != q and len(w) == len(v))
        out += [(q, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["gauss", "spread", "same", "odd", "few"])
def test_top_k(spark, kind):
    draw = np.random.default_rng(7)
    rows = [(i, [float(np.float32(x)) for x in draw.normal(size=8)]) for i in range(400)]
    if kind == "spread":
        rows = [(i, [x * 2.0 ** (i % 13 - 6) for x in v]) for i, v in rows]
    if kind == "same":
        rows = [(i, rows[0][1] if i % 3 else v) for i, v in rows]
    if kind == "few":
        rows = rows[:3] + [(50, [-1.0] * 8)]
    if kind == "odd":
        rows += [(401, None), (402, []), (403, [1.0, None]), (450, [float("nan")] * 8), (404, [float("inf")] * 8), (None, [1.0] * 8), (0, [2.0] * 8), (500, [1.0, -0.001]), (501, [-1e-9, 3.0]), (502, [0.0] * 8), (550, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, score string")
    found = topk.top_k(topk.divisible_queries(df), df, block=64, query_block=3).collect()
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == brute_top(rows)


def test_top_k_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.top_k(df, df).count() == 0


def vectors_of(kind, draw, n, dim):
    v = draw.normal(size=(n, dim))
    if kind != "gauss":
        v /= np.sqrt((v**2).sum(axis=1))[:, None]
    if kind == "spread":
        v *= 2.0 ** draw.integers(-3, 4, n)[:, None]
    if kind == "near":
        v = v[draw.integers(0, 20, n)] + draw.normal(size=(n, dim)) * 0.02
    if kind == "copies":
        v = v[draw.integers(0, 30, n)]
    if kind == "positive":
        v = np.abs(v) + 0.2
    if kind == "negative":
        v = -np.abs(v) * np.where(np.arange(n) % 2, 1, -1)[:, None]
    if kind == "sparse":
        v *= draw.random((n, dim)) < 0.1
    if kind == "decay":
        v *= np.arange(1, dim + 1.0) ** -1
    if kind == "large":
        v *= 1e7
    return np.floor(v * 256)


@pytest.mark.parametrize("kind", ["unit", "gauss", "spread", "near", "copies", "positive", "negative", "sparse", "decay", "large"])
@pytest.mark.parametrize("dim", [1, 2, 8, 64, 200])
def test_best_of_a_group_equals_brute_force(kind, dim):
    draw = np.random.default_rng(dim)
    n, k = 1200, 5
    vectors, ids = vectors_of(kind, draw, n, dim), draw.permutation(n) // 2 * 3  # ids come twice
    asked = np.unique(ids[draw.choice(n, 200, replace=False)], return_index=True)
    queries = vectors[draw.choice(n, len(asked[0]), replace=False)]
    if kind != "large":
        vectors, queries = vectors.astype(np.float32), queries.astype(np.float32)
    best = topk.Best(asked[0], queries, np.full(len(queries), -np.inf), k)
    for at in range(0, n, 400):
        best.meet(ids[at : at + 400], vectors[at : at + 400])
    scores = queries.astype(np.int64) @ vectors.astype(np.int64).T
    expected = []
    for i, own in enumerate(asked[0].tolist()):
        rest = sorted((-s, j) for s, j in zip(scores[i].tolist(), ids.tolist()) if j != own)
        expected += [(own, j, -s) for s, j in rest[:k]]
    assert sorted(zip(*(x.tolist() for x in best.found()))) == sorted(expected)


@pytest.mark.parametrize("cosine,dim,share", [(0.6, 64, 0.002), (0.9, 64, 0.001), (0.75, 256, 0.002)])
def test_few_pairs_of_unlike_vectors_are_worked_out(monkeypatch, cosine, dim, share):
    """Before, a block's rows were all multiplied and ranked for each query whose
    threshold was under 0.85."""
    draw = np.random.default_rng(4)
    queries, vectors = (vectors_of("unit", draw, n, dim).astype(np.float32) for n in (1500, 4000))
    best = topk.Best(np.arange(10_000, 11_500), queries, np.full(1500, cosine * 2.0**16), 5)
    worked, exact = [], best.exact
    monkeypatch.setattr(best, "exact", lambda i, j, *rest: worked.append(len(i)) or exact(i, j, *rest))
    monkeypatch.setattr(best, "dense", lambda some, *rest: worked.append(len(some) * len(rest[0])))
    best.meet(np.arange(4000), vectors)
    assert sum(worked) <= share * 1500 * 4000
    scores = queries.astype(np.int64) @ vectors.astype(np.int64).T
    assert sorted(zip(*np.nonzero(scores >= cosine * 2**16))) == sorted((i - 10_000, j) for i, j in zip(best.found()[0], best.found()[1]))


def test_thresholds_let_every_field_hold_its_score():
    draw = np.random.default_rng(6)
    half = 1 << (topk.WIDTH - 1)
    for dim in (1, 3, 17, 64, 700):
        unit, others = (x / np.sqrt((x**2).sum(axis=1))[:, None] for x in draw.normal(size=(2, 300, dim)))
        others[:50] = unit[:50]
        rounded = np.rint(others * topk.LENGTH)
        error = np.sqrt(((rounded - others * topk.LENGTH) ** 2).sum(axis=1)).max()
        longest = np.sqrt((rounded**2).sum(axis=1)).max()
        for below in (0.45, 1.0):
            cosine = draw.uniform(0.01, 1.0, 300)
            small, least = topk.thresholds(unit, cosine, error, longest, below)
            field = small @ rounded.T - least[:, None]
            assert field.max() < half - 1 and field.min() > -3 * half + 1
            assert (field[unit @ others.T >= cosine[:, None]] >= 1).all()


def test_first_coordinates_and_the_length_of_the_rest_bound_a_product():
    a, b = np.random.default_rng(8).normal(size=(2, 100, 20))
    for kept in (1, 7, 18, 19, 20):
        assert (topk.short(a, kept) @ topk.short(b, kept).T >= a @ b.T - 1e-9).all()
        assert np.allclose((topk.short(a, kept) ** 2).sum(axis=1), (a**2).sum(axis=1))


def test_rows_of_a_hot_vector_that_no_query_needs_are_left_out():
    ids = np.array([7] * 9 + [1] * 2 + list(range(20, 60)) + [3])
    vectors = np.ones((len(ids), 4))
    vectors[-1] = 2
    kept = topk.alike(ids, vectors, 2)
    assert sorted(ids[kept].tolist()) == [1, 1, 3, 7, 7, 20]


def test_top_k_packs_and_meets_blocks_without_moving_single_rows(spark):
    """Before, each vector was dealt by key and each query block was joined with every
    block of vectors."""
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.normal(size=8)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    packed = topk.blocks(df, 500, True, "vec_id", "embedding", 256, 5)
    assert "Exchange hashpartitioning" not in packed._jdf.queryExecution().toString()
    sizes = [r["size"] for r in packed.select("size").collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 500
    found = topk.top_k(df.where("vec_id % 5 = 0"), df, block=200, query_block=50)
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    scores = np.floor(np.array([np.float32(v) for _, v in rows], dtype=np.float64) * 256).astype(np.int64)
    scores = scores[::5] @ scores.T
    expected = []
    for i, row in enumerate(scores.tolist()):
        best = sorted((-s, j) for j, s in enumerate(row) if j != 5 * i)[:5]
        expected += [(5 * i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()) == expected


def test_pruning_keeps_every_hit():
    draw = np.random.default_rng(9)
    vectors = np.round(draw.normal(size=(500, 6)) * 100)
    norms = np.sqrt((vectors**2).sum(axis=1))
    vectors = vectors[np.argsort(-norms)]
    norms = np.sqrt((vectors**2).sum(axis=1))
    unit = vectors / norms[:, None]
    for _ in range(200):
        query = np.round(draw.normal(size=6) * 100)
        scores = vectors @ query
        bound = float(np.sort(scores)[-draw.integers(1, 20)])
        rows = topk.candidates_of(query, float(np.sqrt(query @ query)), bound, unit, norms, {}, 5)
        kept = set(np.arange(500)[rows].tolist()) if rows is not None else set()
        assert set(np.flatnonzero(scores >= bound).tolist()) <= kept
