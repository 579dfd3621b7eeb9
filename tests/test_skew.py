"""Skew-safe joins and numbering against brute force, with one hot key."""

import pytest
from pyspark.sql import functions as F

from rosterloom.operators.responses import merge_by_coverage, prefer_source
from rosterloom.operators.skew import dense_index, flag_repeats, hot_keys, keep_first, salted_lookup
from rosterloom.operators.tables import grid_to_rows
from rosterloom.operators.versions import lineage_depth


@pytest.fixture(scope="module", params=[1, 7])
def rows(spark, request):
    data = [(i, "hot" if i % 3 == 0 else f"k{i % 11}", i % 4) for i in range(600)]
    return spark.createDataFrame(data, "id long, key string, kind int").repartition(request.param)


def test_salted_lookup(spark, rows):
    lookup = spark.createDataFrame([("hot", 1), ("k1", 2)], "key string, v int")
    found = {r.id: r.v for r in salted_lookup(rows, lookup, ["key"], ["id"]).collect()}
    assert len(found) == 600
    assert all(found[i] == (1 if i % 3 == 0 else 2 if i % 11 == 1 else None) for i in found)


@pytest.mark.parametrize("share", [0, 33, 100])
@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_lookup_at_any_share(spark, share, how):
    """One key owns so many of a hundred rows; a tenth of all keys are null."""
    data = [(i, None if i % 10 == 0 else "hot" if i % 100 < share else f"k{i}") for i in range(1000)]
    big = spark.createDataFrame(data, "id long, key string")
    lookup = spark.createDataFrame([("hot", 1), ("k1", 2), ("k999", 3), (None, 4)], "key string, v int")
    known = {"hot": 1, "k1": 2, "k999": 3}
    found = {r.id: r.asDict().get("v") for r in salted_lookup(big, lookup, ["key"], ["id"], how=how).collect()}
    if how == "left_anti":
        assert set(found) == {i for i, key in data if key not in known}
    else:
        kept = {i: known.get(key) for i, key in data if how == "left" or key in known}
        assert set(found) == set(kept)
        assert how == "left_semi" or found == kept


def test_only_keys_above_an_even_share_are_hot(spark):
    big = spark.range(1000).withColumn("key", F.when(F.col("id") < 301, F.lit(-1)).otherwise(F.col("id")))
    assert [tuple(r) for r in hot_keys(big, ["key"], 10).collect()] == [(-1, 4)]
    assert hot_keys(big.where("key > 0"), ["key"], 10).isEmpty() and hot_keys(big.where("false"), ["key"], 10).isEmpty()


def test_flag_repeats(rows):
    flags = {r.id: r.is_repeat for r in flag_repeats(rows, ["key"], ["id"]).collect()}
    seen = set()
    for i in range(600):
        key = "hot" if i % 3 == 0 else f"k{i % 11}"
        assert flags[i] == (key in seen)
        seen.add(key)


def test_keep_first(rows):
    kept = {r.key: r.id for r in keep_first(rows, ["key"], ["kind", "id"]).collect()}
    best = {}
    for i in range(600):
        key = "hot" if i % 3 == 0 else f"k{i % 11}"
        best[key] = min(best.get(key, (9, 9)), (i % 4, i)) if key in best else (i % 4, i)
    assert kept == {k: v[1] for k, v in best.items()}


@pytest.mark.parametrize("chunk", [1, 13, 10_000])
def test_dense_index(rows, chunk):
    out = dense_index(rows, ["key"], ["kind"], "id", chunk_rows=chunk).collect()
    groups = {}
    for r in out:
        groups.setdefault(r.key, []).append(((r.kind, r.id), r.row_idx))
    assert sum(map(len, groups.values())) == 600
    for members in groups.values():
        assert [n for _, n in sorted(members)] == list(range(len(members)))


def test_source_choice(spark):
    data = [("a", 0, "rule"), ("a", 1, "model"), ("b", 0, "rule"), ("c", 0, "rule"), ("c", 1, "model"), ("c", 2, "model")]
    df = spark.createDataFrame(data, "job string, i int, source string")
    chosen = {(r.job, r.i) for r in prefer_source(df, ["job"], "source", ["model", "rule"], ["i"]).collect()}
    assert chosen == {("a", 1), ("b", 0), ("c", 1), ("c", 2)}
    merged = {(r.job, r.i) for r in merge_by_coverage(df, ["job"], "source", "rule", "model", ["i"]).collect()}
    assert merged == {("a", 0), ("b", 0), ("c", 1), ("c", 2)}


def test_lineage_with_one_hot_parent_and_a_long_chain(spark):
    star = [(i, 0) for i in range(1, 300)]
    chain = [(1000, None)] + [(1000 + i, 999 + i) for i in range(1, 150)]
    df = spark.createDataFrame([(0, None), *star, *chain], "version_id long, parent_version_id long")
    out = {r.version_id: (r.root, r.depth) for r in lineage_depth(df).collect()}
    assert out[0] == (0, 0) and all(out[i] == (0, 1) for i in range(1, 300))
    assert all(out[1000 + i] == (1000, i) for i in range(150))
    loop = spark.createDataFrame([(1, 2), (2, 1)], "version_id long, parent_version_id long")
    with pytest.raises(ValueError):
        lineage_depth(loop, rounds=4)


def test_grid_rows(spark):
    grid = [["Name", None, "NPI "], ["Ann", "x", "1"], [None, None, None], ["", "y", None]]
    cells = [("d", 0, 0, r, c, t) for r, row in enumerate(grid) for c, t in enumerate(row)]
    df = spark.createDataFrame(cells, "doc string, page int, table int, row int, col int, text string")
    out = {r.row_key: r.data for r in grid_to_rows(df, ["doc"]).collect()}
    assert out == {"0_0_1": {"Name": "Ann", "col_1": "x", "NPI": "1"}, "0_0_3": {"col_1": "y"}}


def test_partition_count_does_not_change_results(spark):
    from rosterloom.operators.validate import issue_table, validate
    from rosterloom.plans.derive import relation
    from tests.conftest import SF_DIR

    base = relation(spark, SF_DIR, "roster").where("job_id % 5 = 0")

    def run(parts):
        found = issue_table(validate(base.repartition(parts), "2025-01-01"), ["job_id", "row_idx"])
        return sorted(map(tuple, found.collect()))

    assert run(1) == run(8)


def test_normalizing_twice_changes_nothing(spark):
    from rosterloom.operators.normalize import normalize
    from rosterloom.plans.derive import relation
    from tests.conftest import SF_DIR

    once = normalize(relation(spark, SF_DIR, "roster")).drop("deltas")
    twice = normalize(once).drop("deltas")
    # An address loses its place on the first pass and is no street line after it.
    columns = [c for c in once.columns if c != "complete_address"]
    assert once.select(columns).exceptAll(twice.select(columns)).isEmpty()


def test_null_keys_and_orders(spark):
    data = [(1, None, 5), (2, None, 3), (3, "a", None), (4, "a", 2), (5, "b", None)]
    df = spark.createDataFrame(data, "id long, key string, at int")
    assert {r.id for r in keep_first(df, ["key"], ["at"]).collect()} == {2, 4, 5}
    assert {r.id for r in flag_repeats(df, ["key"], ["at"]).where("is_repeat").collect()} == {1, 3}
