"""Every registered query against its SQL in a second engine."""

import glob
import os

import duckdb
import pytest

from rosterloom.plans.catalog import CATALOG
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    return repr(round(value, 9)) if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name,build,sql", CATALOG, ids=[c[0] for c in CATALOG])
def test_query_matches_sql(spark, duck, name, build, sql):
    df = build(spark, SF_DIR)
    columns = sorted(df.columns)
    ours = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    answer = duck.execute(sql)
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert ours == sorted(tuple(plain(r[i]) for i in order) for r in answer.fetchall())


def test_every_query_reads_a_table(spark):
    for name, build, _ in CATALOG:
        plan = build(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
        assert "parquet" in plan or "LogicalRDD" in plan, name
