"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import pytest

from weft.plans import all_queries
from weft.plans.views import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return db


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def rows(columns, names, found):
    at = [names.index(c) for c in columns]
    return sorted((tuple(plain(r[i]) for i in at) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(all_queries.QUERIES))
def test_query(name, spark, duck):
    df = all_queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = rows(columns, df.columns, df.collect())
    if name not in all_queries.ORACLE_SQL:
        assert got
        return
    result = duck.execute(all_queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == rows(columns, names, result.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_does_not_need_the_corpus_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "weft")):
        if os.path.basename(folder) != "llm":
            for file in files:
                if file.endswith(".py"):
                    assert "weft.llm" not in open(os.path.join(folder, file)).read()
