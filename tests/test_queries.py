import math
import os

import duckdb
import pytest

from lodestone.plans import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return str(value)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = queries.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted(tuple(shown(r[c]) for c in columns) for r in got.collect())
    wanted = duck.sql(queries.oracle_sql()[name])
    assert sorted(wanted.columns) == columns
    assert rows == sorted(tuple(map(shown, r)) for r in wanted.select(*[f'"{c}"' for c in columns]).fetchall())
