import math
import os

import duckdb
import pytest

from weftgraph.session import get_spark, reach

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = reach(get_spark("tests", cpus=4, shuffle_partitions=4))
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(v):
    """Values that both engines spell alike."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "tolist"):
        v = v.tolist()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Asserts that a query's rows are those of its SQL at the smallest scale."""

    def check(query, sql):
        df = query(spark, SF)
        found = duck.sql(sql)
        assert sorted(df.columns) == sorted(found.columns)
        assert rows_of(df.columns, df.collect()) == rows_of(found.columns, found.fetchall())

    return check
