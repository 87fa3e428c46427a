"""Every registered query that has SQL, held against it on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans.catalog import ORACLE, QUERIES
from tidemark.plans.proxy import TABLES

SF = "/root/testdata/sf0.001"


def flat(rows):
    def value(v):
        if isinstance(v, float):
            return None if v != v else round(v, 6)
        if isinstance(v, (list, tuple)):
            return tuple(map(value, v))
        return str(v) if hasattr(v, "isoformat") else v

    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    rel = db.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    want = rel.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert flat(got) == flat(want)


def test_registry():
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
