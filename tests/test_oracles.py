"""Every registered query against its SQL on the smallest tables; those without SQL have to give rows of a fixed schema."""

from __future__ import annotations

import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__
from tablecraft.plans import registered

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = registered.queries(), registered.oracle_sql()


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(cols, found):
    return sorted(tuple(plain(v) for _, v in sorted(zip(cols, r, strict=True))) for r in found)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    q = con.execute(SQL[name])
    cols = [x[0] for x in q.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == rows(cols, q.fetchall())


#: Many fits over the whole table; the same operators are held against known results in test_models.py.
MODELS = {"cross_validate", "model_comparison", "random_search", "fit_boosted_trees", "fit_random_forest", "chained_categorical_imputer", "imputed_data_sets"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - MODELS))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
