"""Loads with a ledger, and tables with a history."""

from __future__ import annotations

import os
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.sources import files, history, loads

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])


@pytest.fixture
def stage(tmp_path):
    def put(name, text):
        os.makedirs(os.path.dirname(path := f"{tmp_path}/stage/{name}"), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)

    put("trips/a.csv", "1,one\n2,two\n")
    put("trips/b.csv", "3,\n")
    put("other/c.csv", "9,other\n")
    return put


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_loads_take_each_file_once(spark, tmp_path, stage):
    t, source = loads.LoadedTable(spark, f"{tmp_path}/t", SCHEMA), f"{tmp_path}/stage"
    assert ids(t.read()) == [] and t.copy_into(source, "tri") == loads.Copied(1, 2, 3, 0)
    assert ids(t.read()) == [1, 2, 3] and t.read().where("name is null").count() == 1
    assert t.copy_into(source, "trips/") == loads.Copied(None, 0, 0, 0)
    stage("trips/a.csv", "1,one\n2,two\n4,four\n")  # another length: a new file
    stage("trips/d.csv", "5,five\n")
    assert t.copy_into(f"file://{source}/", "trips") == loads.Copied(2, 2, 4, 0) and ids(t.read()) == [1, 1, 2, 2, 3, 4, 5]
    assert t.copy_into(source) == loads.Copied(3, 1, 1, 0) and t.ledger().count() == 5
    assert t.copy_into(source, "other", force=True) == loads.Copied(4, 1, 1, 0) and t.copy_into(source, "none").load is None


def test_a_bad_record_ends_the_load_or_is_put_apart(spark, tmp_path, stage):
    stage("trips/e.csv", "6,six\nx,bad\n7,seven,more\n")
    t, source = loads.LoadedTable(spark, f"{tmp_path}/t", SCHEMA), f"{tmp_path}/stage"
    with pytest.raises(Exception, match="(?i)malformed"):
        t.copy_into(source, "trips")
    assert ids(t.read()) == [] and t.ledger().count() == 0
    assert t.copy_into(source, "trips", on_error="continue") == loads.Copied(1, 3, 4, 2)
    assert ids(t.read()) == [1, 2, 3, 6]
    assert sorted((r["path"].rpartition("/")[2], r["record"]) for r in t.rejects().collect()) == [("e.csv", "7,seven,more"), ("e.csv", "x,bad")]
    with pytest.raises(ValueError):
        t.copy_into(source, on_error="skip")


def test_a_load_that_is_lost_before_the_ledger_is_replaced(spark, tmp_path, stage):
    t, source = loads.LoadedTable(spark, f"{tmp_path}/t", SCHEMA), f"{tmp_path}/stage"
    t.copy_into(source, "trips")
    shutil.rmtree(f"{tmp_path}/t/ledger")
    assert ids(t.read()) == []
    assert t.copy_into(source).files == 3 and ids(t.read()) == [1, 2, 3, 9]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_history_reads_and_restores(spark, tmp_path):
    t = history.VersionedTable(spark, f"{tmp_path}/t", SCHEMA, ["id"])
    make = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    assert rows(t.read()) == [] and t.last_version() == 0
    t.write(make((1, "a"), (2, None), (3, "c")), "insert into t")
    first = rows(t.read())
    spoilt = t.write(make((1, "oops"), (2, "oops"), (3, "oops")), "update t set name = 'oops'")
    t.write(make((4, "d")), "insert into t", make((1, None)))
    now = rows(t.read())
    assert now == [(2, "oops"), (3, "oops"), (4, "d")] and rows(t.read(1)) == first and rows(t.before(spoilt)) == first
    assert files.last_change(t.log(), "update").first()["query_id"] == spoilt
    again = t.restore_before(spoilt)
    assert rows(t.read()) == first and rows(t.before(again)) == now and t.last_version() == 4
    t.restore_before(again)
    assert rows(t.read()) == now
    with pytest.raises(KeyError):
        t.before("unheard of")
    held = {tuple(r) for r in t.intervals().where("id = 1").collect()}
    assert held == {(1, "a", 1, 2), (1, "oops", 2, 3), (1, "a", 4, 5)}
    facts = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4), (1, 9), (4, 2), (4, 3), (8, 1)], "id long, v long")
    assert rows(t.join_as_of(facts, "v")) == sorted([(1, 1, "a"), (1, 2, "oops"), (1, 3, None), (1, 4, "a"), (1, 9, None), (4, 2, None), (4, 3, "d"), (8, 1, None)], key=str)


def test_a_version_without_a_log_entry_is_not_there(spark, tmp_path):
    t = history.VersionedTable(spark, f"{tmp_path}/t", SCHEMA, ["id"])
    t.write(spark.createDataFrame([(1, "a")], SCHEMA), "insert")
    lost = spark.createDataFrame([(1, "lost"), (2, "lost")], SCHEMA).withColumns({"_deleted": F.lit(False), "_version": F.lit(2).cast("long")})
    lost.write.partitionBy("_version").mode("append").parquet(f"{tmp_path}/t/versions")
    assert rows(t.read()) == [(1, "a")]
    t.write(spark.createDataFrame([(3, "c")], SCHEMA), "insert")
    assert rows(t.read()) == [(1, "a"), (3, "c")]
