"""A table under changes in any order, before and after compactions."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import types as T

from tablecraft.streaming import changes

SCHEMA = T.StructType([T.StructField(c, t) for c, t in (("op", T.StringType()), ("seq", T.LongType()), ("id", T.LongType()), ("name", T.StringType()))])
#: One change of key 1 is older than its update, one of key 2 older than its delete, key 3 comes back, and key 4 is deleted
#: before its insert is seen.
BATCHES = [
    [("I", 1, 1, "first"), ("I", 1, 2, "first"), ("U", 5, 1, "new")],
    [("U", 3, 1, "old"), ("D", 5, 2, None), ("I", 2, 3, "third")],
    [("I", 4, 2, "back"), ("D", 6, 3, None), ("D", 9, 4, None)],
    [("I", 8, 3, "again"), ("I", 7, 4, "late"), ("I", 7, 4, "late"), ("I", None, 5, "no seq"), ("I", 1, None, "no key")],
]
WANT = [(None, "no key"), (1, "new"), (3, "again")]


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Each partition has a state store and a worker of its own."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def rows(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


@pytest.mark.parametrize("order", list(itertools.permutations(range(4)))[::23])
def test_any_order_gives_the_same_table(spark, tmp_path, order):
    """Each batch is a run of its own; the table is compacted after the second one, and at the end."""
    table = changes.ChangedTable(spark, f"{tmp_path}/table", SCHEMA, ["id"])
    for n, k in enumerate(order):
        spark.createDataFrame(BATCHES[k], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/changes")
        changes.apply_change_stream(f"{tmp_path}/changes", table, f"{tmp_path}/place")
        if n == 1:
            before = rows(table)
            table = table.compacted(f"{tmp_path}/compacted")
            assert rows(table) == before
    assert rows(table) == sorted(WANT, key=str)
    assert rows(table.compacted(f"{tmp_path}/again")) == sorted(WANT, key=str)
    # another run finds nothing new and changes nothing
    changes.apply_change_stream(f"{tmp_path}/changes", table, f"{tmp_path}/place")
    assert rows(table) == sorted(WANT, key=str)


def test_expired_tombstones_and_repeated_batches(spark, tmp_path):
    """After its tombstone has gone, a deleted key is new; a batch that is written twice counts once."""
    table = changes.ChangedTable(spark, f"{tmp_path}/table", SCHEMA, ["id"])
    for batch in ([("D", 9, 1, None), ("I", 3, 2, "two")], [("I", 4, 1, "one"), ("U", 2, 2, "old")]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/changes")
        changes.apply_change_stream(f"{tmp_path}/changes", table, f"{tmp_path}/place", tombstone=1)
    # the tombstone's seq is in the table's batches, too, but not in a base
    assert rows(table) == [(2, "two")]
    compact = table.compacted(f"{tmp_path}/compacted")
    spark.createDataFrame([("I", 5, 1, "one")], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/changes")
    changes.apply_change_stream(f"{tmp_path}/changes", compact, f"{tmp_path}/place", tombstone=1)
    assert rows(compact) == [(1, "one"), (2, "two")]
    compact.append(spark.createDataFrame([("U", 6, 2, "new")], SCHEMA), 7)
    compact.append(spark.createDataFrame([("U", 6, 2, "new")], SCHEMA), 7)
    assert rows(compact) == [(1, "one"), (2, "new")] and sorted(r[0] for r in compact.read(3).collect()) == [1, 2]
