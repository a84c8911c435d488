"""Hot keys by blocks, short peer lists, several completed tables, and a schema's constraints."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tablecraft.operators import checks, clean, measures, models

KINDS = {
    "bigint": lambda rng: rng.choice([None, *range(-400, 400)]),
    "double": lambda rng: rng.choice([None, float("nan"), float("inf"), rng.gauss(0, 1), 0.5]),
    "string": lambda rng: rng.choice([None, "", "ä" * rng.randrange(4), f"key{rng.randrange(50)}", f"longer key {rng.randrange(50)}"]),
    "date": lambda rng: rng.choice([None, datetime.date(1960, 1, 1) + datetime.timedelta(days=rng.randrange(40_000))]),
    "timestamp": lambda rng: datetime.datetime(2020, 1, 1) + datetime.timedelta(microseconds=rng.randrange(10**12)),
}


@pytest.mark.parametrize("kind", KINDS)
def test_running_sums_in_blocks(spark, kind):
    """One key with most rows, a key that is NULL, ties, and values that are NULL, in orders of all kinds."""
    rng = random.Random(kind)
    rows = [(i, rng.choice(["hot"] * 8 + ["cold", None]), KINDS[kind](rng), rng.choice([None, *range(9)])) for i in range(600)]
    df = spark.createDataFrame(rows, f"id int, k string, o {kind}, v int")
    want = {r["id"]: r["running"] for r in measures.running_sum(df, "v", ["k"], ["o"]).collect()}
    for blocks in (1, 7, 256):
        assert {r["id"]: r["running"] for r in measures.running_sum_by_step(df, "v", ["k"], ["o"], blocks=blocks).collect()} == want
    block = df.select("o", measures.range_block(df, "o", 16).alias("b")).orderBy("o", "b").collect()
    assert [r["b"] for r in block] == sorted(r["b"] for r in block) and len({r["b"] for r in block}) > 4
    numbers = [r["n"] for r in checks.ordered_keys(df, "n", "o", 5).orderBy("o", "n").collect()]
    assert sorted(numbers) == list(range(5, 605)) and numbers == sorted(numbers)


def test_running_sums_of_unique_steps(spark):
    df = spark.range(5000).selectExpr("id", "1 as k", "5000 - id as o", "id % 7 as v")
    want = {r["id"]: r["running"] for r in measures.running_sum(df, "v", ["k"], ["o"]).collect()}
    assert {r["id"]: r["running"] for r in measures.running_sum_by_step(df, "v", ["k"], ["o"]).collect()} == want
    assert measures.running_sum_by_step(df.limit(0), "v", ["k"], ["o"]).count() == 0


def test_peers_of_a_hot_key(spark):
    few = spark.createDataFrame([("p", 1, None), ("p", 2, "x"), ("p", 3, None), ("q", 4, None), (None, 5, None)], "k string, id int, v string")
    assert sorted((r["row_id"], r["peer_id"]) for r in clean.peers(few, "k", "id", "v").collect()) == [(1, 2), (1, 3), (3, 1), (3, 2)]
    assert sorted((r["row_id"], r["peer_id"], r["peer_value"]) for r in clean.peers(few, "k", "id", "v", most=1).collect()) == [(1, 2, "x"), (3, 1, None), (3, 2, "x")]
    hot = spark.range(100_000).selectExpr("'hot' as k", "id", "if(id % 7 = 0, null, 'x') as v")
    lacking = 100_000 // 7 + 1
    # row 0 is among the short list of four and lacks the column, so it has three of them
    assert clean.peers(hot, "k", "id", "v", most=3).count() == lacking * 4 - 1


def test_schema_violations_equal_single_checks(spark):
    parent = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c")], "id int, name string")
    child = spark.createDataFrame([(1, 1, "x", 5), (2, 9, "y", None), (2, None, None, 50), (None, 2, "z", -1), (None, 2, "z", 7)], "id int, parent int, kind string, n int")
    schema = {
        "parent": checks.Constraints(["id"], [["name"], ["id", "name"]]),
        "child": checks.Constraints(["id"], not_null=["kind"], domains={"kind": ["x", "y"]}, ranges={"n": (0, 10)}, foreign={"parent": ("parent", "id"), "id": ("parent", "id")}),
    }
    tables = {"parent": parent, "child": child}
    got = {(r["table"], r["kind"], r["columns"]): r["n"] for r in checks.schema_violations(tables, schema).collect()}
    assert set(got) == {(t, *n) for t, has in schema.items() for n in has.names()}
    known = lambda df, c: df.dropna(subset=c)
    want = {
        ("parent", "primary key", "id"): checks.pk_violations(known(parent, ["id"]), ["id"]).count(), ("parent", "unique", "name"): checks.pk_violations(parent, ["name"]).count(),
        ("parent", "unique", "id, name"): 1, ("parent", "not null", "id"): 1, ("child", "primary key", "id"): 1, ("child", "not null", "id"): 2, ("child", "not null", "kind"): 1,
        ("child", "domain", "kind"): checks.domain_violations(child, "kind", ["x", "y"]).count(), ("child", "range", "n"): checks.range_violations(child, "n", 0, 10).count(),
        ("child", "foreign key", "parent"): checks.fk_orphans(child, "parent", parent, "id").count(), ("child", "foreign key", "id"): checks.fk_orphans(child, "id", parent, "id").count(),
    }
    assert got == want


def test_several_completed_tables(spark, tmp_path):
    """One text column follows from the number, the other one from the first; a third of the rows say nothing about it."""
    rows = [(i, float(i % 4), float(i % 2), "abcd"[i % 4] if i % 5 else None, ("even" if i % 4 in (0, 3) else "odd") if i % 7 else None, "xy"[i * i % 11 % 2] if i % 3 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, p double, q double, one string, two string, noise string").repartition(2)
    at = iter(range(100))

    def through(t):
        t.write.parquet(path := f"{tmp_path}/{next(at)}")
        return spark.read.schema(t.schema).parquet(path)

    sets = models.impute_categorical_sets(df, "id", ["one", "two", "noise"], ["p", "q"], datasets=3, steps=25, through=through)
    found = {}
    for r in sets.collect():
        found.setdefault(r["dataset"], {})[r["id"]] = r
    assert found.keys() == {0, 1, 2} and all(len(t) == 400 for t in found.values())
    for t in found.values():
        for i, _, _, *known in rows:
            assert all(k is None or k == t[i][c] for k, c in zip(known, ("one", "two", "noise"), strict=True))
            assert None not in (t[i]["one"], t[i]["two"], t[i]["noise"])
    right = sum(t[i]["one"] == "abcd"[i % 4] for t in found.values() for i in range(0, 400, 5))
    assert right > 0.6 * 240  # chance gives a quarter
    differ = {tuple(found[m][i]["noise"] for i in range(0, 400, 3)) for m in range(3)}
    assert len(differ) == 3
    spread = {(r["column"], r["value"]): (r["least"], r["most"]) for r in models.spread_of_sets(sets, ["noise"]).collect()}
    assert all(a <= b for a, b in spread.values()) and sum(a for a, _ in spread.values()) <= 400 <= sum(b for _, b in spread.values())
