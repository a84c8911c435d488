"""Hand-made rows that trip the plain form of an operator."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecraft.functions import text
from tablecraft.operators import checks, clean, measures, profile
from tablecraft.plans import rental
from tablecraft.sources import files
from tablecraft.streaming import changes, ingest


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.fixture(scope="module")
def shop(spark):
    make = spark.createDataFrame
    return {
        "inventory": make([(1, 10, 1), (2, 10, 1), (3, 11, 2), (4, 12, 2)], "inventory_id int, film_id int, store_id int"),
        "rental": make([(1, 1, 5, None), (2, 2, 5, dt.datetime(2020, 1, 9)), (3, 3, 6, dt.datetime(2020, 1, 3))], "rental_id int, inventory_id int, customer_id int, return_date timestamp_ntz").withColumn("rental_date", F.lit(dt.datetime(2020, 1, 1)).cast("timestamp_ntz")),
        "payment": make([(1, 5, 4.0), (2, 5, 2.0), (3, 6, 1.0)], "rental_id int, customer_id int, amount double").withColumn("payment_date", F.lit(dt.datetime(2020, 1, 31, 23, 59)).cast("timestamp_ntz")),
        "customer": make([(5,), (6,), (7,)], "customer_id int"),
        "film": make([(10, "TWO KINDS", 1.0, 3), (11, "NO KIND", 2.0, 3), (12, "UNSEEN", 2.0, 3)], "film_id int, title string, rental_rate double, rental_duration int"),
        "category": make([(1, "Drama"), (2, "Comedy")], "category_id int, name string"),
        "film_category": make([(10, 1), (10, 2)], "film_id int, category_id int"),
        "actor": make([(1, "ANN MARY", "LEE"), (2, "BOB", "RAY")], "actor_id int, first_name string, last_name string"),
        "film_actor": make([(1, 10), (1, 11)], "actor_id int, film_id int"),
    }


def test_open_rentals(spark, shop):
    assert rows(rental.inventory_held_by(shop).where("customer_id is not null"), "inventory_id", "customer_id") == [(1, 5)]
    twice = shop | {"rental": shop["rental"].unionByName(shop["rental"].where("rental_id = 1"))}
    with pytest.raises(Exception, match="several open rentals of item 1"):
        rental.inventory_held_by(twice).collect()
    asked = spark.createDataFrame([(1,), (2,), (99,)], "inventory_id int")
    assert rows(rental.inventory_in_stock(shop, asked), "inventory_id", "in_stock") == [(1, False), (2, True), (99, True)]
    assert rows(rental.counted(rental.film_in_stock(shop, F.col("film_id") == 10)), "inventory_id", "found") == [(2, 1)]
    assert rows(rental.counted(rental.film_not_in_stock(shop)), "inventory_id", "found") == [(1, 1)]


def test_rewards_limits(shop):
    report = lambda n, s: rows(rental.counted(rental.rewards_report(shop, n, s, dt.date(2020, 2, 10))), "customer_id", "found")
    assert report(1, 5.0) == [(5, 1)] and report(1, 6.0) == [] and report(2, 1.0) == []
    for n, s in ((0, 1.0), (1, 0.0)):
        with pytest.raises(ValueError):
            rental.rewards_report(shop, n, s, dt.date(2020, 2, 10))


def test_balance(shop):
    """Five days late on a film of three days; open rentals owe their fee only; a customer without rentals owes nothing."""
    assert rows(rental.customer_balance(shop, dt.datetime(2020, 3, 1)), "customer_id", "balance") == [(5, 1 + 1 + 5 - 6), (6, 2 + 0 - 1), (7, 0)]


def test_film_in_two_categories(shop):
    assert rows(rental.sales_by_category(shop), "category", "total_sales") == [("Comedy", 6.0), ("Drama", 6.0)]
    info = dict(rows(rental.actor_info(shop), "actor_id", "film_info"))
    assert info[1] == "Comedy: TWO KINDS; Drama: TWO KINDS" and info[2] is None


def test_quoted_null_word(spark, tmp_path):
    (tmp_path / "c.csv").write_text('id ,stage\n1,4\n2,"NA"\n3,NA\n')
    df = files.read_csv(spark, f"{tmp_path}/c.csv")
    assert df.columns == ["id", "stage"] and [r["stage"] for r in df.orderBy("id").collect()] == [4, None, None]


def test_ties_of_the_running_sum(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 7), ("a", 2, 1), ("b", 1, 2), (None, 1, 3)], "k string, day int, v int")
    want = [(1, 12), (1, 12), (2, 13)]
    for f in (measures.running_sum, measures.running_sum_by_step):
        out = f(df, "v", ["k"], ["day"])
        assert rows(out.where("k = 'a'"), "day", "running") == want
        assert rows(out.where("k is null"), "running") == [(3,)]


def test_peers(spark):
    df = spark.createDataFrame([(1, "p", None), (2, "p", "x"), (3, "p", "y"), (4, "q", None), (5, None, "z"), (6, None, None)], "id int, parcel string, address string")
    out = clean.fill_from_peer(df, "address", "parcel", ["id"])
    assert out.columns == df.columns and {r["id"]: r["address"] for r in out.collect()} == {1: "x", 2: "x", 3: "y", 4: None, 5: "z", 6: "z"}


def test_null_safe_updates(spark):
    now = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, t string")
    log = spark.createDataFrame([("U", 1, 1, None), ("U", 1, 2, "b"), ("U", 1, 3, "d"), ("D", 2, 3, None), ("I", 1, 4, "e")], "op string, seq int, id int, t string")
    run = lambda safe: {r["id"]: r["t"] for r in ingest.apply_changes(now, log, ["id"], ["t"], null_safe=safe).collect()}
    assert run(True) == {1: None, 2: "b", 4: "e"} and run(False) == {1: "a", 2: None, 4: "e"}


def test_batches_of_changes_in_any_cut(spark, tmp_path):
    schema = "op string, seq long, id int, t string"
    all_ = [("I", 1, 1, "a"), ("I", 1, 2, "b"), ("U", 2, 1, "c"), ("D", 3, 2, None), ("I", 4, 2, "again"), ("U", 5, 9, "late")]
    found = []
    for at, cuts in enumerate(([6], [1, 5], [2, 2, 2])):
        t = changes.ChangedTable(spark, f"{tmp_path}/{at}", spark.createDataFrame([], schema).schema, ["id"])
        left = list(all_)
        for k, n in enumerate(cuts):
            t.append(spark.createDataFrame(left[:n], schema), k)
            t.append(spark.createDataFrame(left[:n], schema), k)  # a batch that is run again replaces itself
            left = left[n:]
        found += [rows(t.read(), "id", "t"), rows(t.compacted(f"{tmp_path}/{at}c").read(), "id", "t")]
    assert found == [[(1, "c"), (2, "again"), (9, "late")]] * 6
    assert rows(t.read(0), "id", "t") == [(1, "a"), (2, "b")]


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    data = [(k, float(v)) for k in ("a", "b", None) for v in np.round(rng.normal(0, 10, n), rng.integers(0, 6))] + [("a", None), ("c", None)]
    df = spark.createDataFrame(data, "k string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    found = {r["k"]: r["q"] for r in profile.quantiles(df, ["k"], "v", probs).collect()}
    for k in ("a", "b", None):
        assert found[k] == pytest.approx(np.quantile([v for x, v in data if x == k and v is not None], probs).tolist())
    assert "c" not in found
    whole = profile.quantiles(df, [], "v", probs).first()["q"]
    assert whole == pytest.approx(np.quantile([v for _, v in data if v is not None], probs).tolist())


def test_addresses_of_any_number_of_parts(spark):
    texts = ["1 A ST", "1 A ST, TOWN", "1 A ST, TOWN, TN", "1 A ST, FL 2, TOWN, TN", "1 A ST. FL 2, X, TOWN, TN", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, a string")
    out = df.select("i", *[text.part_from_right(F.col("a"), n).alias(f"p{n}") for n in (3, 2, 1)], text.before_comma(F.col("a")).alias("b"), text.after_comma(F.col("a")).alias("c")).orderBy("i").collect()
    assert [tuple(r)[1:4] for r in out] == [(None, None, "1 A ST"), (None, "1 A ST", "TOWN"), ("1 A ST", "TOWN", "TN"), ("FL 2", "TOWN", "TN"), (None, None, None), (None, None, None)]
    assert [tuple(r)[4:] for r in out] == [(None, None), ("1 A ST", "TOWN"), ("1 A ST", "TOWN, TN"), ("1 A ST", "FL 2, TOWN, TN"), ("1 A ST. FL 2", "X, TOWN, TN"), (None, None)]


def test_clone_of_a_database(spark, tmp_path):
    paths = {}
    for name, n in (("one", 3), ("two", 5)):
        paths[name] = f"{tmp_path}/{name}"
        spark.range(n).write.parquet(paths[name])
    copies = files.clone_database(spark, paths, f"{tmp_path}/copy")
    spark.range(9).write.mode("overwrite").parquet(paths["one"])
    assert {k: v.count() for k, v in copies.items()} == {"one": 3, "two": 5}
    with pytest.raises(Exception, match="exist"):
        files.clone_database(spark, paths, f"{tmp_path}/copy")


def test_conditions_that_are_null_do_not_hold(spark):
    df = spark.createDataFrame([(1, True, True), (2, True, None), (3, False, True)], "i int, a boolean, b boolean")
    assert [r["i"] for r in df.where(checks.check_all(F.col("a"), F.col("b"))).collect()] == [1]
