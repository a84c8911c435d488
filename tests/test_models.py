"""Model operators on small tables whose results are known."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablecraft.operators import models


@pytest.fixture(scope="module")
def written(tmp_path_factory):
    at = iter(range(1000))

    def through(df):
        path = f"{tmp_path_factory.mktemp('through')}/{next(at)}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    return through


@pytest.fixture(scope="module")
def clouds(spark):
    """Three classes around corners, a tenth of the rows of another class than theirs."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(600):
        k = i % 3
        x = rng.normal([(0, 0), (6, 0), (0, 6)][k], 1.0)
        rows.append((i, [float(v) for v in x], float(k if i % 10 else (k + 1) % 3)))
    df = spark.createDataFrame(rows, "id long, x array<double>, label double")
    return df.select("id", array_to_vector("x").alias("features"), "label").cache()


def test_split_and_folds(spark, clouds):
    train, test = models.stratified_split(clouds, "label", "id", 0.3)
    all_, cut = Counter(r["label"] for r in clouds.collect()), Counter(r["label"] for r in test.collect())
    assert cut == {k: round(n * 0.3) for k, n in all_.items()} and train.count() + test.count() == 600
    assert train.join(test, "id").count() == 0
    again = models.stratified_split(clouds.repartition(7), "label", "id", 0.3)[1]
    assert {r["id"] for r in again.collect()} == {r["id"] for r in test.collect()}
    found = Counter((r["label"], r["fold"]) for r in models.folds(clouds, "label", "id", 10).collect())
    for k, n in all_.items():
        assert all(abs(found[k, f] - n / 10) < 1 for f in range(10))
    with_null = clouds.withColumn("label", F.when(F.col("id") % 2 == 0, F.col("label")))
    assert sum(x.count() for x in models.stratified_split(with_null, "label", "id")) == 600


def test_classifiers_and_validation(clouds):
    folded = models.folds(clouds, "label", "id", 5)
    for m in (models.logistic(maxIter=20), models.random_forest(numTrees=10), models.boosted_trees(maxIter=3)):
        assert models.accuracy(m.fit(clouds).transform(clouds)) > 0.85
    mean, std = models.cross_validate(models.logistic(maxIter=20), folded, k=5)
    each = [models.accuracy(models.logistic(maxIter=20).fit(folded.where(F.col("fold") != k)).transform(folded.where(F.col("fold") == k))) for k in range(5)]
    assert mean == pytest.approx(np.mean(each)) and std == pytest.approx(np.std(each))
    table = {r["model"]: r for r in models.compare({"logistic": models.logistic(maxIter=20), "forest": models.random_forest(numTrees=10)}, folded, clouds, k=5).collect()}
    assert table["logistic"]["cv_mean"] == pytest.approx(mean) and table["forest"]["accuracy"] > 0.85 and 0.85 < table["forest"]["f1"] <= 1


def test_random_search(clouds):
    folded = models.folds(clouds, "label", "id", 3)
    grid = {"regParam": [0.0, 0.1, 100.0], "maxIter": [5, 20]}
    score, params, model = models.random_search(models.logistic(), grid, folded, n=50, k=3)
    assert params["regParam"] < 100 and score > 0.85 and models.accuracy(model.transform(clouds)) > 0.85
    one = models.random_search(models.logistic(), grid, folded, n=1, k=3, seed=4)
    assert one[1] == models.random_search(models.logistic(), grid, folded, n=1, k=3, seed=4)[1] and one[1].keys() == grid.keys()


def test_numeric_imputer(spark, written):
    rng = random.Random(2)
    rows = [(i, (a := rng.random()), (b := rng.random()), 2 * a - b + 1) for i in range(300)]
    full = spark.createDataFrame(rows, "id long, a double, b double, c double")
    gaps = full.withColumn("c", F.when(F.col("id") % 5 != 0, F.col("c"))).withColumn("a", F.when(F.col("id") % 7 != 0, F.col("a")))
    found = {r["id"]: r for r in models.impute_numeric(gaps, ["a", "b", "c"], through=written).collect()}
    for i, a, b, c in rows:
        r = found[i]
        assert r["b"] == b and (i % 5 == 0 or r["c"] == c) and (i % 7 == 0 or r["a"] == a)
        if i % 35:
            assert r["c"] == pytest.approx(c, abs=0.05) and r["a"] == pytest.approx(a, abs=0.05)


def test_categorical_imputer(spark, written):
    """One text column follows from the number, the other from the first one only, which takes a second round."""
    rows = [(i, float(i % 4), "abcd"[i % 4], "even" if i % 4 in (0, 3) else "odd") for i in range(400)]
    full = spark.createDataFrame(rows, "id long, x double, one string, two string")
    gaps = full.withColumn("one", F.when(F.col("id") % 5 != 0, F.col("one"))).withColumn("two", F.when(F.col("id") % 7 != 0, F.col("two")))
    assert models.impute_categorical(full, ["one", "two"], ["x"]) is full
    for dataset in (0, 2):
        found = {r["id"]: (r["one"], r["two"]) for r in models.impute_categorical(gaps, ["one", "two"], ["x"], dataset, 2, through=written).collect()}
        assert found == {i: (one, two) for i, _, one, two in rows}
    known = gaps.where("one is not null and two is not null").collect()
    assert all(found[r["id"]] == (r["one"], r["two"]) for r in known)


def test_metrics(spark):
    p = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 1.0), (2.0, 0.0)], "label double, prediction double")
    assert {(r["label"], r["prediction"]): r["n"] for r in models.confusion(p).collect()} == {(0, 0): 1, (0, 1): 1, (1, 1): 2, (2, 0): 1}
    m = {r["class"]: r for r in models.class_metrics(p).collect()}
    assert (m[0]["precision"], m[0]["recall"], m[0]["support"]) == (0.5, 0.5, 2)
    assert (m[1]["precision"], m[1]["recall"]) == (pytest.approx(2 / 3), 1.0) and (m[2]["precision"], m[2]["recall"], m[2]["f1"]) == (0, 0, 0)


@pytest.mark.parametrize("levels", [3, 40, 10_000])
def test_roc(spark, levels):
    rng = random.Random(levels)
    rows = [(rng.choice("xy"), rng.randrange(levels) / levels, rng.random() < 0.3) for _ in range(1500)]
    df = spark.createDataFrame(rows, "class string, score double, positive boolean")
    found = {r["class"]: r["auc"] for r in models.auc(df, "score", "positive", "class").collect()}
    for k in "xy":
        pos, neg = (np.array([s for c, s, p in rows if c == k and p == want]) for want in (True, False))
        assert found[k] == pytest.approx(np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)))
    points = sorted((r["fpr"], r["tpr"]) for r in models.roc_points(df, "score", "positive").collect())
    assert points[-1] == (1, 1) and points == sorted(points, key=lambda x: x[1])
    assert models.auc(df.where("positive"), "score", "positive").first()["auc"] is None
