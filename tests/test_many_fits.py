"""Fits side by side against fits one by one, against Spark's own, and on data whose answer is known."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablecraft.operators import many_fits, models
from tablecraft.operators.many_fits import Fit


@pytest.fixture(scope="module")
def clouds(spark):
    """Three classes around corners, a tenth of the rows of another class than theirs, and a constant feature."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(600):
        x = rng.normal([(0, 0), (6, 0), (0, 60)][i % 3], (1.0, 10.0))
        rows.append((i, [*map(float, x), 7.0], float(i % 3 if i % 10 else (i + 1) % 3)))
    df = spark.createDataFrame(rows, "id long, x array<double>, label double")
    return models.folds(df.select("id", array_to_vector("x").alias("features"), "label"), "label", "id", 4).cache()


def test_logistic_fits_equal_sparks(clouds):
    draws = [{"regParam": 0.1, "elasticNetParam": 0.0}, {"regParam": 0.05, "elasticNetParam": 0.5}]
    fits = [*many_fits.fits_of(draws, 2), Fit((("regParam", 0.1),))]
    model, scores = many_fits.fit_logistic(clouds, fits, steps=150, tolerance=1e-9)
    for i, f in enumerate(fits):
        seen = clouds.where(F.col("fold") != f.fold)
        theirs = LogisticRegression(family="multinomial", regParam=f.get("regParam", 0), elasticNetParam=f.get("elasticNetParam", 0), maxIter=400, tol=1e-10).fit(seen)
        w = model.weights[i]
        assert w[:-1].T == pytest.approx(theirs.coefficientMatrix.toArray(), abs=2e-3)
        intercept = w[-1] - model.mean @ w[:-1]
        assert intercept - intercept.mean() == pytest.approx(theirs.interceptVector.toArray(), abs=2e-2)
        if f.fold >= 0:
            assert scores[i] == pytest.approx(models.accuracy(theirs.transform(clouds.where(F.col("fold") == f.fold))), abs=0.01)


def test_fits_side_by_side_equal_single_ones(clouds):
    fits = many_fits.fits_of([{"stepSize": 0.5, "maxDepth": 2}, {"maxIter": 2, "subsamplingRate": 0.7}], 2)
    together, scores = many_fits.fit_boosted(clouds, fits, rounds=3, depth=3)
    for i, f in enumerate(fits):
        alone, score = many_fits.fit_boosted(clouds, [f], rounds=3, depth=3)
        shape = alone.value.shape
        part = tuple(slice(0, n) for n in shape[1:])
        if f.get("subsamplingRate", 1) == 1:
            assert (together.feature[(i, *part)] == alone.feature[0]).all() and together.value[(i, *part)] == pytest.approx(alone.value[0])
            assert scores[i] == score[0]
        assert scores[i] > 0.8


def test_passes_have_a_task_a_core_and_fits_go_in_parts(clouds, monkeypatch):
    """A table in 50 parts: a task's histograms have the same size whatever its rows, so there are no more tasks than cores."""
    many = clouds.repartition(50)
    assert many_fits._rows(many).rdd.getNumPartitions() == many.sparkSession.sparkContext.defaultParallelism
    fits = many_fits.fits_of([{"subsamplingRate": 0.7, "maxDepth": 2}], 3)
    together, scores = many_fits.fit_boosted(many, fits, rounds=3, depth=3)
    monkeypatch.setattr(many_fits, "CARRIED", 3)
    monkeypatch.setattr(many_fits, "CELL_ROWS", 11)
    parts, same = many_fits.fit_boosted(many, fits, rounds=3, depth=3)
    assert (together.feature == parts.feature).all() and together.value == pytest.approx(parts.value)
    for i, f in enumerate(fits):
        seen = clouds.where(F.col("fold") == f.fold)
        alone = many_fits.Boosted(parts.cuts, parts.feature[[i]], parts.bin[[i]], parts.value[[i]], parts.depth, parts.rounds)
        assert scores[i] == same[i] == pytest.approx(models.accuracy(alone.transform(seen)))


def test_boosted_trees_learn_what_takes_depth(spark):
    """Four classes on a chessboard: no single cut helps, two do; a table of one class and one row."""
    rng = random.Random(4)
    rows = [(i, [x := rng.random(), y := rng.random(), rng.random()], float(2 * (x > 0.5) + (y > 0.3))) for i in range(800)]
    board = spark.createDataFrame(rows, "id long, x array<double>, label double").select("id", array_to_vector("x").alias("features"), "label")
    model = models.boosted_trees(maxIter=6, maxDepth=3).fit(board)
    out = model.transform(board)
    assert models.accuracy(out) > 0.97 and {"probability", "prediction", "features", "label"} <= set(out.columns)
    one = board.limit(1).withColumn("label", F.lit(0.0))
    assert models.accuracy(models.boosted_trees(maxIter=2).fit(one).transform(one)) == 1


def test_best_splits_by_trying_all():
    rng = np.random.default_rng(1)
    g, h = rng.normal(size=(5, 4, 6)), rng.random((5, 4, 6))
    g[:, 1:] *= g[:, :1].sum(2, keepdims=True) / g[:, 1:].sum(2, keepdims=True)
    h[:, 1:] *= h[:, :1].sum(2, keepdims=True) / h[:, 1:].sum(2, keepdims=True)
    gain, feature, cut, *_ = many_fits.best_splits(g, h, 1.0, 0.4)
    for n in range(5):
        tried = {}
        for f in range(4):
            for c in range(5):
                a, b, p, q = g[n, f, : c + 1].sum(), g[n, f, c + 1 :].sum(), h[n, f, : c + 1].sum(), h[n, f, c + 1 :].sum()
                if min(p, q) >= 0.4:
                    tried[f, c] = a * a / (p + 1) + b * b / (q + 1) - (a + b) ** 2 / (p + q + 1)
        assert gain[n] == pytest.approx(max(tried.values())) and tried[feature[n], cut[n]] == pytest.approx(gain[n])


def test_search_and_folds_of_both_kinds(clouds):
    score, params, model = models.random_search(models.logistic_side_by_side(maxIter=60), {"regParam": [0.01, 50.0], "elasticNetParam": [0.0, 0.5]}, clouds, n=50, k=4)
    assert params["regParam"] == 0.01 and score > 0.85 and models.accuracy(model.transform(clouds)) > 0.85
    score, params, model = models.random_search(models.boosted_trees(), {"maxIter": [1, 2], "stepSize": [0.001, 0.5]}, clouds, n=3, k=2)
    assert score > 0.8 and models.accuracy(model.transform(clouds)) > 0.85
    mean, std = models.cross_validate(models.logistic_side_by_side(regParam=0.01), clouds, k=4)
    assert mean > 0.85 and 0 <= std < 0.1


def chained(x, rounds, ridge=1e-6):
    """Chained regressions column by column with numpy."""
    gaps = np.isnan(x)
    z = np.where(gaps, np.nanmean(x, 0), x)
    for _ in range(rounds):
        for c in np.flatnonzero(gaps.any(0)):
            others = [i for i in range(x.shape[1]) if i != c]
            a, y = z[~gaps[:, c]][:, others], z[~gaps[:, c], c]
            m, s = a.mean(0), a.std(0)
            s = np.where(s > 0, s, np.inf)
            w = np.linalg.solve(((a - m) / s).T @ ((a - m) / s) / len(a) + ridge * np.eye(len(others)), ((a - m) / s).T @ (y - y.mean()) / len(a)) / s
            z[gaps[:, c], c] = y.mean() + (z[gaps[:, c]][:, others] - m) @ w
    return z


@pytest.mark.parametrize("patterns", [1000, 2])
def test_numeric_imputer_equals_regressions_one_by_one(spark, tmp_path, monkeypatch, patterns):
    monkeypatch.setattr(models, "PATTERNS", patterns)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 4)) @ rng.normal(size=(4, 4)) + 3
    x[:, 3] += x[:, 0]
    x[rng.random(x.shape) < [0.2, 0.1, 0, 0.3]] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], None) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double").repartition(3)
    at = iter(range(100))

    def through(t):
        t.write.parquet(path := f"{tmp_path}/{next(at)}")
        return spark.read.schema(t.schema).parquet(path)

    out = models.impute_numeric(df, ["a", "b", "c", "d", "e"], rounds=3, through=through)
    assert out.columns == df.columns
    found = np.array([[r[c] for c in "abcd"] for r in out.orderBy("id").collect()])
    assert found == pytest.approx(chained(x, 3), abs=1e-6) and out.where("e is not null").count() == 0
    assert models.impute_numeric(df, ["c"]) is df
