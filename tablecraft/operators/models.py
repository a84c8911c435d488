"""Preparing data and fitting classifiers on ``pyspark.ml``.

Fits run on the executors; the driver gets models and metrics only. Transformers are fitted on training rows alone.
"""

import itertools
import random
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, MinMaxScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import many_fits
from .profile import categorical, numeric


def columns_by_type(df: DataFrame, but: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns."""
    return [c for c in numeric(df) if c not in but], [c for c in categorical(df) if c not in but]


#: Combinations of missing columns that are told apart at most; beyond that columns are regressed one after another.
PATTERNS = 1_000


def impute_numeric(df: DataFrame, columns: list[str], rounds: int = 10, ridge: float = 1e-6, through=None) -> DataFrame:
    """Fill NULLs by chained regressions: means first, then round by round each column with NULLs from all others, by the
    rows that know it. Known cells never change; a column without any value stays NULL.

    What stands in a gap is, after every step, linear in the row's known cells, and in the same way for all rows that lack
    the same columns. So products of known cells, summed up for each such pattern in one pass, are all that the regressions
    of all rounds need: these are solved on the driver, in matrices of the number of columns, and a last narrow pass fills
    the gaps. Features are held down by ``ridge`` in units of their standard deviation. Where there are more than
    ``PATTERNS`` patterns, each regression is a pass of its own, and ``through`` is called with the table after each round
    and returns it with its lineage cut."""
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns], F.count("*").alias("_all")).first()
    gaps = [c for c in columns if 0 < nulls[c] < nulls["_all"]]
    used = [c for c in columns if nulls[c] < nulls["_all"]]
    if not gaps:
        return df
    if df.select(*[F.col(c).isNull().alias(f"_{c}") for c in gaps]).distinct().limit(PATTERNS + 1).count() > PATTERNS:
        return _impute_one_by_one(df, used, gaps, rounds, ridge, through)
    places = [used.index(c) for c in gaps]
    cells = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(used)])

    def products(b: pa.RecordBatch) -> dict[str, np.ndarray]:
        x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1).astype(float)
        code = [row.tobytes() for row in np.isnan(x[:, places])]
        z = np.c_[np.nan_to_num(x), np.ones(len(x))]
        names, of = np.unique(code, return_inverse=True)
        return {"".join("01"[v] for v in n.ljust(len(places), b"\0")): z[of == k].T @ z[of == k] for k, n in enumerate(names)}

    d = len(used) + 1
    sums = {name: v.reshape(d, d) for name, v in many_fits.totals(cells, products).items()}
    fills = chained_regressions({tuple(c == "1" for c in name): v for name, v in sums.items()}, places, rounds, ridge)
    pattern = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in gaps])
    table = df.sparkSession.createDataFrame([("".join("01"[m] for m in missing), v.tolist()) for missing, v in fills.items()], "_pattern string, _fill array<array<double>>")
    both = df.withColumn("_pattern", pattern).join(F.broadcast(table), "_pattern")
    known = [*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in used], F.lit(1.0)]
    filled = both.withColumn("_known", F.array(*known))
    value = lambda i: F.aggregate(F.zip_with("_known", F.col("_fill")[i], lambda x, w: x * w), F.lit(0.0), lambda a, b: a + b)
    return filled.withColumns({c: F.coalesce(F.col(c).cast("double"), value(i)) for i, c in enumerate(gaps)}).select(*df.columns)


def _regression(gram: np.ndarray, target: int, others: list[int], ridge: float) -> np.ndarray:
    """Weights of ``others`` and an intercept for the target, from sums of products whose last row and column are of 1."""
    n = gram[-1, -1]
    mean = gram[-1] / n
    cov = gram / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov)[others], 0))
    scale = np.where(scale > 1e-12 * (1 + abs(mean[others])), scale, np.inf)
    r = cov[np.ix_(others, others)] / np.outer(scale, scale) + ridge * np.eye(len(others))
    w = np.linalg.solve(r, cov[others, target] / scale) / scale
    return np.r_[w, mean[target] - mean[others] @ w]


def chained_regressions(sums: dict[tuple[bool, ...], np.ndarray], places: list[int], rounds: int, ridge: float) -> dict[tuple[bool, ...], np.ndarray]:
    """For each pattern of missing columns how each of these follows from a row's known cells and 1: an array (gaps,
    cells + 1). ``sums`` are products of cells, missing ones being 0, and 1, ``places`` the columns with gaps."""
    d = len(next(iter(sums.values())))
    total = sum(sums.values())
    fill = {m: np.eye(d) for m in sums}  # all cells by the known ones
    for g, c in enumerate(places):
        n = sum(v[-1, -1] for m, v in sums.items() if not m[g])
        for m in sums:
            if m[g]:
                fill[m][c] = np.eye(d)[-1] * (total[-1, c] / n)
    for _ in range(rounds):
        for g, c in enumerate(places):
            others = [i for i in range(d - 1) if i != c]
            gram = sum(fill[m] @ v @ fill[m].T for m, v in sums.items() if not m[g])
            w = _regression(gram, c, others, ridge)
            for m in sums:
                if m[g]:
                    fill[m][c] = w @ fill[m][[*others, d - 1]]
    return {m: f[places] for m, f in fill.items()}


def _impute_one_by_one(df: DataFrame, columns: list[str], gaps: list[str], rounds: int, ridge: float, through) -> DataFrame:
    work = df.withColumns({f"_lacks_{c}": F.col(c).isNull() for c in gaps}).withColumns({c: F.col(c).cast("double") for c in columns})
    means = work.agg(*[F.avg(c).alias(c) for c in gaps]).first()
    work = work.fillna({c: means[c] for c in gaps})
    for _ in range(rounds):
        work = through(work) if through else work
        for c in gaps:
            cells = work.where(~F.col(f"_lacks_{c}")).select(*columns)

            def products(b: pa.RecordBatch) -> dict[str, np.ndarray]:
                z = np.c_[np.stack([v.to_numpy() for v in b.columns], 1), np.ones(b.num_rows)]
                return {"all": z.T @ z}

            others = [i for i, x in enumerate(columns) if x != c]
            w = _regression(many_fits.totals(cells, products)["all"].reshape(len(columns) + 1, -1), columns.index(c), others, ridge)
            said = F.lit(float(w[-1]))
            for weight, i in zip(w, others, strict=False):
                said = said + F.lit(float(weight)) * F.col(columns[i])
            work = work.withColumn(c, F.when(F.col(f"_lacks_{c}"), said).otherwise(F.col(c)))
    return work.select(*df.columns)


def impute_categorical(df: DataFrame, columns: list[str], by: list[str], dataset: int = 2, rounds: int = 5, trees: int = 10, seed: int = 7, through=None) -> DataFrame:
    """Fill NULLs of text columns with the class that a random forest predicts from the numeric columns ``by`` and, from
    the second round on, from the other text columns as filled before. Known cells never change. Of the several completed
    tables, ``dataset`` is one: each has a seed of its own. ``through`` is called with the table after each round and
    returns it with its lineage cut."""
    gaps = [c for c in columns if df.where(F.col(c).isNull()).limit(1).count() and df.where(F.col(c).isNotNull()).limit(1).count()]
    if not gaps:
        return df
    work = df.withColumns({f"_was_null_{c}": F.col(c).isNull() for c in gaps})
    for r in range(rounds):
        work = through(work) if through else work
        for c in gaps:
            others = [] if r == 0 else [x for x in columns if x != c]
            stages = [StringIndexer(inputCol=x, outputCol=f"_i_{x}", handleInvalid="keep", stringOrderType="alphabetAsc") for x in others]
            known = work.where(~F.col(f"_was_null_{c}"))
            labels = StringIndexer(inputCol=c, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="keep").fit(known)
            assembler = VectorAssembler(inputCols=[*by, *[f"_i_{x}" for x in others]], outputCol="_x", handleInvalid="keep")
            bins = max([32, *[work.select(x).distinct().count() + 1 for x in others]])
            forest = RandomForestClassifier(featuresCol="_x", labelCol="_label", predictionCol="_p", probabilityCol="_q", rawPredictionCol="_r", numTrees=trees, maxBins=bins, seed=seed + 1000 * dataset + r)
            model = Pipeline(stages=[*stages, assembler, forest]).fit(labels.transform(known))
            named = IndexToString(inputCol="_p", outputCol="_named", labels=labels.labels)
            filled = named.transform(model.transform(work.withColumn("_label", F.lit(0.0))))
            work = filled.withColumn(c, F.when(F.col(f"_was_null_{c}"), F.col("_named")).otherwise(F.col(c))).select(*work.columns)
    return work.select(*df.columns)


def _uniform(*of) -> Column:
    """A number from 0 to 1 that the values decide."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / float(1 << 53)


def impute_categorical_sets(df: DataFrame, key: str, columns: list[str], by: list[str], datasets: int = 4, rounds: int = 2, steps: int = 30, seed: int = 7, through=None) -> DataFrame:
    """Several completed tables in one, told apart by ``dataset`` from 0, so that their spread shows how sure a fill is.

    NULLs of text columns are filled by chained draws: a multinomial regression on the numbers ``by``, which have no NULLs,
    and from the second round on on the other text columns as filled in the same data set, gives each row the chances of
    the classes, from which one is drawn. Each data set has a bootstrap sample of the known rows of its own, and all are
    fitted side by side. Draws follow from ``key``, the data set and ``seed``: the same in every run. Known cells never
    change. The classes of a column come to the driver. ``through`` is called with the table after each column and returns
    it with its lineage cut."""
    classes = {c: sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().collect()) for c in columns}
    gaps = [c for c in columns if classes[c] and df.where(F.col(c).isNull()).limit(1).count()]
    work = df.withColumn("dataset", F.explode(F.array(*[F.lit(i) for i in range(datasets)]))).withColumns({f"_was_null_{c}": F.col(c).isNull() for c in gaps})
    for r in range(rounds):
        for c in gaps:
            work = through(work) if through else work
            others = [] if r == 0 else [x for x in columns if x != c]
            x = F.concat(F.array(*[F.col(n).cast("double") for n in by]), *[F.array(*[F.col(o).eqNullSafe(v).cast("double") for v in classes[o]]) for o in others])
            u = _uniform(key, "dataset", F.lit(f"rows {c} {r} {seed}"))
            times = F.when(u < 0.36788, 0).when(u < 0.73576, 1).when(u < 0.91970, 2).when(u < 0.98101, 3).otherwise(4)  # Poisson of mean 1
            known = work.where(~F.col(f"_was_null_{c}")).select(array_to_vector(x).alias("features"), (F.array_position(F.array(*[F.lit(v) for v in classes[c]]), F.col(c)) - 1).alias("label"), F.col("dataset").alias("fold"), times.alias("_times"))
            known = known.where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times")))
            model, _ = many_fits.fit_logistic(known, [many_fits.Fit((("regParam", 0.01),), m, True) for m in range(datasets)], steps)
            drawn = _drawn(model)(x, "dataset", _uniform(key, "dataset", F.lit(f"draw {c} {r} {seed}")))
            named = F.element_at(F.array(*[F.lit(v) for v in classes[c]]), drawn + 1)
            work = work.withColumn(c, F.when(F.col(f"_was_null_{c}"), named).otherwise(F.col(c)))
    return work.select("dataset", *df.columns)


def _drawn(model: many_fits.Logistic):
    def draw(x: pd.Series, dataset: pd.Series, u: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="int32")
        scores = model.scores(np.stack(x))[np.arange(len(x)), dataset.to_numpy()]
        chance = np.exp(scores - scores.max(1, keepdims=True)).cumsum(1)
        return pd.Series((chance < u.to_numpy()[:, None] * chance[:, -1:]).sum(1).astype("int32"))

    return F.pandas_udf(draw, "int")


def spread_of_sets(sets: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, least, most): how few and how many rows have each value among the data sets."""
    long = sets.select("dataset", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])).alias("x")).select("dataset", "x.*")
    n = long.groupBy("column", "value").pivot("dataset").count().fillna(0)
    each = [F.col(f"`{c}`") for c in n.columns[2:]]
    return n.select("column", "value", F.array_min(F.array(*each)).alias("least"), F.array_max(F.array(*each)).alias("most"))


def _placed(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """``df`` with ``_place``, gapless from 1 within each class in the order of a hash of the key, and ``_all``, the size of
    the class. Rows are numbered within a class's 4,096 blocks of the hash only, after the blocks' counts."""
    marked = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))).withColumn("_block", F.shiftright("_h", 52))
    counts = marked.groupBy(F.col(label).alias("_class"), F.col("_block").alias("_of")).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("_class")
    upto = whole.orderBy("_of").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.select("_class", "_of", (F.sum("_n").over(upto) - F.col("_n")).alias("_start"), F.sum("_n").over(whole).alias("_all"))
    within = Window.partitionBy("_class", "_of").orderBy("_h", key)
    both = marked.join(counts, F.col(label).eqNullSafe(F.col("_class")) & (F.col("_block") == F.col("_of")))
    return both.withColumn("_place", F.col("_start") + F.row_number().over(within)).drop("_h", "_block", "_class", "_of", "_start")


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.3, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(train, test): of each class the share, to within a row, by a hash of the key; the same rows every time."""
    marked = _placed(df, label, key, seed).withColumn("_test", F.col("_place") <= F.round(F.col("_all") * share)).drop("_place", "_all")
    return marked.where(~F.col("_test")).drop("_test"), marked.where("_test").drop("_test")


def folds(df: DataFrame, label: str, key: str, k: int = 10, seed: int = 1, name: str = "fold") -> DataFrame:
    """A fold number for each row, classes spread evenly."""
    return _placed(df, label, key, seed).withColumn(name, (F.col("_place") % k).cast("int")).drop("_place", "_all")


def column_pipeline(numbers: list[str], texts: list[str], label: str | None = None) -> Pipeline:
    """Min-max scaled numbers and alphabetical indices of texts as ``features``; other columns pass."""
    stages: list = []
    if numbers:
        stages += [VectorAssembler(inputCols=numbers, outputCol="_numbers", handleInvalid="keep"), MinMaxScaler(inputCol="_numbers", outputCol="_scaled")]
    if texts:
        stages.append(StringIndexer(inputCols=texts, outputCols=[f"_code_{c}" for c in texts], stringOrderType="alphabetAsc", handleInvalid="keep"))
    if label:
        stages.append(StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip"))
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=[*(["_scaled"] if numbers else []), *[f"_code_{c}" for c in texts]], outputCol="features", handleInvalid="keep")])


def logistic(**kw) -> LogisticRegression:
    return LogisticRegression(family="multinomial", **kw)


def random_forest(**kw) -> RandomForestClassifier:
    return RandomForestClassifier(**({"numTrees": 50, "seed": 1} | kw))


@dataclass
class SideBySide:
    """An estimator whose folds and draws of parameters are fitted together, a pass for each step of all of them."""

    fit_all: Callable
    params: dict

    def fit(self, df: DataFrame):
        return self.fit_all(df, [many_fits.Fit(tuple(sorted(self.params.items())))])[0]

    def fold_scores(self, df: DataFrame, k: int, draws: list[dict] | None = None) -> np.ndarray:
        """Accuracies (draws, folds) on the fold that each fit leaves out."""
        every = [self.params | d for d in draws or [{}]]
        return self.fit_all(df, many_fits.fits_of(every, k))[1].reshape(len(every), k)

    def validated(self, df: DataFrame, k: int) -> tuple[np.ndarray, object]:
        """The accuracies of k folds, and the model of all rows, fitted beside them."""
        mine = tuple(sorted(self.params.items()))
        model, scores = self.fit_all(df, [many_fits.Fit(mine), *many_fits.fits_of([self.params], k)])
        return scores[1:], model


def logistic_side_by_side(**kw) -> SideBySide:
    return SideBySide(many_fits.fit_logistic, kw)


def boosted_trees(**kw) -> SideBySide:
    """Boosted trees for several classes by softmax: ``maxIter`` rounds of 10, ``maxDepth`` 5, ``stepSize`` 0.3 and
    ``subsamplingRate`` 1, if not given."""
    return SideBySide(many_fits.fit_boosted, kw)


def accuracy(predictions: DataFrame) -> float:
    return MulticlassClassificationEvaluator(metricName="accuracy").evaluate(predictions)


def weighted_f1(predictions: DataFrame) -> float:
    return MulticlassClassificationEvaluator(metricName="f1").evaluate(predictions)


def _validated(estimator, df: DataFrame, grid: list[dict], fold: str, k: int, parallelism: int):
    """A cross-validator's model, fitted on the given folds: its best parameters are refitted on all of ``df``."""
    score = MulticlassClassificationEvaluator(metricName="accuracy")
    return CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=score, numFolds=k, foldCol=fold, parallelism=parallelism).fit(df)


def cross_validate(estimator, df: DataFrame, fold: str = "fold", k: int = 10, parallelism: int = 4) -> tuple[float, float]:
    """Mean and standard deviation of the accuracy over the folds."""
    if isinstance(estimator, SideBySide):
        scores = estimator.fold_scores(df.withColumnRenamed(fold, "fold"), k)[0]
        return float(scores.mean()), float(scores.std())
    found = _validated(estimator, df, [{}], fold, k, parallelism)
    return float(found.avgMetrics[0]), float(found.stdMetrics[0])


@dataclass
class Comparison:
    model: str
    cv_mean: float
    cv_std: float
    accuracy: float
    f1: float


def compare(models: dict, train: DataFrame, test: DataFrame, k: int = 10) -> DataFrame:
    """(model, cv_mean, cv_std, accuracy, f1), a row for each model."""
    rows = []
    for name, m in models.items():
        if isinstance(m, SideBySide):
            scores, model = m.validated(train, k)
            mean, std = float(scores.mean()), float(scores.std())
        else:
            found = _validated(m, train, [{}], "fold", k, 4)
            mean, std, model = float(found.avgMetrics[0]), float(found.stdMetrics[0]), found.bestModel
        p = model.transform(test).select("label", "prediction").persist()
        rows.append(Comparison(name, mean, std, accuracy(p), weighted_f1(p)))
        p.unpersist()
    return train.sparkSession.createDataFrame(rows)


def random_search(estimator, grid: dict[str, list], train: DataFrame, n: int = 50, k: int = 5, seed: int = 1, parallelism: int = 8):
    """(best score, parameters, model refitted on all of train) among ``n`` random draws from a grid, no draw twice."""
    every = [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]
    draws = random.Random(seed).sample(every, min(n, len(every)))
    if isinstance(estimator, SideBySide):
        means = estimator.fold_scores(train, k, draws).mean(1)
        best = int(means.argmax())
        return float(means[best]), draws[best], SideBySide(estimator.fit_all, estimator.params | draws[best]).fit(train)
    found = _validated(estimator, train, [{estimator.getParam(p): v for p, v in d.items()} for d in draws], "fold", k, parallelism)
    best = max(range(len(draws)), key=lambda i: (found.avgMetrics[i], -i))
    return float(found.avgMetrics[best]), draws[best], found.bestModel


def confusion(predictions: DataFrame, label: str = "label") -> DataFrame:
    return predictions.groupBy(F.col(label).cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction")).agg(F.count("*").alias("n"))


def class_metrics(predictions: DataFrame, label: str = "label") -> DataFrame:
    """(class, precision, recall, f1, support) from the confusion counts."""
    c = confusion(predictions, label)
    rows = c.select(F.explode(F.array(F.struct(F.col("label").alias("class"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("said")),
                                      F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("said")))).alias("x")).select("x.*")
    g = rows.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("actual").alias("support"), F.sum("said").alias("said"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    g = g.withColumn("precision", zero(F.try_divide("tp", "said"))).withColumn("recall", zero(F.try_divide("tp", "support")))
    return g.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))).select("class", "precision", "recall", "f1", "support")


def _cumulated(scores: DataFrame, score: str, positive: str, by: str | None, blocks: int = 64) -> DataFrame:
    """(by, score, p, n, tp, fp, all_p, all_n): at every score its positive and all rows, those of this score and above,
    and those of the whole class. Rows are counted by score first; scores are dealt to blocks of about equal size, blocks
    are summed up, and sums within a block need that block only."""
    keys = [by] if by else []
    g = scores.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.count("*").alias("n"))
    cuts = sorted(set(g.approxQuantile("score", [i / blocks for i in range(1, blocks)], 0.005)))
    g = g.withColumn("_block", F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c >= F.col("score"))))
    sums = g.groupBy(*keys, "_block").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_block").alias("_of"), *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in "pn"], *[F.sum(f"_{c}").over(whole).alias(f"all_{c}") for c in "pn"])
    on = [g["_block"] == sums["_of"], *[g[k].eqNullSafe(sums[f"_{k}"]) for k in keys]]
    down = Window.partitionBy(*keys, "_block").orderBy(F.desc("score"))
    tp, n = F.col("_p") + F.sum("p").over(down), F.col("_n") + F.sum("n").over(down)
    return g.join(sums, on).select(*keys, "score", "p", "n", tp.alias("tp"), (n - tp).alias("fp"), "all_p", (F.col("all_n") - F.col("all_p")).alias("all_n"))


def roc_points(scores: DataFrame, score: str, positive: str, by: str | None = None) -> DataFrame:
    """(fpr, tpr) at every score."""
    keys = [by] if by else []
    return _cumulated(scores, score, positive, by).select(*keys, "score", F.try_divide("tp", "all_p").alias("tpr"), F.try_divide("fp", "all_n").alias("fpr"))


def auc(scores: DataFrame, score: str, positive: str, by: str | None = None) -> DataFrame:
    """The area under the curve: of the pairs of a positive and a negative row the share that is in order, equal scores
    counting half."""
    keys = [by] if by else []
    pairs = (F.col("n") - F.col("p")) * (F.col("tp") - F.col("p") / 2)
    return _cumulated(scores, score, positive, by).groupBy(*keys).agg(F.try_divide(F.sum(pairs), F.first("all_p") * F.first("all_n")).alias("auc"))


def roc_auc_ovr(predictions: DataFrame, classes: int, label: str = "label", probability: str = "probability") -> DataFrame:
    """(class, auc) of each class against the rest."""
    p = predictions.select(F.col(label).alias("_l"), vector_to_array(probability).alias("_p"))
    rows = p.select(F.explode(F.array(*[F.struct(F.lit(k).alias("class"), F.col("_p")[k].alias("score"), (F.col("_l") == k).alias("positive")) for k in range(classes)])).alias("x")).select("x.*")
    return auc(rows, "score", "positive", "class")
