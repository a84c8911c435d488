"""Profiles, quality checks and models over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, models, profile
from ..sources import files
from .registry import query, table

S, D = SparkSession, DataFrame
_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(c: str) -> str:
    q = ", ".join(f"round(quantile_cont({c}, {p}), 6) AS q{int(p * 100)}" for p in (0.25, 0.5, 0.75))
    return f"SELECT '{c}' AS \"column\", COUNT({c}) AS n, round(AVG({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(MIN({c}), 6) AS least, {q}, round(MAX({c}), 6) AS most FROM lineitem"


@query(" UNION ALL ".join(_describe_sql(c) for c in _NUM))
def describe_stats(spark: S, d: str) -> D:
    out = profile.describe(table(spark, d, "lineitem"), _NUM)
    return out.select("column", "n", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


_GAPPED = "SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS status, NULLIF(o_orderpriority, '5-LOW') AS priority, CASE WHEN o_custkey % 10 > 0 THEN o_custkey END AS customer FROM orders"


def _gapped(spark: S, d: str) -> D:
    return table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"), F.when(F.col("o_custkey") % 10 > 0, F.col("o_custkey")).alias("customer"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", COUNT(*) FILTER ({c} IS NULL) AS nulls FROM ({_GAPPED})" for c in ("o_orderkey", "status", "priority", "customer")))
def null_counts(spark: S, d: str) -> D:
    return profile.null_counts(_gapped(spark, d))


@query(f"SELECT (COUNT(*) * 3 - COUNT(status) - COUNT(priority) - COUNT(customer))::BIGINT AS nulls FROM ({_GAPPED})")
def total_nulls(spark: S, d: str) -> D:
    return profile.total_nulls(_gapped(spark, d))


@query("SELECT SUM(n - 1)::BIGINT AS duplicates FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def duplicate_count(spark: S, d: str) -> D:
    return profile.duplicate_count(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", COUNT({c}) AS non_null, '{t}' AS type FROM ({_GAPPED})" for c, t in (("o_orderkey", "bigint"), ("status", "string"), ("priority", "string"), ("customer", "bigint"))))
def schema_info(spark: S, d: str) -> D:
    return profile.schema_info(_gapped(spark, d))


@query("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY 1, 2")
def crosstab_count(spark: S, d: str) -> D:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT least(floor((c_acctbal - lo) / ((hi - lo) / 20.0)), 19)::INT AS bin, COUNT(*) AS n FROM customer, (SELECT MIN(c_acctbal) AS lo, MAX(c_acctbal) AS hi FROM customer) GROUP BY 1")
def histogram_bins(spark: S, d: str) -> D:
    return profile.histogram(table(spark, d, "customer"), "c_acctbal", 20)


_GRID = ", ".join(repr((i + 0.5) / 99) for i in range(99))


@query(f"WITH q AS (SELECT quantile_cont(c_acctbal::DOUBLE, [{_GRID}]) AS a FROM customer) SELECT i - 1 AS point, round(a[i], 6) AS sample FROM q, (SELECT unnest(range(1, 100)) AS i)")
def qq_points(spark: S, d: str) -> D:
    """The sample quantiles; each point's theoretical one is a constant."""
    found = profile.qq_points(table(spark, d, "customer"), "c_acctbal")
    return found.select(F.round(F.col("p") * 99 - 0.5).cast("long").alias("point"), F.round("sample", 6).alias("sample"))


_BOX = "SELECT quantile_cont(p_retailprice, 0.25) AS q1, quantile_cont(p_retailprice, 0.5) AS median, quantile_cont(p_retailprice, 0.75) AS q3 FROM part"


@query(f"SELECT round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(q1 - 1.5 * (q3 - q1), 6) AS low, round(q3 + 1.5 * (q3 - q1), 6) AS high FROM ({_BOX})")
def boxplot_stats(spark: S, d: str) -> D:
    b = profile.box(table(spark, d, "part"), "p_retailprice")
    return b.select(*[F.round(c, 6).alias(c) for c in b.columns])


@query("SELECT e.* FROM events e, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)")
def boxplot_outliers(spark: S, d: str) -> D:
    return profile.outliers(table(spark, d, "events"), "value")


@query(f"SELECT o_orderkey, (status IS NULL)::INT AS status, (priority IS NULL)::INT AS priority, (customer IS NULL)::INT AS customer FROM ({_GAPPED})")
def null_matrix(spark: S, d: str) -> D:
    return profile.null_matrix(_gapped(spark, d), "o_orderkey")


@query(f"SELECT '0' || (status IS NULL)::INT || (priority IS NULL)::INT || (customer IS NULL)::INT AS pattern, COUNT(*) AS n FROM ({_GAPPED}) GROUP BY 1")
def null_patterns(spark: S, d: str) -> D:
    return profile.null_patterns(_gapped(spark, d))


@query(" UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS feature, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3 FROM lineitem GROUP BY 1" for c in _NUM[:2]))
def value_by_class(spark: S, d: str) -> D:
    out = profile.quartiles_by_class(table(spark, d, "lineitem"), _NUM[:2], "l_returnflag")
    return out.select("l_returnflag", "feature", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")])


# --- checks


@query("SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def pk_violations(spark: S, d: str) -> D:
    return checks.pk_violations(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def fk_orphans(spark: S, d: str) -> D:
    return checks.fk_orphans(table(spark, d, "lineitem"), "l_orderkey", table(spark, d, "orders").where("o_orderstatus <> 'P'"), "o_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", COUNT(*) FILTER ({c} IS NULL) AS nulls FROM ({_GAPPED})" for c in ("status", "priority", "customer")))
def not_null_violations(spark: S, d: str) -> D:
    return checks.not_null_violations(_gapped(spark, d), ["o_orderkey", "status", "priority", "customer"])


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def domain_violations(spark: S, d: str) -> D:
    return checks.domain_violations(table(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).select("o_orderkey", "o_orderpriority")


@query("SELECT p_partkey, p_brand AS strange FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2')")
def set_violations(spark: S, d: str) -> D:
    members = table(spark, d, "part").withColumn("members", F.concat(F.lit("Brand#1,"), "p_brand"))
    return checks.set_violations(members, "members", ["Brand#1", "Brand#2"]).select("p_partkey", F.array_join("strange", ",").alias("strange"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE NOT (c_acctbal BETWEEN 0 AND 9000)")
def range_violations(spark: S, d: str) -> D:
    return checks.range_violations(table(spark, d, "customer"), "c_acctbal", 0.0, 9000.0).select("c_custkey", "c_acctbal")


@query(f"SELECT o_orderkey, COALESCE(status, 'O') AS status, COALESCE(priority, 'none') AS priority, COALESCE(customer, -1) AS customer FROM ({_GAPPED})")
def default_fill(spark: S, d: str) -> D:
    return checks.fill_defaults(_gapped(spark, d), {"status": "O", "priority": "none", "customer": -1})


_SCHEMA = {
    "region": checks.Constraints(["r_regionkey"], [["r_name"]]),
    "nation": checks.Constraints(["n_nationkey"], not_null=["n_name"], foreign={"n_regionkey": ("region", "r_regionkey")}),
    "customer": checks.Constraints(["c_custkey"], not_null=["c_name"], ranges={"c_acctbal": (0, 9000)}, foreign={"c_nationkey": ("nation", "n_nationkey")}),
    "supplier": checks.Constraints(["s_suppkey"], foreign={"s_nationkey": ("nation", "n_nationkey")}),
    "part": checks.Constraints(["p_partkey"], [["p_name", "p_brand"]], ranges={"p_size": (1, 40)}),
    "orders": checks.Constraints(["o_orderkey"], domains={"o_orderstatus": ["O", "F"]}, foreign={"o_custkey": ("customer", "c_custkey")}),
    "lineitem": checks.Constraints(["l_orderkey", "l_linenumber"], not_null=["l_shipdate"], domains={"l_returnflag": ["A", "N"]}, ranges={"l_quantity": (1, 45), "l_discount": (0, 0.05)}, foreign={"l_orderkey": ("orders", "o_orderkey"), "l_partkey": ("part", "p_partkey"), "l_suppkey": ("supplier", "s_suppkey")}),
    "events": checks.Constraints(["event_id"], not_null=["ts"], domains={"event_type": ["click", "view"]}, foreign={"user_id": ("customer", "c_custkey")}),
}


def _schema_sql() -> str:
    parts = []
    for t, has in _SCHEMA.items():
        for kind, columns in has.names():
            c = columns
            if kind in ("primary key", "unique"):
                known = " AND ".join(f"{x} IS NOT NULL" for x in columns.split(", "))
                n = f"(SELECT COUNT(*) FROM (SELECT {c} FROM {t} WHERE {known} GROUP BY {c} HAVING COUNT(*) > 1))"
            elif kind == "foreign key":
                parent, at = has.foreign[c]
                n = f"(SELECT COUNT(*) FROM {t} WHERE {c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} WHERE {at} = {c}))"
            else:
                broken = {"not null": lambda c: f"{c} IS NULL", "domain": lambda c: f"{c} NOT IN ({', '.join(repr(v) for v in has.domains[c])})", "range": lambda c: "NOT ({0} BETWEEN {1} AND {2})".format(c, *has.ranges[c])}[kind](c)
                n = f"(SELECT COUNT(*) FROM {t} WHERE {broken})"
            parts.append(f"SELECT '{t}' AS \"table\", '{kind}' AS kind, '{c}' AS columns, {n} AS n")
    return " UNION ALL ".join(parts)


@query(_schema_sql())
def schema_constraints(spark: S, d: str) -> D:
    """All constraints of eight tables, of which some are stricter than the data."""
    return checks.schema_violations({t: table(spark, d, t) for t in _SCHEMA}, _SCHEMA)


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS id FROM customer")
def surrogate_key_in_order(spark: S, d: str) -> D:
    """Gapless numbers in the order of a column, without a window over the table."""
    return checks.ordered_keys(table(spark, d, "customer"), "id", "c_custkey").select("c_custkey", "id")


@query("SELECT COUNT(*) AS n, 1::BIGINT AS least, COUNT(*) AS most, COUNT(*) AS different FROM customer")
def surrogate_key(spark: S, d: str) -> D:
    keyed = checks.surrogate_keys(table(spark, d, "customer"), "id", ["c_custkey"])
    return keyed.agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("most"), F.countDistinct("id").alias("different"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN NULL WHEN o_custkey % 10 = 1 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey FROM orders")
def fk_action_apply(spark: S, d: str) -> D:
    gone = table(spark, d, "customer").where("c_custkey % 10 = 0")
    renamed = table(spark, d, "customer").where("c_custkey % 10 = 1").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1000000).alias("new"))
    o = checks.on_delete_set_null(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", gone, "c_custkey")
    return checks.on_update_cascade(o, "o_custkey", renamed)


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0")
def fk_restrict(spark: S, d: str) -> D:
    return checks.on_delete_restrict(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer").where("c_custkey % 10 = 0"), "c_custkey").select("o_orderkey")


# --- models


def _labelled(spark: S, d: str) -> D:
    """Vectors in columns x0 to x63, with their label."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(x) for i, x in enumerate(_X)], F.col("label").cast("string").alias("class"))


_X = [f"x{i}" for i in range(64)]


@query("SELECT label::VARCHAR AS class, round(COUNT(*) * 0.3)::BIGINT AS test, COUNT(*) - round(COUNT(*) * 0.3)::BIGINT AS train FROM embeddings GROUP BY 1")
def stratified_split(spark: S, d: str) -> D:
    train, test = models.stratified_split(_labelled(spark, d), "class", "vec_id", 0.3)
    n = lambda df, name: df.groupBy("class").agg(F.count("*").alias(name))
    return n(test, "test").join(n(train, "train"), "class")


@query("SELECT p_partkey, round((p_retailprice - lo) / (hi - lo), 6) AS scaled FROM part, (SELECT MIN(p_retailprice) AS lo, MAX(p_retailprice) AS hi FROM part)")
def minmax_scale(spark: S, d: str) -> D:
    from pyspark.ml.functions import vector_to_array

    p = table(spark, d, "part")
    out = models.column_pipeline(["p_retailprice"], []).fit(p).transform(p)
    return out.select("p_partkey", F.round(vector_to_array("features")[0], 6).alias("scaled"))


@query("SELECT p_partkey, (dense_rank() OVER (ORDER BY p_type) - 1)::DOUBLE AS code FROM part")
def ordinal_encode(spark: S, d: str) -> D:
    from pyspark.ml.functions import vector_to_array

    p = table(spark, d, "part")
    return models.column_pipeline([], ["p_type"]).fit(p).transform(p).select("p_partkey", vector_to_array("features")[0].alias("code"))


@query("SELECT p_partkey, (dense_rank() OVER (ORDER BY p_type) - 1)::DOUBLE AS label FROM part")
def label_encode(spark: S, d: str) -> D:
    p = table(spark, d, "part")
    return models.column_pipeline(["p_size"], [], "p_type").fit(p).transform(p).select("p_partkey", "label")


@query("""SELECT p_partkey, (dense_rank() OVER (ORDER BY p_type) - 1)::DOUBLE AS label, round((p_size - MIN(p_size) OVER ()) / (MAX(p_size) OVER () - MIN(p_size) OVER ())::DOUBLE, 6) AS size,
 round((p_retailprice - MIN(p_retailprice) OVER ()) / (MAX(p_retailprice) OVER () - MIN(p_retailprice) OVER ()), 6) AS price, (dense_rank() OVER (ORDER BY p_brand) - 1)::DOUBLE AS brand FROM part""")
def column_pipeline(spark: S, d: str) -> D:
    from pyspark.ml.functions import vector_to_array

    p = table(spark, d, "part")
    out = models.column_pipeline(["p_size", "p_retailprice"], ["p_brand"], "p_type").fit(p).transform(p).withColumn("x", vector_to_array("features"))
    return out.select("p_partkey", "label", F.round(F.col("x")[0], 6).alias("size"), F.round(F.col("x")[1], 6).alias("price"), F.col("x")[2].alias("brand"))


def _written(df: D) -> D:
    return files.snapshot(df, files.new_path(df.sparkSession, "imputed"))[0]


@query()
def chained_numeric_imputer(spark: S, d: str) -> D:
    x = _labelled(spark, d).withColumn("x0", F.when(F.col("vec_id") % 4 != 0, F.col("x0"))).withColumn("x1", F.when(F.col("vec_id") % 5 != 0, F.col("x1")))

    return models.impute_numeric(x, _X, through=_written)


@query()
def chained_categorical_imputer(spark: S, d: str) -> D:
    """Two text columns with gaps, each predicted from the other and from the vector."""
    x = _labelled(spark, d).withColumn("side", F.when(F.col("x0") > 0, "right").otherwise("left"))
    x = x.withColumn("class", F.when(F.col("vec_id") % 6 != 0, F.col("class"))).withColumn("side", F.when(F.col("vec_id") % 5 != 0, F.col("side")))
    return models.impute_categorical(x, ["class", "side"], _X, through=_written)


@query()
def imputed_data_sets(spark: S, d: str) -> D:
    """Four completed tables of the same gaps, and how far they differ."""
    x = _labelled(spark, d).withColumn("side", F.when(F.col("x0") > 0, "right").otherwise("left"))
    x = x.withColumn("class", F.when(F.col("vec_id") % 6 != 0, F.col("class"))).withColumn("side", F.when(F.col("vec_id") % 5 != 0, F.col("side")))
    return models.spread_of_sets(models.impute_categorical_sets(x, "vec_id", ["class", "side"], _X, through=_written), ["class", "side"])


def _prepared(spark: S, d: str) -> tuple[D, D]:
    """(train, test), split once: every pass of a fit would split again."""
    train, test = (_written(part) for part in models.stratified_split(_labelled(spark, d), "class", "vec_id", 0.3))
    p = models.column_pipeline(_X, [], "class").fit(train)
    shape = lambda df: p.transform(df).select("vec_id", "features", "label")
    return shape(train), shape(test)


def _metrics(spark: S, d: str, model) -> D:
    train, test = _prepared(spark, d)
    p = model.fit(train).transform(test)
    return spark.createDataFrame([(models.accuracy(p), models.weighted_f1(p))], "accuracy double, f1 double")


@query()
def fit_logistic(spark: S, d: str) -> D:
    return _metrics(spark, d, models.logistic(maxIter=20))


@query()
def fit_random_forest(spark: S, d: str) -> D:
    return _metrics(spark, d, models.random_forest())


@query()
def fit_boosted_trees(spark: S, d: str) -> D:
    return _metrics(spark, d, models.boosted_trees())


@query()
def cross_validate(spark: S, d: str) -> D:
    train, _ = _prepared(spark, d)
    mean, std = models.cross_validate(models.logistic_side_by_side(regParam=0.01, maxIter=100), models.folds(train, "label", "vec_id"))
    return spark.createDataFrame([(mean, std)], "mean double, std double")


@query()
def model_comparison(spark: S, d: str) -> D:
    train, test = _prepared(spark, d)
    three = {"logistic": models.logistic_side_by_side(regParam=0.01, maxIter=60), "forest": models.random_forest(), "boosted": models.boosted_trees()}
    return models.compare(three, _written(models.folds(train, "label", "vec_id", 10)), test, k=10)


@query()
def random_search(spark: S, d: str) -> D:
    train, _ = _prepared(spark, d)
    grid = {"maxIter": [20, 40, 60], "regParam": [0.0, 0.001, 0.01, 0.03, 0.1, 0.3], "elasticNetParam": [0.0, 0.1, 0.5, 1.0]}
    best, params, _ = models.random_search(models.logistic_side_by_side(), grid, models.folds(train, "label", "vec_id", 5), n=50, k=5)
    return spark.createDataFrame([(best, str(sorted(params.items())))], "score double, params string")


def _predicted(spark: S, d: str) -> D:
    train, test = _prepared(spark, d)
    return models.logistic(maxIter=20).fit(train).transform(test)


@query()
def classification_metrics(spark: S, d: str) -> D:
    return models.class_metrics(_predicted(spark, d))


@query()
def confusion_matrix(spark: S, d: str) -> D:
    return models.confusion(_predicted(spark, d))


_RULE = "SELECT (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)::INT AS label, (CASE WHEN l_quantity < 20 THEN 0 WHEN l_discount < 0.05 THEN 1 ELSE 3 END)::INT AS prediction FROM lineitem"


def _ruled(spark: S, d: str) -> D:
    """Predictions of a class by a rule, as a job before this one could have written them; one class is never predicted,
    another one never there."""
    label = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    said = F.when(F.col("l_quantity") < 20, 0).when(F.col("l_discount") < 0.05, 1).otherwise(3)
    return table(spark, d, "lineitem").select(label.cast("double").alias("label"), said.cast("double").alias("prediction"))


@query(f"SELECT label, prediction, COUNT(*) AS n FROM ({_RULE}) GROUP BY 1, 2")
def confusion_of_predictions(spark: S, d: str) -> D:
    return models.confusion(_ruled(spark, d))


@query(f"""WITH p AS ({_RULE}), c AS (SELECT class, (SELECT COUNT(*) FROM p WHERE label = class AND prediction = class) AS tp, (SELECT COUNT(*) FROM p WHERE label = class) AS support,
 (SELECT COUNT(*) FROM p WHERE prediction = class) AS said FROM (SELECT label AS class FROM p UNION SELECT prediction FROM p)),
 m AS (SELECT class, COALESCE(tp / NULLIF(said, 0), 0)::DOUBLE AS p, COALESCE(tp / NULLIF(support, 0), 0)::DOUBLE AS r, support FROM c)
 SELECT class, round(p, 8) AS precision, round(r, 8) AS recall, round(COALESCE(2 * p * r / NULLIF(p + r, 0), 0), 8) AS f1, support FROM m""")
def metrics_of_predictions(spark: S, d: str) -> D:
    out = models.class_metrics(_ruled(spark, d))
    return out.select("class", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"""WITH p AS (SELECT label, prediction, COUNT(*)::DOUBLE AS n FROM ({_RULE}) GROUP BY 1, 2)
 SELECT x.label AS class, round(SUM(CASE WHEN x.prediction > y.prediction THEN 1 WHEN x.prediction = y.prediction THEN 0.5 ELSE 0 END::DOUBLE * x.n * y.n) / SUM(x.n * y.n), 8) AS auc
 FROM p x JOIN p y ON x.label <> y.label GROUP BY 1""")
def auc_of_predictions(spark: S, d: str) -> D:
    """How well a score parts each class from the others."""
    p = _ruled(spark, d)
    rows = p.select(F.explode(F.array(*[F.struct(F.lit(k).alias("class"), F.col("prediction").alias("score"), (F.col("label") == k).alias("positive")) for k in range(3)])).alias("x")).select("x.*")
    return models.auc(rows, "score", "positive", "class").select("class", F.round("auc", 8).alias("auc"))


@query()
def roc_auc_ovr(spark: S, d: str) -> D:
    p = _predicted(spark, d)
    return models.roc_auc_ovr(p, table(spark, d, "embeddings").select("label").distinct().count())


@query("SELECT round(SUM((fpr - f0) * (tpr + t0) / 2), 8) AS auc FROM (SELECT fpr, tpr, lag(fpr, 1, 0.0) OVER (ORDER BY s DESC) AS f0, lag(tpr, 1, 0.0) OVER (ORDER BY s DESC) AS t0 FROM (SELECT s, SUM(SUM(p)) OVER (ORDER BY s DESC) / SUM(SUM(p)) OVER () AS tpr, SUM(SUM(1 - p)) OVER (ORDER BY s DESC) / SUM(SUM(1 - p)) OVER () AS fpr FROM (SELECT c_acctbal AS s, CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p FROM customer) GROUP BY s))")
def roc_auc(spark: S, d: str) -> D:
    scored = table(spark, d, "customer").select(F.col("c_acctbal").alias("s"), (F.col("c_mktsegment") == "BUILDING").alias("p"))
    return models.auc(scored, "s", "p").select(F.round("auc", 8).alias("auc"))


@query("SELECT 'p_partkey' AS \"column\", COUNT(p_partkey) AS n FROM part UNION ALL SELECT 'p_size', COUNT(p_size) FROM part UNION ALL SELECT 'p_retailprice', COUNT(p_retailprice) FROM part")
def select_by_type(spark: S, d: str) -> D:
    p = table(spark, d, "part")
    return profile.describe(p, models.columns_by_type(p)[0]).select("column", "n")
