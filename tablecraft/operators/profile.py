"""Profiles of tables: counts, quantiles, histograms."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def numeric(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMBERS or t.startswith("decimal")]


def categorical(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "string"]


def _rows(df: DataFrame, names: list[str], fields: dict) -> DataFrame:
    """A row for each column of one aggregation of the whole table."""
    wide = df.agg(*[f(c).alias(f"{c}|{k}") for c in names for k, f in fields.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}|{k}`").alias(k) for k in fields]) for c in names])).alias("x")).select("x.*")


def _matched(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined to a row of ``other`` for each value of the keys, NULLs too; a single row without keys."""
    if not keys:
        return rows.join(F.broadcast(other))
    named = other.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    on = [rows[k].eqNullSafe(named[f"_k{i}"]) for i, k in enumerate(keys)]
    return rows.join(named, on).drop(*[f"_k{i}" for i in range(len(keys))])


def quantiles(rows: DataFrame, keys: list[str], value: str, probs: list[float], blocks: int = 64) -> DataFrame:
    """(keys, q): the exact quantiles of ``value``, interpolated, as an array, for each value of the keys.

    Equal values are counted first. A sketch deals the values to blocks of about equal size, whose counts tell which
    blocks hold the wanted ranks; only those are ranked, each by itself, so no task has to hold or sort all values of a
    key.
    """
    values = rows.where(F.col(value).isNotNull())
    cuts = values.groupBy(*keys).agg(F.percentile_approx(value, [i / blocks for i in range(1, blocks)], 1000).alias("_cuts"))
    counted = values.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    placed = _matched(counted, cuts, keys).withColumn("_block", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    sums = placed.groupBy(*keys, "_block").agg(F.sum("_n").alias("_many"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sums.withColumns({"_end": F.sum("_many").over(upto), "_all": F.sum("_many").over(whole)})
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    places = F.transform(wanted, lambda p: p * (F.col("_all") - 1))
    ranks = F.array_distinct(F.concat(F.transform(places, lambda x: F.floor(x)), F.transform(places, lambda x: F.ceil(x))))
    starts = starts.withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_end") - F.col("_many")) & (r < F.col("_end")))).where(F.size("_ranks") > 0)
    within = Window.partitionBy(*keys, "_block").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = _matched(placed, starts, [*keys, "_block"]).withColumn("_after", F.col("_end") - F.col("_many") + F.sum("_n").over(within))
    hit = F.filter("_ranks", lambda r: (r >= F.col("_after") - F.col("_n")) & (r < F.col("_after")))
    hits = ranked.select(*keys, "_all", value, F.explode(hit).alias("_rank")).groupBy(*keys, "_all").agg(F.map_from_entries(F.collect_list(F.struct("_rank", value))).alias("_at"))
    q = F.transform(places, lambda x: F.col("_at")[F.floor(x)] + (F.col("_at")[F.ceil(x)] - F.col("_at")[F.floor(x)]) * (x - F.floor(x)))
    return hits.select(*keys, q.alias("q"))


def _long(df: DataFrame, columns: list[str], name: str, *keys: str) -> DataFrame:
    """(keys, name, value): the columns' values as doubles, a row for each."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias("value")) for c in columns]))
    return df.select(*keys, each.alias("x")).select(*keys, "x.*")


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max) of the numeric columns, with exact quartiles."""
    columns = columns or numeric(df)
    d = lambda c: F.col(c).cast("double")
    plain = _rows(df, columns, {"n": lambda c: F.count(c), "mean": lambda c: F.avg(d(c)), "std": lambda c: F.stddev(d(c)), "least": lambda c: F.min(d(c)), "most": lambda c: F.max(d(c))})
    q = quantiles(_long(df, columns, "column"), ["column"], "value", [0.25, 0.5, 0.75])
    quartiles = [F.get("q", F.lit(i)).alias(f"q{p}") for i, p in enumerate((25, 50, 75))]
    return plain.join(q, "column", "left").select("column", "n", "mean", "std", "least", *quartiles, "most")


def null_counts(df: DataFrame) -> DataFrame:
    return _rows(df, df.columns, {"nulls": lambda c: F.sum(F.col(c).isNull().cast("long"))})


def total_nulls(df: DataFrame) -> DataFrame:
    return null_counts(df).agg(F.sum("nulls").alias("nulls"))


def duplicate_count(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows beyond the first of each set of equal rows; NULLs are equal."""
    return df.groupBy(*(columns or df.columns)).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def schema_info(df: DataFrame) -> DataFrame:
    """(column, type, non_null)."""
    kinds = dict(df.dtypes)
    return _rows(df, df.columns, {"non_null": lambda c: F.count(c)}).withColumn("type", F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("column")])


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, n) of bins of equal width from the least to the greatest value, which is in the last one."""
    ends = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    at = F.least(F.floor((F.col(column) - F.col("lo")) / F.try_divide(F.col("hi") - F.col("lo"), F.lit(float(bins)))), F.lit(bins - 1))
    return df.where(F.col(column).isNotNull()).select(column).join(F.broadcast(ends)).groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def qq_points(df: DataFrame, column: str, points: int = 99) -> DataFrame:
    """(p, theoretical, sample): quantiles of the standard normal and of the column, NULLs filled with its mean."""
    grid = [(i + 0.5) / points for i in range(points)]
    mean = df.agg(F.avg(column).alias("_mean"))
    filled = df.select(column).join(F.broadcast(mean)).select(F.coalesce(F.col(column).cast("double"), "_mean").alias("x"))
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(NormalDist().inv_cdf(p)).alias("theoretical"), F.lit(i).alias("i")) for i, p in enumerate(grid)]))
    return quantiles(filled, [], "x", grid).select("q", rows.alias("g")).select("g.p", "g.theoretical", F.col("q")[F.col("g.i")].alias("sample"))


def box(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Quartiles and the fences 1.5 quartile ranges out, of the column or of each class."""
    keys = [by] if by else []
    out = quantiles(df.select(*keys, F.col(column).cast("double").alias("_value")), keys, "_value", [0.25, 0.5, 0.75])
    out = out.select(*keys, *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    return out.withColumn("low", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).withColumn("high", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))


def outliers(df: DataFrame, column: str) -> DataFrame:
    return df.join(F.broadcast(box(df, column).select("low", "high"))).where((F.col(column) < F.col("low")) | (F.col(column) > F.col("high"))).drop("low", "high")


def null_patterns(df: DataFrame) -> DataFrame:
    """(pattern, n): which columns are NULL together, as a text of 0 and 1 in the order of the columns."""
    return df.groupBy(F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in df.columns]).alias("pattern")).agg(F.count("*").alias("n"))


def null_matrix(df: DataFrame, key: str) -> DataFrame:
    """The key, and for each other column 1 where it is NULL."""
    return df.select(key, *[F.col(c).isNull().cast("int").alias(c) for c in df.columns if c != key])


def quartiles_by_class(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """(class, feature, q1, median, q3) of several columns, in one pass."""
    out = quantiles(_long(df, columns, "feature", by), [by, "feature"], "value", [0.25, 0.5, 0.75])
    return out.select(by, "feature", *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])
