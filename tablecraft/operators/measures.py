"""Measures over groups and along time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import pct, ratio


def ratio_of_sums(a: str, b: str) -> Column:
    """100 * sum(a) / sum(b) at whatever grain it is used."""
    return pct(F.sum(a), F.sum(b))


def _millionths(value: str) -> Column:
    """A number as a whole number of millionths, NULL where it is none, or 10^9 or more."""
    at = F.rint(F.col(value).cast("double") * 1e6)
    return F.when((F.abs(value) < 1e9) & (at / 1e6 == F.col(value).cast("double")), at.cast("long"))


def exact_ratio_of_sums(a: str, b: str) -> Column:
    """sum(a) / sum(b), NULL where sum(b) is 0. Doubles of up to six decimals are added as whole numbers, so that a ratio at
    a limit, or at half of a last digit, is the same in whatever order rows come; other numbers are added as they are."""
    whole = (F.count(_millionths(a)) == F.count(a)) & (F.count(_millionths(b)) == F.count(b))
    x, y = F.try_sum(_millionths(a)), F.try_sum(_millionths(b))
    there = whole & x.isNotNull() & y.isNotNull()
    return ratio(F.when(there, x.cast("double")).otherwise(F.sum(a)), F.when(there, y.cast("double")).otherwise(F.sum(b)))


def max_over_avg(a: str, b: str) -> Column:
    return ratio(F.max(a), F.avg(b))


def running_sum(df: DataFrame, value: str, keys: list[str], order: list[str], name: str = "running") -> DataFrame:
    """Running total over ``order`` within ``keys``; rows with equal order get the same total. A key's rows are sorted in
    one task: for a key with very many rows use ``running_sum_by_step``."""
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(*order)))


def _as_number(column: Column, kind: T.DataType) -> Column:
    """A number that never goes down where the column's values go up."""
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp")).cast("double")
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("double")
    return column.cast("double")


def range_block(df: DataFrame, column: str, blocks: int = 256) -> Column:
    """A number for ranges of a column that have about equally many rows: equal values are in one block, greater values in
    the same or a later one, NULLs in the first. A row's block is looked up by halves."""
    number = _as_number(F.col(column), df.schema[column].dataType)
    shares = F.array(*[F.lit(i / blocks) for i in range(1, max(blocks, 2))])
    found = df.agg(F.percentile_approx(number, shares, 10 * blocks)).first()[0]
    cuts = sorted({c for c in found or [] if c == c})
    limits = F.array(*[F.lit(c) for c in cuts]).cast("array<double>")
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))]).cast("array<int>")
    further = lambda at, step: F.when((at + step <= len(cuts)) & (F.get(limits, at + step - 1) < number), at + step).otherwise(at)
    return F.when(F.col(column).isNull(), -1).otherwise(F.aggregate(halves, F.lit(0), further))


def running_sum_by_step(df: DataFrame, value: str, keys: list[str], order: list[str], name: str = "running", blocks: int = 256) -> DataFrame:
    """The same for keys with very many rows. Values are first summed up by (keys, order), partly before the shuffle, so
    that rows of equal order are one step. Steps are dealt to blocks by ranges of the first column of ``order``: a block's
    sum goes to those after it in its key, and a window spans the steps of one block only. Totals come back by a join."""
    steps = df.groupBy(*keys, *order).agg(F.sum(value).alias("_v"))
    steps = steps.withColumn("_block", range_block(steps, order[0], blocks))
    upto = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = steps.groupBy(*keys, "_block").agg(F.sum("_v").alias("_s"))
    sums = sums.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_block").alias("_of"), F.sum("_s").over(upto).alias("_before"))
    within = F.sum("_v").over(Window.partitionBy(*keys, "_block").orderBy(*order))
    on = [steps["_block"] == sums["_of"], *[steps[k].eqNullSafe(sums[f"_of_{k}"]) for k in keys]]
    both = steps.withColumn("_within", within).join(sums, on)
    totals = both.select(*keys, *order, F.coalesce(F.col("_within") + F.col("_before"), "_within", "_before").alias(name))
    on = reduce(lambda x, y: x & y, [df[c].eqNullSafe(totals[c]) for c in [*keys, *order]])
    return df.join(totals, on).select(df["*"], totals[name])


def share_of_total(df: DataFrame, column: str, digits: int = 1) -> DataFrame:
    """(value, n, pct, label): how often each value occurs and its share in per cent."""
    n = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    p = F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), digits)
    return n.withColumn("pct", p).withColumn("label", F.concat(F.col("pct").cast("string"), F.lit("%")))


def measures_as_rows(df: DataFrame, measures: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """(by, position, measure, value): several aggregates as rows in the given order."""
    by = by or []
    wide = df.groupBy(*by).agg(*[m.cast("double").alias(f"_{i}") for i, m in enumerate(measures.values())])
    long = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("measure"), F.col(f"_{i}").alias("value")) for i, n in enumerate(measures)]))
    return wide.select(*by, long.alias("x")).select(*by, "x.*")


def manual_order(column: Column, members: list[str]) -> Column:
    """Rank of a value in a list, for ordering; others come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(m) for m in members]), column), F.lit(0)), F.lit(len(members) + 1))


def blend(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """Two aggregates at the grain of ``key``; all rows of the first."""
    return primary.join(secondary, key, "left")
