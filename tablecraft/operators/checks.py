"""Data-quality checks: constraints as jobs that report what breaks them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pk_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def fk_orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent; NULL keys are allowed."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def not_null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    from .profile import null_counts

    return null_counts(df.select(*columns)).where("nulls > 0")


def domain_violations(df: DataFrame, column: str, allowed: list) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(allowed))


def set_violations(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose comma-separated members aren't all allowed, with those that aren't."""
    strange = F.array_except(F.split(column, ","), F.array(*[F.lit(a) for a in allowed]))
    return df.withColumn("strange", strange).where(F.size("strange") > 0)


def range_violations(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    return df.where(~F.col(column).between(lo, hi))


def fill_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def surrogate_keys(df: DataFrame, name: str, order: list[str], start: int = 1, blocks: int = 1024) -> DataFrame:
    """Gap-free numbers from ``start`` in a stable order: blocks by a hash of ``order``, rows within a block by order. No
    window spans the table."""
    b = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    counts = b.groupBy("_block").agg(F.count("*").alias("_c"))
    counts = counts.select("_block", (F.sum("_c").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_c")).alias("_s"))
    at = F.row_number().over(Window.partitionBy("_block").orderBy(*order))
    return b.join(counts, "_block").withColumn(name, F.col("_s") + at + (start - 1)).drop("_block", "_s")


def ordered_keys(df: DataFrame, name: str, order: str, start: int = 1, blocks: int = 256) -> DataFrame:
    """Gap-free numbers from ``start`` in the order of a column, NULLs first; equal values in any order. Rows are numbered
    within ranges of the column that have about equally many rows, after the counts of those before."""
    from .measures import range_block

    b = df.withColumn("_block", range_block(df, order, blocks))
    counts = b.groupBy("_block").agg(F.count("*").alias("_c"))
    counts = counts.select("_block", (F.sum("_c").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_c")).alias("_s"))
    at = F.row_number().over(Window.partitionBy("_block").orderBy(order))
    return b.withColumn("_at", at).join(counts, "_block").withColumn(name, F.col("_s") + F.col("_at") + (start - 1)).select(*df.columns, name)


def on_delete_set_null(child: DataFrame, key: str, deleted: DataFrame, deleted_key: str) -> DataFrame:
    """NULL for keys of deleted parents."""
    gone = deleted.select(F.col(deleted_key).alias("_gone")).distinct()
    return child.join(gone, child[key] == gone["_gone"], "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")


def on_delete_restrict(child: DataFrame, key: str, deleted: DataFrame, deleted_key: str) -> DataFrame:
    """Child rows that forbid the deletion."""
    return child.join(deleted.select(F.col(deleted_key).alias(key)), key, "left_semi")


def on_update_cascade(child: DataFrame, key: str, renamed: DataFrame) -> DataFrame:
    """Keys replaced by a table of (old, new)."""
    return child.join(renamed, child[key] == renamed["old"], "left").withColumn(key, F.coalesce("new", key)).drop("old", "new")


def check_all(*flags: Column) -> Column:
    """Whether all conditions hold; NULL conditions don't."""
    return F.least(*[F.coalesce(f, F.lit(False)) for f in flags])


@dataclass(frozen=True)
class Constraints:
    """What a table declares: its primary key, unique column lists, columns without NULLs, allowed values and ranges of
    columns, and foreign keys as {column: (table, its column)}."""

    key: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    not_null: list[str] = field(default_factory=list)
    domains: dict[str, list] = field(default_factory=dict)
    ranges: dict[str, tuple] = field(default_factory=dict)
    foreign: dict[str, tuple[str, str]] = field(default_factory=dict)

    def names(self) -> list[tuple[str, str]]:
        """(kind, columns) of every constraint; a key's columns have no NULLs either."""
        rest = [*[("not null", c) for c in dict.fromkeys([*self.key, *self.not_null])], *[("domain", c) for c in self.domains], *[("range", c) for c in self.ranges]]
        return [*([("primary key", ", ".join(self.key))] if self.key else []), *[("unique", ", ".join(u)) for u in self.unique], *rest, *[("foreign key", c) for c in self.foreign]]


def _row_checks(df: DataFrame, has: Constraints, tables: dict[str, DataFrame]) -> DataFrame:
    """One row: how many rows break each constraint that a row and the keys it refers to decide. Parents come to it by left
    joins on their distinct keys, so that all foreign keys of a table are part of one pass."""
    work = df
    for i, (c, (parent, at)) in enumerate(has.foreign.items()):
        keys = tables[parent].select(F.col(at).alias(f"_key_{i}")).where(f"_key_{i} IS NOT NULL").distinct()
        work = work.join(keys, F.col(c) == F.col(f"_key_{i}"), "left")
    broken = {("not null", c): F.col(c).isNull() for c in dict.fromkeys([*has.key, *has.not_null])}
    broken |= {("domain", c): F.col(c).isNotNull() & ~F.col(c).isin(v) for c, v in has.domains.items()}
    broken |= {("range", c): ~F.col(c).between(*v) for c, v in has.ranges.items()}
    broken |= {("foreign key", c): F.col(c).isNotNull() & F.col(f"_key_{i}").isNull() for i, c in enumerate(has.foreign)}
    if not broken:
        return None
    counts = work.agg(*[F.count_if(b).alias(f"_{i}") for i, b in enumerate(broken.values())])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("columns"), F.col(f"_{i}").alias("n")) for i, (k, c) in enumerate(broken)])).alias("x")).select("x.*")


def _key_check(df: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """One row: how many keys occur more than once; keys with a NULL are no keys."""
    known = df.dropna(subset=columns).groupBy(*columns).agg(F.count("*").alias("n"))
    return known.agg(F.count_if(F.col("n") > 1).alias("n")).select(F.lit(kind).alias("kind"), F.lit(", ".join(columns)).alias("columns"), "n")


def schema_violations(tables: dict[str, DataFrame], schema: dict[str, Constraints]) -> DataFrame:
    """(table, kind, columns, n) of every constraint of a schema, n being 0 where it holds: one pass over each table for
    all constraints on rows and foreign keys, and one for each key."""
    out = None
    for name, has in schema.items():
        df = tables[name]
        parts = [_row_checks(df, has, tables), *([_key_check(df, "primary key", has.key)] if has.key else []), *[_key_check(df, "unique", u) for u in has.unique]]
        for part in parts:
            if part is not None:
                part = part.select(F.lit(name).alias("table"), "kind", "columns", "n")
                out = part if out is None else out.unionByName(part)
    return out
