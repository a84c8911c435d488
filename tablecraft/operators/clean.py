"""Cleaning: duplicates, gaps, renamed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedupe(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows with equal keys (NULLs are equal) the first in order. Spark drops later rows before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def fill_from_peer(df: DataFrame, column: str, key: str, order: list[str]) -> DataFrame:
    """Fill NULLs from the first row of equal key, in ascending order, that has a value. The value of a key is an
    aggregate, made partly before the shuffle, so that a key with very many rows is in no single task."""
    known = df.where(F.col(column).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min_by(column, F.struct(*order)).alias("_value"))
    return df.join(known, df[key].eqNullSafe(known["_key"]), "left").withColumn(column, F.coalesce(column, "_value")).select(*df.columns)


def peers(df: DataFrame, key: str, identity: str, column: str, most: int | None = None) -> DataFrame:
    """Pairs of different rows of equal key of which the first lacks the column. That is the square of a key's rows: with
    ``most``, each row gets only the first ``most`` + 1 rows of its key by identity, less itself. These are found partly
    before the shuffle, and what a key with very many rows is joined to is that short list."""
    b = df.select(F.col(key).alias("_key"), F.col(identity).alias("peer_id"), F.col(column).alias("peer_value")).where("_key IS NOT NULL")
    if most is not None:
        b = b.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy("peer_id"))).where(F.col("_n") <= most + 1).drop("_n")
    a = df.where(F.col(column).isNull()).select(F.col(key), F.col(identity).alias("row_id"))
    return a.join(b, (a[key] == b["_key"]) & (a["row_id"] != b["peer_id"])).select(key, "row_id", "peer_id", "peer_value")


def rename_values(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """Values by a dictionary, a map literal in the plan; others stay as they are."""
    lookup = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return df.withColumn(column, F.coalesce(F.try_element_at(lookup, F.col(column)), F.col(column)))


def choose(df: DataFrame, column: str, members: list | None = None) -> DataFrame:
    """Rows of the chosen members; all rows without a choice."""
    return df if members is None else df.where(F.col(column).isin(members))


def exclude(df: DataFrame, column: str, *members) -> DataFrame:
    """All rows but those of the members; NULLs stay."""
    return df.where(~F.col(column).isin(list(members)) | F.col(column).isNull())


def mask_columns(df: DataFrame, role: str, columns: list[str], hidden_from: tuple[str, ...] = ("JUNIOR_DBA",)) -> DataFrame:
    from ..functions.scalars import mask

    return df.withColumns({c: mask(F.col(c), role, hidden_from) for c in columns})
