"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Each document's expected copies are its source's target over its source's size. They are summed up within the source,
one random offset is added, and a document is emitted once for each integer boundary that its share crosses. Documents
are taken in order of size class, the largest first, so that a source's sample has long and short documents in their right
proportions. Documents of over 1/``PARTS`` of their source's target come whole or not at all, so what they leave of the
target is what the others are expected to give, in copies between none and ``MOST``. Of ``OFFSETS`` random offsets a
source takes the one whose words come nearest to its target. So the words of small sources come near it, too.

No window spans a source. Documents are counted by (source, size class and two digits of a digest of doc_id); the
counts are summed up to each block's start, and documents are numbered within a block. A source with a third of all rows
is spread over thousands of blocks.

Defined cases: a null source is a source of its own, last in order; null or empty texts have size 0 and add no words;
repeated rows are documents of their own; an empty table gives no rows; other columns than doc_id, source and text are
not read. Documents without doc_id are dealt to blocks by a digest of their text.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, staged

WEIGHTS = (5, 2, 1)
#: Share of all words that the mix has, and how often a source is repeated at most.
SHARE, MOST = 1.5, 2.0
WORD = r"[^\x20\x09-\x0D]+"
SEED, OFFSETS, PARTS = 20_24, 16, 20


def offsets(seed: int = SEED) -> list[float]:
    """The random offsets that a source can have, in [0, 1)."""
    made = random.Random(seed)
    return [round(made.random(), 12) for _ in range(OFFSETS)]


def size_class(size: Column) -> Column:
    """A text that orders sizes by their highest four binary digits."""
    b = F.bin(size)
    return F.concat(F.lpad(F.length(b).cast("string"), 2, "0"), F.substring(b, 1, 4))


def class_start(size: Column) -> Column:
    """The least size of the size class."""
    low = F.greatest(F.lit(0), F.length(F.bin(size)) - 4)
    return F.call_function("shiftleft", F.call_function("shiftright", size, low), low)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Add ``target`` to (source, source_size), a row for each source: weighted shares of all words, none above ``most``
    times its size; what is above goes to the others by weight, until none is.

    A source is at its limit if, in order of size by weight, the level that remains for it and all later ones would
    lift it above the limit. The window runs over sources, not over documents.
    """
    at = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.lit(float(weights[-1]))
    for k, x in enumerate(weights[:-1]):
        w = F.when((F.row_number().over(at) - 1) % len(weights) == k, float(x)).otherwise(w)
    by_need = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_ = by_need.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    return (
        sources.withColumn("weight", w)
        .withColumn("rest", F.lit(share) * F.sum("source_size").over(all_) - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("rest_weight", F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("rest") / F.col("rest_weight"))
        .withColumn("open", F.col("level") * F.col("weight") <= F.lit(most) * F.col("source_size"))
        .withColumn("level", F.max(F.when(F.col("open"), F.col("level"))).over(all_))
        .withColumn("target", F.when(F.col("open"), F.col("level") * F.col("weight")).otherwise(F.lit(most) * F.col("source_size")))
        .select("source", "source_size", "target")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document; ``taken`` is copies times size."""
    block = F.concat(size_class(F.col("size")), F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), "text", F.lit("")).cast("binary")), 1, 2))
    slim = staged(
        docs.select("doc_id", "source", "text", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")).select("doc_id", "source", "size", block.alias("block")),
        "mixing",
    )
    blocks = slim.groupBy("source", "block").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    sources = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("source_rows")).select("source", "source_size"), weights, share, most)
    upto = Window.partitionBy("source").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = blocks.withColumn("start", F.sum("n").over(upto) - F.col("n")).select("source", "block", "start")
    s, t = starts.alias("s"), sources.alias("t")
    starts = s.join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).select(F.col("s.source").alias("_source"), F.col("s.block").alias("_block"), "start", "source_size", "target")
    inner = Window.partitionBy("source", "block").orderBy(F.desc("size"), "doc_id")
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    placed = (
        slim.join(starts, slim["source"].eqNullSafe(starts["_source"]) & (slim["block"] == starts["_block"]))
        .select("doc_id", "source", "size", "source_size", "target", rate.alias("rate"), (F.col("start") + F.row_number().over(inner)).alias("place"))
        .withColumn("large", class_start(F.col("size")) * PARTS > F.col("target"))
    )
    placed = staged(placed, "placed")
    dropped(slim)

    def crossed(at: Column, step: Column) -> Column:
        return F.least(F.floor(at + step) - F.floor(at), F.lit(math.ceil(most))).cast("long")

    def large_copies(u: Column) -> Column:
        return crossed(u + F.col("rate") * (F.col("place") - 1), F.col("rate"))

    def copies(u: Column, other: Column) -> Column:
        before = u + F.col("rate") * F.col("n_large") + other * (F.col("place") - 1 - F.col("n_large"))
        return F.when(F.col("large"), large_copies(u)).otherwise(crossed(before, other))

    def of_source(rows: DataFrame, by_source: DataFrame) -> DataFrame:
        by_source = by_source.withColumnRenamed("source", "_source")
        return rows.join(by_source, rows["source"].eqNullSafe(by_source["_source"])).drop("_source")

    large_words = [F.sum(F.when(F.col("large"), large_copies(F.lit(u)) * F.col("size")).otherwise(0)).alias(f"large_{k}") for k, u in enumerate(offsets(seed))]
    sums = placed.groupBy("source").agg(F.first("target").alias("_target"), F.count_if("large").alias("n_large"), F.sum(F.when(F.col("large"), 0).otherwise(F.col("size"))).alias("other_words"), *large_words)
    other = [F.least(F.lit(most), F.greatest(F.lit(0.0), F.coalesce((F.col("_target") - F.col(f"large_{k}")) / F.nullif("other_words", F.lit(0)), F.lit(0.0)))).alias(f"other_{k}") for k in range(OFFSETS)]
    sums = staged(sums.select("source", "_target", "n_large", *other), "offsets")
    taken = of_source(placed, sums).groupBy("source").agg(F.first("_target").alias("_target"), *[F.sum(copies(F.lit(u), F.col(f"other_{k}")) * F.col("size")).alias(f"taken_{k}") for k, u in enumerate(offsets(seed))])
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"taken_{k}") - F.col("_target")).alias("off"), F.lit(k).alias("k")) for k in range(OFFSETS)]))["k"]
    chosen = of_source(sums, taken.select("source", nearest.alias("k")))
    chosen = chosen.select("source", "n_large", F.array(*[F.lit(u) for u in offsets(seed)])[F.col("k")].alias("offset"), F.array(*[f"other_{k}" for k in range(OFFSETS)])[F.col("k")].alias("other"))
    return (
        of_source(placed, chosen).withColumn("copies", copies(F.col("offset"), F.col("other")))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def oracle(weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, table: str = "documents") -> str:
    """The mix as DuckDB SQL, for any table of documents."""
    case = " ".join(f"WHEN {k} THEN {float(x)}" for k, x in enumerate(weights))
    tried = ", ".join(f"({k}, {u}::DOUBLE)" for k, u in enumerate(offsets(seed)))
    crossed = lambda at, step: f"LEAST(floor({at} + {step}) - floor({at}), {math.ceil(most)})::BIGINT"
    large_copies = crossed("(u + rate * (place - 1))", "rate")
    copies = f"CASE WHEN large THEN {large_copies} ELSE {crossed('(u + rate * n_large + other * (place - 1 - n_large))', 'other')} END"
    return rf"""
    WITH sized AS (SELECT doc_id, source, text, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {table}),
    blocked AS (SELECT *, lpad(length(bin(size))::VARCHAR, 2, '0') || substr(bin(size), 1, 4) || substr(md5(COALESCE(doc_id::VARCHAR, text, '')), 1, 2) AS block FROM sized),
    sums AS (SELECT source, SUM(size)::BIGINT AS source_size FROM sized GROUP BY source),
    weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(weights)} {case} END AS weight FROM sums),
    levels AS (SELECT *,
        ({share} * SUM(source_size) OVER () - {most} * COALESCE(SUM(source_size) OVER before, 0))
        / (SUM(weight) OVER () - COALESCE(SUM(weight) OVER before, 0)) AS level FROM weighed
        WINDOW before AS (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    aimed AS (SELECT source, source_size, CASE WHEN level * weight <= {most} * source_size
        THEN MAX(CASE WHEN level * weight <= {most} * source_size THEN level END) OVER () * weight ELSE {most} * source_size END AS target FROM levels),
    placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY block DESC, size DESC, doc_id) AS place FROM blocked),
    rated AS (SELECT p.doc_id, p.source, p.size, a.source_size, a.target::DOUBLE AS target, p.place, COALESCE(a.target / NULLIF(a.source_size, 0), 0.0)::DOUBLE AS rate,
        (p.size >> greatest(0, length(bin(p.size)) - 4)::BIGINT << greatest(0, length(bin(p.size)) - 4)::BIGINT) * {PARTS} > a.target::DOUBLE AS large
        FROM placed p JOIN aimed a ON p.source IS NOT DISTINCT FROM a.source),
    tried AS (SELECT source, k, u, COUNT(*) FILTER (large) AS n_large, LEAST({most}::DOUBLE, GREATEST(0.0::DOUBLE, COALESCE((ANY_VALUE(target) - COALESCE(SUM({large_copies} * size) FILTER (large), 0)::DOUBLE)
        / NULLIF(COALESCE(SUM(size) FILTER (NOT large), 0), 0)::DOUBLE, 0.0::DOUBLE))) AS other FROM rated CROSS JOIN (VALUES {tried}) AS o(k, u) GROUP BY source, k, u),
    took AS (SELECT t.*, (SELECT SUM(({copies}) * size) FROM rated r WHERE r.source IS NOT DISTINCT FROM t.source) AS words, (SELECT MAX(target) FROM rated r WHERE r.source IS NOT DISTINCT FROM t.source) AS aim FROM tried t),
    chosen AS (SELECT source, u, n_large, other FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY abs(words - aim), k) AS nth FROM took) WHERE nth = 1),
    copied AS (SELECT r.*, {copies} AS copies FROM rated r JOIN chosen c ON r.source IS NOT DISTINCT FROM c.source)
    """


def oracle_sql() -> str:
    return oracle() + "SELECT doc_id, size, source_size, target, copies * size AS taken FROM copied"
