"""From raw documents to shards of a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All stages but the last return the columns of documents, extra ones included, whatever their names. Rows
without doc_id, repeated rows and empty texts pass through every stage by the rules in its docstring; an empty table gives
an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.llm import decontamination, jaccard, mixing, quality, sharding
from tablecraft.llm.shared import dropped, read, staged, whole


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go if the classifier, fitted on the labelled ones among them, gives grade 1 or better less than half.
    Each row is judged by its text alone: repeated rows and rows without doc_id are like any other."""
    return quality.keep(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows that links connect, the one with the smallest doc_id stays, once; rows without doc_id come last. Rows
    without shingles all stay, repeated ones once. Different texts of one doc_id are rows of their own."""
    groups = staged(jaccard.grouped(docs)[0], "groups")
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row")
    first = groups.where("component is not null").groupBy("component").agg(F.min(place).alias("first")).select(F.col("first.row").alias("key"))
    stay = first.unionByName(groups.where("component is null").select(F.col("row").alias("key"))).distinct()
    return docs.select(jaccard.row_key().alias("key"), whole(docs).alias("row")).join(stay, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go if a benchmark item leaks into them; each row is judged by its text alone."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is repeated as often as the mix takes it; those it doesn't take go. Rows are told apart by source,
    doc_id and text; what the mix takes of repeated rows is taken of one of them."""
    keyed = docs.select(F.xxhash64("source", F.col("doc_id").cast("long"), F.lit(1), "text").alias("key"), whole(docs).alias("row"))
    copies = mixing.mix(keyed.select(F.col("key").alias("doc_id"), "row.source", "row.text")).groupBy(F.col("doc_id").alias("key")).agg(F.sum("copies").cast("int").alias("copies"))
    taken = keyed.dropDuplicates(["key"]).join(copies.where("copies > 0"), "key")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def deal_to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of the mix; no other columns are read."""
    return sharding.shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", reject_poor),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", deal_to_shards),
]

#: The classifier and the tiling can't be expressed in SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, docs = None, read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            dropped(before)
        before = docs = made
    return docs
