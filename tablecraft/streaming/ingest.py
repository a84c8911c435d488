"""Structured Streaming: new files only, changes applied in order, metrics of closed hours.

Every query runs with ``availableNow``: it takes what is there, keeps its place in the checkpoint and ends, so a job that
is run again, or after a loss, goes on where it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ingest_new_files(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, kind: str = "parquet", options: dict | None = None) -> int:
    """Append the files that earlier runs haven't loaded; returns the rows of this run."""
    stream = spark.readStream.format(kind).schema(schema).options(**(options or {})).load(source)
    q = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(p["numInputRows"] for p in q.recentProgress)


def latest_changes(changes: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Of each key the last change."""
    return changes.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq)))).where("_n = 1").drop("_n")


def differs(old: Column, new: Column, null_safe: bool) -> Column:
    """Whether a value changed. Without ``null_safe`` a change from or to NULL doesn't count, as ``!=`` has it."""
    return ~old.eqNullSafe(new) if null_safe else F.coalesce(old != new, F.lit(False))


def apply_changes(current: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], op: str = "op", seq: str = "seq", null_safe: bool = True) -> DataFrame:
    """The table after the changes (op I, U or D): the last change of a key holds. Without ``null_safe`` an update of
    which no column differs by ``!=`` is passed over; then updates count one by one, so give it batches of one change
    for a key.

    One full join on the keys; keys without a change keep their row.
    """
    last = latest_changes(changes, keys, seq).select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(f"_{c}") for c in columns], F.col(op).alias("_op"))
    both = current.join(last, [current[k] == last[f"_{k}"] for k in keys], "full")
    there = F.lit(False)
    for k in keys:
        there = there | F.col(k).isNotNull()
    changed = F.lit(False)
    for c in columns:
        changed = changed | differs(F.col(c), F.col(f"_{c}"), null_safe)
    take = F.col("_op").isNotNull() & (~there | (F.col("_op") == "I") | changed)
    rows = both.where(F.col("_op").isNull() | (F.col("_op") != "D"))
    return rows.select(*[F.coalesce(F.col(k), F.col(f"_{k}")).alias(k) for k in keys], *[F.when(take, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def hourly_metrics_stream(trips: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Trips, mean minutes and mean km of each closed hour of a stream (ts, seconds, lat1, lon1, lat2, lon2). Rows that
    come later than ``late`` behind the newest are dropped."""
    from ..functions.geo import haversine_km

    km = haversine_km(*[F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")])
    g = trips.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 hour"))
    return g.agg(F.count("*").alias("trips"), (F.avg("seconds") / 60).alias("avg_minutes"), F.avg(km).alias("avg_km")).select(F.col("window.start").alias("hour"), "trips", "avg_minutes", "avg_km")


def run_once(stream: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Append what a stream has to give now to a Parquet table, and read that."""
    q = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)
