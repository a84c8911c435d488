"""Tables between steps, kept in the folder that the cluster shares, filters on whole rows, and row numbers without a
global window."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. A local folder is made where it is unset and all tasks run in this
    process, as in tests; on a cluster executors could not see it, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: it is computed once, its lineage is cut, and
    any executor can be lost afterwards."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete the staged tables of ``frames``, whose successors are written: nothing may read them any more."""
    for df in frames:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def whole(docs: DataFrame) -> Column:
    """All columns of a row as one, so that helper columns beside it clash with none of them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def filtered(docs: DataFrame, stays: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of docs whose texts ``stays`` marks, batch by batch; a null text is given as an empty one."""
    both = docs.select(whole(docs).alias("row"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0)], ["row"]).filter(pa.array(stays(b.column(1))))

    return both.mapInArrow(run, both.select("row").schema).select("row.*")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def numbered(df: DataFrame, group: str, block: str, order: list, name: str = "slot") -> DataFrame:
    """Gapless numbers from 0 within ``group``, in order of ``block`` and then ``order``.

    A window over a whole group would put it in one task. Rows are counted by (group, block), the counts are summed up
    to each block's start, and rows are numbered within a block only, so a task gets one block at most.
    """
    starts = (
        df.groupBy(group, block)
        .agg(F.count("*").alias("_n"))
        .withColumn("_start", F.sum("_n").over(Window.partitionBy(group).orderBy(block).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n"))
        .select(F.col(group).alias("_g"), F.col(block).alias("_b"), "_start")
    )
    inner = Window.partitionBy(group, block).orderBy(*order)
    joined = df.join(starts, df[group].eqNullSafe(starts["_g"]) & df[block].eqNullSafe(starts["_b"]))
    return joined.withColumn(name, F.col("_start") + F.row_number().over(inner) - 1).drop("_g", "_b", "_start")
