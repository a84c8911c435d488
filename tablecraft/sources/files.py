"""Files: readers with their options spelled out, listings, bulk loads and snapshots.

Loads are plain Spark writes; the number of files follows the partitions of what is written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A named CSV format: no header, double quotes, ragged rows, backslash escapes, empty text is NULL.
CSV_FORMAT = {
    "sep": ",", "lineSep": "\n", "header": "false", "quote": '"', "escape": "\\", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    "mode": "PERMISSIVE", "nullValue": "", "emptyValue": "",
}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. A local folder is made where it is unset and all tasks run in this
    process, as in tests; on a cluster executors could not see it, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, null: str = "NA", header: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header; ``null`` is the word for NULL, quoted or not. Types are inferred if no schema is given, which
    reads the files twice. Names are trimmed."""
    reader = spark.read.options(header=header, nullValue=null, encoding=encoding)
    df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path, inferSchema=True)
    return df.toDF(*[c.strip() for c in df.columns])


def read_csv_format(spark: SparkSession, path: str, schema: T.StructType | str, options: dict[str, str] | None = None) -> DataFrame:
    return spark.read.options(**(CSV_FORMAT | (options or {}))).schema(schema).csv(path)


def peek(spark: SparkSession, path: str, columns: int, rows: int = 10) -> DataFrame:
    """The first columns by position, as text, of a few rows of a file without header."""
    return spark.read.options(**CSV_FORMAT).csv(path).select([F.col(f"_c{i}") for i in range(columns)]).limit(rows)


def read_variant_json(spark: SparkSession, path: str, column: str = "v") -> DataFrame:
    """JSON documents whole in one VARIANT column."""
    return spark.read.option("singleVariantColumn", column).json(path)


def in_parts(df: DataFrame, n: int) -> DataFrame:
    """``df`` in ``n`` parts, each with rows if there are enough, to be written as so many files. Where what it reads comes
    in as many parts or more, all with rows, these are put together as they are, without a shuffle."""
    parts = df.rdd.getNumPartitions()
    if parts >= n and df.groupBy(F.spark_partition_id()).count().count() == parts:
        return df.coalesce(n)
    return df.repartition(n)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime) of all files below a path; their contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def file_stats(files: DataFrame) -> DataFrame:
    """Total GiB and mean MiB cut down to one digit, and the number of files."""
    down = lambda c: F.floor(c * 10) / 10
    return files.agg(
        down(F.sum("length") / F.lit(1024.0**3)).cast("double").alias("total_gb"), down(F.avg("length") / F.lit(1024.0**2)).cast("double").alias("mean_mb"), F.count("*").alias("n_files")
    )


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns by position, cast to the declared types and named as declared."""
    if len(df.columns) != len(schema):
        raise ValueError(f"{len(df.columns)} columns for {len(schema)} declared ones")
    return df.toDF(*[f"_{i}" for i in range(len(schema))]).select(*[F.col(f"_{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(schema)])


def bulk_load(df: DataFrame, path: str, mode: str = "append") -> int:
    """Append to a Parquet table and return the rows that were written, counted while writing."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).parquet(path)
    return seen.get["n"]


def truncate_reload(df: DataFrame, path: str) -> int:
    return bulk_load(df, path, "overwrite")


def snapshot(df: DataFrame, path: str) -> tuple[DataFrame, int]:
    """A full copy as Parquet, and its rows."""
    n = bulk_load(df, path, "overwrite")
    return df.sparkSession.read.schema(df.schema).parquet(path), n


def clone_table(spark: SparkSession, path: str, to: str) -> DataFrame:
    """A copy of a table's contents."""
    spark.read.parquet(path).write.mode("error").parquet(to)
    return spark.read.parquet(to)


def clone_database(spark: SparkSession, tables: dict[str, str], to: str) -> dict[str, DataFrame]:
    return {name: clone_table(spark, path, f"{to}/{name}") for name, path in tables.items()}


def create_view(df: DataFrame, name: str) -> str:
    df.createOrReplaceTempView(name)
    return name


def drop_if_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.dropTempView(name)


def write_version(df: DataFrame, path: str, version: int) -> None:
    """A table's state as version ``version`` of its folder."""
    df.withColumn("version", F.lit(version)).write.partitionBy("version").mode("append").parquet(path)


def as_of(versions: DataFrame, keys: list[str], version: int, deleted: Column | None = None) -> DataFrame:
    """Rows as they were at a version: of each key the row of the last version up to it. A folder of versions is pruned
    to those that count."""
    from pyspark.sql import Window

    last = versions.where(F.col("version") <= version).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("version")))).where("_n = 1").drop("_n")
    return last if deleted is None else last.where(~deleted)


def last_change(log: DataFrame, kind: str = "update", among: int = 5) -> DataFrame:
    """The id of the matching statement of a change log: of the ``among`` oldest the first, as the script's ascending
    order has it."""
    return log.where(F.lower("statement").like(f"{kind}%")).orderBy("start_time", "query_id").limit(among).limit(1).select("query_id")
