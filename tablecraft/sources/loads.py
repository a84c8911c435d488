"""Bulk loads that know what they have loaded.

A load takes the files below a folder whose names begin with a prefix and that its ledger doesn't have, or has with another
length or time. Its rows are a partition of the target of their own, written before the ledger: a load that is lost between
the two is not seen by readers, and its partition is replaced by the next one. The ledger is a table with a row for each
file; only the names of new files come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import CSV_FORMAT, list_files

LEDGER = "path string, length long, modified timestamp, load long"


@dataclass(frozen=True)
class Copied:
    """What a load did: its number, or None if no file was new, and how many files, rows and rejected records it had."""

    load: int | None
    files: int
    rows: int
    rejected: int


class LoadedTable:
    """A target at ``path`` with rows of ``schema``, its ledger and its rejected records."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def _table(self, name: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        """(path, length, modified, load) of the files that have been loaded."""
        return self._table("ledger", LEDGER)

    def _last_load(self) -> int:
        return self.ledger().agg(F.coalesce(F.max("load"), F.lit(0))).first()[0]

    def read(self) -> DataFrame:
        """The rows of all loads that the ledger has."""
        found = self._table("rows", T.StructType([*self.schema.fields, T.StructField("load", T.LongType())]))
        return found.where(F.col("load") <= self._last_load()).drop("load")

    def rejects(self) -> DataFrame:
        """(path, record, fields, load): records that didn't fit the schema and how many of their fields could be read, of
        loads that go on in spite of them."""
        return self._table("rejects", "path string, record string, fields int, load long").where(F.col("load") <= self._last_load())

    def new_files(self, source: str, prefix: str = "", force: bool = False) -> DataFrame:
        """(path, length, modified) of files that a load would take; all files if forced."""
        found = list_files(self.spark, source).select("path", "length", F.col("modificationTime").alias("modified"))
        below = F.regexp_replace("path", r"^.*?:/*(?=/)", "")
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source).toUri().getPath().rstrip("/")
        found = found.where(F.startswith(below, F.lit(f"{root}/{prefix}")))
        return found if force else found.join(self.ledger(), ["path", "length", "modified"], "left_anti")

    def copy_into(self, source: str, prefix: str = "", on_error: str = "abort", options: dict[str, str] | None = None, force: bool = False) -> Copied:
        """Load the new CSV files. A record that doesn't fit ends the load (``abort``), of which then nothing remains, or is
        put with the rejected ones (``continue``)."""
        if on_error not in ("abort", "continue"):
            raise ValueError(f"on_error is abort or continue, not {on_error}")
        taken = self.new_files(source, prefix, force).collect()
        if not taken:
            return Copied(None, 0, 0, 0)
        load = self._last_load() + 1
        reader = self.spark.read.options(**(CSV_FORMAT | (options or {})))
        paths = [r["path"] for r in taken]
        rows, bad = Observation(), Observation()
        if on_error == "abort":
            good = reader.option("mode", "FAILFAST").schema(self.schema).csv(paths)
        else:
            marked = T.StructType([*self.schema.fields, T.StructField("_record", T.StringType())])
            found = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_record").schema(marked).csv(paths)
            good = found.where("_record IS NULL").drop("_record")
            read = sum((F.col(f.name).isNotNull().cast("int") for f in self.schema), F.lit(0))
            wrong = found.select(F.col("_metadata.file_path").alias("path"), F.col("_record").alias("record"), read.alias("fields")).where("record IS NOT NULL")
            self._put(wrong.observe(bad, F.count(F.lit(1)).alias("n")), "rejects", load)
        self._put(good.observe(rows, F.count(F.lit(1)).alias("n")), "rows", load)
        self.spark.createDataFrame([(*r, load) for r in taken], LEDGER).coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")
        return Copied(load, len(paths), rows.get["n"], bad.get["n"] if on_error == "continue" else 0)

    def _put(self, df: DataFrame, name: str, load: int) -> None:
        put = df.withColumn("load", F.lit(load).cast("long")).write.partitionBy("load").mode("overwrite")
        put.option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/{name}")
