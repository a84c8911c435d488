"""Tables whose earlier states can be read and put back, by the id of the statement that changed them.

A version holds the rows that its statement wrote or deleted, not a copy of the table. Its partition is written first and
then a row of the log; a version that the log lacks, after a loss between the two, isn't read and is replaced by the next
one. From the versions follow the intervals in which each row held.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = "query_id string, version long, start_time timestamp, statement string"


class VersionedTable:
    """Rows of ``schema`` with ``keys`` at ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path, schema, keys
        self.columns = schema.fieldNames()
        self.stored = T.StructType([*schema.fields, T.StructField("_deleted", T.BooleanType()), T.StructField("_version", T.LongType())])

    def _table(self, name: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def log(self) -> DataFrame:
        """(query_id, version, start_time, statement) of every statement that changed the table."""
        return self._table("log", LOG)

    def last_version(self) -> int:
        return self.log().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def version_of(self, query_id: str) -> int:
        found = self.log().where(F.col("query_id") == query_id).first()
        if found is None:
            raise KeyError(f"no statement {query_id}")
        return found["version"]

    def _changes(self, upto: int) -> DataFrame:
        return self._table("versions", self.stored).where(F.col("_version") <= upto)

    def write(self, rows: DataFrame | None, statement: str, deleted: DataFrame | None = None) -> str:
        """A version in which ``rows`` replace those with their keys, or are new, and the keys in ``deleted`` are gone; the
        id of its statement. Keys are in one of both, once."""
        version, query_id = self.last_version() + 1, uuid.uuid4().hex
        parts = [] if rows is None else [rows.select(*self.columns, F.lit(False).alias("_deleted"))]
        if deleted is not None:
            parts.append(deleted.select(*[F.col(f.name) if f.name in self.keys else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema], F.lit(True).alias("_deleted")))
        for n, part in enumerate(parts):
            out = part.withColumn("_version", F.lit(version).cast("long")).write.partitionBy("_version").mode("overwrite" if n == 0 else "append")
            out.option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/versions")
        entry = self.spark.range(1).select(F.lit(query_id).alias("query_id"), F.lit(version).cast("long").alias("version"), F.current_timestamp().alias("start_time"), F.lit(statement).alias("statement"))
        entry.write.mode("append").parquet(f"{self.path}/log")
        return query_id

    def read(self, version: int | None = None) -> DataFrame:
        """The table now, or as it was after a version; later versions aren't read. The last change of a key is an
        aggregate, made partly before the shuffle."""
        rest = [c for c in self.columns if c not in self.keys]
        found = self._changes(self.last_version() if version is None else version)
        last = found.groupBy(*self.keys).agg(F.max_by(F.struct("_deleted", *rest), "_version").alias("_last"))
        return last.where("not _last._deleted").select(*[F.col(c) if c in self.keys else F.col(f"_last.`{c}`") for c in self.columns])

    def before(self, query_id: str) -> DataFrame:
        """The table as it was before a statement."""
        return self.read(self.version_of(query_id) - 1)

    def restore_before(self, query_id: str) -> str:
        """Put back the state before a statement, as a version that holds what differs; nothing of the history goes."""
        then, now = self.before(query_id), self.read()
        same = lambda a, b, columns: [a[c].eqNullSafe(b[c]) for c in columns]
        changed = then.join(now, same(then, now, self.columns), "left_anti")
        gone = now.join(then, same(now, then, self.keys), "left_anti").select(*self.keys)
        return self.write(changed, f"restore before {query_id}", gone)

    def intervals(self) -> DataFrame:
        """(columns, from_version, to_version): in which versions each row held, the last one not included; NULL if it
        still does."""
        after = Window.partitionBy(*self.keys).orderBy("_version")
        found = self._changes(self.last_version()).withColumn("to_version", F.lead("_version").over(after))
        return found.where("not _deleted").select(*self.columns, F.col("_version").alias("from_version"), "to_version")

    def join_as_of(self, facts: DataFrame, version: str) -> DataFrame:
        """The facts with the row that held for their keys in the version that each names; the columns of both."""
        held = self.intervals().withColumnsRenamed({k: f"_{k}" for k in self.keys})
        on = [facts[k] == held[f"_{k}"] for k in self.keys]
        on += [facts[version] >= held["from_version"], held["to_version"].isNull() | (facts[version] < held["to_version"])]
        return facts.join(held, on, "left").drop(*[f"_{k}" for k in self.keys], "from_version", "to_version")
