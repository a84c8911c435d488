"""A table kept up to date by a stream of changes, in whatever order these come.

The stream keeps the last ``seq`` of each key in RocksDB state: a change goes on only if it is newer, so that a late one
neither overwrites a newer row nor brings back a deleted one. Deletes leave a tombstone in the state, which expires after
a stated time; until then a late change of a deleted key is told from a new row.

What goes on is appended to a Parquet table as a partition for each batch; a batch that is run again after a loss replaces
its own partition. ``compacted`` folds the batches into a base with one row for each key. Readers leave out the base's rows
that later batches replace, an anti join whose right side is the changes since, and don't rank or shuffle the base.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class NewestChange(StatefulProcessor):
    """Of each key the newest change of a batch, if it is newer than all before. Of changes with one seq the greatest by
    op and values counts, and one that comes in a later batch is a repetition."""

    def __init__(self, tombstone_ms: int):
        self.tombstone_ms = tombstone_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        seq = T.StructType([T.StructField("seq", T.LongType())])
        self.live = handle.getValueState("live", seq)
        self.deleted = handle.getValueState("deleted", seq, self.tombstone_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest = max(rows, key=lambda r: (r["seq"], r["op"], str(tuple(r))))
        known = max((state.get()[0] for state in (self.live, self.deleted) if state.exists()), default=None)
        if known is not None and newest["seq"] <= known:
            return
        here, gone = (self.deleted, self.live) if newest["op"] == "D" else (self.live, self.deleted)
        here.update((newest["seq"],))
        gone.clear()
        yield newest

    def close(self) -> None:
        pass


def newest_changes(changes: DataFrame, keys: list[str], tombstone: int = 7 * 86_400_000) -> DataFrame:
    """The changes of a stream (op I, U or D, seq, keys, columns) that are newer than all before of their key. Tombstones
    last for ``tombstone`` milliseconds. The session's state store has to be RocksDB."""
    kept = changes.select(*[F.col(f"`{f.name}`").cast("long").alias("seq") if f.name == "seq" else F.col(f"`{f.name}`") for f in changes.schema.fields])
    kept = kept.where(F.col("seq").isNotNull() & F.col("op").isin("I", "U", "D"))
    return kept.groupBy(*keys).transformWithState(NewestChange(tombstone), kept.schema, "update", "ProcessingTime")


class ChangedTable:
    """A base at ``path``/base and the changes since at ``path``/batches. Without a base all rows come from changes."""

    def __init__(self, spark: SparkSession, path: str, changes: T.StructType, keys: list[str], base: str | None = None):
        self.spark, self.path, self.keys, self.base = spark, path, keys, base
        self.columns = [f.name for f in changes.fields if f.name not in ("op", "seq", *keys)]
        self.schema = T.StructType([*[f if f.name != "seq" else T.StructField("seq", T.LongType()) for f in changes.fields], T.StructField("batch", T.LongType())])

    def append(self, changes: DataFrame, batch: int) -> None:
        """Write a batch of changes, each newer than all before of its key. The partition is replaced if it is there."""
        written = changes.withColumn("batch", F.lit(batch).cast("long")).write.partitionBy("batch")
        written.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/batches")

    def last_changes(self, upto: int | None = None) -> DataFrame:
        """(keys, seq, op, columns) of the last change since the base of each key that has one."""
        found = self.spark.read.schema(self.schema).parquet(f"{self.path}/batches")
        found = found if upto is None else found.where(F.col("batch") <= upto)
        rest = ["seq", "op", *self.columns]
        return found.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "seq").alias("_last")).select(*self.keys, *[F.col(f"_last.`{c}`").alias(c) for c in rest])

    def read(self, upto: int | None = None) -> DataFrame:
        """The table's rows after all batches, or after those up to one."""
        last = self.last_changes(upto)
        rows = last.where("op <> 'D'").select(*self.keys, *self.columns)
        if self.base is None:
            return rows
        base = self.spark.read.schema(rows.schema).parquet(self.base)
        return base.join(last, [base[k].eqNullSafe(last[k]) for k in self.keys], "left_anti").unionByName(rows)

    def compacted(self, path: str) -> ChangedTable:
        """The same table with a base at ``path``/base that has all batches up to now. What seq each key has, and which
        keys are deleted, is in the stream's state."""
        self.read().write.parquet(f"{path}/base")
        out = ChangedTable(self.spark, path, T.StructType(self.schema.fields[:-1]), self.keys, f"{path}/base")
        out.append(self.spark.createDataFrame([], T.StructType(self.schema.fields[:-1])), -1)
        return out


def apply_change_stream(source: str, table: ChangedTable, checkpoint: str, max_files: int | None = None, tombstone: int = 7 * 86_400_000) -> None:
    """Take the change files that earlier runs haven't taken. ``checkpoint`` has the state of the table's keys: it belongs
    to the table, and to the one that is compacted from it."""
    # in processing time a state that expires asks for one more batch again and again: only batches with changes are wanted
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    spark = table.spark
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        options = {"maxFilesPerTrigger": str(max_files)} if max_files else {}
        stream = newest_changes(spark.readStream.schema(T.StructType(table.schema.fields[:-1])).options(**options).parquet(source), table.keys, tombstone)
        stream.writeStream.outputMode("update").foreachBatch(table.append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
