"""Queries that write the given tables to files and read them as the sources do, and queries over snapshots and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import files, history, loads
from ..streaming import changes, ingest
from .registry import query, table
from .relational_queries import trips_of_events

S, D = SparkSession, DataFrame


def _csv(df: D, name: str, header: bool, null: str) -> str:
    path = files.new_path(df.sparkSession, name)
    df.write.options(header=header, nullValue=null, emptyValue="").csv(path)
    return path


_GAPS = "SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_size END AS p_size, p_name FROM part"


@query(_GAPS)
def csv_header_infer_scan(spark: S, d: str) -> D:
    t = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("p_size"), "p_name")
    return files.read_csv(spark, _csv(t, "part", True, "NA")).select(F.col("p_partkey").cast("long"), "p_size", "p_name")


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS c_mktsegment, c_acctbal FROM customer")
def csv_named_format_scan(spark: S, d: str) -> D:
    t = table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("c_mktsegment"), "c_acctbal")
    return files.read_csv_format(spark, _csv(t, "customer", False, ""), "c_custkey long, c_name string, c_mktsegment string, c_acctbal double")


@query()
def csv_positional_peek(spark: S, d: str) -> D:
    return files.peek(spark, _csv(table(spark, d, "customer"), "customer", False, ""), 5)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_variant_scan(spark: S, d: str) -> D:
    path = files.new_path(spark, "events-json")
    table(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("props")).write.json(path)
    v = files.read_variant_json(spark, path)
    return v.select(F.try_variant_get("v", "$.event_id", "long").alias("event_id"), F.try_variant_get("v", "$.props.k", "int").alias("k"))


@query("SELECT o_orderstatus AS status, COUNT(*) AS n FROM orders GROUP BY 1")
def csv_dashboard_source(spark: S, d: str) -> D:
    schema = "key long, customer long, status string, total double, day date, priority string"
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate"), "o_orderpriority")
    return files.read_csv(spark, _csv(o, "orders", True, ""), schema, null="").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def sheet_source(spark: S, d: str) -> D:
    return files.read_csv(spark, _csv(table(spark, d, "nation"), "nation", True, ""), "n_nationkey int, n_name string, n_regionkey int", null="")


@query()
def stage_list(spark: S, d: str) -> D:
    path = files.new_path(spark, "orders")
    table(spark, d, "orders").write.parquet(path)
    return files.list_files(spark, path)


@query("SELECT 8 AS n_files, true AS sized")
def stage_file_stats(spark: S, d: str) -> D:
    """Lineitem as eight files, and whether their sizes add up."""
    path = files.new_path(spark, "lineitem")
    files.in_parts(table(spark, d, "lineitem"), 8).write.parquet(path)
    sized = F.col("total_gb") * 1024 / F.col("n_files") - F.col("mean_mb")
    return files.file_stats(files.list_files(spark, path)).select("n_files", (F.abs(sized) <= 0.1 * 1024 / 8 + 0.1).alias("sized"))


@query("SELECT COUNT(*) * 2 AS loaded, COUNT(*) * 2 AS n FROM orders")
def bulk_load(spark: S, d: str) -> D:
    path, o = files.new_path(spark, "loaded"), table(spark, d, "orders")
    loaded = files.bulk_load(o, path) + files.bulk_load(o, path)
    return spark.read.parquet(path).agg(F.count("*").alias("n")).withColumn("loaded", F.lit(loaded).cast("long"))


@query("SELECT COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def truncate_reload(spark: S, d: str) -> D:
    path, o = files.new_path(spark, "reloaded"), table(spark, d, "orders")
    files.bulk_load(o, path)
    files.truncate_reload(o.where("o_orderstatus = 'F'"), path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18, 0)) AS total FROM orders WHERE o_totalprice - floor(o_totalprice) <> 0.5")
def create_typed_table(spark: S, d: str) -> D:
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("total", T.DecimalType(18, 0))])
    return files.typed(table(spark, d, "orders").where("o_totalprice - floor(o_totalprice) <> 0.5").select("o_orderkey", "o_totalprice"), schema)


@query("SELECT CAST(c_custkey AS INT) AS id, CAST(c_nationkey AS VARCHAR) AS nation, CAST(c_acctbal AS DECIMAL(12, 2)) AS balance FROM customer")
def insert_select(spark: S, d: str) -> D:
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("nation", T.StringType()), T.StructField("balance", T.DecimalType(12, 2))])
    path = files.new_path(spark, "inserted")
    files.typed(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


@query("SELECT COUNT(*) AS n FROM supplier")
def drop_if_exists(spark: S, d: str) -> D:
    files.create_view(table(spark, d, "supplier"), "suppliers_seen")
    out = spark.sql("SELECT COUNT(*) AS n FROM suppliers_seen")
    files.drop_if_exists(spark, "suppliers_seen")
    files.drop_if_exists(spark, "suppliers_seen")
    return out


@query("SELECT * FROM part")
def ctas_copy(spark: S, d: str) -> D:
    path = files.new_path(spark, "part")
    table(spark, d, "part").write.parquet(path)
    return files.clone_table(spark, path, files.new_path(spark, "part-copy"))


@query("SELECT o_orderstatus, COUNT(*) AS n, (SELECT COUNT(*) FROM orders) AS rows_written FROM orders GROUP BY 1")
def materialize_snapshot(spark: S, d: str) -> D:
    copy, n = files.snapshot(table(spark, d, "orders"), files.new_path(spark, "snapshot"))
    return copy.groupBy("o_orderstatus").agg(F.count("*").alias("n")).withColumn("rows_written", F.lit(n).cast("long"))


@query("SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY 1")
def create_view(spark: S, d: str) -> D:
    name = files.create_view(table(spark, d, "customer"), "customers_by_segment")
    return spark.sql(f"SELECT c_mktsegment, COUNT(*) AS n FROM {name} GROUP BY 1")


@query("SELECT c_custkey, c_mktsegment FROM customer")
def table_as_of(spark: S, d: str) -> D:
    """All rows are spoilt by an update, its id is looked up in the history, and the state before it is put back."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    t = history.VersionedTable(spark, files.new_path(spark, "versions"), c.schema, ["c_custkey"])
    t.write(c, "insert into customer")
    t.write(c.withColumn("c_mktsegment", F.lit("oops")), "update customer set c_mktsegment = 'oops'")
    t.restore_before(files.last_change(t.log()).first()["query_id"])
    return t.read()


@query("""SELECT o_orderkey, v AS version, CASE WHEN v = 1 OR o_orderkey % 3 <> 0 THEN o_orderstatus WHEN v = 2 THEN 'X' END AS status FROM orders, (VALUES (1), (2), (3)) AS t(v) WHERE NOT (v = 3 AND o_orderkey % 3 = 0)
 UNION ALL SELECT o_orderkey, 3, NULL FROM orders WHERE o_orderkey % 3 = 0""")
def point_in_time_join(spark: S, d: str) -> D:
    """Three versions of orders (all, a third updated, that third deleted), joined to facts that each name a version."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_orderstatus").alias("status"))
    t = history.VersionedTable(spark, files.new_path(spark, "versions"), o.schema, ["o_orderkey"])
    third = o.where("o_orderkey % 3 = 0")
    t.write(o, "insert")
    t.write(third.withColumn("status", F.lit("X")), "update")
    t.write(None, "delete", third)
    facts = o.select("o_orderkey", F.explode(F.array(*[F.lit(v) for v in (1, 2, 3)])).alias("version"))
    return t.join_as_of(facts, "version")


@query("SELECT event_id AS query_id FROM events WHERE event_type = 'purchase' ORDER BY ts, event_id LIMIT 1")
def last_change_lookup(spark: S, d: str) -> D:
    log = table(spark, d, "events").select(F.col("event_id").alias("query_id"), F.col("ts").alias("start_time"), F.when(F.col("event_type") == "purchase", "UPDATE t").otherwise("SELECT 1").alias("statement"))
    return files.last_change(log)


# --- streams


def _halves(spark: S, d: str) -> tuple[str, D, D]:
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "value")
    return files.new_path(spark, "arriving"), e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")


@query("SELECT COUNT(*) AS n, COUNT(DISTINCT event_id) AS ids FROM events")
def incremental_file_ingest(spark: S, d: str) -> D:
    """Two drops of files, loaded by three runs, of which one finds nothing new."""
    source, a, b = _halves(spark, d)
    target, place = files.new_path(spark, "ingested"), files.new_path(spark, "place")
    for part in (a, None, b):
        if part is not None:
            part.write.mode("append").parquet(source)
        ingest.ingest_new_files(spark, source, a.schema, target, place)
    return spark.read.schema(a.schema).parquet(target).agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


_EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("value", T.DoubleType())])


def _drop_csv(df: D, folder: str, name: str) -> None:
    df.write.options(header="false", nullValue="", emptyValue="").csv(f"{folder}/{name}")


@query("SELECT COUNT(*) AS n, COUNT(DISTINCT event_id) AS ids, COUNT(*) FILTER (event_id % 2 = 0) AS first, 0::BIGINT AS again, COUNT(*) FILTER (event_id % 2 = 1) AS second FROM events")
def incremental_load(spark: S, d: str) -> D:
    """Loads of a folder by a prefix: one half of the events, nothing new, the other half; files of another prefix stay out."""
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    folder, t = files.new_path(spark, "stage"), loads.LoadedTable(spark, files.new_path(spark, "loaded"), _EVENTS)
    _drop_csv(e, folder, "other")
    _drop_csv(e.where("event_id % 2 = 0"), folder, "events-0")
    counts = [t.copy_into(folder, "events").rows, t.copy_into(folder, "events").rows]
    _drop_csv(e.where("event_id % 2 = 1"), folder, "events-1")
    counts.append(t.copy_into(folder, "events").rows)
    out = t.read().agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))
    return out.select("n", "ids", *[F.lit(n).cast("long").alias(c) for n, c in zip(counts, ("first", "again", "second"), strict=True)])


@query("SELECT event_id, false AS rejected FROM events WHERE event_id % 50 <> 0 UNION ALL SELECT event_id, true FROM events WHERE event_id % 50 = 0")
def load_with_rejects(spark: S, d: str) -> D:
    """Events of which one in fifty has no number for its value: a load that goes on keeps these records apart."""
    e = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 50 == 0, "none").otherwise(F.col("value").cast("string")).alias("value"))
    folder, t = files.new_path(spark, "stage"), loads.LoadedTable(spark, files.new_path(spark, "loaded"), _EVENTS)
    _drop_csv(e, folder, "events")
    t.copy_into(folder, on_error="continue")
    bad = t.rejects().select(F.split("record", ",")[0].cast("long").alias("event_id"), F.lit(True).alias("rejected"))
    return t.read().select("event_id", F.lit(False).alias("rejected")).unionByName(bad)


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'new ' || p_name ELSE p_name END AS p_name FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey + 1000000, p_name FROM part WHERE p_partkey % 7 = 0")
def apply_changes(spark: S, d: str) -> D:
    """Inserts, updates and deletes of parts, taken as a stream of files in disorder: the deletes come before the older
    updates, and a compaction is between them. Added parts have a key of their own kind, so that none replaces a part
    whose number is theirs."""
    p = table(spark, d, "part").select(F.lit(False).alias("added"), F.col("p_partkey").cast("long").alias("p_partkey"), "p_name")
    first = [("D", p.where("p_partkey % 5 = 0"), 3), ("I", p, 1)]
    more = p.where("p_partkey % 7 = 0").withColumns({"added": F.lit(True), "p_partkey": F.col("p_partkey") + 1000000})
    late = [("I", more, 4), ("U", p.where("p_partkey % 3 = 0").withColumn("p_name", F.concat(F.lit("new "), "p_name")), 2)]
    source, place = files.new_path(spark, "changes"), files.new_path(spark, "place")
    schema = T.StructType.fromDDL("op string, seq long, added boolean, p_partkey bigint, p_name string")
    target = changes.ChangedTable(spark, files.new_path(spark, "changed"), schema, ["added", "p_partkey"])
    for batch in (first, late):
        for op, rows, seq in batch:
            rows.select(F.lit(op).alias("op"), F.lit(seq).cast("long").alias("seq"), "added", "p_partkey", "p_name").write.mode("append").parquet(source)
        changes.apply_change_stream(source, target, place)
        target = target.compacted(files.new_path(spark, "compacted"))
    return target.read().select("p_partkey", "p_name")


@query("""SELECT hour, trips, avg_minutes FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, COUNT(*) AS trips, round(AVG(value * 10) / 60, 7) AS avg_minutes FROM events GROUP BY 1)
 WHERE hour + INTERVAL 1 HOUR <= (SELECT MAX(ts) - INTERVAL 10 MINUTE FROM events)""")
def hourly_metrics_stream(spark: S, d: str) -> D:
    """Hours that are closed when the stream has read all events."""
    trips = trips_of_events(table(spark, d, "events"))
    source = files.new_path(spark, "trips")
    trips.write.parquet(source)
    stream = spark.readStream.schema(trips.schema).parquet(source)
    out = ingest.run_once(ingest.hourly_metrics_stream(stream), files.new_path(spark, "hours"), files.new_path(spark, "place"))
    return out.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "trips", F.round("avg_minutes", 7).alias("avg_minutes"))


@query("SELECT o_custkey, MAX(o_orderdate) AS last_order, round(SUM(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def dashboard_extract(spark: S, d: str) -> D:
    """Report to file to dashboard: an aggregate is written as a snapshot, which the next step reads."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return files.snapshot(o, files.new_path(spark, "extract"))[0]

