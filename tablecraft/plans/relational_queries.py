"""Queries over the given tables for projections, filters, joins, aggregates, windows and order."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, geo, scalars, text, variants
from ..operators import clean, measures
from .registry import query, table

S, D = SparkSession, DataFrame


# --- projections and column edits


@query("SELECT o_orderkey, o_orderdate, o_totalprice, o_orderstatus FROM orders")
def project_columns(spark: S, d: str) -> D:
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_tax / NULLIF(l_discount, 0) * 100, 6) AS pct FROM lineitem")
def computed_ratio_pct(spark: S, d: str) -> D:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(scalars.pct(F.col("l_tax"), F.col("l_discount")), 6).alias("pct"))


@query("SELECT l_returnflag, round(AVG(l_quantity), 6) AS avg_quantity, round(AVG(l_extendedprice), 4) AS avg_price, round(AVG(l_extendedprice) / AVG(l_quantity), 4) AS unit_price FROM lineitem GROUP BY 1")
def alias_reuse(spark: S, d: str) -> D:
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("p"))
    return g.withColumn("unit_price", F.round(F.col("p") / F.col("q"), 4)).select("l_returnflag", F.round("q", 6).alias("avg_quantity"), F.round("p", 4).alias("avg_price"), "unit_price")


@query("SELECT *, CAST(o_orderdate AS DATE) AS order_day FROM orders")
def add_column(spark: S, d: str) -> D:
    return table(spark, d, "orders").withColumn("order_day", F.to_date("o_orderdate"))


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def drop_columns(spark: S, d: str) -> D:
    return table(spark, d, "orders").drop("o_orderstatus", "o_orderpriority")


@query("SELECT c_custkey, 'oops' AS c_mktsegment FROM customer")
def update_all_rows(spark: S, d: str) -> D:
    return table(spark, d, "customer").withColumn("c_mktsegment", F.lit("oops")).select("c_custkey", "c_mktsegment")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 'Yes' WHEN 'N' THEN 'No' ELSE l_returnflag END AS returned FROM lineitem")
def case_recode(spark: S, d: str) -> D:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scalars.recode(F.col("l_returnflag"), {"A": "Yes", "N": "No"}).alias("returned"))


@query("SELECT p_partkey, CASE WHEN r < 1 THEN 'Bad' WHEN r BETWEEN 1 AND 3 THEN 'Good' ELSE 'Excellent' END AS band FROM (SELECT p_partkey, NULLIF(p_size, 7) / 10.0 AS r FROM part)")
def case_binning(spark: S, d: str) -> D:
    return table(spark, d, "part").select("p_partkey", scalars.rate_band(F.nullif("p_size", F.lit(7)) / 10.0).alias("band"))


@query("SELECT r_regionkey, CASE r_name WHEN 'AFRICA' THEN 'Africa' WHEN 'AMERICA' THEN 'Americas' WHEN 'EUROPE' THEN 'Europe' ELSE r_name END AS r_name FROM region")
def value_aliases(spark: S, d: str) -> D:
    return clean.rename_values(table(spark, d, "region"), "r_name", {"AFRICA": "Africa", "AMERICA": "Americas", "EUROPE": "Europe"})


@query("""SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'URGENT' WHEN '2-HIGH' THEN 'URGENT' WHEN '5-LOW' THEN 'LOW' ELSE o_orderpriority END AS o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1""")
def entity_normalization(spark: S, d: str) -> D:
    folded = clean.rename_values(table(spark, d, "orders"), "o_orderpriority", {"1-URGENT": "URGENT", "2-HIGH": "URGENT", "5-LOW": "LOW"})
    return folded.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'active' ELSE '' END AS note FROM customer")
def if_flag_label(spark: S, d: str) -> D:
    return table(spark, d, "customer").select("c_custkey", scalars.if_flag(F.col("c_acctbal") > 0, "active").alias("note"))


# --- filters


@query("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_eq(spark: S, d: str) -> D:
    return table(spark, d, "customer").where(F.col("c_mktsegment") == "BUILDING")


@query("SELECT * FROM customer WHERE lower(c_mktsegment) = 'building'")
def filter_like(spark: S, d: str) -> D:
    return table(spark, d, "customer").where(text.same_text(F.col("c_mktsegment"), "Building"))


@query("SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1995-08-01' AND o_orderdate < TIMESTAMP '1995-09-01'")
def filter_like_prefix_date(spark: S, d: str) -> D:
    return table(spark, d, "orders").where(dates.in_month(F.col("o_orderdate"), 1995, 8))


@query("SELECT COUNT(*) FILTER (f IS NULL) AS nulls, COUNT(*) FILTER (f IS NOT NULL) AS others FROM (SELECT NULLIF(l_returnflag, 'N') AS f FROM lineitem)")
def filter_null(spark: S, d: str) -> D:
    f = table(spark, d, "lineitem").select(F.nullif("l_returnflag", F.lit("N")).alias("f"))
    return f.agg(F.count_if(F.col("f").isNull()).alias("nulls"), F.count_if(F.col("f").isNotNull()).alias("others"))


@query("SELECT o_orderkey, p FROM (SELECT o_orderkey, NULLIF(o_orderpriority, '3-MEDIUM') AS p FROM orders) WHERE p NOT IN ('1-URGENT', '5-LOW')")
def filter_not_in(spark: S, d: str) -> D:
    p = table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("3-MEDIUM")).alias("p"))
    return p.where(~F.col("p").isin("1-URGENT", "5-LOW"))


@query("SELECT * FROM nation WHERE n_name IN ('FRANCE', 'GERMANY', 'CHINA', 'NATION_1', 'NATION_7')")
def filter_in_list(spark: S, d: str) -> D:
    return clean.choose(table(spark, d, "nation"), "n_name", ["FRANCE", "GERMANY", "CHINA", "NATION_1", "NATION_7"])


@query("SELECT o_orderkey, p FROM (SELECT o_orderkey, NULLIF(o_orderpriority, '3-MEDIUM') AS p FROM orders) WHERE p <> '5-LOW' OR p IS NULL")
def filter_exclude_member(spark: S, d: str) -> D:
    return clean.exclude(table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("3-MEDIUM")).alias("p")), "p", "5-LOW")


@query("SELECT * FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31'")
def filter_date_range(spark: S, d: str) -> D:
    return table(spark, d, "orders").where(F.col("o_orderdate").between(F.lit(dt.datetime(1995, 1, 1)).cast("timestamp_ntz"), F.lit(dt.datetime(1995, 12, 31)).cast("timestamp_ntz")))


@query("SELECT * FROM lineitem WHERE date_trunc('month', l_shipdate) = DATE '1996-01-01'")
def filter_month_equals(spark: S, d: str) -> D:
    return table(spark, d, "lineitem").where(dates.in_month(F.col("l_shipdate"), 1996, 1))


@query("SELECT * FROM (SELECT o_orderkey, o_totalprice / 1000 AS thousands FROM orders) WHERE thousands > 200")
def filter_on_alias(spark: S, d: str) -> D:
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("thousands")).where("thousands > 200")


@query("SELECT r_name, COUNT(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_name IN ('EUROPE', 'ASIA') GROUP BY 1")
def filter_user_choice(spark: S, d: str, regions: list[str] | None = None) -> D:
    chosen = clean.choose(table(spark, d, "region"), "r_name", regions or ["EUROPE", "ASIA"])
    return chosen.join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))


@query("SELECT * FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-02-01' AND DATE '1996-02-29'")
def filter_between_dates(spark: S, d: str) -> D:
    return table(spark, d, "orders").where(dates.between_days(F.col("o_orderdate"), *dates.previous_month(dt.date(1996, 3, 15))))


@query("SELECT * FROM (SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS status FROM orders) WHERE status IS NOT NULL")
def drop_null_rows(spark: S, d: str) -> D:
    return table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status")).na.drop(subset=["status"])


# --- joins


@query("SELECT a.o_orderkey, b.o_orderkey AS other, a.o_custkey, a.o_orderdate FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate WHERE a.o_orderkey < b.o_orderkey")
def inner_join_composite(spark: S, d: str) -> D:
    o = table(spark, d, "orders")
    a, b = o.select("o_custkey", "o_orderdate", "o_orderkey"), o.select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("other"))
    return a.join(b, ["o_custkey", "o_orderdate"]).where("o_orderkey < other").select("o_orderkey", "other", "o_custkey", "o_orderdate")


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'FRANCE' OR n_nationkey = 3")
def inner_join_single(spark: S, d: str) -> D:
    n = table(spark, d, "nation").where("n_name = 'FRANCE' or n_nationkey = 3")
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")


@query("SELECT o_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND o_orderdate >= TIMESTAMP '1995-08-01' AND o_orderdate < TIMESTAMP '1995-09-01'")
def inner_join_extra_on(spark: S, d: str) -> D:
    on = (F.col("o_orderkey") == F.col("l_orderkey")) & dates.in_month(F.col("o_orderdate"), 1995, 8)
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), on).select("o_orderkey", "l_linenumber", "l_partkey")


_PEERS = "(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority FROM orders)"


def _with_gaps(spark: S, d: str) -> D:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("priority"))


@query(f"SELECT a.o_custkey, a.o_orderkey AS row_id, b.o_orderkey AS peer_id, b.priority AS peer_value FROM {_PEERS} a JOIN {_PEERS} b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey WHERE a.priority IS NULL")
def self_join_neq(spark: S, d: str) -> D:
    return clean.peers(_with_gaps(spark, d), "o_custkey", "o_orderkey", "priority")


@query(f"SELECT a.o_custkey, a.o_orderkey AS row_id, b.o_orderkey AS peer_id, b.priority AS peer_value FROM {_PEERS} a JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM {_PEERS}) b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND b.n <= 3 WHERE a.priority IS NULL")
def self_join_few_peers(spark: S, d: str) -> D:
    """The same with the first three orders of each customer as peers: what a hot customer gives grows with its rows."""
    return clean.peers(_with_gaps(spark, d), "o_custkey", "o_orderkey", "priority", most=2)


@query("SELECT c_custkey, o_orderkey, l_linenumber, l_partkey, p_name FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey")
def left_join_chain(spark: S, d: str) -> D:
    c = table(spark, d, "customer")
    c = c.join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return c.join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"), "left").select("c_custkey", "o_orderkey", "l_linenumber", "l_partkey", "p_name")


@query("""SELECT e.event_type, COUNT(*) AS n FROM events e LEFT JOIN (SELECT DISTINCT date_trunc('hour', ts) AS h FROM events WHERE event_type = 'purchase') w ON date_trunc('hour', e.ts) = w.h WHERE w.h IS NOT NULL GROUP BY 1""")
def left_join_hour_bucket(spark: S, d: str) -> D:
    e = table(spark, d, "events")
    w = e.where("event_type = 'purchase'").select(F.date_trunc("hour", "ts").alias("h")).distinct()
    return e.join(w, F.date_trunc("hour", "ts") == w["h"], "left").where("h is not null").groupBy("event_type").agg(F.count("*").alias("n"))


_STAR = """FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"""


@query(f"SELECT r_name, p_brand, round(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue {_STAR} GROUP BY 1, 2")
def multi_way_star_join(spark: S, d: str) -> D:
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.expr("l_orderkey = o_orderkey")).join(t("customer"), F.expr("o_custkey = c_custkey")).join(t("nation"), F.expr("c_nationkey = n_nationkey"))
    j = j.join(t("region"), F.expr("n_regionkey = r_regionkey")).join(t("part"), F.expr("l_partkey = p_partkey")).join(t("supplier"), F.expr("l_suppkey = s_suppkey"))
    return j.groupBy("r_name", "p_brand").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT n_name, r_name, s_name FROM nation, region, supplier WHERE n_regionkey = r_regionkey AND s_nationkey = n_nationkey")
def comma_join(spark: S, d: str) -> D:
    t = lambda n: table(spark, d, n)
    return t("nation").join(t("region"), F.expr("n_regionkey = r_regionkey")).join(t("supplier"), F.expr("s_nationkey = n_nationkey")).select("n_name", "r_name", "s_name")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def anti_join_in_stock(spark: S, d: str) -> D:
    open_ = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(open_, "o_orderkey", "left_anti")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def semi_join_not_in_stock(spark: S, d: str) -> D:
    open_ = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(open_, "o_orderkey", "left_semi")


@query("SELECT COUNT(*) AS n, COUNT(x.k2) AS matched FROM (SELECT o_orderkey AS k FROM orders) LEFT JOIN (SELECT l_orderkey AS k, l_partkey AS k2 FROM lineitem) x USING (k)")
def left_join_using(spark: S, d: str) -> D:
    a, b = table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("k2"))
    return a.join(b, "k", "left").agg(F.count("*").alias("n"), F.count("k2").alias("matched"))


@query("SELECT n_name FROM nation WHERE n_regionkey = (SELECT r_regionkey FROM region WHERE r_name = 'EUROPE')")
def scalar_subquery_filter(spark: S, d: str) -> D:
    key = table(spark, d, "region").where("r_name = 'EUROPE'").select("r_regionkey")
    return table(spark, d, "nation").where(F.col("n_regionkey") == key.scalar()).select("n_name")


@query("""SELECT c_custkey, s AS o_orderstatus, (SELECT string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) FROM orders o WHERE o.o_custkey = x.o_custkey AND o.o_orderstatus = x.s) AS priorities
 FROM (SELECT DISTINCT o_custkey, o_orderstatus AS s FROM orders) x JOIN customer ON c_custkey = o_custkey""")
def correlated_scalar_subquery(spark: S, d: str) -> D:
    per = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ", ").alias("priorities"))
    return table(spark, d, "customer").join(per, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderstatus", "priorities")


@query("SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING SUM(o_totalprice) > 2000000)")
def semi_join_report(spark: S, d: str) -> D:
    best = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("s")).where("s > 2000000")
    return table(spark, d, "customer").join(best, "c_custkey", "left_semi")


@query("""SELECT a.n_nationkey, round(a.balance, 2) AS balance, round(b.ratio, 6) AS ratio FROM (SELECT c_nationkey AS n_nationkey, SUM(c_acctbal) AS balance FROM customer GROUP BY 1) a
 LEFT JOIN (SELECT s_nationkey AS n_nationkey, MAX(s_acctbal) / NULLIF(AVG(s_acctbal), 0) AS ratio FROM supplier GROUP BY 1) b USING (n_nationkey)""")
def blend_aggregates(spark: S, d: str) -> D:
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.round(F.sum("c_acctbal"), 2).alias("balance"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.round(measures.max_over_avg("s_acctbal", "s_acctbal"), 6).alias("ratio"))
    return measures.blend(a, b, "n_nationkey")


# --- aggregates


@query("SELECT round(SUM(l_quantity), 2) AS total, SUM(CAST(l_linenumber AS BIGINT))::BIGINT AS numbers, round(SUM(l_tax) / SUM(l_quantity) * 100, 8) AS pct FROM lineitem WHERE NULLIF(l_returnflag, 'N') IS NOT NULL")
def global_agg(spark: S, d: str) -> D:
    rows = table(spark, d, "lineitem").where(F.nullif("l_returnflag", F.lit("N")).isNotNull())
    return rows.agg(F.round(F.sum("l_quantity"), 2).alias("total"), F.sum(F.col("l_linenumber").cast("string").cast("int")).alias("numbers"), F.round(measures.ratio_of_sums("l_tax", "l_quantity"), 8).alias("pct"))


@query("SELECT l_shipdate, round(SUM(l_quantity), 2) AS quantity, round(SUM(l_extendedprice), 2) AS price, round(SUM(l_quantity) / NULLIF(SUM(l_extendedprice), 0) * 100, 8) AS pct FROM lineitem GROUP BY 1")
def group_agg_day(spark: S, d: str) -> D:
    return table(spark, d, "lineitem").groupBy("l_shipdate").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.round(measures.ratio_of_sums("l_quantity", "l_extendedprice"), 8).alias("pct"))


@query("SELECT p_brand, MAX(TRY_CAST(CASE WHEN p_size % 5 = 0 THEN 'x' ELSE CAST(p_size AS VARCHAR) END AS INT)) AS most FROM part GROUP BY 1")
def group_max(spark: S, d: str) -> D:
    size = F.when(F.col("p_size") % 5 == 0, "x").otherwise(F.col("p_size").cast("string"))
    return table(spark, d, "part").groupBy("p_brand").agg(F.max(scalars.to_int(size)).alias("most")).orderBy(F.desc_nulls_last("most"))


@query("SELECT o_custkey, o_orderstatus, MAX(o_totalprice) AS most, round(MAX(o_totalprice / NULLIF(o_custkey % 5, 0)) * 100, 4) AS pct FROM orders GROUP BY 1, 2")
def group_max_of_ratio(spark: S, d: str) -> D:
    return table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.max("o_totalprice").alias("most"), F.round(F.max(scalars.ratio(F.col("o_totalprice"), F.col("o_custkey") % 5)) * 100, 4).alias("pct"))


@query("SELECT p AS o_orderpriority, round(SUM(o_totalprice), 2) AS total FROM (SELECT NULLIF(o_orderpriority, '3-MEDIUM') AS p, o_totalprice FROM orders) WHERE p IS NOT NULL AND p NOT IN ('5-LOW', '1-URGENT') GROUP BY 1")
def group_sum_filtered(spark: S, d: str) -> D:
    o = table(spark, d, "orders").withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("3-MEDIUM")))
    return o.where(F.col("o_orderpriority").isNotNull() & ~F.col("o_orderpriority").isin("5-LOW", "1-URGENT")).groupBy("o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT f AS flag, MAX(l_quantity) AS most FROM (SELECT NULLIF(l_returnflag, 'N') AS f, l_quantity FROM lineitem) WHERE f IS NOT NULL GROUP BY 1")
def group_max_by_continent(spark: S, d: str) -> D:
    rows = table(spark, d, "lineitem").withColumn("flag", F.nullif("l_returnflag", F.lit("N"))).where("flag is not null")
    return rows.groupBy("flag").agg(F.max("l_quantity").alias("most")).orderBy(F.desc("most"))


@query("SELECT o_custkey, round(AVG(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def group_avg(spark: S, d: str) -> D:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.avg("o_totalprice"), 4).alias("mean")).orderBy(F.desc("mean"))


@query("SELECT o_custkey, o_orderpriority, round(SUM(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2")
def group_sum_multi_key(spark: S, d: str) -> D:
    return table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT COUNT(*) AS n FROM lineitem")
def count_star(spark: S, d: str) -> D:
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"))


@query("SELECT MIN(p_name) AS title, COUNT(l_partkey) AS n FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_partkey = 7")
def count_column(spark: S, d: str) -> D:
    return table(spark, d, "part").where("p_partkey = 7").join(table(spark, d, "lineitem"), F.expr("p_partkey = l_partkey")).agg(F.any_value("p_name").alias("title"), F.count("l_partkey").alias("n"))


@query("SELECT COUNT(o_custkey) AS as_written, COUNT(DISTINCT o_custkey) AS as_meant FROM orders")
def distinct_of_count(spark: S, d: str) -> D:
    return table(spark, d, "orders").agg(F.count("o_custkey").alias("as_written"), F.countDistinct("o_custkey").alias("as_meant")).distinct()


@query("SELECT o_custkey, round(SUM(o_totalprice), 2) AS total, COUNT(*) AS n FROM orders GROUP BY 1 HAVING SUM(o_totalprice) > 1500000 AND COUNT(*) > 10")
def having_two(spark: S, d: str) -> D:
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n")).where("s > 1500000 and n > 10")
    return g.select("o_custkey", F.round("s", 2).alias("total"), "n")


@query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def group_concat(spark: S, d: str) -> D:
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("names"))


@query("""SELECT c_mktsegment, string_agg(DISTINCT line, '; ' ORDER BY line) AS info FROM (SELECT c_mktsegment, o_orderstatus || ': ' || string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS line
 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, o_orderstatus) GROUP BY 1""")
def group_concat_ordered_distinct(spark: S, d: str) -> D:
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey"))
    inner = j.groupBy("c_mktsegment", "o_orderstatus").agg(F.concat("o_orderstatus", F.lit(": "), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ", ")).alias("line"))
    return inner.groupBy("c_mktsegment").agg(F.array_join(F.array_sort(F.collect_set("line")), "; ").alias("info"))


@query("SELECT strftime(ts, '%a') AS weekday, COUNT(*) AS n FROM events GROUP BY 1")
def group_count_by_expr(spark: S, d: str) -> D:
    return table(spark, d, "events").groupBy(dates.short_day_name(F.col("ts")).alias("weekday")).agg(F.count("*").alias("n")).orderBy(F.desc("n"))


_PLACE = "(user_id % 90)::DOUBLE AS lat1, (user_id % 180)::DOUBLE AS lon1, (user_id % 90 + value / 100)::DOUBLE AS lat2, (user_id % 180 + value / 50)::DOUBLE AS lon2"
_KM = "(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))))"


def hourly_metrics(trips: D) -> D:
    """By hour: trips, mean duration in minutes, mean distance in km, and the speed that follows. trips: (ts, seconds,
    lat1, lon1, lat2, lon2)."""
    km = geo.haversine_km(*[F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")])
    g = trips.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("trips"), (F.avg("seconds") / 60).alias("avg_minutes"), F.avg(km).alias("avg_km"))
    return g.withColumn("km_per_hour", 60 * scalars.ratio(F.col("avg_km"), F.col("avg_minutes")))


def trips_of_events(events: D) -> D:
    u, v = F.col("user_id"), F.col("value")
    return events.select("ts", (v * 10).alias("seconds"), (u % 90).cast("double").alias("lat1"), (u % 180).cast("double").alias("lon1"), (u % 90 + v / 100).alias("lat2"), (u % 180 + v / 50).alias("lon2"))


@query(f"""SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, COUNT(*) AS trips, round(AVG(value * 10) / 60, 7) AS avg_minutes, round(AVG({_KM}), 7) AS avg_km, round(60 * AVG({_KM}) / NULLIF(AVG(value * 10) / 60, 0), 7) AS km_per_hour
 FROM (SELECT ts, value, {_PLACE} FROM events) GROUP BY 1""")
def hourly_trip_metrics(spark: S, d: str) -> D:
    m = hourly_metrics(trips_of_events(table(spark, d, "events")))
    return m.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "trips", *[F.round(c, 7).alias(c) for c in ("avg_minutes", "avg_km", "km_per_hour")])


@query("SELECT n_nationkey, n_name, COUNT(*) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
def agg_dependent_columns(spark: S, d: str) -> D:
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    return table(spark, d, "nation").select("n_nationkey", "n_name").join(c, "n_nationkey")


@query("SELECT l_shipdate, l_returnflag, round(SUM(l_tax) / NULLIF(SUM(l_discount), 0) * 100, 6) AS pct FROM lineitem GROUP BY 1, 2")
def ratio_of_sums(spark: S, d: str) -> D:
    return table(spark, d, "lineitem").groupBy("l_shipdate", "l_returnflag").agg(F.round(measures.ratio_of_sums("l_tax", "l_discount"), 6).alias("pct"))


@query("SELECT c_nationkey, round(MAX(c_acctbal) / NULLIF(AVG(c_acctbal), 0), 6) AS ratio FROM customer GROUP BY 1")
def max_over_avg(spark: S, d: str) -> D:
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(measures.max_over_avg("c_acctbal", "c_acctbal"), 6).alias("ratio"))


@query("SELECT l_suppkey, round(m, 6) AS m FROM (SELECT l_suppkey, SUM(l_tax) / NULLIF(SUM(l_discount), 0) AS m FROM lineitem GROUP BY 1) WHERE m IS NOT NULL AND m BETWEEN 0 AND 0.8")
def filter_on_aggregate(spark: S, d: str) -> D:
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(measures.exact_ratio_of_sums("l_tax", "l_discount").alias("m"))
    return g.where("m is not null and m between 0 and 0.8").select("l_suppkey", F.round("m", 6).alias("m"))


@query("SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, o_orderpriority, round(SUM(o_totalprice), 2) AS total, round(AVG(o_totalprice), 4) AS mean FROM orders GROUP BY 1, 2")
def monthly_agg(spark: S, d: str) -> D:
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")
    return table(spark, d, "orders").groupBy(month, "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("SELECT CASE r_name WHEN 'AFRICA' THEN 'Africa' ELSE r_name END AS r_name, round(SUM(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'MIDDLE EAST' GROUP BY 1")
def sum_by_region(spark: S, d: str) -> D:
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey")).join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
    named = clean.rename_values(clean.exclude(j, "r_name", "MIDDLE EAST"), "r_name", {"AFRICA": "Africa"})
    return named.groupBy("r_name").agg(F.round(F.sum("c_acctbal"), 2).alias("balance")).orderBy(F.desc("balance"))


@query("""WITH g AS (SELECT o_orderstatus, SUM(o_totalprice) AS a, MAX(o_totalprice) AS b, COUNT(*)::DOUBLE AS c FROM orders GROUP BY 1)
 SELECT o_orderstatus, 0 AS position, 'total' AS measure, round(a, 2) AS value FROM g UNION ALL SELECT o_orderstatus, 1, 'most', round(b, 2) FROM g UNION ALL SELECT o_orderstatus, 2, 'orders', c FROM g""")
def measure_names_unpivot(spark: S, d: str) -> D:
    rows = measures.measures_as_rows(table(spark, d, "orders"), {"total": F.sum("o_totalprice"), "most": F.max("o_totalprice"), "orders": F.count("*")}, ["o_orderstatus"])
    return rows.withColumn("value", F.round("value", 2))


@query("SELECT o_orderpriority AS value, COUNT(*) AS n, round(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 1)::DOUBLE AS pct FROM orders GROUP BY 1")
def value_share_pct(spark: S, d: str) -> D:
    return measures.share_of_total(table(spark, d, "orders"), "o_orderpriority").select("value", "n", F.col("pct").cast("double").alias("pct"))


# --- windows


@query("SELECT o_custkey, l_orderkey, l_linenumber, l_partkey, round(SUM(l_quantity) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), 2) AS running FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def running_sum(spark: S, d: str) -> D:
    j = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.expr("l_orderkey = o_orderkey"))
    return measures.running_sum(j, "l_quantity", ["o_custkey"], ["o_orderdate"]).select("o_custkey", "l_orderkey", "l_linenumber", "l_partkey", F.round("running", 2).alias("running"))


@query("SELECT o_custkey, l_orderkey, l_linenumber, l_partkey, round(SUM(l_quantity) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), 2) AS running FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def running_sum_large_keys(spark: S, d: str) -> D:
    j = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.expr("l_orderkey = o_orderkey"))
    return measures.running_sum_by_step(j, "l_quantity", ["o_custkey"], ["o_orderdate"]).select("o_custkey", "l_orderkey", "l_linenumber", "l_partkey", F.round("running", 2).alias("running"))


@query("SELECT event_id, round(SUM(value) OVER (ORDER BY event_id), 2) AS running FROM events")
def running_sum_one_key(spark: S, d: str) -> D:
    """A running total over a whole table in which each row is a step of its own."""
    e = table(spark, d, "events").select("event_id", "value").withColumn("all", F.lit(1))
    return measures.running_sum_by_step(e, "value", ["all"], ["event_id"]).select("event_id", F.round("running", 2).alias("running"))


@query("""SELECT o_custkey, o_orderkey, o_orderdate, round(running, 2) AS running, round(running / NULLIF(total, 0) * 100, 4) AS pct FROM (SELECT o_custkey, o_orderkey, o_orderdate,
 SUM(q) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS running, SUM(q) OVER (PARTITION BY o_custkey) AS total
 FROM (SELECT o_custkey, o_orderkey, o_orderdate, SUM(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3))""")
def running_pct(spark: S, d: str) -> D:
    j = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"))
    j = j.join(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey")
    r = measures.running_sum(j, "q", ["o_custkey"], ["o_orderdate"]).withColumn("total", F.sum("q").over(Window.partitionBy("o_custkey")))
    return r.select("o_custkey", "o_orderkey", "o_orderdate", F.round("running", 2).alias("running"), F.round(scalars.pct(F.col("running"), F.col("total")), 4).alias("pct"))


_ORDERED = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_ORDERED)}) AS n FROM lineitem) WHERE n = 1")
def dedupe_row_number(spark: S, d: str) -> D:
    first = clean.dedupe(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col(c) for c in _ORDERED])
    return first.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query(f"SELECT o_orderkey, o_custkey, COALESCE(priority, first_value(priority IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS priority FROM {_PEERS}")
def fill_from_peer(spark: S, d: str) -> D:
    return clean.fill_from_peer(_with_gaps(spark, d), "priority", "o_custkey", ["o_orderkey"])


# --- order, limits, sets


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC NULLS LAST")
def order_by_columns(spark: S, d: str) -> D:
    return table(spark, d, "customer").orderBy(F.asc_nulls_first("c_mktsegment"), F.desc_nulls_last("c_acctbal")).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY 1 ORDER BY 2 DESC")
def order_by_ordinal(spark: S, d: str) -> D:
    return spark.sql("SELECT c_mktsegment, COUNT(*) AS n FROM {customer} GROUP BY 1 ORDER BY 2 DESC", customer=table(spark, d, "customer"))


@query()
def limit_rows(spark: S, d: str) -> D:
    return table(spark, d, "orders").limit(5)


@query("SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 20")
def top_k(spark: S, d: str) -> D:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(20)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def shared_table_topn(spark: S, d: str) -> D:
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10)


@query("SELECT o_orderpriority, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END AS rank, COUNT(*) AS n FROM orders GROUP BY 1, 2")
def manual_order(spark: S, d: str) -> D:
    g = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return g.withColumn("rank", measures.manual_order(F.col("o_orderpriority"), ["5-LOW", "1-URGENT"]).cast("int")).orderBy("rank", "o_orderpriority")


@query("SELECT p_brand, round(SUM(p_retailprice), 2) AS total FROM part GROUP BY 1 ORDER BY 2 DESC")
def sort_by_measure(spark: S, d: str) -> D:
    return table(spark, d, "part").groupBy("p_brand").agg(F.round(F.sum("p_retailprice"), 2).alias("total")).orderBy(F.desc("total"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def select_distinct(spark: S, d: str) -> D:
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("(SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def member_set_union_except(spark: S, d: str) -> D:
    a = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).union(table(spark, d, "customer").select("c_nationkey")).distinct()
    return a.exceptAll(table(spark, d, "nation").where("n_regionkey = 1").select("n_nationkey"))


# --- scalar functions


@query("SELECT p_partkey, TRY_CAST(CASE WHEN p_size % 3 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS INT) AS size FROM part")
def cast_text_to_int(spark: S, d: str) -> D:
    return table(spark, d, "part").select("p_partkey", scalars.to_int(F.when(F.col("p_size") % 3 == 0, "n/a").otherwise(F.col("p_size").cast("string"))).alias("size"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def convert_to_date(spark: S, d: str) -> D:
    return table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@query("SELECT o_orderkey, COALESCE(NULLIF(o_orderstatus, 'P'), 'unknown') AS status FROM orders")
def null_replacement(spark: S, d: str) -> D:
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("unknown")).alias("status"))


_ADDRESS = "CASE WHEN c_custkey % 9 = 0 THEN c_name ELSE c_name || ', ' || c_mktsegment || ', ' || c_custkey END"


def _addresses(spark: S, d: str) -> D:
    full = F.concat_ws(", ", "c_name", "c_mktsegment", F.col("c_custkey").cast("string"))
    return table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, F.col("c_name")).otherwise(full).alias("a"))


@query(f"SELECT c_custkey, CASE WHEN instr(a, ',') > 0 THEN left(a, instr(a, ',') - 1) END AS street, CASE WHEN instr(a, ',') > 0 THEN trim(substr(a, instr(a, ',') + 1)) END AS city FROM (SELECT c_custkey, {_ADDRESS} AS a FROM customer)")
def split_address_two(spark: S, d: str) -> D:
    return _addresses(spark, d).select("c_custkey", text.before_comma(F.col("a")).alias("street"), text.after_comma(F.col("a")).alias("city"))


@query(f"SELECT c_custkey, CASE WHEN len(x) >= 3 THEN trim(x[len(x) - 2]) END AS street, CASE WHEN len(x) >= 2 THEN trim(x[len(x) - 1]) END AS city, trim(x[len(x)]) AS state FROM (SELECT c_custkey, CASE WHEN len(p) <= 4 THEN p END AS x FROM (SELECT c_custkey, string_split(replace({_ADDRESS}, '.', ','), ',') AS p FROM customer))")
def split_address_three(spark: S, d: str) -> D:
    return _addresses(spark, d).select("c_custkey", *[text.part_from_right(F.col("a"), n).alias(c) for n, c in ((3, "street"), (2, "city"), (1, "state"))])


@query("SELECT p_partkey, replace(p_name, ' ', '.') AS name FROM part")
def replace_text(spark: S, d: str) -> D:
    return table(spark, d, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit(".")).alias("name"))


@query("SELECT c_custkey, c_name || ' ' || NULLIF(c_mktsegment, 'BUILDING') AS name FROM customer")
def concat_null(spark: S, d: str) -> D:
    return table(spark, d, "customer").select("c_custkey", text.full_name(F.col("c_name"), F.nullif("c_mktsegment", F.lit("BUILDING"))).alias("name"))


@query("SELECT p_partkey, upper(p_name[1]) || lower(p_name[2:]) AS name FROM part")
def capitalize_first(spark: S, d: str) -> D:
    return table(spark, d, "part").select("p_partkey", text.capitalize_first(F.col("p_name")).alias("name"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, date_trunc('month', ts)::TIMESTAMP AS month, COUNT(*) AS n FROM events GROUP BY 1, 2")
def date_trunc_units(spark: S, d: str) -> D:
    unit = lambda u: F.date_trunc(u, "ts").cast("timestamp_ntz").alias(u)
    return table(spark, d, "events").groupBy(unit("hour"), unit("month")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, (date_trunc('month', o_orderdate) - INTERVAL 1 MONTH)::DATE AS first, (date_trunc('month', o_orderdate) - INTERVAL 1 DAY)::DATE AS last FROM orders")
def previous_month_bounds(spark: S, d: str) -> D:
    first, last = dates.previous_month_bounds(F.to_date("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", first.alias("first"), last.alias("last"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def days_between(spark: S, d: str) -> D:
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.expr("l_orderkey = o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", F.datediff("l_shipdate", "o_orderdate").cast("long").alias("days"))


@query("SELECT p_brand, floor(SUM(p_retailprice * 1e6) / pow(1024.0, 3) * 10) / 10 AS gb FROM part GROUP BY 1")
def floor_power(spark: S, d: str) -> D:
    return table(spark, d, "part").groupBy("p_brand").agg(scalars.gigabytes(F.sum(F.col("p_retailprice") * 1e6)).alias("gb"))


@query(f"SELECT event_id, round({_KM}, 6) AS km FROM (SELECT event_id, {_PLACE} FROM events)")
def haversine_km(spark: S, d: str) -> D:
    e = table(spark, d, "events")
    u, v = F.col("user_id"), F.col("value")
    km = geo.haversine_km((u % 90).cast("double"), (u % 180).cast("double"), u % 90 + v / 100, u % 180 + v / 50)
    return e.select("event_id", F.round(km, 6).alias("km"))


@query("SELECT event_id, round(value - 273.15, 6) AS celsius, round(value / 60, 6) AS minutes, (user_id / 365)::DOUBLE::BIGINT AS years FROM (SELECT event_id, value, user_id - user_id % 365 AS user_id FROM events)")
def arithmetic(spark: S, d: str) -> D:
    return table(spark, d, "events").select("event_id", F.round(scalars.celsius(F.col("value")), 6).alias("celsius"), F.round(F.col("value") / 60, 6).alias("minutes"), scalars.whole_years(F.col("user_id")).cast("long").alias("years"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, json_extract_string(props, '$.absent') AS absent FROM events")
def variant_extract(spark: S, d: str) -> D:
    v = F.parse_json("props")
    return table(spark, d, "events").select("event_id", variants.field(v, "$.k", "int").alias("k"), variants.field(v, "$.absent").alias("absent"))


_WEATHER = """to_json({'time': strftime(ts, '%Y-%m-%d %H:%M:%S'), 'city': {'id': user_id, 'name': event_type, 'country': 'US', 'coord': {'lat': value / 10, 'lon': -value / 10}}, 'clouds': {'all': event_id % 101},
 'main': {'temp': 273.15 + value, 'temp_min': 272.15 + value, 'temp_max': 274.15 + value}, 'weather': [{'main': event_type, 'description': event_type || ' all day', 'icon': '01d'}], 'wind': {'deg': event_id % 360, 'speed': value / 2}})"""


@query(f"""SELECT ts AS observation_time, (r->>'$.city.id')::INT AS city_id, r->>'$.city.name' AS city_name, r->>'$.city.country' AS country, round((r->>'$.city.coord.lat')::DOUBLE, 6) AS city_lat,
 round((r->>'$.city.coord.lon')::DOUBLE, 6) AS city_lon, (r->>'$.clouds.all')::INT AS clouds, round((r->>'$.main.temp')::DOUBLE - 273.15, 6) AS temp_avg, round((r->>'$.main.temp_min')::DOUBLE - 273.15, 6) AS temp_min,
 round((r->>'$.main.temp_max')::DOUBLE - 273.15, 6) AS temp_max, r->>'$.weather[0].main' AS conditions, r->>'$.weather[0].description' AS conditions_desc, r->>'$.weather[0].icon' AS icon,
 (r->>'$.wind.deg')::DOUBLE AS wind_dir, round((r->>'$.wind.speed')::DOUBLE, 6) AS wind_speed FROM (SELECT date_trunc('second', ts) AS ts, {_WEATHER} AS r FROM events) WHERE (r->>'$.city.id')::INT > 50""")
def weather_view(spark: S, d: str) -> D:
    """Reports of weather as JSON made of events, through the view's fifteen paths."""
    whole = lambda **kw: F.struct(*[c.alias(k) for k, c in kw.items()])
    v, n = F.col("value"), F.col("event_id")
    report = whole(
        time=F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), clouds=whole(all=n % 101), wind=whole(deg=n % 360, speed=v / 2),
        city=whole(id=F.col("user_id"), name=F.col("event_type"), country=F.lit("US"), coord=whole(lat=v / 10, lon=-v / 10)),
        main=whole(temp=v + 273.15, temp_min=v + 272.15, temp_max=v + 274.15),
        weather=F.array(whole(main=F.col("event_type"), description=F.concat("event_type", F.lit(" all day")), icon=F.lit("01d"))),
    )
    reports = table(spark, d, "events").select(F.to_json(report).alias("report"))
    view = reports.select(F.parse_json("report").alias("v")).select(*[c.alias(k) for k, c in variants.weather_columns(F.col("v")).items()])
    plain = view.where("city_id > 50").withColumn("observation_time", F.col("observation_time").cast("timestamp_ntz"))
    return plain.withColumns({c: F.round(c, 6) for c in ("city_lat", "city_lon", "temp_avg", "temp_min", "temp_max", "wind_speed")})


@query("SELECT 'JUNIOR_DBA' AS role, '*******' AS event_type, COUNT(*) AS n FROM events UNION ALL SELECT 'SYSADMIN', event_type, COUNT(*) FROM events GROUP BY 2")
def column_mask(spark: S, d: str) -> D:
    e = table(spark, d, "events").select("event_type")
    seen = lambda role: clean.mask_columns(e, role, ["event_type"]).groupBy("event_type").agg(F.count("*").alias("n")).select(F.lit(role).alias("role"), "event_type", "n")
    return seen("JUNIOR_DBA").unionByName(seen("SYSADMIN"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= '1996-01-01'")
def string_coercion(spark: S, d: str) -> D:
    return table(spark, d, "orders").where("o_orderdate >= '1996-01-01'").select("o_orderkey")


@query("SELECT c_custkey, printf('%.2f', c_acctbal::DOUBLE) || '%' AS label FROM customer WHERE c_acctbal BETWEEN 0 AND 999")
def number_label(spark: S, d: str) -> D:
    return table(spark, d, "customer").where("c_acctbal between 0 and 999").select("c_custkey", scalars.label_pct(F.col("c_acctbal")).alias("label"))


@query("SELECT p_partkey, p_size BETWEEN 5 AND 20 AND NOT (p_brand = 'Brand#1' OR p_retailprice > 1500) AS ok FROM part")
def boolean_logic(spark: S, d: str) -> D:
    return table(spark, d, "part").select("p_partkey", (F.col("p_size").between(5, 20) & ~((F.col("p_brand") == "Brand#1") | (F.col("p_retailprice") > 1500))).alias("ok"))


@query("SELECT * FROM supplier")
def table_scan(spark: S, d: str) -> D:
    return table(spark, d, "supplier")


@query("SELECT o_custkey, o_orderkey, o_orderdate, round(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), 2) AS running FROM orders WHERE o_orderstatus <> 'P'")
def vaccination_view(spark: S, d: str) -> D:
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'")
    o.createOrReplaceTempView("orders_so_far")
    return spark.sql("SELECT o_custkey, o_orderkey, o_orderdate, round(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), 2) AS running FROM orders_so_far")
