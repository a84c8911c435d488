"""What only larger tables have, on small ones made for it: results against the SQL, and how much a task takes."""

from __future__ import annotations

import itertools
import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__
from tablecraft.operators import measures
from tablecraft.sources import files


def _oracle(tables: dict[str, str], name: str) -> list[tuple]:
    con = duckdb.connect()
    for t, path in tables.items():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return sorted(con.execute(__spark_entry__.oracle_sql()[name]).fetchall())


def test_added_parts_replace_none_of_their_number(spark, tmp_path):
    """Parts whose numbers reach those that the stream adds, as 50 times sf 0.1 has them."""
    keys = [*range(40), *range(1_000_000, 1_000_040)]
    pd.DataFrame({"p_partkey": keys, "p_name": [f"part {k}" for k in keys]}).to_parquet(f"{tmp_path}/part.parquet")
    got = __spark_entry__.queries()["apply_changes"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == _oracle({"part": f"{tmp_path}/part.parquet"}, "apply_changes")


def test_ratio_at_a_limit_is_exact(spark, tmp_path):
    """Sums whose ratio is 0.8 or half of a millionth, in another order for each supplier; numbers that are no millionths."""
    rng, rows, want = random.Random(5), [], {}
    for s in range(60):
        tax, discount = ([8] * 400, [10] * 400) if s % 2 else ([7] * 354 + [5], [10] * 320)  # 24.83 / 32 = 0.7759375
        tax = [x for t in tax for k in [rng.randint(0, t)] for x in (t - k, k)]
        tax, discount = rng.sample(tax, len(tax)), rng.sample(discount, len(discount))
        rows += [(s, t / 100, d / 100) for t, d in itertools.zip_longest(tax, discount, fillvalue=0)]
        want[s] = 0.8 if s % 2 else 0.775938
    rows += [(100, 1e300, 2e300), (101, 1e-9, 4e-9), (102, None, 0.1), (103, 0.1, 0.0), (104, float("nan"), 0.1)]
    spark.createDataFrame(rows, "l_suppkey long, l_tax double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = __spark_entry__.queries()["filter_on_aggregate"](spark, str(tmp_path))
    assert dict(map(tuple, got.collect())) == want | {100: 0.5, 101: 0.25}


def test_staged_files_are_put_together_without_a_shuffle(spark, tmp_path):
    """Eight files of a table that has parts enough, and of one that has not."""
    spark.range(9_000, numPartitions=9).write.parquet(f"{tmp_path}/many")
    small = {"spark.sql.files.openCostInBytes": "1", "spark.sql.files.maxPartitionBytes": "6000"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        many, few = files.in_parts(spark.read.parquet(f"{tmp_path}/many"), 8), files.in_parts(spark.range(0, 90, 1, 2), 8)
        for name, df, rows, shuffled in (("a", many, 9000, False), ("b", few, 90, True)):
            assert ("Exchange" in df._jdf.queryExecution().executedPlan().toString()) == shuffled
            df.write.parquet(f"{tmp_path}/{name}")
            assert files.list_files(spark, f"{tmp_path}/{name}").count() == 8 and spark.read.parquet(f"{tmp_path}/{name}").count() == rows
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_blocks_are_looked_up_by_halves(spark):
    """A row's block takes a step for each halving of the blocks and is the number of limits below the value."""
    df = spark.range(4000).select("id", F.when(F.col("id") % 9 > 0, F.col("id") * 7919 % 1009).alias("o"))
    block = measures.range_block(df, "o", 256)
    steps = df.select(block.alias("b"))._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in steps and "aggregate(" in steps
    found = df.select("o", block.alias("b")).orderBy("o").collect()
    assert [r["b"] for r in found] == sorted(r["b"] for r in found) and len({r["b"] for r in found}) > 200
