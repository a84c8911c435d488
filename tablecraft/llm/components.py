"""Connected components of a graph of links, by DataFrame functions only.

Links are turned into stars around the smallest vertex of each component by alternating two steps (Kiveris et al. 2014):
each vertex links its larger neighbours, then its smaller ones, to the smallest vertex it knows. Rounds grow with the
logarithm of the longest path. Every round is written to the shared folder, so nothing gathers on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .shared import dropped, staged

#: Rounds have a task for so many edges, and ``TASKS`` at least.
EDGES, TASKS = 50_000, 8


def _least(both: DataFrame) -> DataFrame:
    """(u, m): each vertex and the smallest of itself and its neighbours in (u, v)."""
    return both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _kept(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The edges, written, and the number of edges with a sum of their hashes, which are the same for the same edges. Both
    are taken while they are written; a lost task that is counted twice costs another round and nothing else."""
    seen = Observation()
    out = staged(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v") % (1 << 40)), F.lit(0)).alias("sum")), name)
    return out, (seen.get["n"], seen.get["sum"])


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(vertex, component) of all vertices that have a link; a component is named by its smallest vertex. Null ends and
    links to oneself are left out."""
    edges, state = _kept(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull().alias("_x"), F.col(b).isNotNull().alias("_y"))
        .where("_x and _y and u > v").select("u", "v").distinct(),
        "links",
    )
    for _ in range(rounds):
        tasks = max(TASKS, state[0] // EDGES)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct().coalesce(tasks)
        large, state_of_large = _kept(large, "large-star")
        # stars stay as they are, and each of their vertices has one centre
        if state_of_large == state and large.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo < hi").isEmpty():
            dropped(large)
            break
        least = _least(large)
        small = (
            large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u > v").coalesce(tasks).distinct().coalesce(tasks)
        )
        last, (edges, state) = edges, _kept(small, "small-star")
        dropped(last, large)
    else:
        raise RuntimeError(f"links did not become stars in {rounds} rounds")
    stars = edges.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
