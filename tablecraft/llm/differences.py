"""Links between the members of long lists of near copies, without holding all their pairs against each other. DataFrame
functions only; the n-gram Jaccard join and the fuzzy lines share it.

``lists`` has rows (key, rep): sets, named by rep, that share a key may link. Long lists that share members are a group,
and its most typical set c is its centre. Sets x and y link if m(x, y) * PER <= |x| + |y| for the size m of their
symmetric difference, which is that of their differences X and Y from c; PER is (100 + p) / (100 - p) for a likeness of
p percent. Two sets that
both link to c are connected anyway. If x doesn't, a linking y has o = ceil((PER (|X| + |Y|) - |x| - |y|) / (2 PER)) >= 1
tokens of Y in common with X. In one order, here of how many differences have a token, the first common one then has o - 1
others after it in either difference. Alone, each side knows that o > (PER |Y| + |c| - |y|) / (2 PER) if y links to c, and
that o >= |X| - |x| (100 - p) / p if x doesn't. These first tokens make lists of their own, in which members meet one
centre first, the member nearest to c; only members that are in different components after that are compared in pairs.

Only sets within ``BALL`` percent of Jaccard distance from c are compared so. By the triangle inequality, a set that links
to one beyond the ball is beyond its core, and what is beyond the core gets other centres, and after ``BALL_ROUNDS`` of
them the empty set for a centre. All of this changes which pairs are looked at, never the components.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import dropped, staged

#: Lists with more members can be joined by differences; a token of a difference costs as much as so many scanned pairs.
LONG_LIST, TOKEN_COST = 32, 3
BALL, BALL_ROUNDS = 50, 3


def renamed(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the ``component`` that ``links`` give their rep."""
    named = components(links).withColumnRenamed("vertex", "rep")
    return rows.drop("component").join(named, "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def open_lists(entries: DataFrame, by: list[str]) -> DataFrame:
    """The rows of the lists, named by the columns ``by``, that show several components, with their list's ``length``."""
    lists = entries.groupBy(*by).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("length")).where("lo < hi")
    return entries.join(lists.select(*by, "length"), by)


def deep_lists(entries: DataFrame) -> DataFrame:
    """The keys of the open lists of (key, rep, n, length) that are cheaper to join by differences than to scan for pairs.
    A set is worth its differences if its long lists have more members than these have tokens; a list goes the same way
    if its pairs are more than the tokens of the other sets in it. So scans cost no more than differences would."""
    long = entries.where(F.col("length") > LONG_LIST)
    own = F.sum("length").over(Window.partitionBy("rep")) > TOKEN_COST * F.col("n")
    lists = long.withColumn("own", own).groupBy("key").agg(F.first("length").alias("length"), F.sum(F.when(F.col("own"), 0).otherwise(F.col("n"))).alias("tokens"))
    return lists.where(F.col("length") * F.col("length") > 2 * TOKEN_COST * F.col("tokens")).select("key")


def union(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def linking(x: str, y: str, tokens: Callable[[Column], Column], percent: int) -> Column:
    """Whether the sets that ``tokens`` makes of the contents x and y link; each is made once, in a lambda's variable."""
    both = F.array(F.struct(tokens(F.col(x)).alias("x"), tokens(F.col(y)).alias("y")))
    return F.exists(both, lambda p: F.size(F.array_intersect(p["x"], p["y"])) * (100 + percent) >= (F.size(p["x"]) + F.size(p["y"])) * percent)


def verified(pairs: DataFrame, sets: DataFrame, tokens: Callable[[Column], Column], percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link. sets: (rep, content), and ``tokens`` makes the set of a content, after the joins."""
    x, y = sets.select(F.col("rep").alias("a"), F.col("content").alias("x")), sets.select(F.col("rep").alias("b"), F.col("content").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").where(linking("x", "y", tokens, percent)).select("a", "b")


def _balls(lists: DataFrame, sets: DataFrame, tokens: Callable[[Column], Column], percent: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The differences (ball, rep, nc, n, m, close, differ) by which sets that share a list can be compared, the links
    (a, b) found on the way, and the staged tables that both read."""
    out, links, held = [], [], []
    within = "200 * m <= {} * (n + nc + m)"  # a Jaccard distance of so many percent from the centre at most
    firsts = lists.groupBy("key").agg(F.min("rep").alias("b"))
    groups = components(lists.join(firsts, "key").select(F.col("rep").alias("a"), "b")).withColumnRenamed("vertex", "rep").withColumnRenamed("component", "group")
    groups = staged(groups, "ball-groups")  # later rounds have members of the same groups
    held.append(groups)
    for _ in range(BALL_ROUNDS):
        sized = lists.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
        lists = staged(lists.join(sized, "key").select("key", "rep", "many"), "ball-lists")
        # the most typical set is in the most and longest lists
        typical = lists.groupBy("rep").agg(F.sum("many").alias("weight")).join(groups, "rep")
        centres = typical.groupBy("group").agg(F.max(F.struct("weight", "rep")).alias("c")).select("group", F.col("c.rep").alias("centre"))
        beside = staged(typical.join(centres, "group").select("centre", "rep"), "ball-members")
        both = beside.join(sets.select(F.col("rep").alias("centre"), F.col("content").alias("x")), "centre").join(sets, "rep")
        both = both.select("centre", "rep", F.explode(F.array(F.struct(tokens(F.col("x")).alias("x"), tokens(F.col("content")).alias("y")))).alias("p"))
        differ = F.concat(F.array_except("p.x", "p.y"), F.array_except("p.y", "p.x"))
        found = both.select("centre", "rep", F.size("p.x").cast("long").alias("nc"), F.size("p.y").cast("long").alias("n"), F.explode(F.array(differ)).alias("differ")).withColumn("m", F.size("differ").cast("long"))
        found = staged(found.withColumn("differ", F.expr(f"CASE WHEN {within.format(BALL)} THEN differ END")), "ball-differences")
        close = F.expr(f"{100 + percent} * m <= {100 - percent} * (n + nc)")
        out.append(found.where("m > 0 AND differ IS NOT NULL").select(F.xxhash64("centre").alias("ball"), "rep", "nc", "n", "m", close.alias("close"), "differ"))
        links.append(found.where(close & (F.col("m") > 0)).select(*ordered("centre", "rep")))
        rest = found.where(f"NOT {within.format(BALL - (100 - percent))}").select("rep")
        left = staged(lists.select("key", "rep").join(rest, "rep"), "ball-rest")
        dropped(lists, beside)
        lists = left
        held += [found, lists]
        if lists.isEmpty():
            return union(out), union(links), held
    rest = lists.select("rep").distinct().join(sets, "rep").select("rep", F.explode(F.array(tokens(F.col("content")))).alias("differ")).withColumn("m", F.size("differ").cast("long"))
    out.append(rest.select(F.lit(0).cast("long").alias("ball"), "rep", F.lit(0).cast("long").alias("nc"), F.col("m").alias("n"), "m", F.lit(False).alias("close"), "differ"))
    return union(out), union(links), held


def links_of(lists: DataFrame, sets: DataFrame, tokens: Callable[[Column], Column], links: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that, with ``links``, connect all sets that link and share one of ``lists`` (key, rep), staged.
    sets: (rep, content) of all members, each once."""
    differ, found, held = _balls(lists.select("key", "rep"), sets, tokens, percent)
    found = staged(found.distinct(), "ball-links")
    links = links.unionByName(found)
    rows = staged(differ.select("ball", "rep", "nc", "n", "m", "close", F.explode("differ").alias("token")), "difference-rows")
    dropped(*held)
    by, of_rep, up, down = ["ball", "token"], ["ball", "rep"], 100 + percent, 100 - percent
    often = rows.groupBy(*by).agg(F.count("*").alias("often")).where("often > 1")
    # tokens of one difference only come first in the order and are in no list: the others' places follow their number
    shared = rows.join(often, by).withColumn("shared", F.count("*").over(Window.partitionBy(*of_rep)))
    placed = shared.withColumn("place", F.col("m") - F.col("shared") + F.row_number().over(Window.partitionBy(*of_rep).orderBy("often", "token")))
    least = f"CASE WHEN close THEN greatest(1, floor(({up} * m + {down} * (nc - n)) / {2 * up}) + 1) ELSE greatest(1, m - n * {down} div {percent}) END"
    entries = staged(placed.where(f"place + {least} <= m + 1").select(*by, "rep", "n", "m", "close", "place"), "difference-entries")
    dropped(rows)

    def side(some: DataFrame, s: str) -> DataFrame:
        return some.select(*by, *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "component", "n", "m", "close", "place")])

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        need = f"greatest(1, ceil(({up} * (m_x + m_y) - {down} * (n_x + n_y)) / {2 * up}))"
        sizes = f"100 * least(n_x, n_y) >= {percent} * greatest(n_x, n_y)"
        return side(x.where("NOT close"), "x").join(side(y, "y"), by).where(f"component_x <> component_y AND {sizes} AND place_x + {need} <= m_x + 1 AND place_y + {need} <= m_y + 1")

    apart = staged(open_lists(renamed(entries, links), by).drop("length"), "open-entries")
    dropped(entries)
    centres = apart.groupBy(*by).agg(F.min(F.struct("m", "rep", "component", "n", "close", "place")).alias("c")).select(*by, "c.*")
    stars = met(apart, centres).groupBy("rep_x", "rep_y").agg(F.count("*").alias("common"))
    stars = stars.withColumn("_n", F.row_number().over(Window.partitionBy("rep_x").orderBy(F.desc("common"), "rep_y"))).where("_n <= 2")
    stars = staged(stars.select(*ordered("rep_x", "rep_y")).distinct(), "difference-stars")
    before, found = found, staged(found.unionByName(verified(stars, sets, tokens, percent)), "difference-star-links")

    before_2, apart = apart, staged(open_lists(renamed(apart, links.unionByName(found)), by).drop("length"), "apart-entries")
    pairs = met(apart, apart).where("close_y OR rep_x < rep_y").select(*ordered("rep_x", "rep_y")).distinct().join(stars, ["a", "b"], "left_anti")
    pairs = staged(pairs, "difference-pairs")
    out = staged(found.unionByName(verified(pairs, sets, tokens, percent)).distinct(), "difference-links")
    dropped(before, before_2, found, apart, stars, pairs)
    return out
