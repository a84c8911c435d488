"""N-gram Jaccard join: a size-aware heavy-light join of the documents' sets of five-word shingles.

Two sets with 100 * intersection >= 80 * union share at least ceil(0.8 n) shingles, n being either's size. In one order
of all shingles, the first n - ceil(0.8 n) + l of both sets then have l shingles in common. Hence:

* small sets (up to ``boundary`` shingles) are found by their fixed-size subsets: each pair out of their first
  n - ceil(0.8 n) + 2 shingles is a key (l = 2);
* large sets are found by inverted lists of their first n - ceil(0.8 n) + 1 shingles, which are scanned and counted
  (l = 1); sets just below the boundary are in those lists too, so that a small set meets a large one.

``boundary`` is where the expected number of keys and list entries is least (``cheapest_boundary``). The order puts
shingles that are frequent within any task last, so that passages which many documents share seldom make a key; which
shingles those are changes the cost only, never the result.

Equal sets are one class from the start. In each list the members are first held against one centre; links make
components, and only lists that show several components go on. The number of common keys bounds the intersection from
above, which rules out nearly all pairs before their sets are read; the rest is decided on the whole sets. Open lists
are scanned for pairs where that costs less; lists of many sets that meet in many of them, that is, of near copies, are
joined by their members' differences from a centre (``differences.py``): sets link if the symmetric difference of their
differences is small enough, and what most members share with the centre, or lack of it, makes no pair. So a group of
thousands of near copies costs about its size and not its square, also where many of them are just too unlike to link.

Defined cases: null or empty texts, or texts of white space, have no shingles, link with nothing and are components of
their own; fewer than five words are one shingle. Repeated rows are equal sets. Rows without doc_id, and different texts
of one doc_id, are joined like all others: sets are represented by a key of the row (``row_key``), and a component gets
the smallest doc_id of its rows (null if none has one). Sets are told apart by a 64-bit hash and their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import differences
from .components import components
from .differences import open_lists, renamed, verified
from .shared import dropped, staged
from .words import U, mix, shingle_sets

PERCENT = 80
#: A shingle is put last if some task has it in so many of its sets and all such tasks together in ``FREQUENT``.
LOCAL, FREQUENT = 3, 12
#: Frequent shingles that are put last, the most frequent first: 8 bytes each are broadcast. Others stay in hash order.
PUT_LAST = 1_000_000
LARGEST_BOUNDARY = 64
#: Bits of the bitmap of wanted sets at most, which is broadcast: 8 MB.
MOST_BITS = 1 << 26


def least_common(n: int) -> int:
    """Shingles that a set of size n shares at least with any set it links to: ceil(0.8 n)."""
    return -(-n * PERCENT // 100)


def row_key() -> Column:
    """A 64-bit hash of doc_id and text; only repeated rows have the same."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def set_id(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(tokens ^ U(0x6A09E667F3BCC909)).sum(dtype=U) + U(len(tokens))], U)).view(np.int64)[0])


def sets_of(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n, set_id, token, times): a row for each document, token null; and a row for each task and shingle
    that is frequent in the task, row, doc_id and n null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        kept: list[np.ndarray] = []
        often: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def count() -> None:
            if kept:
                t, n = np.unique(np.concatenate(kept), return_counts=True)
                often.append((t[n >= LOCAL], n[n >= LOCAL]))
                kept.clear()

        for b in batches:
            n, ids = [], []
            for s in shingle_sets(b.column(2)):
                i = set_id(s) if len(s) else 0
                n.append(len(s)), ids.append(i)
                if len(s) and i not in known:
                    known.add(i)
                    kept.append(s)
                    size += len(s)
                    if size > 4_000_000:
                        count()
                        size = 0
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), none, none], ["row", "doc_id", "n", "set_id", "token", "times"])
        count()
        for t, n in often:
            none = pa.nulls(len(t), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(t.view(np.int64)), pa.array(n.astype(np.int64))], ["row", "doc_id", "n", "set_id", "token", "times"])

    return docs.select(row_key().alias("row"), F.col("doc_id").cast("long"), "text").mapInArrow(run, "row long, doc_id long, n long, set_id long, token long, times long")


def cheapest_boundary(sizes: dict[int, int], list_length: float) -> int:
    """The boundary with the least cost: keys of small sets, and list entries of the others, each of which is scanned
    against ``list_length`` others. sizes: number of sets of each size up to LARGEST_BOUNDARY."""
    best, least = 3, None
    for x in range(3, LARGEST_BOUNDARY + 1):
        cost = 0.0
        for n, many in sizes.items():
            p = n - least_common(n)
            if n <= x:
                cost += many * (p + 2) * (p + 1) / 2
            if n >= least_common(x + 1):
                cost += many * (p + 1) * (1 + list_length)
        if least is None or cost < least:
            best, least = x, cost
    return best


def keys_of(tokens: np.ndarray, last: np.ndarray, boundary: int) -> np.ndarray:
    """The keys of one sorted set. ``last`` marks the shingles that come last in the order."""
    n = len(tokens)
    if n < 4:  # links to equal sets only
        return tokens[:0]
    ordered = np.concatenate((tokens[~last], tokens[last]))
    p = n - least_common(n)
    out = []
    if n <= boundary:
        first = mix(ordered[: p + 2])
        i, j = np.triu_indices(p + 2, 1)
        with np.errstate(over="ignore"):
            out.append(mix(first[i] * U(0x9E3779B97F4A7C55) + first[j]))
    if n >= least_common(boundary + 1):
        out.append(ordered[: p + 1])
    return np.concatenate(out)


def postings(docs: DataFrame, put_last: np.ndarray, boundary: int) -> DataFrame:
    """(key, set_id, n) of every set, equal sets of a task once."""
    sent = docs.sparkSession.sparkContext.broadcast(put_last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = sent.value
        maybe = np.zeros(1 << 22, bool)
        maybe[(late & U((1 << 22) - 1)).astype(np.int64)] = True
        known: set[int] = set()
        for b in batches:
            keys, ids, sizes, held = [], [], [], 0

            def out() -> pa.RecordBatch:
                many = [len(k) for k in keys]  # noqa: B023
                return pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), many)), pa.array(np.repeat(np.array(sizes, np.int32), many))],  # noqa: B023
                    ["key", "set_id", "n"],
                )

            for s in shingle_sets(b.column(0)):
                if len(s) < 4 or (i := set_id(s)) in known:
                    continue
                known.add(i)
                last = maybe[(s & U((1 << 22) - 1)).astype(np.int64)]
                if len(late) and (at := np.flatnonzero(last)).size:
                    last[at] = late[np.minimum(np.searchsorted(late, s[at]), len(late) - 1)] == s[at]
                k = keys_of(s, last, boundary)
                keys.append(k), ids.append(i), sizes.append(len(s))
                held += len(k)
                if held > 200_000:
                    yield out()
                    keys, ids, sizes, held = [], [], [], 0
            if keys:
                yield out()

    return docs.select("text").mapInArrow(run, "key long, set_id long, n int")


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and set, those whose key belongs to several sets, each once. Lists are streamed."""
    wait = None  # the last row, while its key has one set
    key = sid = None
    for b in batches:
        k, s, n = (b.column(c).to_numpy(zero_copy_only=False) for c in range(3))
        if not len(k):
            continue
        new = np.r_[key is None or k[0] != key or s[0] != sid, (k[1:] != k[:-1]) | (s[1:] != s[:-1])]
        k, s, n = k[new], s[new], n[new]
        if not len(k):
            continue
        after_known = key is not None and wait is None and k[0] == key  # its list is already going out
        if wait is not None:
            k, s, n = np.r_[wait[0], k], np.r_[wait[1], s], np.r_[wait[2], n].astype(np.int32)
        same = k[1:] == k[:-1]
        several = np.r_[after_known, same] | np.r_[same, False]
        wait = None if several[-1] else (k[-1], s[-1], n[-1])
        key, sid = k[-1], s[-1]
        if several.any():
            yield pa.RecordBatch.from_arrays([pa.array(k[several]), pa.array(s[several]), pa.array(n[several])], ["key", "set_id", "n"])


def _need(n: str, m: str, boundary: int, common: str) -> str:
    """SQL: ``common`` keys of sets of sizes n and m allow for a link. With c common shingles among the first p of each,
    the intersection is at most c plus the longer rest; pairs of small sets count pairs of shingles."""
    rest = lambda x, more: f"(({x} * {PERCENT} + 99) div 100 - {more})"
    union = f"(({n} + {m}) * {PERCENT} + {99 + PERCENT}) div {100 + PERCENT}"
    short = lambda more: f"greatest(1, {union} - greatest({rest(n, more)}, {rest(m, more)}))"
    pairs = f"{common} >= greatest(1, {short(2)} * ({short(2)} - 1) div 2)"
    single = f"{common} >= {short(1)}"
    sizes = f"100 * least({n}, {m}) >= {PERCENT} * greatest({n}, {m})"
    return f"{sizes} AND CASE WHEN greatest({n}, {m}) <= {boundary} THEN {pairs} ELSE {single} END"


def _bits(reps: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of hashes of the reps, of ``MOST_BITS`` bits at most, made on executors by words of 64 bits."""
    n = 1 << 16
    many = reps.count()
    while n < min(16 * many, MOST_BITS):
        n *= 2
    at = F.pmod(F.xxhash64("rep"), F.lit(n))
    words = reps.select(F.shiftright(at, 6).alias("w"), F.expr("shiftleft(1L, cast(pmod(xxhash64(rep), 64) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(n // 64, np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out, n


def _whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, content) of the wanted rows (rep, each once). A broadcast bitmap of bounded size passes over most other rows
    before their texts are read; a join takes out what it lets through, so its size changes the cost only."""
    bits, n = _bits(wanted)
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for b in batches:
            h = b.column(1).to_numpy(zero_copy_only=False)
            maybe = (sent.value[(h % n) >> 6] >> (h & 63)) & 1
            b = b.filter(pa.array([bool(m) and r not in known and not known.add(r) for m, r in zip(maybe, b.column(0).to_pylist(), strict=True)], pa.bool_()))
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.view(np.int64) for s in shingle_sets(b.column(2))], pa.list_(pa.int64()))], ["rep", "content"])

    rows = docs.select(row_key().alias("rep"), F.xxhash64(row_key()).alias("h"), "text").mapInArrow(run, "rep long, content array<long>")
    return rows.join(wanted, "rep", "left_semi").dropDuplicates(["rep"])


def join(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, component_id) of every row of docs, and the links (a, b) that were found between
    representatives of different sets, named by row_key; those connect all sets that are connected."""
    out, links = grouped(docs)
    return out.select("doc_id", "n_shingles", "component_id"), links


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``join``, with each row's key ``row`` and the ``component`` of row keys, which is null without shingles."""
    found = staged(sets_of(docs), "sets")
    frequent = found.where("token is not null").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= FREQUENT)
    late = frequent.orderBy(F.desc("times"), "token").limit(PUT_LAST).toPandas()
    members = found.where("token is null").select("row", "doc_id", "n", "set_id")
    classes = staged(members.where("n > 0").groupBy("set_id", "n").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least")), "classes")
    sizes = {r["n"]: r["count"] for r in classes.where((F.col("n") >= 4) & (F.col("n") <= LARGEST_BOUNDARY)).groupBy("n").count().collect()}
    weight = classes.agg(F.sum("n")).first()[0] or 1
    boundary = cheapest_boundary(sizes, float((late["times"].astype(float) ** 2).sum() / weight) if len(late) else 0.0)

    lists = postings(docs, np.sort(late["token"].to_numpy(np.int64).view(U)), boundary)
    shared = lists.repartition("key").sortWithinPartitions("key", "set_id").mapInArrow(_shared_keys, "key long, set_id long, n int")
    raw = staged(shared, "shared-keys")
    shared = staged(raw.join(classes, ["set_id", "n"]).select("key", "rep", F.col("n").cast("long").alias("n")), "lists")
    dropped(raw)

    # every member of a list against the list's centre; of several centres the one with the most common keys
    centre = shared.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("c"))
    stars = (
        shared.join(centre, "key").where("rep > c.rep")
        .groupBy(F.col("c.rep").alias("a"), F.col("rep").alias("b"), F.col("c.n").alias("na"), F.col("n").alias("nb")).agg(F.count("*").alias("common"))
        .where(_need("na", "nb", boundary, "common"))
        .withColumn("_n", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("common"), "a"))).where("_n = 1")
    )
    stars = staged(stars.select("a", "b"), "stars")
    links = _linked(docs, stars, "star")

    # then the members that lists show in different components
    # two sets in different components have no more keys in common than either has in open lists
    marked = open_lists(renamed(shared, links), ["key"]).withColumn("many", F.count("*").over(Window.partitionBy("rep")))
    marked = staged(marked.select("key", "rep", "n", "component", "length", "many"), "open-lists")
    dropped(shared)
    deep = staged(differences.deep_lists(marked), "deep-lists")
    long = marked.join(deep, "key", "left_semi")
    if not deep.isEmpty():
        sets = staged(_whole_sets(docs, staged(long.select("rep").distinct(), "long-reps")), "long-sets")
        links = links.unionByName(differences.links_of(long, sets, _itself, links, PERCENT))
        dropped(sets)
    short = marked.join(deep, "key", "left_anti")
    left, right = (short.select("key", F.col("rep").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "component", "many")]) for x in "ab")
    across = (
        left.join(right, "key").where("a < b and component_a <> component_b").where(_need("n_a", "n_b", boundary, "least(many_a, many_b)"))
        .groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("common")).where(_need("n_a", "n_b", boundary, "common"))
    )
    across = staged(across.select("a", "b").join(stars, ["a", "b"], "left_anti"), "across")
    links = staged(links.unionByName(_linked(docs, across, "across")), "links")

    groups = components(links).withColumnRenamed("vertex", "rep")
    ranked = staged(classes.join(groups, "rep", "left").select("set_id", "n", "least", F.coalesce("component", "rep").alias("component")), "ranked")
    ranked = ranked.join(ranked.groupBy("component").agg(F.min("least").alias("component_id")), "component").drop("least")
    out = members.join(ranked, ["set_id", "n"], "left").select("row", "doc_id", F.col("n").alias("n_shingles"), "component", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out, links


def _linked(docs: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The pairs that link, staged."""
    sets = staged(_whole_sets(docs, staged(_ends(pairs), f"{name}-ends")), f"{name}-sets")
    out = staged(verified(pairs, sets, _itself, PERCENT), f"{name}-links")
    dropped(sets)
    return out


def _itself(content: Column) -> Column:
    return content


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()


def oracle_sql(table: str = "documents") -> str:
    """The join as DuckDB SQL, by all pairs that share a shingle, for tables whose doc_ids are different."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
    WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(text, '{capitals}', '{capitals.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM {table}),
    shingles AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM texts WHERE len(w) > 0)),
    sizes AS (SELECT t.doc_id, COUNT(s.shingle) AS n FROM texts t LEFT JOIN shingles s USING (doc_id) GROUP BY 1),
    common AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS c FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)),
    ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reach AS (SELECT doc_id, doc_id AS other FROM sizes UNION SELECT r.doc_id, w.y FROM reach r JOIN ways w ON r.other = w.x)
    SELECT s.doc_id, n AS n_shingles, MIN(other) AS component_id FROM sizes s JOIN reach USING (doc_id) GROUP BY 1, 2"""
