"""Ranked lexical search: accumulator-limited term-at-a-time.

``index`` writes what an item's terms need of each document to the shared folder: its length in terms and how often each
term of the items occurs, (doc_id, n, terms, tfs). ``statistics`` sums up the corpus from it. ``search`` goes through the
index a segment at a time: a segment's postings are inverted in memory, and each item takes its terms from the rarest one
on. Documents get an accumulator when a term first meets them, until the bounds of the terms that are left add up to less
than the item's k-th partial score: no other document can then come among the first k, so only those that have an
accumulator are updated, exactly, by the remaining terms. What a task has found for an item is the threshold that its
next segment starts from. A task gives k documents of each item at most; Spark merges these.

Only the query's side is broadcast. It is taken in blocks of about ``BLOCK_BYTES`` of item text, each with an index of its
own, so that neither the driver nor a task holds more, whatever the number of items.

A term's hash finds it, and its bytes are compared before it counts. Scores are 64-bit integers, div rounding down;
weights are floors of doubles.

Defined cases: null and empty texts have no terms, are not counted in N, and are never found; items without terms give no
rows; repeated rows, and different texts of one doc_id, are documents of their own; equal scores go by ascending doc_id,
rows without doc_id last, and then by the length of the document; repeated items and items without item_id give their
rows each; texts and terms of any length are taken whole; an empty table of documents or items gives no rows; other
columns than doc_id, item_id and text are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, staged
from .words import LOWER, NOT_WORD, Hasher, chunks, spans

K = 10
#: Bytes of item text in a block, and documents of a segment. They bound memory only.
BLOCK_BYTES, SEGMENT = 8 << 20, 8_192


def terms_of(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes in lower case, starts, ends, where each row's terms start, hashes) of runs of rows."""
    for lo, _, buf, off in chunks(text):
        s, e, bounds = spans(buf, off, NOT_WORD)
        yield lo, LOWER[buf], s, e, bounds, Hasher(buf).of(s, e)


@dataclass
class Terms:
    """The distinct terms of all items: their hashes in order, and their bytes one after another. A term is named by its
    place."""

    hashes: np.ndarray
    starts: np.ndarray
    data: np.ndarray

    @classmethod
    def of(cls, words: list[bytes]) -> Terms:
        words = sorted(set(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int64)
        hashes = Hasher(data).of(starts[:-1], starts[1:]) if words else np.zeros(0, np.uint64)
        if len(np.unique(hashes)) < len(words):
            raise ValueError("two terms of the items have one hash")
        order = np.argsort(hashes)
        size = np.diff(starts)[order]
        at = np.repeat(starts[:-1][order] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return cls(hashes[order], np.r_[0, np.cumsum(size)].astype(np.int64), data[at])

    def find(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places among the words s to e of ``buf``, terms): the words that are terms, compared byte by byte."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        t = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        at = np.flatnonzero((self.hashes[t] == h) & (self.starts[t + 1] - self.starts[t] == e - s))
        t = t[at]
        size = e[at] - s[at]
        begin = np.cumsum(size) - size
        inner = np.arange(size.sum()) - np.repeat(begin, size)
        same = buf[np.repeat(s[at], size) + inner] == self.data[np.repeat(self.starts[t], size) + inner]
        good = np.logical_and.reduceat(same, begin) if len(at) else np.zeros(0, bool)
        return at[good], t[good]


def items_terms(items: DataFrame) -> list[tuple[int | None, list[bytes]]]:
    """(item_id, distinct terms) of the items, in order."""
    rows = sorted(((r["item_id"], r["text"] or "") for r in items.collect()), key=lambda r: (r[0] is None, r[0], r[1]))
    out: list = []
    for lo, low, s, e, bounds, _ in terms_of(pa.array([t for _, t in rows], pa.large_string())):
        for i, (a, z) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            out.append((rows[lo + i][0], sorted({low[x:y].tobytes() for x, y in zip(s[a:z], e[a:z], strict=True)})))
    return out


def blocks(items: DataFrame, size: int = BLOCK_BYTES) -> list[DataFrame]:
    """The items in parts of about ``size`` bytes."""
    narrow = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = narrow.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // size))
    return [narrow] if n == 1 else [narrow.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def index(docs: DataFrame, terms: Terms) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents with a term: a narrow map over whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            for lo, low, s, e, bounds, h in terms_of(b.column(1)):
                n = np.diff(bounds)
                at, t = known.find(low, s, e, h)
                row = np.searchsorted(bounds, at, side="right") - 1
                pair, tf = np.unique(row * np.int64(len(known.hashes) + 1) + t, return_counts=True)
                row, t = np.divmod(pair, len(known.hashes) + 1)
                some = np.flatnonzero(n > 0)
                offsets = pa.array(np.r_[np.searchsorted(row, some), len(row)].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, len(n)).take(pa.array(some)), pa.array(n[some].astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(t.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int64)))],
                    ["doc_id", "n", "terms", "tfs"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def statistics(indexed: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """(N, L, df of each term). What comes to the driver has a row for each term of the items at most."""
    n, length = indexed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(n_terms, np.int64)
    for r in indexed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toLocalIterator():
        df[r["term"]] = r["df"]
    return n, length, df


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


@dataclass
class Query:
    """Items as their terms from the rarest on, and the weights of all terms."""

    terms: list[np.ndarray]
    weights: np.ndarray
    n: int
    length: int


def first_k(score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, equal ones by ``tie``."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
        return some[np.lexsort((tie[some], -score[some]))[:k]]
    return np.lexsort((tie, -score))


def best_of_segment(query: Query, n: np.ndarray, terms: np.ndarray, tfs: np.ndarray, offsets: np.ndarray, tie: np.ndarray, floor: np.ndarray, k: int = K) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(item, rows, scores) of the k best rows of a segment for each item that has any whose score is above 0 and not
    below ``floor``, the item's k-th score so far. ``tie`` orders rows of equal scores."""
    rows = len(n)
    m = 100 - 90 + (90 * n * query.n) // query.length
    row = np.repeat(np.arange(rows), np.diff(offsets))
    part = query.weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[row]))
    order = np.argsort(terms, kind="stable")
    row, part, terms = row[order], part[order], terms[order]
    starts = np.searchsorted(terms, np.arange(len(query.weights) + 1))
    bound = np.zeros(len(query.weights), np.int64)
    there = np.flatnonzero(starts[1:] > starts[:-1])
    bound[there] = np.maximum.reduceat(part, starts[there]) if len(there) else 0
    score, has = np.zeros(rows, np.int64), np.zeros(rows, bool)
    for item, of_item in enumerate(query.terms):
        of_item = of_item[bound[of_item] > 0]
        if not len(of_item):
            continue
        left = np.cumsum(bound[of_item][::-1])[::-1]  # of this term and those after it
        if left[0] < floor[item]:
            continue
        score[:], has[:] = 0, False
        creating, threshold = True, int(floor[item])
        for t, rest in zip(of_item.tolist(), left.tolist(), strict=True):
            at, add = row[starts[t] : starts[t + 1]], part[starts[t] : starts[t + 1]]
            if creating and rest <= score.max() and rows > k:
                threshold = max(threshold, int(np.partition(score, rows - k)[rows - k]))
            creating = creating and rest >= threshold
            if creating:
                has[at] = True
            else:
                at, add = at[has[at]], add[has[at]]
            score[at] += add
        found = np.flatnonzero(has & (score > 0) & (score >= floor[item]))
        if len(found):
            found = found[first_k(score[found], tie[found], k)]
            yield item, found, score[found]


def scores(indexed: DataFrame, ids: list[int | None], query: Query, k: int = K) -> DataFrame:
    """(item, item_id, doc_id, n, score): of each task the k best documents of each item."""
    sent = indexed.sparkSession.sparkContext.broadcast((ids, query))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, query = sent.value
        best: dict[int, list[tuple]] = {}
        floor = np.zeros(len(ids), np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, SEGMENT):
                part = b.slice(lo, SEGMENT)
                doc, n, offsets = part.column(0), part.column(1).to_numpy(), part.column(2).offsets.to_numpy()
                terms, tfs = (c.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64) for c in (part.column(2), part.column(3)))
                tie = np.empty(len(n), np.int64)
                tie[pc.sort_indices(pa.table({"doc": doc, "n": n}), sort_keys=[("doc", "ascending"), ("n", "ascending")], null_placement="at_end").to_numpy()] = np.arange(len(n))
                for item, rows, score in best_of_segment(query, n, terms, tfs, offsets - offsets[0], tie, floor, k):
                    found = zip((-score).tolist(), doc.take(pa.array(rows)).to_pylist(), n[rows].tolist(), strict=True)
                    both = sorted([*best.get(item, ()), *found], key=lambda x: (x[0], x[1] is None, x[1] or 0, x[2]))[:k]
                    best[item], floor[item] = both, -both[-1][0] if len(both) == k else 0
        flat = [(i, ids[i], d, n, -s) for i, found in best.items() for s, d, n in found]
        if flat:
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat, strict=True), kinds, strict=True)], ["item", "item_id", "doc_id", "n", "score"])

    return indexed.mapInArrow(run, "item int, item_id long, doc_id long, n long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the k documents that score highest, if above 0."""
    out = None
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for block in blocks(items, block_bytes):
        wanted = items_terms(block)
        known = Terms.of([w for _, words in wanted for w in words])
        indexed = staged(index(narrow, known), "search-index")
        n, length, df = statistics(indexed, len(known.hashes))
        weights = np.array([weight(n, int(x)) for x in df], np.int64)
        place = {known.data[a:z].tobytes(): t for t, (a, z) in enumerate(zip(known.starts[:-1].tolist(), known.starts[1:].tolist(), strict=True))}
        rarest_first = [np.array(sorted((place[w] for w in words), key=lambda t: (df[t], t)), np.int64) for _, words in wanted]
        found = scores(indexed, [i for i, _ in wanted], Query(rarest_first, weights, n, length), k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "n")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        best = staged(ranked, "search-results")
        dropped(indexed)
        out = best if out is None else out.unionByName(best)
    return out


def oracle_sql(k: int = K) -> str:
    words = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH asked AS (SELECT item_id, unnest(list_distinct({words.format("text")})) AS term FROM benchmark),
held AS (SELECT doc_id, {words.format("text")} AS terms FROM documents),
lengths AS (SELECT doc_id, len(terms)::BIGINT AS n FROM held WHERE len(terms) > 0),
corpus AS (SELECT COUNT(*)::BIGINT AS docs, SUM(n)::BIGINT AS length FROM lengths),
postings AS (SELECT doc_id, term, COUNT(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM held) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * COUNT(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, corpus GROUP BY term, docs),
scored AS (SELECT item_id, doc_id, SUM(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // length))))::BIGINT AS score
 FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), corpus GROUP BY ALL HAVING score > 0)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored) WHERE rank <= {k}"""
