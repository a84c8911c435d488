"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item meet if they share a seed, a run of ``RUN`` tokens. For such a pair the longest runs of
tokens that both have and that no earlier tile covers are marked again and again until none of ``RUN`` tokens is left;
runs are found by Karp-Rabin hashes and their ends compared token by token. An item leaks into a document if the tiles
cover ``COVER`` of its tokens, in whatever order its passages stand.

Two exact bounds come before any run. An item's seeds are put in order, those of the most items first; the longest head
of that order that covers less than ``COVER`` of the item can't make a leak alone, so that only the seeds after it, the
rarer ones, are looked up. A passage that many items share, as an instruction or a template, costs nothing that way. Then
an item that is found is covered by the seeds that the document has, each counted once however often it stands there,
and only an item of which these cover ``COVER`` gets runs. Only seeds at which a common run begins are made, that is,
whose tokens before differ: what a pair needs grows with its common runs, not with the product of repeats in a document
and an item. Runs are held for one pair at a time.

The benchmark is read in blocks of bounded size, each broadcast; documents are scanned once for each block, and ``clean``
writes what is left between blocks, so that a worker has one block at a time and nothing grows with the documents.
Scanning is a narrow map over whole texts.

Defined cases: null or empty texts and items, and empty tables, have no tokens and never match; an item of fewer than
``RUN`` tokens has its whole sequence as its only seed; repeated documents each give their rows; repeated items are
reported for each; of equally long runs the first in the document, then in the item, is marked first; ``clean`` returns
all columns of documents, whatever their names, and ``leaks`` reads no other than doc_id and text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, filtered, staged
from .words import U, chunks, mix, word_hashes

RUN, COVER = 5, 0.6
#: Bytes of benchmark text that are broadcast at once, and rows.
BLOCK_BYTES, BLOCK_ROWS = 16 << 20, 50_000
_STEP = U(0x9E3779B97F4A7C55)
#: Stand for the token before a text's and an item's first one.
_FIRST_OF_TEXT, _FIRST_OF_ITEM = U(1), U(2)


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of k tokens."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        acc = np.zeros(n, U)
        for j in range(k):
            acc = acc * _STEP + words[j : n + j]
    return mix(acc)


class Prefixes:
    """Karp-Rabin hashes of any runs of tokens of one sequence, as differences of prefix hashes."""

    def __init__(self, tokens: np.ndarray):
        self.powers = np.full(len(tokens) + 1, _STEP, U)
        self.powers[0] = 1
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(self.powers, dtype=U)
            # prefix hashes divided by the power of their length are plain sums, since the step is odd and has an inverse
            inverse = np.full(len(tokens) + 1, pow(int(_STEP), -1, 1 << 64), U)
            inverse[0] = 1
            self.sums = np.r_[U(0), np.cumsum(tokens * np.cumprod(inverse, dtype=U)[:-1], dtype=U)]

    def of(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[at + n] - self.sums[at]) * self.powers[at]


def spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the ranges that begin at ``start``, end to end, and the range of each."""
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(len(which)) + (start - np.r_[0, np.cumsum(size)[:-1]])[which], which


class Places:
    """Where the runs of k tokens of a document stand, by their hash and by the token before them."""

    def __init__(self, doc: np.ndarray, k: int):
        h = runs(doc, k)
        before = np.r_[_FIRST_OF_TEXT, doc[:-1]][: len(h)]
        self.at = np.lexsort((before, h))
        self.hashes = h[self.at]
        group = self._group(self.hashes, before[self.at])
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)])
        last = np.r_[first[1:], len(group)][: len(first)]
        order = np.argsort(group[first], kind="stable")
        self.groups, self.first, self.last = group[first][order], first[order], last[order]

    @staticmethod
    def _group(h: np.ndarray, before: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(h * _STEP + before)

    def have(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(h), bool)
        return self.hashes[np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)] == h

    def starts(self, h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place here, number of the seed) of all places of seeds but those after the same token, which are inside a run."""
        lo, hi = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, side="right")
        which = np.flatnonzero(lo < hi)
        lo, hi = lo[which], hi[which]
        group = self._group(h[which], before[which])
        g = np.minimum(np.searchsorted(self.groups, group), len(self.groups) - 1)
        same = self.groups[g] == group
        a, b = np.where(same, self.first[g], hi), np.where(same, self.last[g], hi)
        at, seed = spread(np.r_[lo, b], np.r_[a - lo, hi - b])
        return self.at[at], np.r_[which, which][seed]


class Items:
    """The tokens of a block of benchmark items, their seeds, and the seeds by which documents look for them."""

    def __init__(self, ids: list, texts: list[str | None], run: int = RUN, cover: float = COVER):
        self.ids = ids
        parts, bounds = [np.zeros(0, U)], [np.zeros(1, np.int64)]
        for _, _, buf, off in chunks(pa.array(texts, pa.large_string())):
            words, b = word_hashes(buf, off)
            parts.append(words)
            bounds.append(b[1:] + bounds[-1][-1])
        self.words, self.bounds = np.concatenate(parts), np.concatenate(bounds)
        self.prefixes = Prefixes(self.words)
        self.size = np.diff(self.bounds)
        #: Tokens of each item's seeds, and how many of its tokens have to be covered.
        self.length, self.need = np.minimum(run, self.size), np.maximum(np.ceil(cover * self.size), 1)
        item_of = np.repeat(np.arange(len(self.size)), self.size)
        place = np.arange(len(self.words))
        self.begins = place + self.length[item_of] <= self.bounds[item_of + 1]
        self.seeds, often = np.zeros(len(self.words), U), np.zeros(len(self.words), np.int64)
        lengths = sorted(set(self.length.tolist()) - {0})
        for k in lengths:
            at = np.flatnonzero(self.begins & (self.length[item_of] == k))
            self.seeds[at] = runs(self.words, k)[at]
            _, which, n = np.unique(self.seeds[at], return_inverse=True, return_counts=True)
            often[at] = n[which]
        rank = self._ranks(item_of, often)
        looked_up = self.begins & (rank >= self._threshold(item_of, rank, run)[item_of])
        #: By length of seeds: hashes of those that are looked up, their items, and a filter on the hashes.
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        for k in lengths:
            at = np.flatnonzero(looked_up & (self.length[item_of] == k))
            at = at[np.argsort(self.seeds[at], kind="stable")]
            maybe = np.zeros(1 << 20, bool)
            maybe[self._slot(self.seeds[at])] = True
            self.by_length[k] = self.seeds[at], item_of[at], maybe

    def _ranks(self, item_of: np.ndarray, often: np.ndarray) -> np.ndarray:
        """Each seed's place in one order in which an item's most frequent seeds come first."""
        rank = np.zeros(len(often), np.int64)
        rank[np.lexsort((-often, item_of))] = np.arange(len(often))
        return rank

    def _threshold(self, item_of: np.ndarray, rank: np.ndarray, run: int) -> np.ndarray:
        """Of each item the rank of the first seed with which the seeds up to it cover as much as a leak needs."""
        covered = np.full(len(rank), len(rank), np.int64)  # by which seed a token is covered first
        for j in range(run):
            seed = np.arange(len(rank) - j)
            seed = seed[self.begins[seed] & (j < self.length[item_of[seed]])]
            covered[seed + j] = np.minimum(covered[seed + j], rank[seed])
        covered = covered[np.lexsort((covered, item_of))]
        out = np.zeros(len(self.size), np.int64)
        full = np.flatnonzero(self.size)
        out[full] = covered[self.bounds[full] + np.minimum(self.need[full], self.size[full]).astype(np.int64) - 1]
        return out

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h & U((1 << 20) - 1)).astype(np.int64)

    def tokens(self, item: int) -> np.ndarray:
        return self.words[self.bounds[item] : self.bounds[item + 1]]

    def found(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(row, length of seeds, items) of the items of which a row has a seed that is looked up."""
        if not len(words):
            return
        row_of = np.searchsorted(bounds, np.arange(len(words)), side="right") - 1
        for k, (keys, item, maybe) in self.by_length.items():
            h = runs(words, k)
            near = np.flatnonzero(maybe[self._slot(h)])
            near = near[near + k <= bounds[row_of[near] + 1]]
            lo, hi = np.searchsorted(keys, h[near]), np.searchsorted(keys, h[near], side="right")
            hit = np.flatnonzero(lo < hi)
            # a seed counts once for each row
            pairs, at = np.unique(np.stack([row_of[near[hit]], lo[hit]]), axis=1, return_index=True)
            hi = hi[hit[at]]
            cut = np.flatnonzero(np.r_[True, pairs[0][1:] != pairs[0][:-1]][: len(hi)])
            for a, z in zip(cut, np.r_[cut[1:], len(hi)], strict=False):
                yield int(pairs[0][a]), k, np.unique(item[spread(pairs[1][a:z], hi[a:z] - pairs[1][a:z])[0]])

    def coverable(self, items: np.ndarray, k: int, places: Places) -> np.ndarray:
        """Those of the items of which the seeds that a document has cover enough tokens."""
        keep = [np.zeros(0, np.int64)]
        slices = np.cumsum(self.size[items]) >> 20  # tokens at once
        for part in np.split(items, np.flatnonzero(np.diff(slices)) + 1):
            at, _ = spread(self.bounds[part], self.size[part])
            shared = self.begins[at] & places.have(self.seeds[at])
            covered = shared.copy()
            for j in range(1, k):
                covered[j:] |= shared[: len(shared) - j]  # a seed ends inside its item
            keep.append(part[np.add.reduceat(covered.astype(np.int64), np.r_[0, np.cumsum(self.size[part])[:-1]]) >= self.need[part]])
        return np.concatenate(keep)

    def common_runs(self, item: int, places: Places, prefixes: Prefixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the document, place in the item, length) of all longest common runs."""
        lo, size = int(self.bounds[item]), int(self.size[item])
        k = int(self.length[item])
        at = slice(lo, lo + size - k + 1)
        d, t = places.starts(self.seeds[at], np.r_[_FIRST_OF_ITEM, self.words[lo : lo + size - k]])
        least, most = np.full(len(d), k), np.minimum(len(prefixes.sums) - 1 - d, size - t)
        while (least < most).any():
            mid = (least + most + 1) // 2
            fits = prefixes.of(d, mid) == self.prefixes.of(lo + t, mid)
            least, most = np.where(fits, mid, least), np.where(fits, most, mid - 1)
        return d, t, least


def tiles(doc: np.ndarray, item: np.ndarray, at_doc: np.ndarray, at_item: np.ndarray, length: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(place in the document, place in the item, length) of the greedy tiling by common runs, longest tiles first."""
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    out = []
    heap = list(zip((-length).tolist(), at_doc.tolist(), at_item.tolist(), strict=True))
    heapq.heapify(heap)
    while heap:
        n, d, t = heapq.heappop(heap)
        n = -n
        # a Karp-Rabin hit is a match only where its tokens are equal, and a tile only where no earlier one is
        good = free_doc[d : d + n] & free_item[t : t + n] & (doc[d : d + n] == item[t : t + n])
        if good.all():
            free_doc[d : d + n], free_item[t : t + n] = False, False
            out.append((d, t, n))
            continue
        # what is left of this run goes back in its place by length
        edges = np.flatnonzero(np.diff(np.r_[False, good, False].astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= least:
                heapq.heappush(heap, (a - b, d + a, t + a))
    return out


_OUT = "item_id long, item_tokens int, tiles int, covered int, coverage double, spans array<struct<at:int,item_at:int,length:int>>"


def matches(items: Items, text: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(row, item, tiles) of the pairs in which tiles cover as much of the item as a leak needs."""
    for lo, _, buf, off in chunks(text):
        words, bounds = word_hashes(buf, off)
        for row, k, some in items.found(words, bounds):
            doc = words[bounds[row] : bounds[row + 1]]
            places, prefixes = Places(doc, k), None
            for item in items.coverable(some, k, places).tolist():
                prefixes = prefixes or Prefixes(doc)
                got = tiles(doc, items.tokens(item), *items.common_runs(item, places, prefixes), k)
                if sum(n for _, _, n in got) >= items.need[item]:
                    yield lo + row, item, got


def scan(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, item_id, ..., spans), a row for each document and item that leaks into it."""
    sent = docs.sparkSession.sparkContext.broadcast(items)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *[x.split()[0] for x in ("item_id", "item_tokens", "tiles", "covered", "coverage", "spans")]]
    span = pa.list_(pa.struct([("at", pa.int32()), ("item_at", pa.int32()), ("length", pa.int32())]))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), span]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = sent.value
        for batch in batches:
            rows, out = [], []
            for row, item, got in matches(b, batch.column(1)):
                n, covered = len(b.tokens(item)), sum(n for _, _, n in got)
                rows.append(row)
                out.append((b.ids[item], n, len(got), covered, covered / n, [{"at": d, "item_at": i, "length": m} for d, i, m in got]))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *[pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]], names)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, {_OUT}")


def blocks(benchmark: DataFrame, block_bytes: int | None = None, block_rows: int | None = None) -> Iterator[list]:
    """The benchmark's rows in lists of bounded size, equal items in one list. One block is read at a time."""
    block_bytes, block_rows = block_bytes or BLOCK_BYTES, block_rows or BLOCK_ROWS
    sized = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null")
    total = sized.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    n = max(1, -(-total["n"] // block_rows), -(-(total["b"] or 0) // block_bytes))
    for k in range(n):
        part = sized if n == 1 else sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted(part.collect(), key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))


def leaks(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, run: int = RUN) -> DataFrame:
    """All pairs of a document and a benchmark item that leaks into it."""
    out = None
    for block in blocks(benchmark):
        part = scan(docs, Items([r["item_id"] for r in block], [r["text"] for r in block], run, cover))
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, run: int = RUN) -> DataFrame:
    """The rows of docs into which no item leaks, with all their columns: a filter for each block, no join."""
    last = None
    for block in blocks(benchmark):
        if last is not None:  # each block has a worker of its own in a plan, so that blocks of one plan add up
            kept = staged(docs, "clean-of-some-blocks")
            if last:
                dropped(*last)
            docs, last = kept, [kept]
        sent = docs.sparkSession.sparkContext.broadcast(Items([r["item_id"] for r in block], [r["text"] for r in block], run, cover))

        def stays(text: pa.Array, sent=sent) -> np.ndarray:
            out = np.ones(len(text), bool)
            for row, _, _ in matches(sent.value, text):
                out[row] = False
            return out

        docs, last = filtered(docs, stays), last or []
    return docs
