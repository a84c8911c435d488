"""Document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits.

Every shingle of a text is hashed once. The high bits of the hash choose one of ``BINS`` bins and each bin keeps its
least remaining value. An empty bin takes the value of the first non-empty bin along a pseudo-random order of its own,
which is the same for all texts (Shrivastava 2017), so that two bins still agree with a probability equal to the
likeness. ``BITS`` low-order bits of each bin are packed; values that differ agree in those by chance with probability
2**-BITS, which ``likeness`` corrects (Li and Koenig 2010).

Defined cases: a null or empty text, or one of white space only, has the fingerprint ``EMPTY``; two of those have
likeness 1, one of those and any other 0. Fewer than five words are one shingle. Equal texts have equal fingerprints.
Texts of any length are read whole, a chunk at a time; columns other than the id and the text are not read, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U, chunks, mix, shingle_hashes, word_hashes

BINS_LOG2, BITS = 10, 4
BINS = 1 << BINS_LOG2
EMPTY = "empty"
_VALUE_BITS = 64 - 2 * BINS_LOG2
_order: dict[str, np.ndarray] = {}


def _orders() -> tuple[np.ndarray, np.ndarray]:
    """For each bin the order in which others are asked, and each other bin's place in that order."""
    if not _order:
        grid = mix(np.arange(BINS * BINS, dtype=U).reshape(BINS, BINS) * U(0xD1342543DE82EF95))
        _order["order"] = np.argsort(grid, axis=1, kind="stable").astype(np.int16)
        _order["place"] = np.argsort(_order["order"], axis=1, kind="stable").astype(np.int16)
    return _order["order"], _order["place"]


def minima(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row and bin the least value, and which bins had any; at most BINS rows at once."""
    rows = len(bounds) - 1
    at = np.repeat(np.arange(rows, dtype=U), np.diff(bounds))
    keys = (at << U(64 - BINS_LOG2)) | ((hashes >> U(64 - BINS_LOG2)) << U(_VALUE_BITS)) | (hashes & U((1 << _VALUE_BITS) - 1))
    keys.sort()
    cell = keys >> U(_VALUE_BITS)
    first = np.ones(len(keys), bool)
    first[1:] = cell[1:] != cell[:-1]
    value, full = np.zeros(rows * BINS, U), np.zeros(rows * BINS, bool)
    cell = cell[first].astype(np.int64)
    value[cell], full[cell] = keys[first] & U((1 << _VALUE_BITS) - 1), True
    return value.reshape(rows, BINS), full.reshape(rows, BINS)


def densify(value: np.ndarray, full: np.ndarray, asked: int = 12) -> np.ndarray:
    """Fill the empty bins of every row that has a non-empty one."""
    order, place = _orders()
    some = full.any(axis=1)
    row, bin_ = np.nonzero(~full & some[:, None])
    value = value.copy()
    for a in range(asked):
        donor = order[bin_, a]
        hit = full[row, donor]
        value[row[hit], bin_[hit]] = _taken(value[row[hit], donor[hit]], bin_[hit])
        row, bin_ = row[~hit], bin_[~hit]
    cuts = np.flatnonzero(np.diff(row)) + 1
    for b, r in zip(np.split(bin_, cuts), row[np.r_[0, cuts]] if len(row) else [], strict=False):
        donors = np.flatnonzero(full[r])  # few are full, so all of them are asked at once
        value[r, b] = _taken(value[r, donors[np.argmin(place[b][:, donors], axis=1)]], b)
    return value


def _taken(value: np.ndarray, bin_: np.ndarray) -> np.ndarray:
    """A donor's value as bin ``bin_`` takes it: equal values stay equal, and the low bits of different values agree by
    chance in each bin anew, so that one chance agreement isn't copied into all bins that asked the same donor."""
    return mix(value ^ (bin_.astype(U) << U(48))) >> U(2 * BINS_LOG2)


def packed(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows x bytes of packed bits, whether the row has any shingle)."""
    out, some = [np.zeros((0, BINS * BITS // 8), np.uint8)], [np.zeros(0, bool)]
    for _, _, buf, off in chunks(text):
        hashes, bounds = shingle_hashes(*word_hashes(buf, off))
        for lo in range(0, len(off) - 1, BINS):
            b = bounds[lo : lo + BINS + 1]
            value, full = minima(hashes[b[0] : b[-1]], b - b[0])
            low = (densify(value, full) & U((1 << BITS) - 1)).astype(np.uint8)
            out.append((low[:, 0::2] << 4) | low[:, 1::2])
            some.append(full.any(axis=1))
    return np.concatenate(out), np.concatenate(some)


def likeness(a: np.ndarray, a_some: np.ndarray, b: np.ndarray, b_some: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness of the rows of two arrays of packed fingerprints, 0 to 1."""
    x = a ^ b
    agree = ((x >> 4) == 0).sum(axis=1) + ((x & 15) == 0).sum(axis=1)
    chance = 2.0**-BITS
    est = np.clip((agree / BINS - chance) / (1 - chance), 0, 1)
    return np.where(a_some & b_some, est, (a_some == b_some).astype(float))


def _hex(a: np.ndarray, some: np.ndarray) -> list[str]:
    return [x.tobytes().hex() if s else EMPTY for x, s in zip(a, some, strict=True)]


def fingerprint(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint) of every row; no shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_hex(*packed(b.column(1))), pa.string())], [key, "fingerprint"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, fingerprint string")


def _edited(text: str, follower: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + follower[:k]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def _results(ids: list, texts: list[str], followers: list[str]) -> pa.RecordBatch:
    changed = [_edited(t, f) for t, f in zip(texts, followers, strict=True)]
    # all but the last row of a run are followed by the row after them, whose fingerprint is at hand
    same = len(texts) > 1 and followers[:-1] == texts[1:]
    own, own_some = packed(pa.array([*texts, followers[-1]] if same else [*texts, *followers], pa.large_string()))
    n = len(texts)
    nxt, nxt_some = (own[1:], own_some[1:]) if same else (own[n:], own_some[n:])
    own, own_some = own[:n], own_some[:n]
    ed, ed_some = packed(pa.array(changed, pa.large_string()))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            pa.array(_hex(own, own_some), pa.string()), pa.array(_hex(ed, ed_some), pa.string()),
            pa.array(likeness(own, own_some, ed, ed_some)), pa.array(likeness(own, own_some, nxt, nxt_some)),
        ],
        _NAMES,
    )


def fingerprints_of_neighbours(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third is replaced by the start of the next
    document in descending order of doc_id (after the last: the first).

    Documents are dealt to ranges of doc_id and each range is read in order; the greatest id of a range also goes, as a
    guest, to the end of the range above, whose last document it follows, so no task needs more than a range. A range's
    texts are streamed. Several rows of one doc_id, repeated or not, follow each other in the order of their texts. A row
    without doc_id has no place in the order: it is followed by an empty text and follows none, and such rows are dealt
    to ranges of their own by a hash of their text. An empty table gives no rows.
    """
    spark = docs.sparkSession
    slim = docs.select("doc_id", "text")
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = slim.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (4 * parts)) if parts > 1 else []
    # quantiles are doubles, which are exact to 2**53 only: they limit ranges, and the last range is open above
    limits = np.array(sorted({min(int(x), (1 << 63) - 1) for x in cuts}), np.int64)

    @F.pandas_udf("int")
    def places(ids):
        import pandas as pd

        return pd.Series(np.searchsorted(limits, ids.to_numpy()).astype(np.int32))

    doc_id = F.col("doc_id").cast("long")  # without nulls, which would make doubles of a batch's ids
    ranged = slim.withColumn("range", F.when(doc_id.isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int")).otherwise(places(F.coalesce(doc_id, F.lit(0).cast("long")))))
    tops = [(r["range"], r["top"]) for r in ranged.where("range >= 0").groupBy("range").agg(F.max(doc_id).alias("top")).orderBy("range").collect()]
    above = [(top, tops[(k + 1) % len(tops)][0]) for k, (_, top) in enumerate(tops)]
    guests = slim.join(F.broadcast(spark.createDataFrame(above, "top long, range int")), doc_id == F.col("top"))
    both = ranged.select("range", F.lit(False).alias("guest"), "doc_id", "text").unionByName(guests.select("range", F.lit(True).alias("guest"), "doc_id", "text"))
    placed = both.select("range", "guest", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = placed.repartition("range").sortWithinPartitions("range", "guest", F.desc("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, followers = [], [], []
        held = None  # (range, id, text) of the row whose follower has not come yet
        room = 0
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                for rng, guest, i, t in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                    if held is not None:
                        ids.append(held[1]), texts.append(held[2]), followers.append(t if held[0] == rng and rng >= 0 else "")
                        room += 2 * len(held[2])
                    held = None if guest else (rng, i, t)
                    if room > 1 << 21:
                        yield _results(ids, texts, followers)
                        ids, texts, followers, room = [], [], [], 0
        if held is not None:
            ids.append(held[1]), texts.append(held[2]), followers.append("")
        if ids:
            yield _results(ids, texts, followers)

    return dealt.mapInArrow(run, _OUT)
