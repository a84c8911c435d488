"""Quality by ordinal cumulative-link regression over hashed text.

One weight vector is shared by all grades and K - 1 ordered thresholds cut its score: P(grade <= k) = s(t_k - w.x).
From these come the expected grade and the tail probabilities P(grade >= k), by which documents are kept.

Features are hashed into ``SIZE`` slots in four families: words, the last three bytes of a word, the shape of its first
bytes (letters, digits, signs), and whether a word repeats the one before it. Each family is the square root of its
relative frequencies, so that a text's length doesn't count.

Defined cases: a null or empty text has no features and takes the thresholds' own probabilities, and so has any text
where labels have one grade only or none; repeated rows and equal texts have equal scores; a text on the limit is kept;
an empty table gives no rows; ``keep`` returns all columns of documents, whatever their names, and ``score`` reads no
other than doc_id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .samples import SAMPLE_BYTES, SAMPLE_ROWS, joined_up, sampled_table
from .shared import filtered
from .words import SAME, Hasher, U, chunks, spans

SIZE = 1 << 15
#: A document stays if it reaches grade 1 with at least this probability.
KEEP_AT = 0.5
_code = np.arange(256)
#: Signs stand for themselves, other bytes for their kind.
SHAPE = np.select([(_code >= 97) & (_code <= 122), (_code >= 65) & (_code <= 90), (_code >= 48) & (_code <= 57), _code >= 128], [97, 65, 48, 97], _code).astype(np.uint8)


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value), sorted by row and slot."""
    s, e, bounds = spans(buf, off)
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    word = Hasher(buf).of(s, e)
    again = np.zeros(len(word), U)
    again[1:] = ((word[1:] == word[:-1]) & (row[1:] == row[:-1])).astype(U)
    families = (word, Hasher(buf, SAME).of(np.maximum(e - 3, s), e, salt=1), Hasher(buf, SHAPE).of(s, np.minimum(s + 6, e), salt=2), again + U(77))
    total = np.maximum(np.diff(bounds), 1)
    keys, values = [], []
    quarter = SIZE // len(families)
    for k, h in enumerate(families):
        key, count = np.unique(row * SIZE + (h % U(quarter)).astype(np.int64) + k * quarter, return_counts=True)
        keys.append(key)
        values.append(np.sqrt(count / total[key // SIZE]))
    keys, values = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(keys, kind="stable")
    return keys[order] // SIZE, keys[order] % SIZE, values[order]


class CumulativeLink:
    def __init__(self, weight: np.ndarray, cuts: np.ndarray):
        self.weight, self.cuts = weight, cuts

    def tails(self, text: pa.Array) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K - 1, a row for each text. A text without words has no features: it takes the
        thresholds' own probabilities."""
        out = [np.zeros((0, len(self.cuts)))]
        for lo, hi, buf, off in chunks(text):
            row, slot, value = features(buf, off)
            z = np.bincount(row, value * self.weight[slot], hi - lo)
            out.append(1 / (1 + np.exp(np.clip(self.cuts[None, :] - z[:, None], -30, 30))))
        return np.concatenate(out)


def fit(row: np.ndarray, slot: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int, epochs: int = 25, seed: int = 3) -> CumulativeLink:
    """Maximum likelihood with a small ridge, by AdaGrad; thresholds are kept in order by positive steps between them."""
    n = len(grade)
    tail = np.array([((grade >= k).sum() + 0.5) / (n + 1) if n else 0.9 for k in range(1, grades)])
    cuts = np.maximum.accumulate(-np.log(tail / (1 - tail)) + 1e-3 * np.arange(grades - 1))
    first, gaps = cuts[0], np.log(np.maximum(np.diff(cuts), 1e-3))
    w = np.zeros(SIZE)
    if not n or len(np.unique(grade)) < 2:
        return CumulativeLink(w, cuts)
    gw, gc = np.full(SIZE, 1e-6), np.full(grades - 1, 1e-6)
    rng = np.random.default_rng(seed)
    start = np.searchsorted(row, np.arange(n + 1, dtype=row.dtype))
    s = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, 128):
            some = order[lo : lo + 128]
            size = start[some + 1] - start[some]
            r = np.repeat(np.arange(len(some)), size)
            at = np.repeat(start[some] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            idx, x, y = slot[at], value[at], grade[some]
            z = np.bincount(r, w[idx] * x, len(some))
            cuts = first + np.r_[0, np.cumsum(np.exp(gaps))]
            edge = np.r_[-np.inf, cuts, np.inf]
            hi, lo_ = s(edge[y + 1] - z), s(edge[y] - z)
            p = np.maximum(hi - lo_, 1e-9)
            dz = (hi * (1 - hi) - lo_ * (1 - lo_)) / p / len(some)  # of -log p
            dcut = np.zeros(grades + 1)
            np.add.at(dcut, y + 1, -(hi * (1 - hi)) / p / len(some))
            np.add.at(dcut, y, lo_ * (1 - lo_) / p / len(some))
            dcut = dcut[1:-1]
            dw = np.bincount(idx, dz[r] * x, SIZE) + 1e-5 * w
            gw += dw**2
            w -= 0.5 * dw / np.sqrt(gw)
            dpar = np.r_[dcut.sum(), [dcut[k:].sum() * np.exp(gaps[k - 1]) for k in range(1, grades - 1)]]
            gc += dpar**2
            step = 0.1 * dpar / np.sqrt(gc)
            first, gaps = first - step[0], np.clip(gaps - step[1:], -7, 4)
    return CumulativeLink(w, first + np.r_[0, np.cumsum(np.exp(gaps))])


def grade() -> Column:
    """Graded rating of a labelled document: 0 poor, 1 sound but toxic, 2 sound."""
    return F.when(F.col("quality") == 0, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) == 1, 1).when(F.col("quality") == 1, 2)


def train(docs: DataFrame, labels: DataFrame, rating: Column | None = None, grades: int = 3, bound: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> CumulativeLink:
    """Fit on at most ``bound`` graded documents with ``size`` bytes of text; ``rating`` is a column of labels, 0 ..
    grades - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, off in chunks(b.column(2)):
                row, slot, value = features(buf, off)
                ends = np.searchsorted(row, np.arange(hi - lo + 1)).tolist()
                cut = lambda x: pa.array([x[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:], strict=True)], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([*[b.column(k).slice(lo, hi - lo) for k in range(2)], cut(slot.astype(np.uint16)), cut(value.astype(np.float32))], ["doc_id", "grade", "slots", "shares"])

    table = sampled_table(docs, labels, (grade() if rating is None else rating).cast("int"), run, ["slots", "shares"], bound, size)
    order = np.argsort(table["doc_id"].to_numpy(), kind="stable")
    y = table["grade"].to_numpy().astype(np.int64)[order]
    # the numbers stay as narrow as they came; the fit widens those of a batch
    slot, sizes = joined_up(table, "slots", np.uint16, order)
    value, _ = joined_up(table, "shares", np.float32, order)
    del table
    return fit(np.repeat(np.arange(len(y), dtype=np.int32), sizes), slot, value, y, grades)


def score(docs: DataFrame, model: CumulativeLink, keep_at: float = KEEP_AT) -> DataFrame:
    """(doc_id, expected_grade, tails, keep) of every row: a narrow map, the model (SIZE weights) is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = sent.value.tails(b.column(1))
            tails = pa.FixedSizeListArray.from_arrays(pa.array(t.ravel()), t.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(t.sum(axis=1)), tails, pa.array(t[:, 0] >= keep_at)], ["doc_id", "expected_grade", "tails", "keep"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, expected_grade double, tails array<double>, keep boolean")


def keep(docs: DataFrame, model: CumulativeLink, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs, with all their columns, that reach grade 1 with a probability of ``keep_at`` at least."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def stays(text: pa.Array) -> np.ndarray:
        return sent.value.tails(text)[:, 0] >= keep_at

    return filtered(docs, stays)
