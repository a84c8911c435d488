"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct lower-cased words of a text and their beginnings of 4, 5 and 6 bytes, each as a 64-bit hash. On
a bounded sample of labelled rows (``samples.py``), terms are kept whose share differs between the classes beyond chance,
alone or in company: of the ``PAIRED`` most frequent terms, every two are kept whose meeting in a text does. The rest
can't add noise to long texts. The machine adds to the weights of the kept terms an inner product for every two of them
that meet in a text (Rendle 2010), so that a pair can count when neither of its terms does.

Scores read the text only; labels serve the fit, ids choose the fold.

Defined cases: an empty or null text has the score of the bias, and so has any text where labels have one class only or
none; rows without doc_id aren't held out; repeated rows and equal texts have equal scores; an empty table gives no rows;
other columns of documents are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .samples import SAMPLE_BYTES, SAMPLE_ROWS, sampled_features
from .words import NOT_WORD, Hasher, U, chunks, spans

#: Terms of the model at most, and its rank.
TERMS, RANK = 30_000, 4
#: A term is kept with so many rows and so many standard deviations; frequent terms that are tried in pairs, and theirs.
LEAST_ROWS, APART, PAIRED, PAIR_APART = 4, 3.5, 1024, 6.0
THRESHOLD = 0.3
_PREFIXES = (4, 5, 6)


def terms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word and every beginning of a longer one."""
    s, e, bounds = spans(buf, off, NOT_WORD)
    row = np.repeat(np.arange(len(off) - 1), np.diff(bounds))
    h = Hasher(buf)
    rows, out = [row], [h.of(s, e)]
    for k in _PREFIXES:
        long = e - s > k
        rows.append(row[long])
        out.append(h.of(s[long], s[long] + k, salt=k))
    return np.concatenate(rows), np.concatenate(out)


class FactorizationMachine:
    """Bias, weights and factors of the kept terms; terms are sorted by hash."""

    def __init__(self, keys: np.ndarray, bias: float, weight: np.ndarray, factor: np.ndarray):
        self.keys, self.bias, self.weight, self.factor = keys, bias, weight, factor
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(keys & U((1 << 20) - 1)).astype(np.int64)] = True

    def __reduce__(self):
        return FactorizationMachine, (self.keys, self.bias, self.weight, self.factor)

    def find(self, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, term number) of the kept terms, by row."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = self.maybe[(h & U((1 << 20) - 1)).astype(np.int64)]
        row, h = row[near], h[near]
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = self.keys[at] == h
        both = np.unique(row[hit].astype(np.int64) * len(self.keys) + at[hit])
        return both // len(self.keys), both % len(self.keys)

    def logits(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, self.bias)
        if len(row):
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            v = self.factor[term]
            pairs = 0.5 * (np.add.reduceat(v, starts) ** 2 - np.add.reduceat(v * v, starts)).sum(axis=1)
            out[row[starts]] += np.add.reduceat(self.weight[term], starts) + pairs
        return out

    def scores(self, text: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for lo, hi, buf, off in chunks(text):
            out.append(1 / (1 + np.exp(-np.clip(self.logits(*self.find(*terms(buf, off)), hi - lo), -30, 30))))
        return np.concatenate(out)


def _apart(have: np.ndarray, have_pos: np.ndarray, n: int, pos: int) -> np.ndarray:
    """How far the positive rows among ``have`` of n rows are from their share, in standard deviations."""
    share = have / n
    return (have_pos - pos * share) / np.sqrt(pos * share * (1 - pos / n) + 1e-9)


def _in_parts(f: Callable[[np.ndarray], np.ndarray], x: np.ndarray, size: int = 1 << 19) -> np.ndarray:
    """f(x) as 32-bit numbers, without temporary arrays of all of x."""
    return np.concatenate([np.zeros(0, np.int32), *[f(x[a : a + size]).astype(np.int32) for a in range(0, len(x), size)]])


def _paired(start: np.ndarray, at: np.ndarray, y: np.ndarray, tried: np.ndarray, n_keys: int) -> np.ndarray:
    """Which of the terms ``tried`` meet another one in rows of which more or fewer are positive than both alone tell.
    Row k has the terms ``at[start[k] : start[k + 1]]``."""
    place = np.full(n_keys, -1)
    place[tried] = np.arange(len(tried))
    both, both_pos = np.zeros((len(tried), len(tried)), np.float32), np.zeros((len(tried), len(tried)), np.float32)
    for lo in range(0, len(y), 512):
        hi = min(lo + 512, len(y))
        p = place[at[start[lo] : start[hi]]]
        x = np.zeros((hi - lo, len(tried)), np.float32)
        x[np.repeat(np.arange(hi - lo), np.diff(start[lo : hi + 1]))[p >= 0], p[p >= 0]] = 1
        both += x.T @ x
        x = x[y[lo:hi] == 1]
        both_pos += x.T @ x
    n, pos = len(y), int(y.sum())
    have, have_pos = np.diag(both), np.diag(both_pos)
    rate = have_pos / np.maximum(have, 1) / (pos / n)
    wanted = both * np.clip(pos / n * np.outer(rate, rate), 0, 1)  # positive rows if the terms count one by one
    z = np.abs(both_pos - wanted) / np.sqrt(wanted * (1 - np.minimum(wanted / np.maximum(both, 1), 0.99)) + 0.5)
    z[both < LEAST_ROWS] = 0
    np.fill_diagonal(z, 0)
    return (z >= PAIR_APART).any(axis=1)


def fit(row: np.ndarray, h: np.ndarray, y: np.ndarray, n_terms: int = TERMS, rank: int = RANK, epochs: int = 12, seed: int = 5) -> FactorizationMachine:
    """Fit on distinct (row, term hash) of rows with labels y by AdaGrad in small batches; row is sorted."""
    n, pos = len(y), int(y.sum())
    if not n or pos in (0, n):  # one class only: its share, smoothed
        p = (pos + 0.5) / (n + 1) if n else 0.05
        return FactorizationMachine(np.zeros(0, U), float(np.log(p / (1 - p))), np.zeros(0), np.zeros((0, rank)))
    # the driver's memory is what bounds the sample: 32-bit numbers, and no copies that outlive their use
    ordered = np.sort(h)
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(h)])
    keys, have = ordered[first], np.diff(np.r_[first, len(h)])
    del ordered, first
    at = _in_parts(lambda x: np.searchsorted(keys, x), h)
    start = np.searchsorted(row, np.arange(n + 1, dtype=row.dtype))
    have_pos = np.bincount(at[np.repeat(y == 1, np.diff(start))], minlength=len(keys))
    z = _apart(have, have_pos, n, pos)
    good = (have >= LEAST_ROWS) & (np.abs(z) >= APART)
    tried = np.sort(np.argsort(-np.where(have <= 0.9 * n, have, 0), kind="stable")[:PAIRED])
    tried = tried[have[tried] >= LEAST_ROWS]
    good[tried[_paired(start, at, y, tried, len(keys))]] = True
    good = np.flatnonzero(good)
    if len(good) > n_terms:
        good = np.sort(good[np.argsort(-np.abs(z[good]), kind="stable")[:n_terms]])
    new = np.full(len(keys), -1)
    new[good] = np.arange(len(good))
    t = _in_parts(lambda x: new[x], at)
    row, t = row[t >= 0], t[t >= 0]
    rng = np.random.default_rng(seed)
    p0 = pos / n
    bias, w, v = float(np.log(p0 / (1 - p0))), np.zeros(len(good)), rng.normal(0, 0.02, (len(good), rank))
    gw, gv, gb = np.full(len(good), 1e-6), np.full((len(good), rank), 1e-6), 1e-6
    start = np.searchsorted(row, np.arange(n + 1, dtype=row.dtype))
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, 256):
            some = order[lo : lo + 256]
            size = start[some + 1] - start[some]
            r = np.repeat(np.arange(len(some)), size)
            idx = t[np.repeat(start[some] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())]
            vs = np.zeros((len(some), rank))
            np.add.at(vs, r, v[idx])
            sq = np.zeros((len(some), rank))
            np.add.at(sq, r, v[idx] ** 2)
            z_ = bias + np.bincount(r, w[idx], len(some)) + 0.5 * (vs**2 - sq).sum(axis=1)
            g = 1 / (1 + np.exp(-np.clip(z_, -30, 30))) - y[some]
            used, inv = np.unique(idx, return_inverse=True)
            dw = np.bincount(inv, g[r], len(used)) / 16 + 2e-3 * w[used]
            dv = np.zeros((len(used), rank))
            np.add.at(dv, inv, g[r, None] * (vs[r] - v[idx]))
            dv = dv / 16 + 1e-2 * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            w[used] -= 0.3 * dw / np.sqrt(gw[used])
            v[used] -= 0.03 * dv / np.sqrt(gv[used])
            db = g.mean()
            gb += db**2
            bias -= 0.1 * db / np.sqrt(gb)
    return FactorizationMachine(keys[good], float(bias), w, v)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES, n_terms: int = TERMS, rank: int = RANK) -> FactorizationMachine:
    """Fit on at most ``bound`` labelled documents with ``size`` bytes of text outside the held-out fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, off in chunks(b.column(2)):
                row, h = terms(buf, off)
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                first = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])] if len(row) else np.zeros(0, bool)
                row, h = row[first], h[first]
                ends = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([*[b.column(k).slice(lo, hi - lo) for k in range(2)], pa.array([h[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["doc_id", "grade", "terms"])

    rows = sampled_features(docs, labels.where(~held_out()), F.col("toxic").cast("int"), run, ["terms"], bound, size)
    raw = rows.pop("terms")
    row = np.repeat(np.arange(len(raw), dtype=np.int32), raw.map(len).to_numpy(np.int64) // 8)
    h = np.concatenate([np.zeros(0, U), *[np.frombuffer(x, U) for x in raw]])
    del raw
    return fit(row, h, rows["grade"].to_numpy(np.int64), n_terms, rank)


def score(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score, predicted) of every row: a narrow map. The model is broadcast; ``n_terms`` and ``rank`` bound it."""
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = sent.value.scores(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [key, "score", "predicted"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, score double, predicted int")
