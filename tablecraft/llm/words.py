"""Words and shingles of whole Arrow batches as numpy arrays.

The bytes of all texts of a chunk are handled at once: separators are found by a table look-up, a word's 64-bit hash is
a difference of prefix sums of a polynomial over its bytes, and a shingle's hash combines those of its words. Nothing is
looped over by word. Hashes depend on the bytes only, so that every task and every rerun agrees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_P = 0x9E3779B97F4A7C55
_PINV = pow(_P, -1, 1 << 64)
_M1, _M2, _M3 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
#: Bytes of text that are handled at once; a longer single text is a chunk of its own.
CHUNK = 1 << 20

_code = np.arange(256)
#: White space: [\x20\x09-\x0D].
SPACE = (_code == 32) | ((_code >= 9) & (_code <= 13))
#: Whatever is neither an ASCII letter or digit nor part of a character beyond ASCII.
NOT_WORD = ~(((_code >= 48) & (_code <= 57)) | ((_code >= 65) & (_code <= 90)) | ((_code >= 97) & (_code <= 122)) | (_code >= 128))
#: A-Z to a-z, all other bytes as they are.
LOWER = np.where((_code >= 65) & (_code <= 90), _code + 32, _code).astype(np.uint8)
SAME = _code.astype(np.uint8)

_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + _M3
        x = (x ^ (x >> U(30))) * _M1
        x = (x ^ (x >> U(27))) * _M2
        return x ^ (x >> U(31))


def _powers(name: str, base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64; grown when a longer chunk comes."""
    if len(_tables.get(name, ())) < n:
        steps = np.full(max(n, CHUNK + 1), base, U)
        steps[0] = 1
        with np.errstate(over="ignore"):
            _tables[name] = np.cumprod(steps, dtype=U)
    return _tables[name]


def chunks(text: pa.Array | pa.ChunkedArray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in the bytes) for runs of rows of about ``size`` bytes.
    A null text counts as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text.cast(pa.large_string()), "")
    n = len(text)
    if not n:
        return
    _, offsets, data = text.buffers()
    off = np.frombuffer(offsets, np.int64)[text.offset : text.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + size, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def spans(buf: np.ndarray, off: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each row's words start among them."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~separator[buf]
    full = off[:-1] < off[1:]
    first, last = off[:-1][full], off[1:][full] - 1
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    start[first], end[last] = inside[first], inside[last]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, off)


class Hasher:
    """Hashes of any byte ranges of one chunk."""

    def __init__(self, buf: np.ndarray, fold: np.ndarray = LOWER):
        n = len(buf)
        self.inv = _powers("inverse", _PINV, n + 1)
        self.sums = np.zeros(n + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum((fold[buf].astype(U) + U(1)) * _powers("power", _P, n + 1)[:n], out=self.sums[1:])

    def of(self, s: np.ndarray, e: np.ndarray, salt: int = 0) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(((self.sums[e] - self.sums[s]) * self.inv[s]) ^ mix((e - s).astype(U) + U(salt << 32)))


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words [^\\x20\\x09-\\x0D]+ and where each row's start."""
    s, e, bounds = spans(buf, off)
    return Hasher(buf).of(s, e), bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words, repeats included, and where each row's start; a row of fewer words has one
    shingle, the whole sequence, and a row without words none."""
    count = np.diff(bounds)
    n = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    out_off = np.concatenate(([0], np.cumsum(n)))
    out = np.empty(out_off[-1], U)
    with np.errstate(over="ignore"):
        if len(words) >= k:
            acc = np.zeros(len(words) - k + 1, U)
            for j in range(k):
                acc = acc * U(_P) + words[j : len(words) - k + 1 + j]
            long = count >= k
            keep = np.ones(len(words), bool)  # not the last k - 1 words of a row, and no short rows
            keep[np.repeat(~long, count)] = False
            ends = bounds[1:][long]
            for j in range(1, k):
                keep[ends - j] = False
            out[np.repeat(long, n)] = mix(acc[np.flatnonzero(keep)])
        for d in np.flatnonzero((count > 0) & (count < k)):
            h = U(int(count[d]))
            for w in words[bounds[d] : bounds[d + 1]]:
                h = h * U(_P) + w
            out[out_off[d]] = mix(np.array([h ^ U(0x5BD1E995)], U))[0]
    return out, out_off


def shingle_sets(text, k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row of an Arrow array of texts."""
    for _, _, buf, off in chunks(text):
        h, bounds = shingle_hashes(*word_hashes(buf, off), k)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield np.unique(h[a:b])
