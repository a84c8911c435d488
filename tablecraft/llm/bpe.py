"""Byte-level BPE by corpus-level merge replay, and the way back.

The distinct pre-tokens of a slice of the corpus are laid end to end as one sequence of symbols. An inverted index leads
from each pair of adjacent symbols that can merge to the positions where it stands. Merges are taken from the index in
the order of their ranks, each at all of its positions in all words at once, and only the two neighbours of a merged
position are looked up and filed again. Work is linear in merges, whatever the length of a word: a megabyte of letters
without a blank is one word like any other.

A word has to take its lowest pair first, the leftmost one of equal pairs. Words don't touch, so merging in the order of
ranks over all of them is the same, unless a merge makes a pair of a lower rank: then the word's other positions wait
until that one has been taken.

``encode`` gives the ids of each whole text, ``decode`` their bytes, ``round_trips`` checksums of both. All are narrow maps
without a shuffle; a task that is lost is run again. Words that a process has met are remembered, twice ``KEEP`` at most.

Defined cases: a null or empty text has no tokens and decodes to no bytes; rows without doc_id, repeated rows and equal
texts are encoded each; texts and words of any length are encoded whole; an empty table gives no rows; other columns than
doc_id and text are not read, whatever their names; strings of special tokens are plain text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

#: Bytes of text whose words are looked up at once, symbols of new words that are replayed at once, words that are
#: remembered in each of two generations, and positions of a rank below which arrays don't pay. They bound memory and
#: time and change nothing else.
SLICE, AT_ONCE, KEEP, FEW = 8 << 20, 1 << 20, 300_000, 60
NONE = 1 << 30


class ByteVocabulary:
    """Bytes of each id and the rank of each pair that merges.

    ``whole``: a word that is a token itself is taken as that token, without merging, as rank files have it.
    """

    def __init__(self, tokens: dict[int, bytes], pairs: dict[tuple[int, int], tuple[int, int]], whole: bool):
        self.size = max(tokens) + 2  # the last symbol stands between words
        self.tokens = [tokens.get(i, b"") for i in range(self.size)]
        self.ids = {t: i for i, t in tokens.items()}
        self.whole = whole
        self.rank = {a * self.size + b: r for (a, b), (r, _) in pairs.items()}
        self.made = dict(pairs.values())
        self.byte = np.array([self.ids[bytes([i])] for i in range(256)] + [self.size - 1])
        self.first = np.full((257, 257), NONE)
        for x in range(256):
            for y in range(256):
                self.first[x, y] = self.rank.get(int(self.byte[x]) * self.size + int(self.byte[y]), NONE)
        # a table of slots for arrays of pairs: none (the last entry), one pair, or several (the last but one)
        n = len(self.rank)
        self.keys = np.array([*self.rank, -1, self.size * self.size])
        self.key_ranks = np.array([*self.rank.values(), NONE, NONE])
        slot = self._slot(self.keys[:n])
        self.slots = np.full(1 << 20, n + 1)
        self.slots[slot] = np.arange(n)
        self.slots[np.bincount(slot, minlength=1 << 20) > 1] = n

    @classmethod
    def of_ranks(cls, path: str) -> ByteVocabulary:
        """A file of lines (token in base64, rank): any two tokens merge whose joined bytes are a token."""
        with open(path, "rb") as f:
            tokens = {int(r): base64.b64decode(t) for t, r in map(bytes.split, f)}
        ids = {t: i for i, t in tokens.items()}
        pairs = {(ids[t[:k]], ids[t[k:]]): (i, i) for t, i in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids}
        return cls(tokens, pairs, True)

    @classmethod
    def of_merges(cls, path: str) -> ByteVocabulary:
        """A JSON file with a vocabulary in printable characters and a list of merges: only those pairs merge."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        added = {x["id"] for x in model.get("added_tokens", ())}
        byte = printable()
        vocab = {t: i for t, i in model["model"]["vocab"].items() if i not in added}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        pairs = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(merges)}
        return cls({i: bytes(byte[c] for c in t) for t, i in vocab.items()}, pairs, bool(model["model"].get("ignore_merges")))

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = self.slots[self._slot(key)]
        out = np.where(self.keys[at] == key, self.key_ranks[at], NONE)
        if (shared := np.flatnonzero(self.keys[at] < 0)).size:
            out[shared] = [self.rank.get(x, NONE) for x in key[shared].tolist()]
        return out

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key * np.int64(0x9E3779B97F4A7C15 - (1 << 64)) >> np.int64(44)) & np.int64((1 << 20) - 1)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as packed unsigned 32-bit little-endian integers."""
        end = self.size - 1
        raw = np.full(sum(map(len, words)) + len(words) + 1, 256)
        ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64)
        letters = np.ones(len(raw), bool)
        letters[0], letters[ends] = False, False
        raw[letters] = np.frombuffer(b"".join(words), np.uint8)
        rank = np.r_[self.first[raw[:-1], raw[1:]], NONE]
        at = np.flatnonzero(rank != NONE)
        at = at[np.argsort(rank[at], kind="stable")]
        index = {r: [p] for r, p in _by_rank(at, rank)}
        state = _Replay(self.byte[raw], rank, np.arange(1, len(raw) + 1), np.arange(-1, len(raw) - 1), ends, index, list(index))
        self._replay_large(state)
        self._replay_small(state)
        left = np.array(state.sym, np.int64)
        left = left[left >= 0][1:]
        packed, out, a = left.astype("<u4").tobytes(), [], 0
        for z in np.flatnonzero(left == end).tolist():
            out.append(packed[4 * a : 4 * z])
            a = z + 1
        return out

    def _replay_large(self, s: _Replay) -> None:
        """Merges in the order of ranks, all positions of a rank as one array, until ranks have few positions each."""
        sym, rank, after, before, index, heap = s.sym, s.rank, s.after, s.before, s.index, s.heap
        usual = float(2 * FEW)
        while heap and usual >= FEW:
            r = heapq.heappop(heap)
            at = np.sort(np.concatenate(index.pop(r)))
            usual += (len(at) - usual) / 16
            at = at[rank[at] == r]  # elsewhere a neighbour has changed since
            if not len(at):
                continue
            new, every = self.made[r], at
            gone = after[at]
            if len(at) > 1 and (follows := gone[:-1] == at[1:]).any():
                # of a run of occurrences that overlap every other one is taken, from the left
                first, run = np.concatenate(([True], ~follows)), np.arange(len(at))
                at = at[(run - run[first][np.cumsum(first) - 1]) % 2 == 0]
                gone = after[at]
            h, k = before[at], after[gone]
            joined = np.concatenate(([False], k[:-1] == at[1:]))  # what stands before has just been merged too
            alike = np.full(len(at), new)
            right, left = self._ranks(alike, sym[k]), self._ranks(np.where(joined, new, sym[h]), alike)
            if (lower := np.minimum(left, right) < r).any():
                # in the words of these only the first one is merged, and all others wait
                word, each = (np.searchsorted(s.ends, x, side="right") for x in (at, every))
                index[r] = [every[np.isin(each, word[lower])]]
                heapq.heappush(heap, r)
                go = ~np.isin(word, word[lower]) | np.concatenate(([True], word[1:] != word[:-1]))
                at, gone, k = at[go], gone[go], k[go]
                joined = np.ones(len(at), bool)
            sym[at], sym[gone], rank[gone] = new, -1, NONE
            after[at], before[k] = k, at
            h = before[at]
            if joined.any():  # neighbours are not what they were
                right, left = self._ranks(sym[at], sym[after[at]]), self._ranks(sym[h], sym[at])
            rank[at], rank[h] = right, left
            alone = np.concatenate(([True], h[1:] != at[:-1]))
            touched, q = np.concatenate((at, h[alone])), np.concatenate((right, left[alone]))
            touched = touched[q != NONE]
            for q, places in _by_rank(touched[np.argsort(rank[touched], kind="stable")], rank):
                if q in index:
                    index[q].append(places)
                else:
                    index[q] = [places]
                    heapq.heappush(heap, q)

    def _replay_small(self, s: _Replay) -> None:
        """The same for the ranks that are left, position by position."""
        s.sym, rank, after, before, stops = s.sym.tolist(), s.rank.tolist(), s.after.tolist(), s.before.tolist(), s.ends.tolist()
        index, heap, sym = {r: np.concatenate(p).tolist() for r, p in s.index.items()}, s.heap, s.sym
        known, size, made = self.rank.get, self.size, self.made
        while heap:
            r = heapq.heappop(heap)
            new, waiting, wait = made[r], [], 0
            for i in sorted(index.pop(r)):
                if rank[i] != r:
                    continue
                if i < wait:
                    waiting.append(i)
                    continue
                gone, h = after[i], before[i]
                k = after[gone]
                sym[i], after[i], before[k] = new, k, i
                sym[gone] = -1
                rank[gone] = NONE
                right, left = known(new * size + sym[k], NONE), known(sym[h] * size + new, NONE)
                rank[i], rank[h] = right, left
                for p, q in ((i, right), (h, left)):
                    if q == NONE:
                        continue
                    if q in index:
                        index[q].append(p)
                    else:
                        index[q] = [p]
                        heapq.heappush(heap, q)
                    if q < r:
                        wait = stops[bisect_right(stops, i)]
            if waiting:
                index[r] = waiting
                heapq.heappush(heap, r)


@dataclass
class _Replay:
    """Symbols of all words with one between each, ranks of the pairs that begin at each, the symbols after and before
    each that are left, where words end, and the index from ranks to positions with a heap of its ranks."""

    sym: np.ndarray | list
    rank: np.ndarray
    after: np.ndarray
    before: np.ndarray
    ends: np.ndarray
    index: dict[int, list[np.ndarray]]
    heap: list[int]


def _by_rank(at: np.ndarray, rank: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(rank, its positions), of positions in the order of their ranks."""
    r = rank[at]
    cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
    for a, z in zip([0, *cuts.tolist()] if len(at) else [], [*cuts.tolist(), len(at)], strict=False):
        yield int(r[a]), at[a:z]


@cache
def printable() -> dict[str, int]:
    """The byte that each character of a printable vocabulary stands for: bytes that print stand for themselves, the
    others for the characters from 256 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@cache
def _differing() -> tuple[frozenset, dict, bytes]:
    """Characters that the regex module and the tokenizers' library put in different classes, since they know different
    editions of Unicode, for each a character that both put where the library has it, and the bytes of UTF-8 that none
    of them begins with or that are below those."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([i]): i for i in range(256)}
    stand: dict[str, str] = {}
    for kind, inside in ((r"\p{L}", "a"), (r"\p{N}", "0"), (r"\s", " ")):
        library = tiktoken.Encoding(kind, pat_str=kind, mergeable_ranks=single, special_tokens={})
        theirs, ours = set(library.decode(library.encode_ordinary(every))), set(regex.findall(kind, every))
        stand.update({c: inside for c in theirs - ours})
        for c in ours - theirs:
            stand.setdefault(c, "�")
    return frozenset(stand), {ord(c): s for c, s in stand.items()}, bytes(range(min((c.encode()[0] for c in stand), default=256)))


@cache
def _compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def pretokens(pattern: str, text: str) -> list[str]:
    """The matches of the pattern, whose classes are those of the tokenizers' library."""
    differ, stand, lower = _differing()
    if text.isascii() or not text.encode().translate(None, lower) or differ.isdisjoint(text):
        return _compiled(pattern).findall(text)
    return [text[m.start() : m.end()] for m in _compiled(pattern).finditer(text.translate(stand))]


class Encoder:
    """Words to packed ids, batch after batch. ``encode_new`` gives the packed ids of a list of new words. Words are
    remembered in two generations: when the younger one is full it becomes the older one, so that words that come again
    and again stay."""

    def __init__(self, split: Callable[[str], list[str]], encode_new: Callable[[list[str]], list[bytes]], keep: int = KEEP):
        self.split, self.encode_new, self.keep = split, encode_new, keep
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def texts(self, texts: list[str]) -> tuple[bytes, np.ndarray]:
        """Packed ids of all texts, one after another, and how many each has."""
        words = [self.split(t) if t else [] for t in texts]
        if len(self.young) > self.keep:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        now: dict[str, bytes] = {}
        missing = set().union(*words).difference(young)
        now.update((w, old[w]) for w in missing if w in old)
        fresh = [w for w in missing if w not in old]
        lo = 0
        while lo < len(fresh):
            hi, size = lo, 0
            while hi < len(fresh) and (hi == lo or size < AT_ONCE):
                size += len(fresh[hi])
                hi += 1
            now.update(zip(fresh[lo:hi], self.encode_new(fresh[lo:hi]), strict=True))
            lo = hi
        young.update(now)
        parts = [b"".join(map(young.__getitem__, ws)) for ws in words]
        # a word of a megabyte is not worth remembering
        for w in [w for w in now if len(w) > 64]:
            del young[w]
        return b"".join(parts), np.array([len(p) // 4 for p in parts], np.int64)


def bpe_encoder(vocabulary: ByteVocabulary, pattern: str, keep: int = KEEP) -> Encoder:
    def encode_new(words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        found = [vocabulary.ids.get(w) if vocabulary.whole else None for w in raw]
        merged = iter(vocabulary.replay([w for w, i in zip(raw, found, strict=True) if i is None]))
        return [next(merged) if i is None else i.to_bytes(4, "little") for i in found]

    return Encoder(lambda text: pretokens(pattern, text), encode_new, keep)


def slices(batch: pa.RecordBatch, column: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``size`` bytes in a column of texts or of lists of ids; a larger row is a run of its own."""
    values = batch.column(column)
    lengths = pc.multiply(pc.list_value_length(values), 4) if pa.types.is_list(values.type) else pc.binary_length(values)
    ends = np.cumsum(pc.fill_null(lengths.cast(pa.int64()), 0).to_numpy(zero_copy_only=False))
    lo = start = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, start + size, side="right")))
        yield batch.slice(lo, hi - lo)
        lo, start = hi, int(ends[hi - 1])


def list_of(packed: bytes, count: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), pa.array(np.frombuffer(packed, "<i4"), pa.int32()))


@cache
def vocabulary_at(path: str) -> ByteVocabulary:
    """The vocabulary of a file, read once in each process."""
    return ByteVocabulary.of_merges(path) if path.endswith(".json") else ByteVocabulary.of_ranks(path)


@cache
def encoder_at(path: str, pattern: str) -> Encoder:
    """An encoder for each process, so that the words of earlier tasks are still known."""
    return bpe_encoder(vocabulary_at(path), pattern)


Batches = Iterator[pa.RecordBatch]


def encoded_batches(batches: Batches, path: str, pattern: str) -> Batches:
    """(doc_id, ids) of (doc_id, text)."""
    encoder = encoder_at(path, pattern)
    for b in batches:
        for part in slices(b, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), list_of(*encoder.texts(part.column(1).to_pylist()))], ["doc_id", "ids"])


def decoded_batches(batches: Batches, path: str) -> Batches:
    """(doc_id, ids, bytes) of (doc_id, ids)."""
    tokens = pa.array(vocabulary_at(path).tokens, pa.binary())
    for b in batches:
        for part in slices(b, 1):
            ids = part.column(1)
            each = pa.ListArray.from_arrays(pc.subtract(ids.offsets, ids.offsets[0]), tokens.take(ids.flatten()))
            yield pa.RecordBatch.from_arrays([part.column(0), ids, pc.binary_join(each, b"")], ["doc_id", "ids", "bytes"])


def digested_batches(batches: Batches) -> Batches:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of (doc_id, ids, bytes); ids are hashed as little-endian unsigned
    32-bit integers."""
    for b in batches:
        ids, texts = b.column(1), b.column(2)
        flat, at = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
        of_ids = [hashlib.sha256(flat[x:y]).hexdigest() for x, y in zip(at[:-1], at[1:], strict=True)]
        of_bytes = [hashlib.sha256(t.as_buffer()).hexdigest() for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at).astype(np.int64)), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every row. ``path`` is read on each executor, where the vocabulary files have to be installed."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda b: encoded_batches(b, path, pattern), f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, bytes) of every row of (doc_id, ids)."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(lambda b: decoded_batches(b, path), f"doc_id {kind}, ids array<int>, bytes binary")


def round_trips(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): checksums of each text's ids and of what they decode to, made in
    one pass."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = lambda b: digested_batches(decoded_batches(encoded_batches(b, path, pattern), path))
    return docs.select("doc_id", "text").mapInArrow(made, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
