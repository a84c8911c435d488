"""Token counts by rank-synchronous merging of ragged arrays.

A batch's distinct pre-tokens are laid end to end as symbol ids. In each round every sequence finds its lowest-rank
adjacent pair and merges all its occurrences, left to right, at the same time as all other sequences; sequences without
a pair are done and leave. What remains is counted; a symbol outside the vocabulary counts its UTF-8 bytes.

The library merges one pair after another. Merging all occurrences at once gives the same result unless a merge makes a
pair of the same or a lower rank, which has to come before the rest; where that happens, the sequence merges only its
leftmost occurrence in that round. Vocabulary files are read from a path that is a parameter.

A pre-token of over ``LONG`` characters, as of a script without blanks or of encoded bytes, has as many rounds as it has
different ranks, so that a round must not go over all of it. Its places wait by rank; a round takes those of the lowest
rank from all long sequences and only looks at their neighbours again. What is done grows with the merges, not with
length times rounds.

Defined cases: a null or empty text has no bytes and no tokens; rows without doc_id, repeated rows and equal texts are
counted each; texts of any length are counted whole; an empty table gives no rows; other columns than doc_id and text are
not read, whatever their names.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_cache: dict[str, PieceVocabulary] = {}
NONE = np.int32(2**31 - 1)
#: Characters of a pre-token beyond which its places wait by rank; changes the cost only.
LONG = 512


class PieceVocabulary:
    """Merge table of a piece model that normalizes by identity and marks spaces."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        pieces = {lib.id_to_piece(i): lib.get_score(i) for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece crosses a word's start: texts can't be cut there")
        marks = sorted({c for p in pieces for c in p})
        self.symbol = {c: i for i, c in enumerate(marks)}
        for p in pieces:
            self.symbol.setdefault(p, len(self.symbol))
        self.size = len(self.symbol) + 1  # the last id stands for any other character
        self.char = np.full(0x110000, self.size - 1, np.int32)
        for c in marks:
            self.char[ord(c)] = self.symbol[c]
        scores = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        pairs = sorted(
            (self.symbol[p[:k]] * self.size + self.symbol[p[k:]], scores[s], self.symbol[p])
            for p, s in pieces.items()
            for k in range(1, len(p))
            if p[:k] in self.symbol and p[k:] in self.symbol
        )
        self.pair, self.rank, self.made = np.array([x[0] for x in pairs], np.int64), np.array([x[1] for x in pairs], np.int32), np.array([x[2] for x in pairs], np.int32)
        self.known = np.zeros(1 << 22, bool)  # pairs that can't be in the table are told at once
        self.known[self._slot(self.pair)] = True
        # what a symbol that is left counts: one token, or the bytes of a character without a piece
        self.bare = np.ones(self.size, bool)
        self.bare[[self.symbol[p] for p in pieces]] = False

    @staticmethod
    def _slot(pair: np.ndarray) -> np.ndarray:
        return (pair * np.int64(0x9E3779B97F4A7C15 - (1 << 64)) >> np.int64(42)) & np.int64((1 << 22) - 1)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; NONE where it doesn't merge."""
        key = a.astype(np.int64) * self.size + b
        rank, made = np.full(len(key), NONE), np.zeros(len(key), np.int32)
        maybe = np.flatnonzero(self.known[self._slot(key)])
        at = np.minimum(np.searchsorted(self.pair, key[maybe]), len(self.pair) - 1)
        hit = self.pair[at] == key[maybe]
        rank[maybe[hit]], made[maybe[hit]] = self.rank[at[hit]], self.made[at[hit]]
        return rank, made

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        total = np.zeros(len(words), np.int64)
        long = np.array([len(w) > LONG for w in words], bool)
        for some, count in ((~long, self._counts_in_rounds), (long, self._counts_by_rank)):
            if some.any():
                total[some] = count([words[i] for i in np.flatnonzero(some)])
        return total

    def _symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol, bytes and sequence of each character."""
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        width = (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)).astype(np.int8)
        return self.char[code], width, np.repeat(np.arange(len(words)), [len(w) for w in words])

    def _counts_by_rank(self, words: list[str]) -> np.ndarray:
        sym, width, seq = self._symbols(words)
        n = len(sym)
        rank, made = self._pair_ranks(sym, seq)
        # neighbours among the symbols that are left; n stands for none
        edge = seq[1:] != seq[:-1]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[np.r_[edge, True]], before[np.r_[True, edge]] = n, n
        sym, seq = np.r_[sym, np.int32(0)], np.r_[seq, -1]
        left = np.ones(n, bool)
        waiting: dict[int, array] = {}
        ranks: list[int] = []

        def wait(at: np.ndarray) -> None:
            at = at[rank[at] != NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            r = rank[at]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            for a, z, k in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], r[np.r_[0, cut]].tolist() if len(r) else [], strict=False):
                if k not in waiting:
                    waiting[k] = array("q")
                    heapq.heappush(ranks, k)
                waiting[k].frombytes(at[a:z].tobytes())

        def pair_ranks(a: np.ndarray, b: np.ndarray, missing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            found, makes = self.ranks(a, b)
            found[missing] = NONE
            return found, makes

        wait(np.arange(n))
        while ranks:
            low = heapq.heappop(ranks)
            every = np.unique(np.frombuffer(waiting.pop(low), np.int64))
            every = at = every[left[every] & (rank[every] == low)]
            if not len(at):
                continue
            # of overlapping occurrences every other one is taken, from the left
            run = np.r_[True, after[at[:-1]] != at[1:]]
            if not run.all():
                first = np.flatnonzero(run)[np.cumsum(run) - 1]
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            new, x, y = made[at], before[at], after[after[at]]
            beside = np.r_[False, y[:-1] == at[1:]]  # the symbol before is made in this round, too
            made_before = sym[x]
            made_before[beside] = new[np.flatnonzero(beside) - 1]
            found, makes = pair_ranks(np.r_[new, made_before], np.r_[sym[y], new], np.r_[y, x] == n)
            bad = np.flatnonzero((found[: len(at)] <= low) | (found[len(at) :] <= low))
            go = np.ones(len(at), bool)
            if len(bad) and len(at) > 1:
                # a sequence goes as far as the first merge that makes a pair which has to come before the rest
                which, one = np.unique(seq[at[bad]], return_index=True)
                k = np.minimum(np.searchsorted(which, seq[at]), len(which) - 1)
                go = (which[k] != seq[at]) | (np.arange(len(at)) <= bad[one][k])
            waits = not go.all()
            if waits:
                at, new, x, y, beside = at[go], new[go], x[go], y[go], beside[go]
                found, makes = found[np.r_[go, go]], makes[np.r_[go, go]]
            if beside.any():
                x = np.where(beside, np.r_[n, at[:-1]], x)  # the symbol before has gone into that one
            gone = after[at]
            left[gone], rank[gone] = False, NONE
            sym[at], after[at] = new, y
            before[y[y < n]] = at[y < n]
            rank[at], made[at] = found[: len(at)], makes[: len(at)]
            there = x < n
            rank[x[there]], made[x[there]] = found[len(at) :][there], makes[len(at) :][there]
            wait(np.r_[at, x[there]])
            if waits:
                wait(every[left[every] & (rank[every] == low)])
        return np.bincount(seq[:n][left], np.where(self.bare[sym[:n][left]], width[left], 1), len(words)).astype(np.int64)

    def _counts_in_rounds(self, words: list[str]) -> np.ndarray:
        total = np.zeros(len(words), np.int64)
        sym, width, seq = self._symbols(words)
        rank, made = self._pair_ranks(sym, seq)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.minimum.reduceat(rank, starts)
            length = np.diff(np.r_[starts, len(seq)])
            # sequences without a pair are counted and leave
            if (done := low == NONE).any():
                gone = np.repeat(done, length)
                total += np.bincount(seq[gone], np.where(self.bare[sym[gone]], width[gone], 1), len(words)).astype(np.int64)
                keep = ~gone
                sym, seq, rank, made, width = sym[keep], seq[keep], rank[keep], made[keep], width[keep]
                low, length = low[~done], length[~done]
                if not len(sym):
                    break
            best = np.repeat(low, length)
            want = rank == best
            # of overlapping occurrences every other one is taken, from the left
            at = np.flatnonzero(want)
            run = np.r_[True, (np.diff(at) > 1) | (seq[at[1:]] != seq[at[:-1]])]
            first = at[run][np.cumsum(run) - 1]
            at = at[(at - first) % 2 == 0]
            at = self._without_conflict(at, sym, seq, rank, made)
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            touched = np.zeros(len(sym), bool)
            touched[at] = True
            touched[np.maximum(at - 1, 0)] = True
            left = at - 1  # the symbol before may itself have just been merged away
            back = left[(left >= 1)]
            touched[back[~keep[back]] - 1] = True
            sym, seq, rank, made, width, touched = sym[keep], seq[keep], rank[keep], made[keep], width[keep], touched[keep]
            t = np.flatnonzero(touched)
            rank[t], made[t] = self._ranks_at(t, sym, seq)
        return total

    def _ranks_at(self, t: np.ndarray, sym: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = np.minimum(t + 1, len(sym) - 1)
        rank, made = self.ranks(sym[t], sym[u])
        rank[(t + 1 >= len(sym)) | (seq[u] != seq[t])] = NONE
        return rank, made

    def _pair_ranks(self, sym: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._ranks_at(np.arange(len(sym)), sym, seq)

    def _without_conflict(self, at: np.ndarray, sym: np.ndarray, seq: np.ndarray, rank: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Keep only the leftmost merge of a sequence in which a merge makes a pair that has to come first."""
        many = np.r_[False, seq[at[1:]] == seq[at[:-1]]]
        many |= np.r_[many[1:], False]
        if not many.any():
            return at
        x = at[many]
        last = len(sym) - 1
        new, r = made[x], rank[x]
        after = np.minimum(x + 2, last)
        right, _ = self.ranks(new, sym[after])
        right[(x + 2 > last) | (seq[after] != seq[x])] = NONE
        before = np.maximum(x - 1, 0)
        left_sym = sym[before].copy()
        prev = np.r_[np.int64(-9), x[:-1]]
        joined = prev == x - 2  # what stands before is the merge before
        left_sym[joined] = made[prev[joined]]
        left, _ = self.ranks(left_sym, new)
        left[(x == 0) | (seq[before] != seq[x])] = NONE
        bad = np.unique(seq[x[(right <= r) | (left <= r)]])
        if not len(bad):
            return at
        leftmost = np.r_[True, seq[at[1:]] != seq[at[:-1]]]
        return at[leftmost | ~np.isin(seq[at], bad)]


_WORD = re.compile(" *[^ ]+| +")
#: Characters of distinct pre-tokens that are merged at once.
AT_ONCE = 1 << 19


def count_batch(vocabulary: PieceVocabulary, texts: list[str], known: dict[str, int] | None = None, keep: int = 200_000) -> list[int]:
    """Tokens of each text. ``known`` remembers up to ``keep`` pre-tokens between batches."""
    known = {} if known is None else known
    # the model puts one space before a text and treats its own mark as a space
    split = [_WORD.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
    fresh = list(dict.fromkeys(w for ws in split for w in ws if w not in known))
    now = {}
    lo = 0
    while lo < len(fresh):
        hi, size = lo, 0
        while hi < len(fresh) and (hi == lo or size < AT_ONCE):
            size += len(fresh[hi])
            hi += 1
        part = fresh[lo:hi]
        now.update(zip(part, vocabulary.counts([w.replace(" ", SPACE) for w in part]).tolist(), strict=True))
        lo = hi
    out = [sum(known[w] if w in known else now[w] for w in ws) for ws in split]
    if len(known) < keep:
        known.update(x for x, _ in zip(now.items(), range(keep - len(known)), strict=False))
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 4096, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row: a narrow map without a shuffle. ``path`` is read on each
    executor, where the vocabulary files have to be installed. A null or empty text has 0 bytes and 0 tokens."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _cache:
            _cache[path] = PieceVocabulary(path)
        known: dict[str, int] = {}
        for b in batches:
            lo = 0
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = count_batch(_cache[path], texts, known)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    [key, "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, n_bytes long, n_tokens long, over_limit boolean")
