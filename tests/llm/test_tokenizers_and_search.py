"""Byte-level BPE, ranked search and tokenizer alignment against the libraries and brute force."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from common import DATA, ROWS, messy
from pyspark.sql import functions as F

from tablecraft.llm import align, bpe, search
from tablecraft.llm import queries as q
from tablecraft.llm.shared import read

RANKS, MERGES, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
PATTERN = public_tokenizers.PATTERN
LETTERS = "abcdefghijklmnop  \n\t'0123456789.,!éüß你好世界😀\x85\x1c ſ́՘₏\U000187f8\U0001246f"


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(rng, letters, n, longest):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(longest))) for _ in range(n)]


def ids_of(encoder, texts):
    packed, n = encoder.texts(texts)
    at = np.r_[0, np.cumsum(n)]
    return [np.frombuffer(packed, "<u4")[a:z].tolist() for a, z in zip(at[:-1], at[1:], strict=True)]


@pytest.mark.parametrize("letters", [LETTERS, "ab", "abc", "aeiou", "the ", "é你", "xyz.", "՘a1"])
def test_bpe_equals_the_library(library, letters):
    rng = random.Random(letters)
    encoder = bpe.bpe_encoder(bpe.vocabulary_at(RANKS), PATTERN, keep=500)
    for _ in range(8):
        texts = random_texts(rng, letters, 200, 120)
        assert ids_of(encoder, texts) == [library.encode_ordinary(t) for t in texts]


def test_bpe_of_a_letter_of_each_kind_and_long_words(library):
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    rng = random.Random(5)
    texts = [every, "a" * 5000, "ab" * 3000, " " * 777 + "x", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)), "it's we'll <|endoftext|>", ""]
    assert ids_of(bpe.bpe_encoder(bpe.vocabulary_at(RANKS), PATTERN), texts) == [library.encode_ordinary(t) for t in texts]


def test_merges_wait_for_lower_ranks():
    """Tokens whose ranks are out of the order of their making: a merge makes a pair that has to come before the rest."""
    import tiktoken

    rng = random.Random(9)
    for _ in range(150):
        found = {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))).encode() for _ in range(12)}
        tokens = {bytes([i]): i for i in range(256)} | {t: 256 + i for i, t in enumerate(rng.sample(sorted(found), len(found)))}
        pairs = {(tokens[t[:k]], tokens[t[k:]]): (i, i) for t, i in tokens.items() for k in range(1, len(t)) if t[:k] in tokens and t[k:] in tokens}
        vocabulary = bpe.ByteVocabulary({i: t for t, i in tokens.items()}, pairs, True)
        words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
        library = tiktoken.Encoding("x", pat_str=r"[a-z]+", mergeable_ranks=tokens, special_tokens={})
        assert ids_of(bpe.bpe_encoder(vocabulary, "[a-z]+"), words) == [library.encode_ordinary(w) for w in words]


def test_bpe_query_and_messy_rows(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in read(spark, DATA, "documents").collect()}
    got = {r["doc_id"]: r for r in q.op11_bpe(spark, DATA).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = library.encode_ordinary(t)
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    docs = messy(spark)
    rows = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS).collect()
    want = Counter((i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t, _, _ in ROWS)
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["bytes"])) for r in rows) == want
    assert bpe.decode(bpe.encode(docs.limit(0), RANKS, PATTERN), RANKS).count() == bpe.round_trips(docs.limit(0), RANKS, PATTERN).count() == 0


# --- search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def ranked(docs, items, k=10):
    """[(item_id, rank, doc_id, score)] by scoring every document for every item."""
    held = [(i, terms(t)) for i, t in docs if terms(t)]
    n, length = len(held), sum(len(t) for _, t in held)
    df = Counter(w for _, t in held for w in set(t))
    out = []
    for item, text in items:
        scores = []
        for i, t in held:
            m, tf = 100 - 90 + 90 * len(t) * n // length, Counter(t)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1000000000 * tf[w] // (1000 * tf[w] + 8 * m)) for w in set(terms(text)) if w in tf)
            scores += [(-s, i is None, i or 0, len(t), i)] if s > 0 else []
        out += [(item, r, x[4], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_search_query(spark):
    docs, items = ([(r[0], r[1]) for r in read(spark, DATA, t).collect()] for t in ("documents", "benchmark"))
    assert found(q.op12_search(spark, DATA)) == ranked(docs, items)


@pytest.mark.parametrize(("segment", "k", "block"), [(7, 3, 1 << 20), (50, 10, 60), (8192, 1, 200)])
def test_search_in_segments_and_blocks(spark, monkeypatch, segment, k, block):
    """Frequent and rare words, ties, repeated rows, and few accumulators."""
    monkeypatch.setattr(search, "SEGMENT", segment)
    rng = random.Random(segment)
    words = [f"w{int(40 * rng.random() ** 3)}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(400)]
    docs += [(400 + i, docs[i][1]) for i in range(40)] + [(7, docs[7][1])] * 3 + [(None, docs[3][1])] * 2 + [(999, "W1, w1; W1"), (1000, None), (1001, " .. ")]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(20)] + [(3, "w1 w2"), (3, "w1 w2"), (None, "w5"), (77, None), (78, "unheard of"), (79, "")]
    table = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    got = search.search(table(docs, "doc_id").repartition(3), table(items, "item_id"), k, block)
    assert found(got) == ranked(docs, items, k)


def test_search_stops_creating_accumulators():
    """A term that all rows have touches only the rows that have an accumulator once the rare term has decided."""
    rows = 1000
    terms_, offsets = np.array([0, 1] * 20 + [1] * (rows - 20)), np.r_[np.arange(0, 41, 2), np.arange(41, rows + 21)]
    query = search.Query([np.array([0, 1])], np.array([5000, 1]), rows, rows * 10)
    (item, at, score), = search.best_of_segment(query, np.full(rows, 10), terms_, np.ones(len(terms_), np.int64), offsets, np.arange(rows), np.zeros(1, np.int64))
    m = 10 + 90
    one = 1000000000 // (1000 + 8 * m)
    assert item == 0 and at.tolist() == list(range(10)) and set(score.tolist()) == {5001 * one}
    assert not list(search.best_of_segment(query, np.full(rows, 10), terms_, np.ones(len(terms_), np.int64), offsets, np.arange(rows), np.array([5001 * one + 1])))


def test_search_messy_rows(spark):
    items = spark.createDataFrame([(1, "the quick brown LINE"), (None, "naïve 你好"), (2, None)], "item_id long, text string").withColumn("rank", F.lit("x"))
    assert found(search.search(messy(spark), items)) == ranked([(i, t) for i, t, _, _ in ROWS], [(1, "the quick brown LINE"), (None, "naïve 你好"), (2, None)])
    assert found(search.search(messy(spark, []), items)) == [] and found(search.search(messy(spark), items.limit(0))) == []


# --- alignment


@pytest.fixture(scope="module")
def sides():
    return align.sides_at(MERGES, PIECES, PATTERN)


@pytest.fixture(scope="module")
def plain(sides):
    """The alignment of a text by the libraries and byte offsets, or None."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib, b_lib = Tokenizer.from_file(MERGES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_lib.encode_special_tokens = True
    of_a, of_b = sides.bytes_a.to_pylist(), sides.bytes_b.to_pylist()

    def run(text):
        text = text or ""
        whole = (" " + text).encode()
        a, b = (a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)) if text else ([], [])
        if b"".join(of_a[i] for i in a) != whole or b"".join(of_b[i] for i in b) != whole:
            return "", 0, 0, []
        ends_a, ends_b = np.cumsum([len(of_a[i]) for i in a]).tolist(), np.cumsum([len(of_b[i]) for i in b]).tolist()
        groups, pairs, i, j = [], [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            x, y = i, j
            i, j = ends_a.index(cut, x) + 1, ends_b.index(cut, y) + 1
            groups.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
            pairs.append((a[i - 1], b[j - 1]))
        return ";".join(groups), len(a), len(b), pairs

    return run


def test_alignment_of_texts(sides, plain):
    rng = random.Random(3)
    special = [None, "", " ", "  ", "a ", "a  ", " a", "   ", "<|endoftext|> <s> x </s>", "\n", "▁", "a▁b", "x" * 3000, "<0x41>", "\x00 b"]
    for texts in (special, [], [None], [""], *(random_texts(rng, letters, 60, 40) for letters in (LETTERS, "ab \n", LETTERS + "▁") for _ in range(10))):
        got = align.align(sides, texts)
        told, at = align.described(sides, got), np.r_[0, np.cumsum(got.groups())]
        for i, t in enumerate(texts):
            groups, n_a, n_b, pairs = plain(t)
            mine = slice(at[i], at[i + 1])
            assert (told[i].decode(), len(got.a[i]), len(got.b[i])) == (groups, n_a, n_b)
            assert list(zip(got.a.values.to_numpy()[got.last_a[mine]].tolist(), got.b.values.to_numpy()[got.last_b[mine]].tolist(), strict=True)) == pairs
            x, y = (s[mine] for s in got.sizes())
            assert x.sum() == n_a and y.sum() == n_b


def summed(plain, docs):
    found = [(i, *plain(t)) for i, t in docs]
    counts = Counter(p for x in found for p in x[4])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return Counter((i, a, b, len(p), len(p), sum(counts[x] == best[x[1]] for x in p), sum(counts[x] for x in p), hashlib.sha256(g.encode()).hexdigest() if g else "") for i, g, a, b, p in found)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_query(spark, plain):
    docs = [(r[0], r[1]) for r in read(spark, DATA, "documents").collect()]
    assert Counter(tuple(r) for r in q.op13_alignment(spark, DATA).select(*COLUMNS).collect()) == summed(plain, docs)


def test_alignment_of_messy_rows(spark, plain):
    docs = [(i, t) for i, t, _, _ in ROWS]
    assert Counter(tuple(r) for r in align.summary(messy(spark), MERGES, PIECES, PATTERN).collect()) == summed(plain, docs)
    assert align.summary(messy(spark, []), MERGES, PIECES, PATTERN).count() == 0
    rows = align.aligned(messy(spark), MERGES, PIECES, PATTERN).collect()
    assert sorted((str(r["doc_id"]), len(r["a"]), len(r["a_sizes"])) for r in rows) == sorted((str(i), n, len(p)) for i, t in docs for _, n, _, p in [plain(t)])


def test_pairs_are_bounded_by_the_vocabularies(sides):
    few_a, few_b = [b"a", b"ba", b"c"], [b"a", b"a", b"cba"]
    bound = sum(x.endswith(y) or y.endswith(x) for x in few_a for y in few_b)

    class Bytes:
        tokens = few_a

    with pytest.MonkeyPatch.context() as m:
        m.setattr(align, "vocabulary_at", lambda _: Bytes)
        m.setattr(align, "pieces_at", lambda _: (None, few_b))
        assert align.pair_bound("", "") == bound
    assert len(sides.bytes_a) * len(sides.bytes_b) > 1000 * align.pair_bound(MERGES, PIECES)
    assert isinstance(sides.words, pa.Array)
