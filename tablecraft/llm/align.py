"""Alignment of two tokenizers on the same texts, as a pipeline of Arrow operations.

Token lists of a slice of texts are flattened, each token with the index of its text. Segmented cumulative sums of token
lengths give the byte offset at which each token ends; an Acero hash join on (text, end) finds the offsets at which tokens
of both sides end, which cut the tokens into groups and link the last token of either side. ``Table.group_by`` counts the
linked pairs of ids in each task, and Spark sums up the counts.

``aligned`` gives tokens and groups of each text, ``pair_counts`` the counts, ``summary`` figures of each text with
checksums of its groups. Texts are tokenized once: ``summary`` keeps each text's links in the shared folder while they are
counted. The counts are broadcast. Tokens that end together have bytes of which one's are the end of the other's, so that
the two vocabularies alone bound the pairs of ids (``pair_bound``, some 200,000), whatever the number of texts.

Side A is byte-level BPE with a list of merges over space + text, side B a piece model that puts the space there itself
and in which no piece crosses a word's start. Words that a process has met are remembered up to a bound.

Defined cases: a null or empty text, and one whose tokens on either side don't join to space + text (a text with the mark
that side B has for a space), has no tokens, groups or links; rows without doc_id, repeated rows and equal texts are
counted each; texts of any length are taken whole; an empty table gives no rows; other columns than doc_id and text are
not read, whatever their names; strings of special tokens are plain text.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, encoder_at, list_of, slices, vocabulary_at
from .shared import dropped, staged

MARK = "▁"
#: Words that each side remembers in each of two generations, bytes of text that are aligned at once, and links that are
#: counted at once. They bound memory only.
KEEP, SLICE, LINKS = 250_000, 2 << 20, 1 << 20
_WORD = re.compile(" *[^ ]+| +")
_BYTE = re.compile("<0x([0-9A-F]{2})>")


@cache
def pieces_at(path: str) -> tuple[Encoder, list[bytes]]:
    """An encoder of a piece model for each process, and the bytes of its ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece crosses a word's start: texts can't be cut there")
    alone = struct.pack("<I", model.piece_to_id(MARK))

    def encode_new(words: list[str]) -> list[bytes]:
        # each word begins with a space, which the model puts there; of a single space nothing would be left
        found = model.encode([w[1:] for w in words], num_threads=1)
        return [struct.pack(f"<{len(ids)}I", *ids) if ids else alone for ids in found]

    of_bytes = [bytes([int(m[1], 16)]) if model.is_byte(i) and (m := _BYTE.fullmatch(p)) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
    return Encoder(lambda text: _WORD.findall(" " + text), encode_new, KEEP), of_bytes


@dataclass
class Sides:
    """The two tokenizers of a process, the bytes of their ids, and the text that stands for each id in a description of
    groups: A's ids before a comma and before a bar, then B's before a comma and before a semicolon."""

    a: Encoder
    b: Encoder
    bytes_a: pa.Array
    bytes_b: pa.Array
    words: pa.Array


@cache
def sides_at(path_a: str, path_b: str, pattern: str) -> Sides:
    a, (b, of_b) = encoder_at(path_a, pattern), pieces_at(path_b)
    of_a = vocabulary_at(path_a).tokens
    words = [f"{i}{x}" for of, marks in ((of_a, ",|"), (of_b, ",;")) for i in range(len(of)) for x in marks]
    return Sides(Encoder(lambda text: a.split(" " + text), a.encode_new, KEEP), b, pa.array(of_a, pa.large_binary()), pa.array(of_b, pa.large_binary()), pa.array(words, pa.large_string()))


def pair_bound(path_a: str, path_b: str) -> int:
    """How many pairs of ids can end together at most: those of which one's bytes are the end of the other's."""
    a, b = vocabulary_at(path_a).tokens, pieces_at(path_b)[1]

    def ends(of: list[bytes], known: list[bytes], least: int) -> int:
        times: dict[bytes, int] = {}
        for t in known:
            times[t] = times.get(t, 0) + 1
        return sum(times.get(t[k:], 0) for t in of for k in range(least, len(t)))

    return ends(a, b, 0) + ends(b, a, 1)


def _tokens(encoder: Encoder, of_bytes: pa.Array, texts: list[str], whole: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
    """The ids of each text, and whether their bytes join to ``whole``."""
    ids = list_of(*encoder.texts(texts))
    parts = pa.ListArray.from_arrays(ids.offsets, of_bytes.take(ids.values))
    return ids, pc.equal(pc.binary_join(parts, pa.scalar(b"", pa.large_binary())), whole).to_numpy(zero_copy_only=False)


def _ends(ids: pa.ListArray, of_bytes: pa.Array, place: str) -> pa.Table:
    """(end, place): of each token its text and the byte at which it ends there, as one number, and its place among all
    tokens."""
    text = pc.list_parent_indices(ids)
    upto = pc.cumulative_sum(pc.binary_length(of_bytes.take(ids.values)))
    before = pa.concat_arrays([pa.array([0], pa.int64()), upto]).take(ids.offsets.slice(0, len(ids)))  # of each text's first token
    start = pc.subtract(pc.multiply(pa.array(np.arange(len(ids))), 1 << 40), before)
    return pa.table({"end": pc.add(upto, start.take(text)), place: np.arange(len(text), dtype=np.int32)})


@dataclass
class Aligned:
    """Of a slice of texts: ids of both sides, and of each group, in order, its text and the places of its last tokens."""

    a: pa.ListArray
    b: pa.ListArray
    text: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray

    def groups(self) -> np.ndarray:
        """How many groups each text has."""
        return np.bincount(self.text, minlength=len(self.a))

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens of A and of B each group has. Groups cover all tokens, so the one before ends where it begins."""
        return np.diff(self.last_a, prepend=-1), np.diff(self.last_b, prepend=-1)


def align(sides: Sides, texts: list[str | None]) -> Aligned:
    texts = ["" if t is None or MARK in t else t for t in texts]
    whole = pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), pa.array([t.encode() for t in texts], pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    (a, same_a), (b, same_b) = _tokens(sides.a, sides.bytes_a, texts, whole), _tokens(sides.b, sides.bytes_b, texts, whole)
    if not (same := same_a & same_b).all():
        none = pa.array(np.where(same, np.arange(len(texts)), -1))
        none = pc.if_else(pc.less(none, 0), None, none)
        a, b = (_without_nulls(x.take(none)) for x in (a, b))
    met = _ends(a, sides.bytes_a, "a").join(_ends(b, sides.bytes_b, "b"), "end", join_type="inner", use_threads=False)
    last_a, last_b = np.sort(met["a"].to_numpy()), np.sort(met["b"].to_numpy())  # both sides end in the same order
    return Aligned(a, b, pc.list_parent_indices(a).to_numpy()[last_a], last_a.astype(np.int64), last_b.astype(np.int64))


def _without_nulls(lists: pa.ListArray) -> pa.ListArray:
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), lists.flatten())


def described(sides: Sides, found: Aligned) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each text: the ids of A and B in each group."""
    n_a, n_b, n = len(found.a.values), len(found.b.values), len(found.text)
    ends_a, ends_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
    ends_a[found.last_a], ends_b[found.last_b] = 1, 1
    of_a, of_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b  # the group of each token
    order = np.empty(n_a + n_b, np.int64)
    words_a = len(sides.bytes_a) * 2
    before = np.r_[0, found.last_b[: n - 1] + 1] if n else np.zeros(0, np.int64)
    order[np.arange(n_a) + before[of_a]] = found.a.values.to_numpy().astype(np.int64) * 2 + ends_a
    order[np.arange(n_b) + found.last_a[of_b] + 1] = words_a + found.b.values.to_numpy().astype(np.int64) * 2 + ends_b
    offsets = pc.add(found.a.offsets, found.b.offsets)
    parts = pa.ListArray.from_arrays(offsets, sides.words.take(pa.array(order)))
    joined = pc.binary_join(parts, pa.scalar("", pa.large_string()))
    return [x.as_buffer().to_pybytes()[:-1] for x in joined]


def _mapped(docs: DataFrame, paths: tuple[str, str, str], schema: str, make: Callable[[Sides, Aligned, pa.RecordBatch], list]) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *[c.split()[0] for c in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = sides_at(*paths)
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                yield pa.RecordBatch.from_arrays([part.column(0), *make(sides, align(sides, part.column(1).to_pylist()), part)], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {schema}")


def _of_texts(found: Aligned, values: np.ndarray) -> pa.ListArray:
    """A value for each group as lists, one for each text."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(found.groups())].astype(np.int32)), pa.array(values.astype(np.int32)))


def aligned(docs: DataFrame, path_a: str, path_b: str, pattern: str) -> DataFrame:
    """(doc_id, a, b, a_sizes, b_sizes): the ids of both sides, and how many of each make up each group."""
    return _mapped(docs, (path_a, path_b, pattern), "a array<int>, b array<int>, a_sizes array<int>, b_sizes array<int>", lambda _, x, __: [x.a, x.b, *(_of_texts(x, s) for s in x.sizes())])


def packed(ids_a: np.ndarray, ids_b: np.ndarray, per_text: np.ndarray, kind: str) -> pa.BinaryArray:
    """The linked ids of each text as bytes, A's and B's in turn: Spark carries them as they are."""
    data = np.stack([ids_a, ids_b], 1).astype(kind)
    offsets = np.r_[0, np.cumsum(per_text)] * (2 * data.itemsize)
    return pa.BinaryArray.from_buffers(pa.binary(), len(per_text), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def unpacked(links: pa.BinaryArray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of A, ids of B, how many links each text has)."""
    offsets = np.frombuffer(links.buffers()[1], np.int32)[links.offset : links.offset + len(links) + 1]
    data = np.frombuffer(links.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(-1, 2)
    return data[:, 0].astype(np.int64), data[:, 1].astype(np.int64), np.diff(offsets) // (2 * data.itemsize)


def _kind(path_a: str, path_b: str) -> str:
    """The least type that holds the ids of both sides."""
    return "<u2" if max(len(vocabulary_at(path_a).tokens), len(pieces_at(path_b)[1])) <= 1 << 16 else "<u4"


def links(docs: DataFrame, path_a: str, path_b: str, pattern: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, links): figures of each text and the ids that it links, packed."""
    kind = _kind(path_a, path_b)

    def make(sides: Sides, x: Aligned, _: pa.RecordBatch) -> list:
        n = [pa.array(np.asarray(v).astype(np.int64)) for v in (np.diff(x.a.offsets.to_numpy()), np.diff(x.b.offsets.to_numpy()), x.groups())]
        told = pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in described(sides, x)], pa.string())
        return [*n, told, packed(x.a.values.to_numpy()[x.last_a], x.b.values.to_numpy()[x.last_b], x.groups(), kind)]

    return _mapped(docs, (path_a, path_b, pattern), "n_a long, n_b long, n_groups long, groups_sha256 string, links binary", make)


def pair_counts(linked: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a, b, n): how many links hold each pair of ids. Tasks count with ``Table.group_by``; their counts are summed up."""
    kind = _kind(path_a, path_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in slices(batch, 0, 4 * LINKS):
                a, b, _ = unpacked(part.column(0), kind)
                some = pa.table({"a": a.astype(np.int32), "b": b.astype(np.int32), "n": np.ones(len(a), np.int64)})
                both = some if total is None else pa.concat_tables([total, some])
                total = both.group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["a", "b", "n"])
        if total is not None:
            yield from total.combine_chunks().to_batches(1 << 16)

    return linked.select("links").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _scored(linked: DataFrame, counts: pa.Table, links_kind: str) -> DataFrame:
    """``linked`` with n_links, n_best and count_sum instead of the ids."""
    kind = linked.schema["doc_id"].dataType.simpleString()
    sent = linked.sparkSession.sparkContext.broadcast(counts)
    kept = ["doc_id", "n_a", "n_b", "n_groups"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        best = known.group_by("b", use_threads=False).aggregate([("n", "max")])
        known = known.join(best, "b", use_threads=False)
        code = known["a"].to_numpy().astype(np.int64) << 32 | known["b"].to_numpy()
        order = np.argsort(code)
        code, n, is_best = code[order], known["n"].to_numpy()[order], pc.equal(known["n"], known["n_max"]).to_numpy()[order]
        for batch in batches:
            for part in slices(batch, 5, 4 * LINKS):
                a, b, size = unpacked(part.column(5), links_kind)
                at = np.searchsorted(code, a << 32 | b)
                text = np.repeat(np.arange(len(size)), size)
                sums = np.zeros(len(size), np.int64)
                np.add.at(sums, text, n[at])
                better = np.bincount(text[is_best[at]], minlength=len(size))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *(pa.array(np.asarray(x).astype(np.int64)) for x in (size, better, sums)), part.column(4)], [*kept, "n_links", "n_best", "count_sum", "groups_sha256"])

    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return linked.select(*kept, "groups_sha256", "links").mapInArrow(run, schema)


def summary(docs: DataFrame, path_a: str, path_b: str, pattern: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row. ``n_best`` are the links whose
    pair is the most frequent one of its B id, ties included, ``count_sum`` is the sum of the pairs' counts."""
    linked = staged(links(docs, path_a, path_b, pattern), "links")
    counts = pair_counts(linked, path_a, path_b).toArrow()
    if len(counts) > (most := pair_bound(path_a, path_b)):
        raise RuntimeError(f"{len(counts)} pairs of ids where {most} can be")
    out = staged(_scored(linked, counts.combine_chunks(), _kind(path_a, path_b)), "alignment")
    dropped(linked)
    return out
