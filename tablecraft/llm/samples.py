"""Bounded samples of labelled documents for fitting classifiers.

A classifier is fitted on ``SAMPLE_ROWS`` labelled documents with ``SAMPLE_BYTES`` of text at most, chosen by a hash of
doc_id, so that every run takes the same ones; scoring covers every row. Documents are picked out by a join in the JVM,
and only the features of the sample go to the driver, never texts, ``SAMPLE_FEATURES`` bytes of them at most. A document
of more than a ``LARGEST``-th of either bound is passed over by the sample, so that it doesn't shut out those after it.

Defined cases: labels without doc_id or grade are left out; of several labels of one document the greatest holds, and of
several texts of one doc_id, or repeated rows, the least text; labels without a document count for nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, staged

#: Labelled documents that a classifier is fitted on at most, and bytes of their text.
SAMPLE_ROWS, SAMPLE_BYTES = 12_000, 96 << 20
#: Bytes of their features that the driver gets at most, and the part of either bound that one document can have.
SAMPLE_FEATURES, LARGEST = 96 << 20, 16


def order_of(key: str = "doc_id", seed: int = 17) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 31))


def sampled_labels(labels: DataFrame, grade: Column, rows: int = SAMPLE_ROWS, seed: int = 17) -> DataFrame:
    """(doc_id, grade) of about ``rows`` labelled documents. They are chosen by a threshold on their hash."""
    graded = labels.select("doc_id", grade.alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    n = graded.count()
    cut = (1 << 31) if n <= rows else int((1 << 31) * 0.97 * rows / n)
    return graded.where(order_of(seed=seed) < cut).orderBy(order_of(seed=seed), "doc_id").limit(rows)


def sampled_texts(docs: DataFrame, labels: DataFrame, grade: Column, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES, seed: int = 17) -> DataFrame:
    """(doc_id, grade, text) of the sampled documents, ordered by nothing. The labels that are broadcast are ``rows`` at
    most, and so is what the window orders."""
    some = F.broadcast(sampled_labels(labels, grade, rows, seed))
    found = docs.select("doc_id", "text").join(some, "doc_id").groupBy("doc_id", "grade").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    found = staged(found, "labelled")
    out = within(found.withColumn("size", F.octet_length("text").cast("long")), size, seed).drop("size")
    out.staged_at = found.staged_at  # for dropped()
    return out


def within(rows: DataFrame, size: int, seed: int = 17) -> DataFrame:
    """Of (doc_id, size, ...), of which a doc_id has one row, the first rows by hash that have ``size`` in sum. The window
    orders two numbers of each row of a sample."""
    before = Window.orderBy(order_of(seed=seed), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    some = rows.select("doc_id", "size").where(F.col("size") * LARGEST <= size).withColumn("sum", F.sum("size").over(before)).where(F.col("sum") <= size)
    return rows.join(F.broadcast(some.select("doc_id")), "doc_id")


def sampled_table(
    docs: DataFrame, labels: DataFrame, grade: Column, features: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], names: list[str], rows: int, size: int
) -> pa.Table:
    """(doc_id, grade, *names) of the sample on the driver, ordered by nothing. ``features`` makes batches with the binary
    columns ``names`` of batches (doc_id, grade, text). The driver gets them as Arrow batches: as rows, both its
    processes would hold them several times over."""
    texts = sampled_texts(docs, labels, grade, rows, size)
    made = texts.select(F.col("doc_id").cast("long"), F.col("grade").cast("int"), "text").mapInArrow(features, ", ".join(["doc_id long, grade int", *[f"{c} binary" for c in names]]))
    made = staged(made, "features")
    dropped(texts)
    sized = made.withColumn("size", sum((F.octet_length(c) for c in names), F.lit(0)).cast("long"))
    out = within(sized, SAMPLE_FEATURES).drop("size").toArrow()
    dropped(made)
    return out


def sampled_features(
    docs: DataFrame, labels: DataFrame, grade: Column, features: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], names: list[str], rows: int, size: int
) -> pd.DataFrame:
    """``sampled_table`` by doc_id, its binary columns as objects."""
    return sampled_table(docs, labels, grade, features, names, rows, size).to_pandas().sort_values("doc_id", kind="stable")


def joined_up(table: pa.Table, name: str, kind: type, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in the binary column ``name``, row after row in ``order``, and how many each row has: one copy of them."""
    parts = [np.frombuffer(x.as_buffer(), kind) for x in table[name]]
    parts = [parts[k] for k in order]
    return np.concatenate([np.zeros(0, kind), *parts]), np.array([len(x) for x in parts], np.int64)
