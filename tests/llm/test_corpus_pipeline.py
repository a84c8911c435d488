"""The stages of the corpus pipeline, each on what its predecessor keeps."""

from __future__ import annotations

from collections import Counter

import pytest
from common import DATA, joined, messy, shingles

import corpus_pipeline
from tablecraft.llm import decontamination, quality
from tablecraft.llm.shared import read, staged

STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def steps(spark):
    docs = read(spark, DATA, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], DATA), f"test-{name}"))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(steps):
    assert all(s.dtypes == steps[0].dtypes for s in steps[:-1])
    assert all(s.count() for s in steps)


def test_quality_stage(spark, steps):
    model = quality.train(steps[0], read(spark, DATA, "labels"))
    want = {r["doc_id"] for r in quality.score(steps[0], model).where("keep").collect()}
    assert set(rows(steps[1])) == want and len(want) < steps[0].count()


def test_near_duplicate_stage(steps):
    before = rows(steps[1])
    top = joined({i: s for i, r in before.items() if (s := shingles(r["text"]))})
    assert set(rows(steps[2])) == {i for i in before if top.get(i, i) == i}


def test_decontamination_stage(spark, steps):
    gone = {r["doc_id"] for r in decontamination.leaks(steps[2], read(spark, DATA, "benchmark")).collect()}
    assert set(rows(steps[3])) == set(rows(steps[2])) - gone


def test_mixing_and_sharding_stages(steps):
    before, after = rows(steps[3]), Counter(r["doc_id"] for r in steps[4].collect())
    assert set(after) <= set(before) and max(after.values()) <= 2
    assert Counter(r["doc_id"] for r in steps[5].collect()) == after


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_messy_and_empty_tables(spark, name):
    docs = messy(spark)
    out = STAGE[name](spark, docs, DATA)
    found = out.collect()
    assert found
    if name != "sharding":
        assert out.dtypes == docs.dtypes
        extra = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
        assert {tuple(r[c] for c in extra) for r in found} == {tuple(docs.first()[c] for c in extra)}
    assert STAGE[name](spark, docs.limit(0), DATA).count() == 0


def test_near_duplicates_without_id(spark):
    docs = messy(spark)
    out = STAGE["near_duplicates"](spark, docs, DATA).collect()
    assert sorted(r["doc_id"] for r in out if r["doc_id"]) == [1, 3, 4, 5, 6, 7, 9, 10, 12]
    assert sorted(str(r["text"])[:5] for r in out if r["doc_id"] is None) == ["None", "no id"]


def test_near_duplicates_by_row(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    docs = [(None, a), (None, a + " end"), (5, b), (None, b + " end"), (6, c), (7, c + " end"), (7, d), (None, "two  words and four MORE here"), (None, "Two words and four more here")]
    out = STAGE["near_duplicates"](spark, messy(spark, [(i, t, "en", "web") for i, t in docs]), DATA).collect()
    assert sorted((str(r["doc_id"]), r["text"][:2].lower()) for r in out) == [("5", "b0"), ("6", "c0"), ("7", "d0"), ("None", "a0"), ("None", "tw")]
