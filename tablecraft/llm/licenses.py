"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them. DataFrame
functions only.

A template of L words is sought in windows of W = 2 * 2**ceil(log2 L) words, each begun W/2 words after the last, so that
any occurrence lies within one window. Shingles are pairs of words, hashed once to 64 bits. A window that holds 80% of a
template has a Jaccard likeness of 0.17 at least with it; with one minimum per band and ``BANDS`` bands it shares a band
with probability over 0.997 (1 - (1 - 0.17)**32), and more as the window's rest is shorter. A window can't hold more of a
template than its text does, nor than its own shingles that any template has; texts and windows that are ruled out by
those counts are passed over before minima are taken. Candidates are verified by the exact share of the template's
shingles that the window has.

Templates go in blocks of ``BLOCK_PAIRS`` shingles, any number of them; documents are scanned once for each block, and
only a block is broadcast. Text isn't shuffled. Words are runs of letters and digits, lower-cased.

Defined cases: null and empty texts, texts of one word and empty tables match nothing; rows of one doc_id, repeated or
not, and all rows without doc_id, give the best of their matches for each template; where windows have the same share,
the first counts; a template of one word is refused; other columns than doc_id and text are not read.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

BANDS, CONTAINED = 32, 0.8
#: Shingles of the templates that are sought in one scan.
BLOCK_PAIRS = 20_000
#: The wording of common license notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def pairs(tokens: Column) -> Column:
    """Hashes of the pairs of neighbouring words of an array of words."""
    n = F.size(tokens)
    return F.when(n < 2, F.array().cast("array<bigint>")).otherwise(F.zip_with(F.slice(tokens, 1, n - 1), F.slice(tokens, 2, n - 1), lambda a, b: F.xxhash64(a, b)))


def _minima(hashes: Column) -> Column:
    """One minimum per band, each of the hashes under another exclusive-or."""
    spread = [((k + 1) * 0x9E3779B97F4A7C15) % (1 << 64) - (1 << 63) for k in range(BANDS)]
    return F.array(*[F.xxhash64(F.lit(k), F.array_min(F.transform(hashes, lambda x: x.bitwiseXOR(F.lit(c))))) for k, c in enumerate(spread)])


def window_of(n: int) -> int:
    w = 2
    while w < 2 * n:
        w *= 2
    return w


def _blocks(templates: list[Row]) -> Iterator[list[Row]]:
    block, held = [], 0
    for r in templates:
        if block and held + len(r["pairs"]) > BLOCK_PAIRS:
            yield block
            block, held = [], 0
        block.append(r)
        held += len(r["pairs"])
    if block:
        yield block


def _scan(docs: DataFrame, block: list[Row], contained: float) -> DataFrame:
    """(doc_id, license, containment, at_word) of every window that contains a template of the block.

    Arrays of one element are there for their lambdas: a lambda's variable is computed once, however often it is used."""
    known = [{"license": r["license"], "wide": window_of(r["n"]), "need": contained * len(r["pairs"]) - 1e-9, "pairs": r["pairs"]} for r in block]
    listed = F.from_json(F.lit(json.dumps(known)), "array<struct<license:string,wide:int,need:double,pairs:array<bigint>>>")
    of_any = f"h -> h IN ({', '.join(f'{h}L' for h in sorted({h for r in known for h in r['pairs']}))})"

    made = docs.select("doc_id", F.transform(F.array(words(F.col("text"))), pairs).alias("a"))
    made = made.select("doc_id", F.expr(f"transform(a, p -> struct(p, array_distinct(filter(p, {of_any})) AS found))").alias("a"))
    able = F.transform("a", lambda x: F.struct(x["p"].alias("p"), F.filter(listed, lambda t: F.size(F.array_intersect(x["found"], t["pairs"])) >= t["need"]).alias("able")))
    made = made.select("doc_id", able.alias("a"))
    scales = F.transform(F.filter("a", lambda x: F.size(x["able"]) > 0), lambda x: F.struct(x["p"].alias("p"), F.array_distinct(x["able"]["wide"]).alias("wides"), F.array_min(x["able"]["need"]).alias("need")))
    made = made.select("doc_id", F.explode(scales).alias("a")).select("doc_id", "a.p", "a.need", F.explode("a.wides").alias("wide"))
    # a window of W words has W - 1 pairs; the last one of a text may be short
    cut = F.expr("transform(sequence(0, greatest(0, size(p) - 1), wide div 2), i -> struct(i AS at_word, slice(p, i + 1, wide - 1) AS hashes))")
    near = made.select("doc_id", "need", "wide", F.explode(cut).alias("w")).where(F.expr(f"size(filter(w.hashes, {of_any})) >= need"))
    met = near.select("doc_id", "wide", "w.at_word", "w.hashes", F.explode(_minima(F.col("w.hashes"))).alias("band"))
    banded = docs.sparkSession.createDataFrame([(r["license"], r["wide"], r["pairs"]) for r in known], "license string, wide int, pairs array<bigint>")
    banded = banded.select("license", "wide", "pairs", F.explode(_minima(F.col("pairs"))).alias("band"))
    share = F.size(F.array_intersect("hashes", "pairs")) / F.size("pairs")
    found = met.join(F.broadcast(banded), ["wide", "band"]).select("doc_id", "license", share.alias("containment"), F.col("at_word").cast("long"))
    return found.where(F.col("containment") >= contained)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, license, containment, at_word): for each document and template that a window of it contains, the best
    share and the first word of the first window with it."""
    templates = TEMPLATES if templates is None else templates
    made = docs.sparkSession.createDataFrame(sorted(templates.items()), "license string, notice string").select("license", words(F.col("notice")).alias("w"))
    known = made.select("license", F.size("w").alias("n"), F.array_distinct(pairs(F.col("w"))).alias("pairs")).collect()  # what the caller gave
    if any(r["n"] < 2 for r in known):
        raise ValueError("a template needs two words at least")
    found = [_scan(docs, block, contained) for block in _blocks(known)]
    best = F.max(F.struct("containment", (-F.col("at_word")).alias("back")))
    out = functools.reduce(DataFrame.unionByName, found).groupBy("doc_id", "license").agg(best.alias("b"))
    return out.select("doc_id", "license", F.col("b.containment").alias("containment"), (-F.col("b.back")).alias("at_word"))


def oracle_sql(templates: dict[str, str] | None = None, contained: float = CONTAINED, table: str = "documents") -> str:
    """The exact scan as DuckDB SQL: all windows are held against all templates."""
    quoted = [(k.replace("'", "''"), v.replace("'", "''")) for k, v in (TEMPLATES if templates is None else templates).items()]
    split = r"string_split(trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
    return f"""
    WITH notices AS (SELECT license, {split.format("notice")} AS w FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in quoted)}) AS t(license, notice)),
    listed AS (SELECT DISTINCT license, len(w) AS n, w[k] || ' ' || w[k + 1] AS pair FROM (SELECT license, w, unnest(range(1, len(w))) AS k FROM notices)),
    wides AS (SELECT license, COUNT(*) AS pairs, CAST(2 * pow(2, ceil(log2(ANY_VALUE(n)))) AS BIGINT) AS wide FROM listed GROUP BY license),
    texts AS (SELECT doc_id, {split.format("text")} AS w FROM {table}),
    places AS (SELECT doc_id, k - 1 AS place, w[k] || ' ' || w[k + 1] AS pair FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS k FROM texts)),
    hits AS (SELECT p.doc_id, l.license, p.pair, p.place, w.wide, w.pairs FROM places p JOIN listed l USING (pair) JOIN wides w USING (license)),
    windowed AS (SELECT *, unnest([place // (wide // 2), place // (wide // 2) - 1]) AS k FROM hits),
    shares AS (SELECT doc_id, license, k * (wide // 2) AS at_word, COUNT(DISTINCT pair) / ANY_VALUE(pairs) AS containment FROM windowed
        WHERE k >= 0 AND place < k * (wide // 2) + wide - 1 GROUP BY doc_id, license, k, wide)
    SELECT doc_id, license, MAX(containment) AS containment, CAST(arg_min(at_word, (-containment, at_word)) AS BIGINT) AS at_word
    FROM shares WHERE containment >= {contained} GROUP BY doc_id, license"""
