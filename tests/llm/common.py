"""Small tables with what real ones have: nulls, empty and long texts, repeated rows, and columns with clashing names."""

from __future__ import annotations

import re
from itertools import combinations

DATA = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of the user that are named as helper columns of the operators are.
EXTRA = "size long, key string, block string, item string, shard int, n long, token long, component long, _keep boolean, score double, row string, rep string, copies string, _whole string, _copy string, _key string, grade string, a string, keep string, place string, guest string, `range` string"
_EXTRA_VALUES = (5, "k", "b", "i", 3, 7, 9, 11, False, 0.5, "r", "p", "c", "w", "y", "z", "g", "a", "e", "l", "u", "q")
LONG = " ".join(f"word{i % 997}x{i}" for i in range(30_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near the old river bank today", "en", "web"),
    (2, "the quick brown fox jumps over the lazy dog near the old river bank today", "en", "web"),
    (2, "the quick brown fox jumps over the lazy dog near the old river bank today", "en", "web"),
    (3, None, None, None),
    (4, "", "en", "web"),
    (5, "  \t\n ", "en", None),
    (6, "two words", "en", "books"),
    (7, LONG, "en", "web"),
    (8, LONG + " tail", "en", "web"),
    (9, "ÄÖÜ straße 你好 世界 😀 … naïve café", "de", "books"),
    (10, "line one is here\nline one is here\n\n----\n----\nline two is there", "en", "forum"),
    (None, "no id but a text of its own with several words inside", "en", "web"),
    (None, None, None, None),
    (12, "Released under the MIT License. Then something else follows in this text.", "en", "web"),
]


def messy(spark, rows=None):
    rows = ROWS if rows is None else rows
    full = [(i, t, lang, s, None if t is None else len(t), *_EXTRA_VALUES) for i, t, lang, s in rows]
    return spark.createDataFrame(full, f"{COLUMNS}, {EXTRA}")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def joined(sets, percent=80):
    """{key: smallest key reachable} by comparing all pairs of sets."""
    up = {k: k for k in sets}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {k: top(k) for k in sets}
