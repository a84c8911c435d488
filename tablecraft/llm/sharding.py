"""Sharding by Karmarkar-Karp differencing: shards of near equal bytes from groups that can't be split.

Documents of equal text are one group. Differencing repeatedly takes the two partial partitions with the largest spread
between their fullest and emptiest shard and adds them in opposite order. It needs all its items at once, so it runs in
levels, each on a bounded number of items:

1. Groups with at least 1/``LARGE`` of all bytes or rows, at most 2 x ``LARGE`` of them, are items of the last level.
2. All other groups are dealt by digest to buckets of about ``BUCKET`` groups. In each bucket differencing packs them
   into ``PARCELS`` parcels of near equal bytes; the groups of one bucket stay single, as fine grain for the last level.
   Parcels are packed again in the same way while there are more than ``TOP`` items.
3. The last level partitions the at most ``TOP`` items and the large groups into the shards, in one task.

Only digests and sums move, never texts. Documents of large groups get their shard by a broadcast of the large groups,
whose number is bounded; all others by a join on the digest, in which no key is hot. Places in a shard are counted by
blocks.

Defined cases: a null text counts as an empty one; repeated rows are documents of their own and share a group, as do all
rows of equal text, with or without doc_id; of equal sizes the least digest comes first; an empty table gives no rows;
other columns than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, numbered, staged

SHARDS, LARGE, BUCKET, PARCELS, TOP = 16, 4096, 20_000, 64, 40_000


def difference(sizes: list[int], parts: int) -> np.ndarray:
    """The part of each item. Ties are broken by position, so equal input gives equal output."""
    out = np.zeros(len(sizes), np.int32)
    if not sizes:
        return out
    # a partial partition: (minus its spread, its number, loads in descending order, chains of items in the same order)
    nxt = [-1] * len(sizes)
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-s, i, [s] + [0] * (parts - 1), [(i, i)] + [None] * (parts - 1)))
    heapq.heapify(heap)
    number = len(sizes)
    while len(heap) > 1:
        _, _, la, ca = heapq.heappop(heap)
        _, _, lb, cb = heapq.heappop(heap)
        both = []
        for k in range(parts):
            x, y = ca[k], cb[parts - 1 - k]
            if x is not None and y is not None:
                nxt[x[1]] = y[0]
                x = (x[0], y[1])
            elif x is None:
                x = y
            both.append((la[k] + lb[parts - 1 - k], x))
        both.sort(key=lambda z: -z[0])
        least = both[-1][0]
        heapq.heappush(heap, (least - both[0][0], number, [z[0] - least for z in both], [z[1] for z in both]))
        number += 1
    for part, chain in enumerate(heap[0][3]):
        i = chain[0] if chain else -1
        while i >= 0:
            out[i] = part
            i = nxt[i]
    return out


def _parcel(parcels: int, salt: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("item", kind="stable")
        part = difference(group["bytes"].tolist(), min(parcels, len(group)))
        return pd.DataFrame({"item": group["item"], "bytes": group["bytes"], "parent": [f"{salt}:{b}:{p}" for b, p in zip(group["bucket"], part, strict=True)]})

    return pack


def assign(items: DataFrame, shards: int = SHARDS, bucket: int = BUCKET, parcels: int = PARCELS, top: int = TOP, level: int = 0) -> DataFrame:
    """(item, shard) for every row of (item string, bytes long); items are distinct."""
    n = items.count()
    if n <= top:
        def last(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("item", kind="stable")
            return pd.DataFrame({"item": group["item"], "shard": difference(group["bytes"].tolist(), shards)})

        return items.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(last, "item string, shard int")
    buckets = -(-n // bucket)
    dealt = items.withColumn("bucket", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(buckets)))
    packed = dealt.where("bucket > 0" if buckets > 1 else "true").groupBy("bucket").applyInPandas(_parcel(parcels, level), "item string, bytes long, parent string")
    packed = staged(packed.unionByName(dealt.where("bucket = 0" if buckets > 1 else "false").select("item", "bytes", F.col("item").alias("parent"))), f"parcels{level}")
    above = packed.groupBy(F.col("parent").alias("item")).agg(F.sum("bytes").alias("bytes"))
    placed = assign(staged(above, f"items{level}"), shards, bucket, parcels, top, level + 1)
    return packed.join(placed.withColumnRenamed("item", "parent"), "parent").select("item", "shard")


def shard(docs: DataFrame, shards: int = SHARDS, large: int = LARGE) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of docs."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = staged(
        docs.select("doc_id", (F.octet_length("text").cast("long")).alias("_n"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("item"))
        .select("doc_id", (F.coalesce("_n", F.lit(0)) + 1).alias("size"), "text_crc32", "item"),
        "sized",
    )
    groups = staged(slim.groupBy("item").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "groups")
    total = groups.agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).first()
    is_large = (F.col("bytes") * large >= F.lit(total["bytes"] or 0)) | (F.col("rows") * large >= F.lit(total["rows"] or 0))
    placed = staged(_with_large(groups, is_large, shards, large), "placed")
    few = F.broadcast(placed.where("large").select("item", F.col("shard").alias("_hot")))  # 2 x LARGE rows at most
    rest = placed.where("not large").select("item", F.col("shard").alias("_cold"))
    marked = slim.join(few, "item", "left")
    cold = marked.where("_hot is null").drop("_hot").join(rest, "item").withColumnRenamed("_cold", "shard")
    hot = marked.where("_hot is not null").withColumnRenamed("_hot", "shard")
    columns = ["doc_id", "size", "text_crc32", "item", "shard"]
    both = cold.select(columns).unionByName(hot.select(columns)).withColumn("block", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), "item").cast("binary")), 1, 3))
    both = staged(both, "sharded")
    dropped(slim, groups, placed)
    return numbered(both, "shard", "block", ["doc_id", "item"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _with_large(groups: DataFrame, is_large, shards: int, large: int) -> DataFrame:
    """(item, shard, large). Large groups join the last level as single items, whatever the number of levels."""
    flagged = groups.select("item", "bytes", is_large.alias("large"))
    small = flagged.where("not large").select("item", "bytes")
    n = small.count()
    big = flagged.where("large").select("item", "bytes")
    if n <= TOP:
        top, packed = small, None
    else:
        buckets = -(-n // BUCKET)
        dealt = small.withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(buckets)))
        packed = dealt.where("bucket > 0").groupBy("bucket").applyInPandas(_parcel(PARCELS, 0), "item string, bytes long, parent string")
        packed = staged(packed.unionByName(dealt.where("bucket = 0").select("item", "bytes", F.col("item").alias("parent"))), "parcels")
        top = staged(packed.groupBy(F.col("parent").alias("item")).agg(F.sum("bytes").alias("bytes")), "items")
    placed = staged(assign(top.unionByName(big), shards, top=TOP + 2 * large, level=1), "top")
    large_items = big.join(placed, "item").select("item", "shard", F.lit(True).alias("large"))
    if packed is None:
        small_items = small.join(placed, "item").select("item", "shard", F.lit(False).alias("large"))
    else:
        small_items = packed.join(placed.withColumnRenamed("item", "parent"), "parent").select("item", "shard", F.lit(False).alias("large"))
    return large_items.unionByName(small_items)
