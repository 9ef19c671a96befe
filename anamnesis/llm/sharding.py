"""Sharding by Karmarkar-Karp differencing, over indivisible groups.

Documents with equal texts form a group that must not be divided. A partial partition is a
tuple of shard sums; the two with the largest spread are combined, the largest sum of one
with the smallest of the other, until one is left. The groups above total / LARGE bytes, by
the pigeonhole fewer than LARGE whatever the input's size, are differenced first, in one
task. All others are dealt by hash into buckets of bounded size; each bucket is differenced
on its own, starting from its proportional part of what the large groups left uneven, so the
buckets level that and stay in step without meeting.

Law `bytes`: shard sizes near equal. Defined results: a null or empty text has size 1 and
equal texts include all null and empty ones; repeated rows stay in one group and each gets a
slot; a very long text is a group like others; an empty table gives an empty result; extra columns are ignored.
Copies of one text meet in the join that gives them their group's shard: rows of five narrow columns, in a join that
adaptive execution splits where they are many.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.llm.common import numbered, pick, written

#: Groups above 1 / LARGE of all bytes are differenced before all others; there are fewer than LARGE.
LARGE = 8192
#: Groups that a bucket holds, about.
BUCKET_GROUPS = 2048
#: Rows that a bucket of slots holds, about.
SLOT_ROWS = 50_000


def difference(sizes: Sequence[float], shards: int, start: Sequence[float] | None = None) -> list[int]:
    """The shard of each item. start: a first partial partition, whose sums keep their shard numbers."""
    # a partial partition: its sums in falling order, each with the root of the tree of items that it holds
    children: dict[int, tuple] = {}
    heap, fresh = [], len(sizes)

    def push(parts: list[tuple[float, int]], order: int) -> None:
        parts.sort(key=lambda p: (-p[0], p[1]))
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], order, parts))

    empty = -1
    if start is not None:
        labels = list(range(fresh, fresh + shards))
        push([(float(s), x) for s, x in zip(start, labels, strict=True)], -1)
        fresh += shards
    for i, s in enumerate(sizes):
        heapq.heappush(heap, (-float(s), i, [(float(s), i)] + [(0.0, empty)] * (shards - 1)))
    while len(heap) > 1:
        _, order, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        parts = []
        for (sa, ta), (sb, tb) in zip(a, reversed(b), strict=True):
            if ta == empty or tb == empty:
                parts.append((sa + sb, tb if ta == empty else ta))
            else:
                children[fresh] = (ta, tb)
                parts.append((sa + sb, fresh))
                fresh += 1
        push(parts, order)
    out = [0] * len(sizes)
    if not heap:
        return out
    for place, (_, root) in enumerate(heap[0][2]):
        leaves, todo, label = [], [root], place
        while todo:
            x = todo.pop()
            if x in children:
                todo.extend(children[x])
            elif x >= len(sizes):
                label = x - len(sizes)
            elif x >= 0:
                leaves.append(x)
        for x in leaves:
            out[x] = label
    return out


def assign_groups(groups: DataFrame, shards: int) -> DataFrame:
    """(key, shard) for (key, bytes)."""
    total, n = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    large = groups.filter(F.col("bytes") * LARGE > F.lit(total))
    small = groups.filter(F.col("bytes") * LARGE <= F.lit(total))

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True])
        return pd.DataFrame({"key": pdf["key"], "bytes": pdf["bytes"], "shard": difference(pdf["bytes"].tolist(), shards)})

    first = written(large.groupBy(F.lit("all")).applyInPandas(whole, "key binary, bytes long, shard int"), "shard-large")
    sums = {r["shard"]: int(r["b"]) for r in first.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}  # a row for each shard
    held = np.array([sums.get(i, 0) for i in range(shards)], float)
    rest = max(total - held.sum(), 1.0)
    uneven = (held - held.min()) / rest
    buckets = max(1, n // BUCKET_GROUPS)

    def bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True])
        sizes = pdf["bytes"].tolist()
        return pd.DataFrame({"key": pdf["key"], "shard": difference(sizes, shards, uneven * sum(sizes))})

    dealt = small.groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")).applyInPandas(bucket, "key binary, shard int")
    return first.select("key", "shard").union(dealt)


def sharded(rows: DataFrame, shards: int) -> DataFrame:
    """(row, doc_id, size, text_crc32, law, shard, slot, grown_shard) of written rows (row, doc_id, size, text_crc32, key)."""
    rows = rows.select("row", "doc_id", "size", "text_crc32", "key")
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    buckets = max(64, rows.count() // (SLOT_ROWS * shards))
    placed = rows.join(assign_groups(groups, shards), "key").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)))
    placed = written(placed.drop("key"), "shard-placed")
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    up_to = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    slotted = placed.withColumn("at", F.row_number().over(within)).join(firsts, ["shard", "bucket"])
    slot = (F.col("first") + F.col("at") - 1).cast("long")
    return slotted.select("row", "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def measured(docs: DataFrame, doc_id: str, text: str, *also: str) -> DataFrame:
    """(row, doc_id, size, text_crc32, key, *also) of each row, written once, so that its number stays the same."""
    t = F.coalesce(F.col(text), F.lit(""))
    size, crc, key = (F.octet_length(t) + 1).cast("long"), F.crc32(t.cast("binary")), F.unhex(F.sha2(t, 256))
    return written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), key.alias("key"), *also), "shard-rows")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot
    (from 0 without gaps in each shard, by doc_id within hash buckets) and grown_shard (null)."""
    return sharded(measured(pick(docs, "doc_id", "text"), "doc_id", "text"), shards).drop("row")


def with_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """docs with all their columns, and size, text_crc32, law, shard and slot of each row. A column of docs that has one of
    these names in any case gives way, and of equal names the first counts."""
    numbers, added = numbered(docs), ("size", "text_crc32", "law", "shard", "slot")
    own = ("doc_id", "text")
    first = {n: docs.columns.index(n) for n in own}
    for i, n in enumerate(docs.columns):
        if n.lower() not in (*added, *own):
            first.setdefault(next((x for x in first if x.lower() == n.lower()), n), i)
    names = {n: f"c{i}" for n, i in sorted(first.items(), key=lambda x: x[1])}
    rows = measured(numbers, names["doc_id"], names["text"], *names.values())
    placed = sharded(rows, shards).select("row", *added)
    return rows.select("row", *(F.col(c).alias(n) for n, c in names.items())).join(placed, "row").select(*names, *added)
