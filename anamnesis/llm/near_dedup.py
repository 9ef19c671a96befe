"""Near-duplicate detection by a MinHash LSH forest.

A document's set is its distinct word shingles, as 64-bit hashes. Equal sets form one class,
and classes are what is linked. Each class has a signature of trees x deepest minimum
hashes. A tree sorts all classes by its part of the signature, in range partitions of
bounded size; the longest common prefixes of neighbours in that order cut it into regions.
A region begins at `depth` shared values; one of more than `region` classes is cut again
where its neighbours' common prefixes are shorter by one value more, down to `deepest`, so
depth adapts to each region. What a region shares at its depth is its set of candidates. The
number of trees is set by the deepest level: a pair at the threshold shares no region in any
tree less than once in 10,000 times even if all its regions are cut that far, and once in a
million times at `depth`. A region that is still large at the deepest level is compared as
it is, however large.

A group of candidates that fits a block is compared whole, and a spanning forest of its links leaves
the task, never all pairs. A larger one is first compared within blocks that its classes are
dealt to; where that leaves classes of different components, the blocks of one component
each are compared with all others but their like. So a large group of copies
costs a few comparisons for each, and only what is no copy meets every block.
First signatures are compared that way within regions (pairs that agree nearly enough, 4.75
standard deviations below the threshold count), then the full sets within the components of
those links. The components of the links between full sets are the result. No link between
different texts of a group is lost, and nothing about all documents reaches the driver.

Defined results: documents without words (null, empty, white space) have an empty set, are
linked with nothing and are their own component; those with fewer words than a shingle have
their whole word sequence as one; repeated rows are one class, and each row is returned; a
null doc_id counts as no smallest id; a very long text has as large a set as it has shingles, and
blocks of such sets hold fewer; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.common import discard, in_arrow, numbered, pick, slices, texts_as_bytes, written
from anamnesis.llm.components import components

_K = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xFF51AFD7ED558CCD)


@dataclass(frozen=True)
class NearRules:
    """Links: 100 * intersection >= threshold_pct * union. depth, deepest: values that a region's classes share at
    least, and signature values of a tree. region: classes of a region above which it is cut deeper. signatures, sets:
    classes of a block of signatures or sets; block_values: shingles of a block of sets, about."""

    shingle: int = 3
    threshold_pct: int = 85
    trees: int = 20
    depth: int = 4
    deepest: int = 6
    region: int = 4096
    signatures: int = 4096
    sets: int = 1024
    block_values: int = 4_000_000
    bucket_rows: int = 2000
    sorted_rows: int = 200_000
    seed: int = 11

    @property
    def least_agreement(self) -> float:
        t, n = self.threshold_pct / 100, self.trees * self.deepest
        return t - 4.75 * math.sqrt(t * (1 - t) / n)


#: Where no contract sets other values: five words, similarity 0.8.
FIVE_WORDS = NearRules(shingle=5, threshold_pct=80, trees=24, depth=3, deepest=5)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; empty without words."""
    words = (text or b"").lower().split()  # bytes: A-Z only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    length = min(n, size)
    rolled = np.full(n - length + 1, length, np.uint64) * _K
    for k in range(length):
        rolled = _mix(rolled * _K + h[k : n - length + 1 + k])
    return np.unique(rolled)


def _permutations(rules: NearRules) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(rules.seed)
    n = rules.trees * rules.deepest
    return rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, low = (hashes >> np.uint64(32)).astype(np.uint32), np.full(len(a), 2**32 - 1, np.uint32)
    for i in range(0, len(x), 256):
        np.minimum(low, (x[i : i + 256, None] * a + b).min(0), out=low)
    return low


def class_of(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, rules: NearRules) -> DataFrame:
    """(doc_id, tie, n_shingles, node, sig, low) of each document; tie, a hash of its text; node, its class, sig and low
    (a byte of each of its values) are null for an empty set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _permutations(rules)
        for batch in slices(batches):
            sets = [shingle_set(t, rules.shingle) for t in texts_as_bytes(batch)]
            sigs = [signature(s, a, b) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([class_of(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([None if s is None else s.tobytes() for s in sigs], pa.binary()),
                    pa.array([None if s is None else s.astype(np.uint8).tobytes() for s in sigs], pa.binary()),
                ],
                names=["doc_id", "tie", "n_shingles", "node", "sig", "low"],
            )

    texts = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("tie"), "text")
    return in_arrow(texts, sketch, "doc_id long, tie long, n_shingles long, node binary, sig binary, low binary")


def sorted_orders(classes: DataFrame, rules: NearRules) -> DataFrame:
    """(key, node) of each class in each tree, in range partitions in the order of key (the tree's number, then its
    values); equal keys go by node, so no partition is larger than others however many classes agree."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            values = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, rules.trees, rules.deepest).astype(">u4")
            numbers = np.broadcast_to(np.arange(rules.trees, dtype=">u4")[None, :, None], (len(values), rules.trees, 1))
            flat = np.concatenate([numbers, values], 2).tobytes()
            width = 4 * (rules.deepest + 1)
            key = pa.Array.from_buffers(pa.binary(width), len(values) * rules.trees, [None, pa.py_buffer(flat)]).cast(pa.binary())
            nodes = b.column(0).take(pa.array(np.repeat(np.arange(len(values)), rules.trees)))
            yield pa.RecordBatch.from_arrays([key, nodes.cast(pa.binary())], names=["key", "node"])

    rows = in_arrow(classes.select("node", "sig"), keys, "key binary, node binary")
    tasks = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), classes.count() * rules.trees // rules.sorted_rows)
    return rows.repartitionByRange(tasks, "key", "node").sortWithinPartitions("key", "node")


#: What says that a run of equal prefixes touches its partition's start, its end, or both.
HEAD, TAIL, BOTH = -1, -2, -3


def prefix_runs(orders: DataFrame, rules: NearRules) -> DataFrame:
    """Of each class that shares a prefix of `depth` with a neighbour: part, node, and for each level from `depth` to
    `deepest` the hash of its prefix and how many classes share it (or HEAD, TAIL, BOTH where the run may go on in
    another partition). Of each partition: edge, with its first and last key and the runs that touch them."""
    levels = range(rules.depth, rules.deepest + 1)
    longs, edge = pa.list_(pa.int64()), pa.struct([("first", pa.binary()), ("last", pa.binary()), ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))])
    names = ["part", "node", "prefixes", "runs", "edge"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, nodes = TaskContext.get().partitionId(), [], []
        for b in batches:
            keys.append(np.frombuffer(b"".join(b.column(0).to_pylist()), ">u4").astype(np.uint64).reshape(-1, rules.deepest + 1))
            nodes.append(b.column(1))
        key, n = np.concatenate(keys or [np.empty((0, rules.deepest + 1), np.uint64)]), sum(map(len, nodes))
        if not n:
            return
        common = np.cumprod(key[1:] == key[:-1], axis=1).sum(1) - 1  # of neighbours: values that they share, -1 between trees
        prefix, lengths, hashes = _mix((key[:, 0] + np.uint64(1)) * _K), [], []
        for k in range(1, rules.deepest + 1):
            prefix = _mix(prefix * _K + key[:, k])
            if k in levels:
                run = np.concatenate([[0], np.cumsum(common < k)])
                size = np.bincount(run)
                head, tail = int(size[0]), int(size[-1])
                held = size.copy()
                held[0], held[-1] = HEAD, TAIL
                if len(size) == 1:
                    held[0] = BOTH
                lengths.append((held[run], head, tail))
                hashes.append(prefix.view(np.int64) + np.int64(k))
        shared = np.flatnonzero(lengths[0][0] != 1)
        every = pa.concat_arrays(nodes) if len(nodes) > 1 else nodes[0]
        for i in range(0, len(shared), 50_000):
            at = shared[i : i + 50_000]
            flat = lambda x: pa.array(np.stack(x, 1)[at].tolist(), longs)
            m = len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, part), pa.int32()), every.take(pa.array(at)).cast(pa.binary()), flat(hashes), flat([x for x, _, _ in lengths]), pa.nulls(m, edge)], names=names
            )
        ends = [key[k].astype(">u4").tobytes() for k in (0, -1)]
        said = {"first": ends[0], "last": ends[1], "head": [x for _, x, _ in lengths], "tail": [x for _, _, x in lengths]}
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, longs), pa.nulls(1, longs), pa.array([said], edge)], names=names)

    kind = "part int, node binary, prefixes array<long>, runs array<long>, edge struct<first: binary, last: binary, head: array<long>, tail: array<long>>"
    return in_arrow(orders, runs, kind)


def whole_runs(edges: Sequence[tuple[bytes, bytes, list[int], list[int]]], rules: NearRules) -> list[tuple[list[int], list[int]]]:
    """For each partition (first key, last key, head, tail), in order: how many classes share the first row's prefix
    in all partitions, at each level, and how many the last row's."""
    out = [([0] * len(e[2]), [0] * len(e[3])) for e in edges]
    for i, k in enumerate(range(rules.depth, rules.deepest + 1)):
        width, open_, total = 4 * (k + 1), [], 0  # the run at hand: its ends in out, and its size so far
        for p, (first, last, head, tail) in enumerate(edges):
            if p and edges[p - 1][1][:width] != first[:width]:
                for side in open_:
                    side[i] = total
                open_, total = [], 0
            total += head[i]
            open_.append(out[p][0])
            if first[:width] != last[:width]:
                for side in open_:
                    side[i] = total
                open_, total = [], tail[i]
            open_.append(out[p][1])
        for side in open_:
            side[i] = total
    return out


def members(classes: DataFrame, rules: NearRules) -> DataFrame:
    """(region, node, n) of the regions of two classes or more, n of them."""
    spark = classes.sparkSession
    runs = written(prefix_runs(sorted_orders(classes, rules), rules), "near-runs")
    # two keys for each partition of the sorted orders, none for a class
    edges = runs.filter("edge is not null").select("part", "edge.*").orderBy("part").collect()
    totals = whole_runs([(bytes(e["first"]), bytes(e["last"]), e["head"], e["tail"]) for e in edges], rules)
    table = spark.createDataFrame([(e["part"], h, t) for e, (h, t) in zip(edges, totals, strict=True)], "part int, heads array<long>, tails array<long>")
    rows = runs.filter("node is not null").join(table, "part")
    n = F.transform("runs", lambda r, i: F.when(r.isin(HEAD, BOTH), F.get("heads", i)).when(r == TAIL, F.get("tails", i)).otherwise(r))
    fits = F.transform("sizes", lambda x, i: F.when(x <= rules.region, i))
    level = F.coalesce(F.array_min(F.filter(fits, lambda i: i.isNotNull())), F.lit(rules.deepest - rules.depth))
    rows = rows.withColumn("sizes", n).withColumn("level", level)
    found = rows.select(F.get("prefixes", F.col("level")).alias("region"), "node", F.get("sizes", F.col("level")).alias("n")).filter("n > 1")
    out = written(found, "near-members")
    discard(runs)
    return out


def forest(m: int, near) -> list[tuple[int, int]]:
    """Spanning forest of m things; near(u) says which others are linked to u."""
    left, out = np.ones(m, bool), []
    for root in range(m):
        todo = [root] if left[root] else []
        left[root] = False
        while todo and left.any():
            u = todo.pop()
            new = np.flatnonzero(near(u) & left)
            left[new] = False
            todo += new.tolist()
            out += [(u, v) for v in new.tolist()]
    return out


def bridges(labels: np.ndarray, near) -> list[tuple[int, int]]:
    """Links between things of different labels, enough to join all labels between which there are links. Those of the
    commonest label need not be asked: any other names its links with them."""
    _, label, count = np.unique(labels, return_inverse=True, return_counts=True)
    top, out = list(range(len(count))), []

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for u in np.flatnonzero(label != count.argmax()).tolist():
        hits = np.flatnonzero(near(u))
        others, first = np.unique(label[hits], return_index=True)
        for k, v in zip(others.tolist(), hits[first].tolist(), strict=True):
            if root(k) != root(int(label[u])):
                top[root(k)] = root(int(label[u]))
                out.append((u, v))
    return out


def spanning(rows: DataFrame, value: str, link) -> DataFrame:
    """(a, b): enough links of each unit of rows (task, unit, node, label, value) to join all that are linked, with
    links by link(values) -> near: a spanning forest, or bridges between labels where there are some. Rows of a unit
    are taken by node, so units that overlap mostly give the same links."""

    def span(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, unit in pdf.sort_values("node").groupby("unit", sort=False):
            nodes, labels = unit["node"].tolist(), unit["label"].tolist()
            if len(nodes) > 1:
                near = link(unit[value].tolist())
                edges = forest(len(nodes), near) if labels[0] is None else bridges(np.array(labels, object).astype("S16"), near)
                a += [min(nodes[u], nodes[v]) for u, v in edges]
                b += [max(nodes[u], nodes[v]) for u, v in edges]
        return pd.DataFrame({"a": a, "b": b})

    return rows.groupBy("large", "task").applyInPandas(span, "a binary, b binary").distinct()


def linked(rows: DataFrame, values: DataFrame, value: str, link, rules: NearRules, orders: int) -> DataFrame:
    """(a, b): links between the members of each group that join all of them that are linked. rows: (grp, node, n,
    blocks), written, n of the group that are to be compared in so many blocks. orders: how many times a group of several blocks
    is dealt to blocks at first."""
    tasks, none = max(1, rows.count() // rules.bucket_rows), F.lit(None).cast("binary")
    small = rows.filter("blocks = 1").select("node", F.xxhash64("grp").alias("unit"), F.lit(False).alias("large"), F.pmod(F.xxhash64("grp"), F.lit(tasks)).alias("task"))
    large = rows.filter("blocks > 1")
    dealt = large.select("*", F.explode(F.array(*(F.lit(i) for i in range(orders)))).alias("order")).withColumn("own", F.pmod(F.xxhash64("node", "grp", "order"), F.col("blocks")))
    dealt = dealt.select("node", F.xxhash64("grp", "order", "own").alias("unit"), F.lit(True).alias("large"))
    units = small.unionByName(dealt.withColumn("task", F.col("unit"))).withColumn("label", none)
    first = spanning(units.join(values, "node"), value, link)
    if not large.limit(1).count():
        return first
    first = written(first, "near-first")
    apart = rest_units(large, components(first))
    return first.union(spanning(apart.join(values, "node"), value, link)).distinct()


def rest_units(large: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label, unit, large, task): what is left to compare in groups that the components (node, label) do not hold
    together. A component of half a block or more has blocks of its own, all others share blocks; a row
    meets each block of its group but those of its own component."""
    rows = large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = rows.groupBy("grp", "label").agg(F.count("*").alias("held"), F.first("n").alias("n"), F.first("blocks").alias("blocks"))
    each = F.greatest(F.lit(1), F.floor(F.col("n") / F.col("blocks")))
    sizes = written(sizes.withColumn("own", F.col("held") * 2 >= each).withColumn("mine", F.ceil(F.col("held") / each).cast("int")), "near-sizes")
    left = F.sum(F.when(~F.col("own"), F.col("held")))
    # at most two blocks for each block's worth of a group
    plan = sizes.groupBy("grp").agg(
        F.count("*").alias("labels"), F.flatten(F.collect_list(F.when(F.col("own"), F.transform(F.sequence(F.lit(1), "mine"), lambda i: F.struct(F.col("label").alias("of"), i.alias("i")))))).alias("pure"),
        F.coalesce(F.ceil(left / F.max(each)).cast("int"), F.lit(0)).alias("shared"),
    ).filter("labels > 1")
    none = F.lit(None).cast("binary")
    mixed = F.transform(F.sequence(F.lit(1), "shared"), lambda i: F.struct(none.alias("of"), i.alias("i")))
    plan = plan.select("grp", "shared", F.concat("pure", F.when(F.col("shared") > 0, mixed).otherwise(F.array().cast("array<struct<of: binary, i: int>>"))).alias("all"))
    rows = rows.select("grp", "node", "label").join(sizes.select("grp", "label", "own", "mine"), ["grp", "label"]).join(plan, "grp")
    parts = F.when(F.col("own"), F.col("mine")).otherwise(F.col("shared"))
    at = F.struct(F.when(F.col("own"), F.col("label")).alias("of"), (F.pmod(F.xxhash64("node"), parts) + 1).cast("int").alias("i"))
    rows = rows.withColumn("at", at)
    others = F.filter("all", lambda x: (x != F.col("at")) & ~F.coalesce(x["of"] == F.col("at.of"), F.lit(False)))
    rows = rows.withColumn("other", F.explode(F.when(F.size("all") == 1, F.col("all")).otherwise(others)))
    return rows.select("node", "label", F.xxhash64("grp", F.least("at", "other"), F.greatest("at", "other")).alias("unit"), F.lit(True).alias("large")).withColumn("task", F.col("unit"))


def suspects(classes: DataFrame, rules: NearRules) -> DataFrame:
    """(a, b): links between classes whose signatures agree nearly enough, within regions."""

    def link(lows: list[bytes]):
        x = np.frombuffer(b"".join(lows), np.uint8).reshape(len(lows), -1)
        least = rules.least_agreement * x.shape[1]
        return lambda u: (x == x[u]).sum(1) >= least

    rows = members(classes, rules)
    named = rows.select(F.col("region").alias("grp"), "node", "n", F.ceil(F.col("n") / rules.signatures).cast("int").alias("blocks"))
    return linked(named, classes.select("node", "low"), "low", link, rules, 1)  # trees deal a large group differently


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs, by products of membership matrices over slices of the hashes that occur twice."""
    m = len(sets)
    values, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    often = np.cumsum(counts > 1) - 1
    keep = counts[where] > 1
    owner, column = owner[keep], often[where[keep]]
    out, width = np.zeros((m, m), np.float32), max(1, min(8192, 4_000_000 // m))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [start, start + width])
        x = np.zeros((m, width), np.float32)
        x[owner[lo:hi], column[lo:hi] - start] = 1
        out += x @ x.T
    return out


def full_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, rules: NearRules) -> DataFrame:
    """(node, hashes) of the given classes, from the text of each one's first document."""
    wanted = nodes.join(classes.select("node", "first_id", "tie"), "node")
    texts = pick(docs, "doc_id", "text").withColumn("h", F.xxhash64("text"))
    held = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["first_id"]) & (texts["h"] == wanted["tie"])).select("node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [shingle_set(t, rules.shingle) for t in texts_as_bytes(b)]
            same = [class_of(s) == n for s, n in zip(found, b.column(0).to_pylist(), strict=True)]  # a hash of a text may repeat
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "hashes"]).filter(pa.array(same, pa.bool_()))

    return in_arrow(held, sets, "node binary, hashes binary").dropDuplicates(["node"])


def confirmed(groups: DataFrame, sets: DataFrame, rules: NearRules) -> DataFrame:
    """(a, b): links between full sets within the groups (node, label)."""

    def link(found: list[bytes]):
        sets = [np.frombuffer(x, np.uint64) for x in found]
        sizes, shared = np.array([len(x) for x in sets]), shared_counts(sets).astype(np.int64)
        return lambda u: 100 * shared[u] >= rules.threshold_pct * (sizes[u] + sizes - shared[u])

    rows = groups.select(F.col("label").alias("grp"), "node").join(sets.select("node", (F.octet_length("hashes") / 8).alias("held")), "node")
    counts = rows.groupBy("grp").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / rules.sets), F.ceil(F.sum("held") / rules.block_values)).cast("int").alias("blocks"))
    return linked(written(rows.join(counts, "grp").drop("held"), "near-groups"), sets, "hashes", link, rules, 2)


def near_duplicates(docs: DataFrame, rules: NearRules = NearRules()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable over links, its own
    included) and kept (whether that is its own)."""
    drawn = written(sketches(docs, rules), "near-sketches")
    first = F.coalesce(F.min_by("tie", "doc_id"), F.first("tie"))
    classes = written(drawn.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), first.alias("tie"), F.first("sig").alias("sig"), F.first("low").alias("low")), "near-classes")
    groups = components(written(suspects(classes, rules), "near-suspects"))
    sets = written(full_sets(groups.select("node"), classes, docs, rules), "near-sets")
    labels = components(written(confirmed(groups, sets, rules), "near-links"))
    discard(groups, sets)
    grouped = classes.select("node", "first_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = grouped.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_class = grouped.join(smallest, "label").select("node", "component_id")
    with_words = drawn.filter("node is not null").select("doc_id", "n_shingles", "node").join(by_class, "node").drop("node")
    out = with_words.unionByName(drawn.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, rules: NearRules = FIVE_WORDS) -> DataFrame:
    """docs with one document of each group; all columns and their order stay. Repeated rows of it count once."""
    columns, flat = docs.columns, numbered(docs)
    key, text = f"c{columns.index('doc_id')}", f"c{columns.index('text')}"
    name = lambda c: F.coalesce(c.cast("string"), F.lit("n"))
    kept = near_duplicates(docs, rules).filter("kept").select(name(F.col("doc_id")).alias("id")).distinct()
    joined = flat.withColumns({"id": name(F.col(key)), "tie": F.xxhash64(text)}).join(kept, "id", "left_semi")
    return joined.dropDuplicates(["id", "tie"]).drop("id", "tie").toDF(*columns)
