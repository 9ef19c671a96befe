"""Mixing sources to target weights.

Each source's words are packed, in document order, into blocks of a fixed length. Output
shards draw how many slots they give to each source from a multinomial. A slot's ordinal
within its source goes through the source's pseudorandom index permutation (one per epoch),
which names a block; blocks are then joined by that index. Draws beyond a source's quota are
left out and what the draws missed fills extra shards, so each source gives its target to
the word: its last slot takes a prefix of its block.

Positions are prefix sums in two levels (hash buckets within a source, then documents within
a bucket), so no source, however hot, meets in one task. What reaches the driver is one row
per source: the mixture's own list of weights is as long.

Defined results: null and empty texts have size 0 and give nothing; null is a source of its
own; repeated rows are separate rows that share nothing; a very long text fills as many blocks as it needs,
and no task holds more of it than the text itself; an empty table gives an empty result; extra columns are ignored
by the report and carried by the mixed documents, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anamnesis.llm.common import n_words, numbered, pick, written

#: A 64-bit mixer's constants, and the rounds of the index permutations.
_MIX1, _MIX2, ROUNDS = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), 4


@dataclass(frozen=True)
class MixRules:
    """share: of all words, in percent, that the mix holds. most: times its size that a source may give."""

    weights: tuple[int, ...] = (3, 1, 2)
    share_pct: int = 150
    most: int = 2
    block_words: int = 128
    shard_slots: int = 4096
    bucket_rows: int = 50_000
    seed: int = 20240201


#: Slots that a task lays out, about. Shards whose draws are added up in one task.
TASK_SLOTS, RUN = 200_000, 4096


def code_point_order(sources: Sequence[str | None]) -> list[str | None]:
    return sorted((s for s in sources if s is not None)) + [s for s in sources if s is None]


def targets(sizes: Sequence[int], weights: Sequence[int], total: float, most: int) -> list[float]:
    """Shares of total by weight; none above `most` times its size, the excess reshared by weight until none is."""
    out, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def _scramble(x: np.ndarray, key: np.uint64) -> np.ndarray:
    x = (x ^ key) * _MIX1
    x ^= x >> np.uint64(33)
    x *= _MIX2
    return x ^ (x >> np.uint64(29))


def permuted(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 applied to index: a Feistel network over the next
    even number of bits, walked until it lands below n."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    low = np.uint64((1 << int(half)) - 1)
    keys = _scramble(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.uint64(key & (2**64 - 1)))

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> half, x & low
        for k in keys[::-1] if inverse else keys:
            if inverse:
                a, b = b ^ (_scramble(a, k) & low), a
            else:
                a, b = b, a ^ (_scramble(b, k) & low)
        return (a << half) | b

    x = once(index.astype(np.uint64))
    while (out := x >= np.uint64(n)).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


@dataclass(frozen=True)
class Source:
    """A source's part of the plan: slots of blocks, the last with last_words only."""

    name: str | None
    number: int
    size: int
    target: float
    blocks: int
    slots: int
    last_words: int


def key_of(seed: int, number: int, epoch: int) -> int:
    return (seed * 0x9E3779B97F4A7C15 + number * 0xC2B2AE3D27D4EB4F + epoch * 0x165667B19E3779F9) & (2**64 - 1)


def plan(stats: Sequence[tuple[str | None, int]], rules: MixRules = MixRules()) -> list[Source]:
    """The mixture from each source's size in words."""
    by = dict(stats)
    names = code_point_order(list(by))
    sizes = [by[s] for s in names]
    weights = [rules.weights[i % len(rules.weights)] for i in range(len(names))]
    out, length = [], rules.block_words
    for i, (name, size, t) in enumerate(zip(names, sizes, targets(sizes, weights, sum(sizes) * rules.share_pct / 100, rules.most), strict=True)):
        blocks, want = -(-size // length), round(t)
        slots, last = 0, 0
        if want:
            epochs, rest = divmod(want, size)
            slots, tail = epochs * blocks, size - (blocks - 1) * length
            short = int(permuted(np.array([blocks - 1]), blocks, key_of(rules.seed, i, epochs), inverse=True)[0])  # the short block's slot
            if not rest:
                last = tail if int(permuted(np.array([blocks - 1]), blocks, key_of(rules.seed, i, epochs - 1))[0]) == blocks - 1 else length
            elif rest <= short * length:
                slots, last = slots + -(-rest // length), (rest - 1) % length + 1
            elif rest <= short * length + tail:
                slots, last = slots + short + 1, rest - short * length
            else:
                over = rest - tail
                slots, last = slots + 1 + -(-over // length), (over - 1) % length + 1
        out.append(Source(name, i, size, t, blocks, slots, last))
    return out


def source_key(c: Column) -> Column:
    """Joins and groups that keep null as a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), c), F.lit("n"))


def sized(rows: DataFrame, doc_id: str, source: str, text: str, tie: Column, *also: str) -> DataFrame:
    """(row, doc_id, source, skey, size, tie, *also) of each row, written once, so that its number stays the same.
    tie orders rows of one doc_id."""
    key = source_key(F.col(source)).alias("skey")
    return written(rows.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), key, n_words(F.col(text)).alias("size"), tie.alias("tie"), *also), "mix-rows")


def positions(rows: DataFrame, rules: MixRules) -> DataFrame:
    """(row, doc_id, skey, size, start) of sized rows; start: the word of its source at which the row begins."""
    buckets = max(1024, rows.count() // rules.bucket_rows)
    rows = rows.select("row", "doc_id", "skey", "size", "tie", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)).alias("bucket"))
    sums = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("held"))
    up_to = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select("skey", "bucket", F.coalesce(F.sum("held").over(up_to), F.lit(0)).alias("first"))
    within = Window.partitionBy("skey", "bucket").orderBy("doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return inside.join(first, ["skey", "bucket"]).select("row", "doc_id", "skey", "size", (F.col("first") + F.col("inside")).alias("start"))


def shard_counts(spark: SparkSession, sources: list[Source], rules: MixRules) -> DataFrame:
    """(number, shard, first, count): the slots, by ordinal within the source, that each shard gives to a source.
    Each shard draws its counts alone, seeded by its number; draws beyond a quota are left out and what is
    missing fills extra shards at the end."""
    total = sum(s.slots for s in sources)
    shards, chances = -(-total // rules.shard_slots), np.array([s.slots for s in sources], float)
    chances, numbers, seed, per = chances / max(chances.sum(), 1), [s.number for s in sources], rules.seed, rules.shard_slots

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for j in b["id"]:
                got = np.random.Generator(np.random.PCG64([seed, int(j)])).multinomial(min(per, total - int(j) * per), chances)
                yield pd.DataFrame({"number": numbers, "shard": int(j), "count": got}).astype("int64")

    drawn = spark.range(shards).mapInPandas(draw, "number long, shard long, count long")
    quota = spark.createDataFrame([(s.number, s.slots) for s in sources], "number long, quota long")
    drawn = written(drawn.join(quota, "number").withColumn("run", F.floor(F.col("shard") / RUN)), "mix-draws")
    ahead = Window.partitionBy("number").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = drawn.groupBy("number", "run").agg(F.sum("count").alias("held")).select("number", "run", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("base"))
    before = Window.partitionBy("number", "run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("inside", F.coalesce(F.sum("count").over(before), F.lit(0))).join(runs, ["number", "run"]).withColumn("first", F.col("base") + F.col("inside"))
    kept = drawn.select("number", "shard", "first", F.greatest(F.lit(0), F.least("count", F.col("quota") - F.col("first"))).alias("count"))
    missed = drawn.groupBy("number").agg(F.max("quota").alias("quota"), F.sum("count").alias("got")).filter("got < quota")
    extra = missed.select("number", F.explode(F.expr(f"sequence(got, quota - 1, {per})")).alias("first"), "quota")
    extra = extra.select("number", (F.lit(shards) + F.floor(F.col("first") / per)).alias("shard"), "first", F.least(F.lit(per), F.col("quota") - F.col("first")).alias("count"))
    return kept.union(extra).filter("count > 0")


def slots(spark: SparkSession, sources: list[Source], rules: MixRules) -> DataFrame:
    """(skey, shard, slot, epoch, block, take): each slot of the mix and the block that it shows."""
    of, seed, length = {s.number: s for s in sources}, rules.seed, rules.block_words
    schema = "skey string, shard long, slot long, epoch long, block long, take long"

    def show(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for number, shard, first, count in b[["number", "shard", "first", "count"]].itertuples(index=False):
                s = of[int(number)]
                slot = np.arange(first, first + count, dtype=np.int64)
                epoch, index = np.divmod(slot, s.blocks)
                block = np.empty_like(slot)
                for e in np.unique(epoch):
                    block[epoch == e] = permuted(index[epoch == e], s.blocks, key_of(seed, s.number, int(e)))
                take = np.minimum(length, s.size - block * length)
                take[slot == s.slots - 1] = s.last_words
                yield pd.DataFrame({"skey": "n" if s.name is None else "s" + s.name, "shard": shard, "slot": slot, "epoch": epoch, "block": block, "take": take})

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(s.slots for s in sources) // TASK_SLOTS)
    dealt = shard_counts(spark, sources, rules).repartition(tasks, "number", "shard")  # few rows become many
    return dealt.mapInPandas(show, schema)


def spans(placed: DataFrame, length: int) -> DataFrame:
    """(skey, block, row, start, size, low, high): the words of each block that a row fills, counted within the block."""
    full = placed.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {length}, (start + size - 1) div {length})")))
    low = F.greatest(F.col("start") - F.col("block") * length, F.lit(0))
    high = F.least(F.col("start") + F.col("size") - F.col("block") * length, F.lit(length))
    return full.select("skey", "block", "row", "start", "size", low.alias("low"), high.alias("high"))


@dataclass
class Mix:
    sources: list[Source]
    placed: DataFrame
    shown: DataFrame


def mix(rows: DataFrame, rules: MixRules = MixRules()) -> Mix:
    """The mix of sized rows: the plan by source, every row's place in its source and every slot of the output."""
    spark = rows.sparkSession
    stats = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()  # a row for each source
    sources = plan([(r["source"], int(r["size"])) for r in stats], rules)
    return Mix(sources, written(positions(rows, rules), "mix-places"), slots(spark, sources, rules))


def mixed_spans(m: Mix, rules: MixRules = MixRules()) -> DataFrame:
    """One row per output slot and row in it: which words (from, to) of the row stand at which slot."""
    # the slots come from a small table, so Spark would take them to be small as well, and broadcast them
    joined = spans(m.placed, rules.block_words).join(m.shown.hint("merge"), ["skey", "block"]).filter("take > low")
    begin = F.col("block") * rules.block_words + F.col("low") - F.col("start")
    return joined.select("row", "skey", "size", "shard", "slot", "epoch", begin.alias("from"), (begin + F.least("high", "take") - F.col("low")).alias("to"))


def report_rows(docs: DataFrame) -> DataFrame:
    """docs as sized rows without their texts."""
    return sized(pick(docs, "doc_id", "source", "text"), "doc_id", "source", "text", F.xxhash64("text"))


def mix_report(docs: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """One row per document: doc_id, size, its source's size and target, and the words that the mix takes of it."""
    m = mix(report_rows(docs), rules)
    uses = m.shown.groupBy("skey", "block", "take").agg(F.count("*").alias("times"))
    filled = spans(m.placed, rules.block_words).join(uses.hint("merge"), ["skey", "block"])  # as in mixed_spans
    words = F.greatest(F.least("high", "take") - F.col("low"), F.lit(0)) * F.col("times")
    taken = filled.groupBy("row").agg(F.sum(words).alias("words"))
    names = docs.sparkSession.createDataFrame([("n" if s.name is None else "s" + s.name, s.size, s.target) for s in m.sources], "skey string, source_size long, target double")
    rows = m.placed.join(taken.hint("merge"), "row", "left").join(names, "skey")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"))


def cut(text: Column, runs: Column) -> Column:
    """The runs (from, to) of words of text, each as it stands there; line ends join runs that do not touch."""
    pieces = F.array(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"))  # a word each, with the space before it

    def joined(p: Column) -> Column:
        def run(r: Column, i: Column) -> Column:
            here = F.array_join(F.slice(p, (r["from"] + 1).cast("int"), (r["to"] - r["from"]).cast("int")), "")
            alone = F.concat(F.when(i > 0, "\n").otherwise(""), F.regexp_replace(here, r"\A[\x20\x09-\x0D]+", ""))
            return F.when((i > 0) & (F.try_element_at(runs, i)["to"] == r["from"]), here).otherwise(alone)

        return F.array_join(F.transform(runs, run), "")

    return F.transform(pieces, joined)[0]  # one split for all runs of a text


def mixed_documents(docs: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """The mix as documents, with the columns of docs: a row for each document and epoch that takes words of it.
    Where the epoch takes all its words the text is the document's own; else its runs of taken words, each as it
    stands in the text, joined by line ends, with n_chars (where there is one) set to the new length."""
    columns, numbers = docs.columns, numbered(docs)
    flat = numbers.columns
    at = {n: flat[columns.index(n)] for n in ("doc_id", "source", "text")}
    plain = [f.name for f in numbers.schema.fields if not f.dataType.simpleString().count("map<")]  # maps have no hash
    rows = sized(numbers, at["doc_id"], at["source"], at["text"], F.xxhash64(*plain), *flat)
    m = mix(rows, rules)
    pieces = mixed_spans(m, rules).groupBy("row", "size", "epoch").agg(F.sum(F.col("to") - F.col("from")).alias("words"), F.sort_array(F.collect_list(F.struct("from", "to"))).alias("runs"))
    whole = F.col("words") == F.col("size")
    joined = pieces.withColumn("runs", F.when(~whole, F.col("runs"))).drop("size", "words").hint("merge").join(rows.select("row", *flat), "row")
    text = F.when(F.col("runs").isNull(), F.col(at["text"])).otherwise(cut(F.col(at["text"]), F.col("runs")))
    out = joined.withColumn(at["text"], text)
    if "n_chars" in columns:
        c = flat[columns.index("n_chars")]
        out = out.withColumn(c, F.length(at["text"]).cast(numbers.schema[c].dataType))
    return out.select(*flat).toDF(*columns)
