"""Benchmark decontamination: a BM25 inverted index of test items, queried with every passage by block-max WAND.

Items are cut into segments of at most half a passage, so that a segment that occurs in a
document lies whole in one of its passages (windows of `passage` words, half overlapping).
A segment's BM25 weights are divided by its score against itself; a passage retrieves every
segment that scores `threshold` or more. Document frequencies and the mean length are those
of all segments, taken in one aggregate, so a score does not depend on how items are grouped.

Each term has a list of the segments that hold it, in their order, and its greatest weight in
each block of consecutive segments. A passage first adds up its terms' block maxima, for many
passages at once in arrays: blocks whose sum misses the threshold are dead. Through its live
blocks it goes by pivots: with the lists in the order of their next segments, the pivot is the
first segment at which the greatest weights of the lists so far reach the threshold. Lists
behind it skip to it, dead blocks are skipped whole, and only a segment that the pivot's lists
have reached is scored. Retrieved items are then verified on the whole document. It holds an item if it
holds half of the item's five-word shingles, or half of those of its question (all but its
end) and of its answer (its end) each. Items of fewer than 14 words have too few shingles for
that: from five words on, they are also found if a stretch of the document is within one
word (changed, added or left out) of them. So one changed word, wherever it stands, hides no
item that was retrieved, and neither does a missing last quarter of an item of eight words or more.

Items are taken in groups of bounded size, each with an index and a broadcast of its own, and
several groups in one pass over the documents, so neither what a task holds nor what is
broadcast at once grows with the benchmark. Documents go through the index in stretches of
bounded size, so neither grows with the longest document either. Defined results:
items of null or empty text and documents without words match nothing; an item with a null item_id counts like others; an item of fewer than ten
words is question and answer at once; repeated documents and items are each judged; empty
tables give empty results (no items: every document is clean); extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.common import discard, in_arrow, numbered, pick, slices, written

#: ASCII characters that end a word, as a table for bytes; and the others, which only texts beyond ASCII have.
_CUT = bytes(c if c >= 0x80 or chr(c).isalnum() or c == 0x5F else 0x20 for c in range(256))
_ODD = re.compile(r"[^\w\x00-\x7F]+")


@dataclass(frozen=True)
class LeakRules:
    """threshold: of a segment's score against itself. overlap: least share of the item's shingles, or of question and of answer shingles.
    block: segments of a block. common: share of the blocks above which a term's maxima are added up by a matrix, not by its list.
    items, item_bytes: size of a group of items, about (one larger item is a group's worth alone). groups: of one pass.
    cells: sums of a passage on a block that are held at once, about."""

    passage: int = 128
    threshold: float = 0.5
    overlap: float = 0.5
    shingle: int = 5
    block: int = 4
    common: float = 0.05
    k1: float = 1.2
    b: float = 0.75
    items: int = 5000
    item_bytes: int = 4_000_000
    groups: int = 8
    cells: int = 1 << 20


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and _, as UTF-8."""
    if not text:
        return []
    t = text.lower()
    if not t.isascii():
        t = _ODD.sub(" ", t)
    return t.encode("utf-8", "replace").translate(_CUT).split()


def shingles(words: Sequence[bytes], n: int) -> set[tuple[bytes, ...]]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def segments(words: list[bytes], rules: LeakRules) -> list[list[bytes]]:
    """An item's words in equal parts of at most half a passage."""
    parts = -(-len(words) // (rules.passage // 2))
    return [words[len(words) * j // parts : len(words) * (j + 1) // parts] for j in range(parts)]


@dataclass(frozen=True)
class Statistics:
    """Of all items: segments, their words, and for the terms at hand the segments that hold each."""

    n: int
    words: int
    df: dict[bytes, int]


def statistics_of(items: Sequence[tuple[int, str]], rules: LeakRules) -> Statistics:
    """The statistics of items that are all there are."""
    cut = [s for _, t in items for s in segments(words_of(t), rules)]
    return Statistics(len(cut), sum(map(len, cut)), Counter(t for s in cut for t in set(s)))


class Index:
    """An inverted index of a group of items (item_id, text), with block maxima."""

    def __init__(self, items: Sequence[tuple[int, str]], rules: LeakRules, of: Statistics | None = None):
        self.rules, of = rules, of or statistics_of(items, rules)
        self.items = [(i, w) for i, t in items if (w := words_of(t))]
        cut = [(k, s) for k, (_, w) in enumerate(self.items) for s in segments(w, rules)]
        cut.sort(key=lambda s: (len(s[1]), s[0]))  # alike in length, so a block's maxima are near its members'
        self.owner, self.vocabulary = [k for k, _ in cut], {}
        self.size, self.blocks, mean = len(cut), -(-len(cut) // rules.block), of.words / max(1, of.n)
        lists: list[list[tuple[int, float]]] = []  # of each term: segments in their order, and its weight there
        for s, (_, words) in enumerate(cut):
            weight = {}
            for t, f in Counter(words).items():
                idf = math.log(1 + (of.n - of.df[t] + 0.5) / (of.df[t] + 0.5))
                weight[t] = idf * f * (rules.k1 + 1) / (f + rules.k1 * (1 - rules.b + rules.b * len(words) / mean))
            own = sum(weight.values())
            for t, x in weight.items():
                k = self.vocabulary.setdefault(t, len(self.vocabulary))
                if k == len(lists):
                    lists.append([])
                lists[k].append((s, x / own))
        self.posted = [np.array([s for s, _ in x], np.int32) for x in lists]
        self.weights = [np.array([w for _, w in x]) for x in lists]
        self.greatest = np.array([w.max() for w in self.weights])
        tops = []  # of each term: its blocks and its greatest weight in each
        for at, w in zip(self.posted, self.weights, strict=True):
            blocks, first = np.unique(at // rules.block, return_index=True)
            tops.append((blocks, np.maximum.reduceat(w, first)))
        often = np.array([len(b) > rules.common * self.blocks for b, _ in tops], bool)
        self.dense = np.full(len(tops) + 1, -1)
        self.dense[:-1][often] = np.arange(often.sum())
        self.matrix = np.zeros((int(often.sum()), self.blocks), np.float32)
        for t in np.flatnonzero(often):
            self.matrix[self.dense[t], tops[t][0]] = tops[t][1]
        rest = [(b[:0], w[:0]) if often[t] else (b, w) for t, (b, w) in enumerate(tops)]
        self.first = np.concatenate([[0], np.cumsum([len(b) for b, _ in rest])]).astype(np.int64)
        self.block_of = np.concatenate([b for b, _ in rest] or [np.empty(0)]).astype(np.int64)
        self.top = np.concatenate([w for _, w in rest] or [np.empty(0)])
        cover = []
        for _, w in self.items:
            whole = [tuple(w[i : i + rules.shingle]) for i in range(len(w) - rules.shingle + 1)]
            end = max(rules.shingle, len(w) // 4)
            question, answer = (w[:-end], w[-end:]) if len(w) >= 2 * rules.shingle else (w, w)
            cover.append((shingles(question, rules.shingle), shingles(answer, rules.shingle), whole))
        self.cover = cover

    def traversed(self, terms: np.ndarray, live: np.ndarray) -> list[tuple[int, float]]:
        """(segment, score) of all segments in the live blocks (in order) that terms (distinct) score at the threshold or above."""
        rules, out, at = self.rules, [], int(live[0]) * self.rules.block
        heads = []  # [next segment, term, place in its list]
        for t in terms.tolist():
            place = int(self.posted[t].searchsorted(at))
            if place < len(self.posted[t]):
                heads.append([int(self.posted[t][place]), t, place])

        def skip(head: list[int], to: int) -> bool:
            """Moves a list to its first segment from `to` on; false at its end."""
            own = self.posted[head[1]]
            head[2] += int(own[head[2] :].searchsorted(to))
            if head[2] == len(own):
                return False
            head[0] = int(own[head[2]])
            return True

        while heads:
            heads.sort()
            bound, pivot = 0.0, -1
            for i, h in enumerate(heads):
                bound += self.greatest[h[1]]
                if bound >= rules.threshold - 1e-9:
                    pivot = i
                    break
            if pivot < 0:
                break
            segment = heads[pivot][0]
            block = int(live.searchsorted(segment // rules.block))
            if block == len(live):
                break
            to = max(segment, int(live[block]) * rules.block)  # past dead blocks
            if to > segment or heads[0][0] < segment:
                heads = [h for h in heads if h[0] >= to or skip(h, to)]
                if to > segment:
                    continue
                heads.sort()
            here = [h for h in heads if h[0] == segment]
            score = math.fsum(self.weights[h[1]][h[2]] for h in here)  # exact, so in no order
            if score >= rules.threshold - 1e-9:
                out.append((segment, score))
            heads = [h for h in heads if h[0] > segment or skip(h, segment + 1)]
        return out

    def retrieved(self, docs: Sequence[list[bytes]]) -> dict[tuple[int, int], float]:
        """{(document, item): best score} of all passages' segments above the threshold. docs: their words. A document
        longer than a stretch is cut into several, which overlap by the half passage that two of them share."""
        half, found = self.rules.passage // 2, {}
        if not self.size:
            return found
        step = max(1, self.rules.cells // self.blocks)  # half passages of a stretch
        batch, held = [], 0
        for d, words in enumerate(docs):
            for at in range(0, len(words), step * half):
                part = words[at : at + (step + 1) * half]
                batch.append((d, part))
                held += -(-len(part) // half)
                if held >= step:
                    self._retrieve(batch, found)
                    batch, held = [], 0
        self._retrieve(batch, found)
        return found

    def _retrieve(self, parts: Sequence[tuple[int, list[bytes]]], found: dict[tuple[int, int], float]) -> None:
        """Adds what the stretches (document, words) retrieve to found."""
        if not parts:
            return
        rules, half, docs = self.rules, self.rules.passage // 2, [w for _, w in parts]
        lengths = np.fromiter(map(len, docs), np.int64, len(docs))
        chunks = -(-lengths // half)
        base = np.concatenate([[0], np.cumsum(chunks)])
        get, n = self.vocabulary.get, int(lengths.sum())
        ids = np.fromiter((get(w, -1) for d in docs for w in d), np.int64, n)
        begin = np.concatenate([[0], np.cumsum(lengths)])
        doc = np.repeat(np.arange(len(docs)), lengths)
        chunk = base[doc] + (np.arange(n) - begin[doc]) // half
        known = np.flatnonzero(ids >= 0)
        listed = self.first[ids[known] + 1] - self.first[ids[known]]
        known, listed = known[listed > 0], listed[listed > 0]
        at = np.repeat(self.first[ids[known]] - np.concatenate([[0], np.cumsum(listed)[:-1]]), listed) + np.arange(int(listed.sum()))
        cells = np.repeat(chunk[known], listed) * self.blocks + self.block_of[at]
        bounds = np.bincount(cells, self.top[at], int(base[-1]) * self.blocks).reshape(-1, self.blocks).astype(np.float32)
        owner = np.repeat(np.arange(len(docs)), chunks)
        there, term = np.zeros((len(bounds), len(self.matrix)), np.float32), self.dense[ids]
        there[chunk[term >= 0], term[term >= 0]] = 1
        if len(bounds) > 1:  # a passage is a chunk and the next of the same document
            joined = (owner[1:] == owner[:-1])[:, None]
            bounds[:-1] += bounds[1:] * joined  # rows ahead are still as they were
            np.maximum(there[:-1], there[1:] * joined, out=there[:-1])
        live = bounds + there @ self.matrix >= rules.threshold - 1e-4
        for window in np.flatnonzero(live.any(1)).tolist():
            d = int(owner[window])
            start = int(begin[d]) + (window - int(base[d])) * half
            terms = np.unique(ids[start : min(start + rules.passage, int(begin[d + 1]))])
            for segment, score in self.traversed(terms[terms >= 0], np.flatnonzero(live[window])):
                k = (parts[d][0], self.owner[segment])
                found[k] = max(found.get(k, 0.0), score)

    def verified(self, docs: Sequence[list[bytes]]) -> list[tuple[int, int, float, float, float]]:
        """(document, item_id, score, question share, answer share) of retrieved items that the document holds."""
        out, held, last = [], set(), -1
        for (d, k), score in sorted(self.retrieved(docs).items()):
            question, answer, whole = self.cover[k]
            if d != last:
                held, last = shingles(docs[d], self.rules.shingle), d
            sizes = {len(s) for part in (question, answer) for s in part}
            own = held if sizes == {self.rules.shingle} else held.union(*(shingles_of(docs[d], n) for n in sizes))
            q, a = len(question & own) / len(question), len(answer & own) / len(answer)
            holds = q >= self.rules.overlap and a >= self.rules.overlap
            holds = holds or bool(whole) and sum(s in held for s in whole) >= self.rules.overlap * len(whole)
            words = self.items[k][1]
            if holds or self.rules.shingle <= len(words) < 3 * self.rules.shingle - 1 and within_one_word(docs[d], words):
                out.append((d, self.items[k][0], score, q, a))
        return out


def shingles_of(words: Sequence[bytes], n: int) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def within_one_word(words: Sequence[bytes], item: Sequence[bytes]) -> bool:
    """Whether a stretch of words is the item with at most one word changed, added or left out."""
    n, where = len(item), {}
    for p, w in enumerate(words):
        where.setdefault(w, []).append(p)
    for cut in range(n):  # all before the word at cut, and all after it, stand as they are
        head, tail = list(item[:cut]), list(item[cut + 1 :])
        first = tail[0] if not head else head[0]
        for p in where.get(first, ()):
            if not head:
                starts = (p,)  # the first word is another or missing
            elif list(words[p : p + cut]) != head:
                continue
            else:
                starts = (p + cut, p + cut + 1)  # the word left out, or another in its place
                if list(words[p + cut + 1 : p + 1 + n]) == list(item[cut:]):  # one added before it
                    return True
            if any(list(words[s : s + len(tail)]) == tail for s in starts):
                return True
    return False


def counted(items: DataFrame, rules: LeakRules) -> DataFrame:
    """(part, term, df) for each group of items and term in it: the segments of all items that hold the term. The null
    term has each group's segments, and their words under the empty one."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            held: dict[int, Counter] = {}
            for part, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = held.setdefault(part, Counter())
                for s in segments(words_of(text), rules):
                    own.update(set(s))
                    own[None] += 1
                    own[b""] += len(s)
            rows = [(p, t, n) for p, c in held.items() for t, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.int64()))], names=["part", "term", "n"])

    each = written(in_arrow(items.select("part", "text"), terms, "part long, term binary, n long").groupBy("part", "term").agg(F.sum("n").alias("n")), "leak-counts")
    df = each.groupBy(F.col("term").alias("t")).agg(F.sum("n").alias("df"))
    out = written(each.select("part", "term").join(df, F.col("term").eqNullSafe(F.col("t"))).drop("t"), "leak-terms")
    discard(each)
    return out


def indexes(benchmark: DataFrame, rules: LeakRules) -> Iterator[Index]:
    """An index for each group of items, one after the other: about rules.items of them and rules.item_bytes of text."""
    items = pick(benchmark, "item_id", "text").filter("text != ''")
    n, held = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(-(-n // rules.items), -(-held // rules.item_bytes))
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) if parts else F.lit(0).cast("long"))
    terms = counted(items, rules) if parts > 1 else None
    for g in range(parts):
        rows = sorted(((r["item_id"], r["text"]) for r in items.filter(F.col("part") == g).collect()), key=lambda i: (i[0] is None, i[0] or 0, i[1]))  # a group's rows only
        of = None
        if terms is not None:
            df = {None if r["term"] is None else bytes(r["term"]): r["df"] for r in terms.filter(F.col("part") == g).collect()}
            of = Statistics(df.pop(None, 0), df.pop(b"", 0), df)
        yield Index(rows, rules, of)
    if terms is not None:
        discard(terms)


def passes(benchmark: DataFrame, rules: LeakRules) -> Iterator[list]:
    """The indexes as broadcasts, in lists of rules.groups: each list for one pass over the documents."""
    spark, all_ = benchmark.sparkSession, indexes(benchmark, rules)
    while held := [spark.sparkContext.broadcast(index) for index in islice(all_, rules.groups)]:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame, rules: LeakRules = LeakRules()) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, score, question_overlap,
    answer_overlap. Clean documents have no row. One pass over the texts for rules.groups groups of items, no shuffle."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
    texts = pick(docs, "doc_id", "text")

    def found(shared: list) -> DataFrame:
        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, 256):
                ids, words = b.column(0).to_pylist(), [words_of(t) for t in b.column(1).to_pylist()]
                rows = [(ids[d], *rest) for index in shared for d, *rest in index.value.verified(words)]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        return in_arrow(texts, judge, schema)

    parts = [found(shared) for shared in passes(benchmark, rules)]
    return reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, rules: LeakRules = LeakRules()) -> DataFrame:
    """docs without those in which an item was found; all columns and their order stay. Where the items need several
    passes, what each leaves is written as the next one's documents."""
    at, out = docs.columns.index("text"), numbered(docs)
    schema, before = out.schema, None

    def clean(rows: DataFrame, shared: list) -> DataFrame:
        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, 256):
                words = [words_of(t) for t in b.column(at).to_pylist()]
                hit = {d for index in shared for d, *_ in index.value.verified(words)}
                yield b.filter(pa.array([i not in hit for i in range(b.num_rows)], pa.bool_()))

        return in_arrow(rows, judge, schema)

    for n, shared in enumerate(passes(benchmark, rules)):
        held = written(out, "leak-pass") if n else out
        if before is not None:
            discard(before)
        before, out = held if n else None, clean(held, shared)
    return out.toDF(*docs.columns)
