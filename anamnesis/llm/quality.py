"""Quality rules: repetition coverage of documents.

Rolling hashes of several n-gram lengths, in numpy, measure how many characters of a
document lie inside n-grams or lines that occur more than once in it.

Defined results: a null or empty text has no words and fails the base rule; repeated rows
are judged alike and each returned; an empty table gives an empty result; extra columns are
ignored. Whole texts are measured, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from anamnesis.llm.common import in_arrow, numbered, pick, slices, texts_as_bytes

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
_ROLL = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class QualityRules:
    """Thresholds. Shares are of the characters inside words."""

    min_words: int = 50
    max_repeat_words_pct: int = 50
    ngrams: tuple[int, ...] = (5, 10)
    max_ngram_share: tuple[float, ...] = (0.30, 0.20)
    max_dup_line_share: float = 0.30
    max_symbols_per_word: float = 0.10


def covered(hashes: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words that lie in an n-gram occurring twice or more, first occurrence included."""
    marks = np.zeros(words + 1, np.int32)
    order = np.sort(hashes)
    twice = order[1:][order[1:] == order[:-1]]
    if len(twice):
        at = np.flatnonzero(np.isin(hashes, twice))
        np.add.at(marks, at, 1)
        np.add.at(marks, at + n, -1)
    return np.cumsum(marks[:-1]) > 0


def word_numbers(words: list[bytes]) -> tuple[np.ndarray, int]:
    """Each word's number in order of first occurrence, and how many there are."""
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(index.__getitem__, words), np.int64, len(words)), len(index)


def exact_trigrams(ids: np.ndarray, distinct: int) -> np.ndarray:
    """A number for each three-word window; equal if and only if the windows are."""
    pairs, width = ids[:-2] * distinct + ids[1:-1], distinct * distinct
    if width * distinct >= 2**62:
        pairs, _ = np.unique(pairs, return_inverse=True)[1], None
    return pairs * distinct + ids[2:]


def measure(text: bytes | None, ngrams: tuple[int, ...]) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, chars in duplicated n-grams...)."""
    b = text or b""
    words = b.split()
    n = len(words)
    ascii_only = b.isascii()

    def chars(x: bytes) -> int:
        return len(x) if ascii_only else len(x.decode("utf-8", "replace"))

    symbols = len(b) - len(b.translate(None, SYMBOLS))
    word_chars = chars(b.translate(None, SPACES))
    seen: set[bytes] = set()
    dup_lines = dup_line_chars = 0
    for line in b.split(b"\n"):
        if line in seen:
            dup_lines += 1
            dup_line_chars += chars(line.translate(None, SPACES))
        elif line.strip():
            seen.add(line)
    repeat, shares = 0, [0] * len(ngrams)
    if n >= 3:
        ids, distinct = word_numbers(words)
        if distinct < n:
            cover = covered(exact_trigrams(ids, distinct), 3, n)
            repeat = int(cover.sum())
        if repeat:  # a longer n-gram can only repeat where its three-word windows do
            lengths = np.fromiter((chars(w) for w in words), np.int64, n)
            mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            rolled, size = mixed, 1
            for k in range(2, max(ngrams) + 1):
                if n < k:
                    break
                rolled = rolled[: n - k + 1] * _ROLL + mixed[k - 1 :]
                size = k
                if size in ngrams:
                    shares[ngrams.index(size)] = int(lengths[covered(rolled, size, n)].sum())
    return (n, word_chars, symbols, dup_lines, repeat, dup_line_chars, *shares)


def verdict(m: tuple, rules: QualityRules) -> tuple[bool, bool]:
    """(base_failed, kept) of what measure() returns."""
    n, word_chars, symbols, _, repeat, line_chars, *grams = m
    base_failed = n < rules.min_words or 100 * repeat > rules.max_repeat_words_pct * n
    kept = (
        not base_failed
        and symbols <= rules.max_symbols_per_word * n
        and line_chars <= rules.max_dup_line_share * word_chars
        and all(g <= share * word_chars for g, share in zip(grams, rules.max_ngram_share, strict=True))
    )
    return base_failed, kept


def quality_report(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per document: doc_id, the base counts, the characters inside duplicated
    n-grams and lines, base_failed and kept. One pass over the texts, no shuffle."""
    grams = [f"dup_{n}gram_chars" for n in rules.ngrams]
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *grams]
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [measure(t, rules.ngrams) for t in texts_as_bytes(b)]
            said = [verdict(m, rules) for m in rows]
            cols = [pa.array([m[i] for m in rows], pa.int64()) for i in range(len(counts))]
            cols += [pa.array([x[i] for x in said], pa.bool_()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *cols], names=["doc_id", *counts, "base_failed", "kept"])

    return in_arrow(pick(docs, "doc_id", "text"), judge, schema)


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """docs without those that the rules reject; all columns and their order stay."""
    flat, at = numbered(docs), docs.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = texts_as_bytes(b, b.schema.field(at).name)
            keep = [verdict(measure(t, rules.ngrams), rules)[1] for t in texts]
            yield b.filter(pa.array(keep, pa.bool_()))

    return in_arrow(flat, judge, flat.schema).toDF(*docs.columns)
