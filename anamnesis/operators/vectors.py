"""Embeddings: the hashing embedder, any text-to-vector callable, coverage and staleness."""

from __future__ import annotations

import functools
import hashlib
import math
import re
import unicodedata
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.functions import text
from anamnesis.functions.lifecycle import c
from anamnesis.operators.scans import live

DIM, GRAM_WEIGHT, GRAMS = 256, 0.35, (3, 4)


def _slot(key: str, dim: int) -> tuple[int, float]:
    d = hashlib.blake2b(key.encode(), digest_size=8).digest()
    return int.from_bytes(d[:4], "big") % dim, 1.0 if d[4] & 1 else -1.0


def _grams(word: str) -> list[str]:
    padded = "^" + re.sub(r"[^a-z0-9]+", " ", unicodedata.normalize("NFKC", word).casefold()) + "$"
    return [padded[i : i + n] for n in GRAMS for i in range(len(padded) - n + 1)]


@functools.lru_cache(maxsize=1 << 16)
def _word(word: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The slots that a word and its letter groups add to, in order, and what they add."""
    found = [(*_slot(word, dim), 1.0), *((*_slot("#" + g, dim), GRAM_WEIGHT) for g in _grams(word))]
    return np.array([i for i, _, _ in found], np.uint16 if dim <= 1 << 16 else np.int64), np.array([sign * w for _, sign, w in found])


#: Words that are added up at a time.
WORDS = 4096


def hashed(token_list: Sequence[str], dim: int = DIM) -> list[float]:
    """A unit vector of signed hashes of words and their letter groups, added up in single precision; zero without words.
    All slots take their next summand at once, so each is rounded as often as if they were added one by one."""
    v = np.zeros(dim, np.float32)
    for at in range(0, len(token_list), WORDS):
        parts = [_word(t, dim) for t in token_list[at : at + WORDS]]
        slots, summands = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(slots, kind="stable")
        slots, counts = slots[order], np.bincount(slots, minlength=dim)
        rounds = np.zeros((counts.max(), dim))
        rounds[np.arange(len(slots)) - (np.cumsum(counts) - counts)[slots], slots] = summands[order]
        for r in rounds:
            v = (v.astype(np.float64) + r).astype(np.float32)
    total = math.fsum(float(x) * float(x) for x in v)
    return (v.astype(np.float64) / math.sqrt(total)).astype(np.float32).tolist() if total > 0 else v.tolist()


def embedded(rows: DataFrame, encode: Callable[[list], list] | None = None) -> DataFrame:
    """(id, vec) of rows (id, text): by encode(texts) -> vectors, a batch at a time, or by hashing the tokens."""

    @F.pandas_udf("array<float>")
    def hashing(tokens: pd.Series) -> pd.Series:
        return tokens.map(hashed)

    @F.pandas_udf("array<float>")
    def external(texts: pd.Series) -> pd.Series:
        return pd.Series(list(encode(texts.tolist())), index=texts.index)

    return rows.select("id", (external(c("text")) if encode else hashing(text.tokens(c("text")))).alias("vec"))


def packed(vec) -> F.Column:
    """A vector as little-endian single-precision bytes, for exchange."""

    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return pack(vec)


def unpacked(blob, dim: int) -> F.Column:
    """The vector in such bytes; null where the length is another."""

    @F.pandas_udf("array<float>")
    def unpack(b: pd.Series) -> pd.Series:
        return b.map(lambda x: np.frombuffer(x, "<f4").tolist() if x is not None and len(x) == 4 * dim else None)

    return unpack(blob)


def unit(vec) -> F.Column:
    """The vector at length 1; a zero vector as it is."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vec, lambda x: x / norm)).otherwise(F.transform(vec, lambda x: x.cast("double")))


def coverage(mem: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """(live, indexed, missing, rows_total) of one model's vectors."""
    own = vectors.filter(c("model") == model).select(c("memory_id").alias("id")).distinct().withColumn("has", F.lit(True))
    counted = live(mem).select("id").join(own, "id", "left").agg(F.count("*").alias("live"), F.count("has").alias("indexed"))
    return counted.withColumn("missing", c("live") - c("indexed")).join(F.broadcast(vectors.agg(F.count("*").alias("rows_total"))))  # two rows of one each


def stale(mem: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """(id, state): live rows whose vector is missing or older than their text."""
    own = vectors.filter(c("model") == model).select(c("memory_id").alias("id"), c("updated_at").alias("vector_at"), F.lit(True).alias("has"))
    rows = live(mem).join(own, "id", "left")
    older = F.when(c("updated_at").isNull(), c("vector_at").isNull()).otherwise(F.coalesce(c("vector_at") < c("updated_at"), F.lit(True)))
    state = F.when(c("has").isNull(), "missing").when(older, "stale")
    return rows.withColumn("state", state).filter("state is not null").select("id", "state")
