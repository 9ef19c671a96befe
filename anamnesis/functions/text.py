"""Text functions as native Columns, and the exact case fold as an Arrow function."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from anamnesis.functions.constants import (
    MAX_NUMBER_LEN, MAX_QUERY_TERMS, MIN_TOKEN_LEN, SHORT_TOKENS, STEM_KEEP_S, STEM_RULES, STOPWORDS, SUBJECT_PREFIX, TECH_WORDS,
)

TOKEN = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: what a lambda only closes over is computed again for every element."""
    return F.transform(F.array(value), use)[0]


def words(*items: str) -> Column:
    return F.array(*(F.lit(x) for x in items))


def fold(c: Column) -> Column:
    """Lower case with ß as ss: the case fold of texts in composed form."""
    return F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ß"), F.lit("ss"))


def fold_exact(c: Column) -> Column:
    """NFKC and full Unicode case folding, for texts that fold() may differ on."""

    @F.pandas_udf("string")
    def folded(s: pd.Series) -> pd.Series:
        return s.fillna("").map(lambda t: unicodedata.normalize("NFKC", t).casefold())

    return folded(c)


def raw_tokens(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0))


def _noise(t: Column) -> Column:
    short = (F.length(t) < MIN_TOKEN_LEN) & ~t.isin(*SHORT_TOKENS)
    return short | (t.rlike(r"\A\p{Nd}+\z") & (F.length(t) > MAX_NUMBER_LEN))


def tokens(c: Column, folded: bool = False) -> Column:
    """Words without stopwords, single letters and long numbers, in order, repeats included."""
    return F.filter(raw_tokens(c if folded else fold(c)), lambda t: ~t.isin(*STOPWORDS) & ~_noise(t))


def identity_tokens(c: Column) -> Column:
    """The sorted distinct words that tokens() drops though they tell facts apart."""
    return F.array_sort(F.array_distinct(F.filter(raw_tokens(fold(c)), lambda t: ~t.isin(*STOPWORDS) & _noise(t))))


def stem(t: Column) -> Column:
    """A crude stem: the first rule that fits, tokens below four letters as they are."""
    keep = F.lit(False)
    for end in STEM_KEEP_S:
        keep = keep | F.endswith(t, F.lit(end))
    out = F.when(F.length(t) < 4, t)
    for suffix, new, least in STEM_RULES:
        fits = F.endswith(t, F.lit(suffix)) & (F.length(t) >= least)
        cut = F.concat(F.substring(t, F.lit(1), F.length(t) - len(suffix)), F.lit(new))
        out = out.when(fits & keep, t).when(fits, cut) if suffix == "s" else out.when(fits, cut)
    return out.otherwise(t)


def normalized(c: Column) -> Column:
    """The canonical form of a text: possessives and apostrophes gone, words joined by spaces; a text
    without words keeps its folded signs, and an empty one a constant that no text has."""
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"['’]s\b", ""), "['’]", "")
    every = F.filter(raw_tokens(fold(flat)), lambda t: F.lit(True))
    signs = F.trim(F.regexp_replace(fold(flat), r"\s+", " "))
    bare = F.when(F.length(signs) > 0, signs).otherwise(F.lit("\0punctuation-only\0"))
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).when(F.size(every) > 0, F.array_join(every, " ")).otherwise(bare)


def norm_hash(c: Column) -> Column:
    return F.sha1(normalized(c))


def trigrams(token_list: Column) -> Column:
    """Distinct three-character pieces of the tokens joined by spaces; a shorter string is its own piece."""


    def pieces(letters: Column) -> Column:
        three = F.transform(F.slice(letters, F.lit(1), F.size(letters) - 2), lambda x, i: F.concat(x, F.get(letters, i + 1), F.get(letters, i + 2)))
        return F.when(F.size(letters) >= 3, F.array_distinct(three)).otherwise(F.array(F.array_join(letters, "")))

    joined = F.array_join(token_list, " ")
    return F.when(F.size(token_list) > 0, let(F.split(joined, ""), pieces)).otherwise(F.array().cast("array<string>"))


def counted(token_list: Column) -> Column:
    """(term, tf) of each distinct word, in order: runs of the sorted words, each from its first word to the next one's."""

    def runs(words: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
        return let(starts, lambda s: F.transform(s, lambda at, k: F.struct(F.get(words, at).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(words)) - at).cast("long").alias("tf"))))

    none = F.array().cast("array<struct<term: string, tf: bigint>>")
    return let(F.sort_array(token_list), lambda w: F.when(F.size(w) > 0, runs(w)).otherwise(none))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the text has."""
    q, t = F.array_distinct(query), F.array_distinct(text)
    return F.when((F.size(q) == 0) | (F.size(t) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(q, t)) / F.size(q))


def refines(old: Column, new: Column) -> Column:
    """Whether new has all tokens of old and at least one more."""
    return (F.size(old) > 0) & (F.size(F.array_except(old, new)) == 0) & (F.size(F.array_except(new, old)) > 0)


def query_terms(token_list: Column) -> Column:
    """At most twelve terms; of more, the longest, repeats included."""
    indexed = F.transform(token_list, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))
    longest = F.transform(F.slice(F.array_sort(indexed), 1, MAX_QUERY_TERMS), lambda s: s["t"])
    return F.when(F.size(token_list) > MAX_QUERY_TERMS, longest).otherwise(token_list)


def summary(c: Column, limit: int) -> Column:
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 1), F.lit("…")))


def truncated(c: Column, limit: int = 8000) -> Column:
    """A tool's output up to limit characters, and how many were cut."""
    over = F.length(c) - limit
    return F.when(over > 0, F.concat(F.substring(c, 1, limit), F.lit("\n["), over.cast("string"), F.lit(" characters truncated]"))).otherwise(c)


def subject_weights(c: Column) -> Column:
    """(token, weight) of a dotted key: stems of its last level weigh 1, of those before it less."""
    levels = F.filter(F.split(F.coalesce(c, F.lit("")), r"[.\s:/-]+"), lambda x: x != "")
    parts = F.transform(levels, lambda x, i: F.struct(F.split(x, r"_+|(?<=[a-z0-9])(?=[A-Z])").alias("parts"), F.when(i == F.size(levels) - 1, 1.0).otherwise(SUBJECT_PREFIX).alias("w")))
    pairs = F.flatten(F.transform(parts, lambda p: F.flatten(F.transform(p["parts"], lambda x: F.transform(tokens(x), lambda t: F.struct(stem(t).alias("token"), p["w"].alias("weight")))))))
    return let(pairs, lambda all_: F.array_distinct(F.filter(all_, lambda p: ~F.exists(all_, lambda q: (q["token"] == p["token"]) & (q["weight"] > p["weight"])))))


def coverage(query_stems: Column, text_tokens: Column, subject_tokens: Column) -> Column:
    """Share of the query's stems that a text or its subject has, whole or by the first four letters."""
    have = F.array_distinct(F.concat(F.filter(text_tokens, lambda t: ~t.rlike(r"\A\p{Nd}+\z")), subject_tokens))
    stems = F.transform(have, lambda t: F.struct(stem(t).alias("stem"), (F.length(t) >= 4).alias("long")))

    def hits(known: Column) -> Column:
        # a stem counts whole, or by four letters: as such heads they are told apart by a sign that no word has
        marks = F.concat(known["stem"], F.transform(F.filter(known, lambda k: k["long"]), lambda k: F.concat(F.substring(k["stem"], 1, 4), F.lit("*"))))
        asked = lambda q: F.array(q, F.concat(F.substring(q, 1, 4), F.lit("*")))
        return let(marks, lambda all_: F.filter(query_stems, lambda q: F.arrays_overlap(all_, asked(q))))

    hit = let(stems, hits)
    return F.when(F.size(query_stems) == 0, F.lit(0.0)).otherwise(F.size(hit) / F.size(query_stems))


def complexity(c: Column) -> Column:
    """Score of a request: its length, technical words (three at most) and code or many lines."""
    w = F.filter(F.split(c, r"\s+"), lambda x: x != "")
    n = F.size(w)
    length = F.when(n > 50, 3).when(n > 20, 2).when(n > 10, 1).otherwise(0)
    hits = F.size(F.filter(w, lambda x: F.lower(x).isin(*TECH_WORDS)))
    code = F.when(F.contains(c, F.lit("```")) | (F.regexp_count(c, F.lit("\n")) > 2), 1).otherwise(0)
    return length + F.least(hits, F.lit(3)) + code
