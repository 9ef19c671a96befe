"""The suffix stripping algorithm of M. F. Porter, An algorithm for suffix stripping (1980).

It is run on distinct words only, so an Arrow function over a vocabulary is enough.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The paper's tables of steps 2, 3 and 4.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(w: str) -> str:
    """v for each vowel, c for each other letter; y is a vowel after another letter that is none."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _short(w: str) -> bool:
    """Whether it ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(w).endswith("cvc") and w[-1] not in "wxy"


def _replaced(w: str, table, least: int) -> str:
    for suffix, new in sorted(table, key=lambda r: -len(r[0])):
        if w.endswith(suffix):
            head = w[: -len(suffix)]
            return head + new if _measure(head) > least else w
    return w


def porter(w: str) -> str:
    if len(w) < 3 or not w.isascii():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and "v" in _shape(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and "v" in _shape(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")) or (_measure(cut) == 1 and _short(cut)):
            w = cut + "e"
        else:
            w = cut[:-1] if _double(cut) and cut[-1] not in "lsz" else cut
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, STEP2, 0), STEP3, 0)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            head = w[: -len(suffix)]
            if _measure(head) > 1 and (suffix != "ion" or head.endswith(("s", "t"))):
                w = head
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if _measure(w) > 1 and w.endswith("ll") else w


def stemmed(rows: DataFrame, column: str = "term") -> DataFrame:
    """rows with the words of a column stemmed: each distinct word once, then joined back."""

    @F.pandas_udf("string")
    def stem(words: pd.Series) -> pd.Series:
        return words.map(porter)

    words = rows.select(column).distinct().withColumn("stem", stem(F.col(column)))
    return rows.join(words, column).withColumn(column, F.col("stem")).drop("stem")
