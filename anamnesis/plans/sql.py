"""Pieces of DuckDB SQL that say what the native text and lifecycle functions compute."""

from __future__ import annotations

from anamnesis.functions.constants import MAX_NUMBER_LEN, SHORT_TOKENS, STEM_KEEP_S, STEM_RULES, STOPWORDS, TECH_WORDS
from anamnesis.plans.memories import NOW


def listed(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


FOLD = "replace(lower({0}), 'ß', 'ss')"
NOISE = f"((length(t) < 2 AND NOT list_contains({listed(SHORT_TOKENS)}, t)) OR (regexp_full_match(t, '\\p{{Nd}}+') AND length(t) > {MAX_NUMBER_LEN}))"
STOP = f"list_contains({listed(STOPWORDS)}, t)"


def raw(x: str) -> str:
    return f"regexp_extract_all({FOLD.format(x)}, '[\\p{{L}}\\p{{N}}]+(?:[''’][\\p{{L}}\\p{{N}}]+)*')"


def toks(x: str) -> str:
    return f"[t FOR t IN {raw(x)} IF NOT {STOP} AND NOT {NOISE}]"


def idents(x: str) -> str:
    return f"list_sort(list_distinct([t FOR t IN {raw(x)} IF NOT {STOP} AND {NOISE}]))"


def stem(t: str) -> str:
    keep = " OR ".join(f"ends_with({t}, '{e}')" for e in STEM_KEEP_S)
    rules = ""
    for suffix, new, least in STEM_RULES:
        if suffix == "s":
            rules += f" WHEN ends_with({t}, 's') AND ({keep}) THEN {t}"
        rules += f" WHEN length({t}) >= {least} AND ends_with({t}, '{suffix}') THEN substr({t}, 1, length({t}) - {len(suffix)}) || '{new}'"
    return f"CASE WHEN length({t}) < 4 THEN {t}{rules} ELSE {t} END"


def normalized(x: str) -> str:
    flat = f"regexp_replace(regexp_replace({x}, '[''’]s\\b', '', 'g'), '[''’]', '', 'g')"
    return f"array_to_string({raw(flat)}, ' ')"


def trigrams(tokens: str) -> str:
    j = f"array_to_string({tokens}, ' ')"
    return f"CASE WHEN length({j}) >= 3 THEN list_distinct([substr({j}, i, 3) FOR i IN range(1, length({j}) - 1)]) WHEN length({j}) > 0 THEN [{j}] ELSE [] END"


DAYS = f"greatest(0::DOUBLE, epoch(TIMESTAMP '{NOW}' - last_accessed_at) / 86400::DOUBLE)"
FLOOR = "0.35::DOUBLE * importance"
DECAYED = f"({FLOOR} + greatest(0::DOUBLE, confidence_score - {FLOOR}) * exp(-decay_rate * {DAYS}))"
IDLE = "365::DOUBLE * (0.5::DOUBLE + importance)"
SALIENCE = f"(0.40::DOUBLE * confidence_score + 0.30::DOUBLE * importance + 0.20::DOUBLE * exp(-{DAYS} / 45) + 0.10::DOUBLE * least(1::DOUBLE, ln(1::DOUBLE + access_count) / ln(11::DOUBLE)))"


def complexity(x: str) -> str:
    w = f"[w FOR w IN regexp_split_to_array({x}, '\\s+') IF w <> '']"
    n = f"len({w})"
    hits = f"len([w FOR w IN {w} IF list_contains({listed(TECH_WORDS)}, lower(w))])"
    code = f"CASE WHEN contains({x}, '```') OR length({x}) - length(replace({x}, chr(10), '')) > 2 THEN 1 ELSE 0 END"
    return f"(CASE WHEN {n} > 50 THEN 3 WHEN {n} > 20 THEN 2 WHEN {n} > 10 THEN 1 ELSE 0 END + least({hits}, 3) + {code})"
