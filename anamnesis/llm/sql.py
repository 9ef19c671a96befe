"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

import re

from anamnesis.llm.chat_format import BEGIN, END, ChatRules
from anamnesis.llm.common import UPPER
from anamnesis.llm.near_dedup import NearRules
from anamnesis.llm.quality import QualityRules
from anamnesis.llm.secret_scan import BASE_RULES, RULES
from anamnesis.llm.url_filter import HOST_RULES, PATTERN_RULES, rarest_tokens

WORDS = "regexp_extract_all(coalesce({0}, ''), '[^\\x20\\x09-\\x0D]+')"


def text(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def any_case(pattern: str) -> str:
    """The pattern with each ASCII letter outside classes and escapes in either case; (?i) would fold other letters to them."""
    return re.sub(r"(\\.[0-9]*|\[[^]]+\])|([A-Za-z])", lambda m: m[1] or f"[{m[2].upper()}{m[2].lower()}]", pattern)


def secret_scan() -> str:
    parts = []
    for k, r in enumerate(RULES):
        pattern = text(any_case(r.pattern) if r.any_case else r.pattern)
        cut = f"SELECT doc_id, regexp_extract_all(t, {pattern}) AS m, regexp_extract_all(t, {pattern}, {r.group}) AS v, regexp_split_to_array(t, {pattern}) AS g FROM d"
        at = "coalesce(list_sum([length(x) FOR x IN g[1:i]]), 0) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0)"
        parts.append(f"SELECT doc_id, {k} AS k, '{r.name}' AS name, {at} AS s, {at} + length(m[i]) AS e FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM ({cut})) WHERE length(v[i]) >= {r.least}")
    base, joined = len(BASE_RULES), "coalesce(string_agg({0}, ',' ORDER BY s, k), '')"
    span = "name || ':' || s::BIGINT || ':' || e::BIGINT"
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{r.name}" for k, r in enumerate(BASE_RULES))
    found = f"SELECT doc_id, {counts}, sha256(coalesce(string_agg({span}, ',' ORDER BY s, k) FILTER (k < {base}), '')) AS base_sha256, {joined.format(span)} AS spans FROM f GROUP BY doc_id"
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(parts)}), r AS ({found}) SELECT d.doc_id, "
        + ", ".join(f"coalesce(n_{r.name}, 0) AS n_{r.name}" for r in BASE_RULES)
        + ", coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN r USING (doc_id)"
    )


def url_filter() -> str:
    rules = HOST_RULES + PATTERN_RULES
    tokens = rarest_tokens(rules)
    hosts = ", ".join(f"({text(r.text)}, {text(r.text.split('/', 1)[0])}, {text('/' + r.text.split('/', 1)[1])}, '{r.action}')" for r in HOST_RULES)

    def hit(action: str) -> str:
        return " OR ".join(f"regexp_matches(target, {text(r.regex())})" for r in PATTERN_RULES if r.action == action)

    fetched = " + ".join("1" if t is None else f"list_contains(words, {text(t)})::INTEGER" for t in tokens)
    lower = f"translate(x.host, '{UPPER}', '{UPPER.lower()}')"
    return f"""WITH x AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^(.*?)://([^/?#]*)([^?#]*)(.*)$', ['scheme', 'host', 'path', 'rest']) AS x FROM pages),
p AS (SELECT page_id, {lower} AS host, x.path AS path, {lower} || x.path || x.rest AS target FROM x), w AS (SELECT *, regexp_split_to_array(target, '[^A-Za-z0-9]+') AS words FROM p),
h(rule, site, path, action) AS (VALUES {hosts}),
b AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action FROM p JOIN h ON (host = site OR ends_with(host, '.' || site)) AND starts_with(p.path, h.path) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN host <> '' AND ({hit("block")}) AND NOT ({hit("allow")}) THEN 'block' ELSE 'allow' END) AS verdict, ({fetched})::BIGINT AS n_candidates
FROM w LEFT JOIN b USING (page_id)"""


def chat_format(hostile: str) -> str:
    r = ChatRules()
    esc = "replace(replace({0}, '&', '&amp;'), '<|', '&lt;|')"
    size = f"{len(BEGIN) + len(END) + 2} + length(replace({esc.format('role')}, chr(10), '&#10;')) + length({esc.format('text')})"
    before = " + ".join(
        f"CASE WHEN NOT lag(sys, {k}) OVER w AND upto - body - lag(upto - body, {k}) OVER w <= least(share, spare) THEN lag(size, {k}) OVER w ELSE 0 END" for k in range(1, r.history_turns + 1)
    )
    return f"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', {text(hostile)}), (-1, 1, 'assistant', {text(hostile)})),
t AS (SELECT *, len({WORDS.format("text")}) + {r.marks} AS tokens, {size} AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth FROM r),
s AS (SELECT *, nth = 1 AND role = '{r.system_role}' AS sys FROM t),
b AS (SELECT *, CASE WHEN sys THEN 0 ELSE tokens END AS body, max(CASE WHEN sys THEN tokens END) OVER (PARTITION BY conv_id) AS st, max(CASE WHEN sys THEN size END) OVER (PARTITION BY conv_id) AS sl FROM s),
u AS (SELECT *, sum(body) OVER (PARTITION BY conv_id ORDER BY nth) AS upto, greatest(0, {r.budget} - coalesce(st, 0)) AS rest FROM b),
q AS (SELECT *, least({r.history_tokens}, rest // 2) AS share, greatest(1, rest - least({r.history_tokens}, rest // 2)) AS room FROM u),
c AS (SELECT *, CASE WHEN sys THEN -1 ELSE floor((upto - 1) / room) END AS cell FROM q),
p AS (SELECT *, CASE WHEN NOT sys AND floor((upto - body) / room) < cell AND sum(body) OVER (PARTITION BY conv_id, cell) > room THEN 0 ELSE 1 END AS part FROM c),
n AS (SELECT *, greatest(dense_rank() OVER (PARTITION BY conv_id ORDER BY cell, part) - 1 - (st IS NOT NULL)::INTEGER, 0) AS win FROM p),
f AS (SELECT *, rest - sum(body) OVER (PARTITION BY conv_id, win) AS spare FROM n),
h AS (SELECT *, CASE WHEN lag(win) OVER w <> win THEN coalesce(sl, 0) + {before} ELSE 0 END AS again FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY nth))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = '{r.target_role}'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = '{r.target_role}'), '')) AS loss_sha256,
 sum(size + again)::BIGINT AS formatted_chars, count(DISTINCT win) AS n_windows FROM h GROUP BY conv_id"""


def near_dedup() -> str:
    r = NearRules()
    k = r.shingle
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + {k - 1}], ' ') FOR i IN range(1, len(w) - {k - 2})]) END) AS g FROM w),
n AS (SELECT doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {r.threshold_pct} * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b)
SELECT doc_id, any_value(n) AS n_shingles, min(b) AS component_id, doc_id = min(b) AS kept FROM n JOIN reach ON a = doc_id GROUP BY doc_id"""


def quality() -> str:
    q = QualityRules()
    sizes = (3, *q.ngrams)
    windows = ", ".join(f"CASE WHEN lead(w, {n - 1}) OVER o IS NOT NULL THEN array_to_string([" + ", ".join("w" if i == 0 else f"lead(w, {i}) OVER o" for i in range(n)) + f"], ' ') END AS g{n}" for n in sizes)
    dups = ", ".join(f"g{n} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g{n}) > 1 AS d{n}" for n in sizes)
    marks = ", ".join(f"bool_or(d{n}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS m{n}" for n in sizes)
    grams = ", ".join(f"coalesce(sum(length(w)) FILTER (m{n}), 0)::BIGINT AS dup_{n}gram_chars" for n in q.ngrams)
    names = [f"dup_{n}gram_chars" for n in q.ngrams]
    gates = " AND ".join(f"{g} <= {s}::DOUBLE * word_chars" for g, s in zip(names, q.max_ngram_share, strict=True))
    failed = f"(n_words < {q.min_words} OR 100 * n_repeat_words > {q.max_repeat_words_pct} * n_words)"
    return f"""WITH l AS (SELECT doc_id, text, {WORDS.format("text")} AS l FROM documents), w AS (SELECT doc_id, l[i] AS w, i FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l)),
g AS (SELECT *, {windows} FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)), d AS (SELECT *, {dups} FROM g), m AS (SELECT *, {marks} FROM d),
c AS (SELECT doc_id, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars, count(*) FILTER (m3) AS n_repeat_words, {grams} FROM m GROUP BY doc_id),
n AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id, x) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
e AS (SELECT doc_id, count(*) AS n_dup_lines, sum(length(regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g')))::BIGINT AS dup_line_chars FROM n WHERE k > 1 GROUP BY doc_id),
a AS (SELECT l.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, coalesce(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), 0) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
 coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars, {", ".join(f"coalesce({g}, 0) AS {g}" for g in names)} FROM l LEFT JOIN c USING (doc_id) LEFT JOIN e USING (doc_id))
SELECT *, {failed} AS base_failed, NOT {failed} AND n_symbols <= {q.max_symbols_per_word}::DOUBLE * n_words AND dup_line_chars <= {q.max_dup_line_share}::DOUBLE * word_chars AND {gates} AS kept FROM a"""
