"""DuckDB SQL of the operators that SQL can express, written from their contracts."""

from __future__ import annotations

from .quality_rules import COMMON_WORDS

SPACE = r"\x20\x09-\x0D"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def quality_rules(char_limit: float, word_limit: float, min_chars: int, min_words: int) -> str:
    # the same classes as the operator's, as character sets
    classes = ["a-z", "A-Z", "0-9", r"\x20\t", r"\n\r", ".,;:", "!?'\"()/_\\[\\]{}=+@\\\\^`~-", "#*$%&|<>"]
    count = lambda s: f"length(t) - length(regexp_replace(t, '[{s.replace(chr(39), chr(39) * 2)}]', '', 'g'))"
    listed = ", ".join(count(s) for s in classes)
    # then the rest of ASCII, and characters beyond it
    ascii_rest = f"(length(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g')) - list_sum([{listed}]))"
    beyond = "(length(t) - length(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g')))"
    words = ", ".join(f"('{lang}', '{w}')" for lang, x in COMMON_WORDS.items() for w in sorted(set(x.split())))
    js = lambda kind: f"""
      SELECT d, sqrt(greatest((sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2, 0)) AS js FROM (
        SELECT docs.d, r.cell, coalesce(x.n, 0) / greatest(tot.n, 1)::double AS p, r.q FROM docs
        JOIN (SELECT lang, cell, n / greatest(sum(n) OVER (PARTITION BY lang), 1)::double AS q FROM (SELECT lang, cell, sum(n) AS n FROM {kind} GROUP BY 1, 2)) r ON r.lang = docs.lang
        JOIN (SELECT d, sum(n) AS n FROM {kind} GROUP BY 1) tot ON tot.d = docs.d
        LEFT JOIN {kind} x ON x.d = docs.d AND x.cell = r.cell) GROUP BY 1"""  # noqa: E731
    return f"""
    WITH docs AS MATERIALIZED (SELECT doc_id AS d, coalesce(text, '') AS t, CASE WHEN lang IN ('de', 'en', 'es', 'fr') THEN lang ELSE '' END AS lang, regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') AS ws FROM documents),
    chars AS MATERIALIZED (SELECT d, lang, unnest(range(10))::varchar AS cell, unnest([{listed}, {ascii_rest}, {beyond}]) AS n FROM docs),
    vocabulary(lang, w) AS (VALUES {words}),
    runs AS MATERIALIZED (SELECT d, lang, unnest(regexp_extract_all({LOWER.format("t")}, '[a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS w FROM docs),
    common AS MATERIALIZED (
      SELECT d, lang, cell, sum(n) AS n FROM (
        SELECT r.d, r.lang, coalesce(v.w, '#') AS cell, count(*) AS n FROM runs r LEFT JOIN vocabulary v ON v.lang = r.lang AND v.w = r.w WHERE r.lang <> '' GROUP BY 1, 2, 3
        UNION ALL SELECT d, lang, '#', 0 FROM docs WHERE lang <> '') GROUP BY 1, 2, 3),
    positions AS MATERIALIZED (SELECT d, unnest(range(1, len(ws) - 1)) AS i, ws FROM docs WHERE len(ws) >= 3),
    triples AS MATERIALIZED (SELECT d, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w FROM positions),
    twice AS (SELECT d, i FROM triples SEMI JOIN (SELECT d, w FROM triples GROUP BY 1, 2 HAVING count(*) > 1) m USING (d, w)),
    repeats AS (SELECT d, count(DISTINCT p) AS n FROM (SELECT d, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1),
    lines AS (SELECT d, count(*) - count(DISTINCT l) AS n FROM (SELECT d, unnest(string_split(t, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '[^{SPACE}]') GROUP BY 1),
    base AS (
      SELECT docs.d, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(lines.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, length(t) AS n_chars
      FROM docs LEFT JOIN lines ON lines.d = docs.d LEFT JOIN repeats ON repeats.d = docs.d)
    SELECT base.d AS doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f AS base_failed,
      NOT f AND NOT (n_chars >= {min_chars} AND cj > {char_limit}) AND NOT (n_words >= {min_words} AND wj > {word_limit}) AS kept, round(cj, 6) AS char_js, round(wj, 6) AS word_js
    FROM (SELECT base.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS f, c.js AS cj, coalesce(w.js, 0) AS wj FROM base JOIN ({js("chars")}) c ON c.d = base.d LEFT JOIN ({js("common")}) w ON w.d = base.d) base"""


def decontaminate(n: int = 13, share: int = 20) -> str:
    words = lambda table, key: f"SELECT {key} AS k, regexp_extract_all({LOWER.format('coalesce(text, ' + chr(39) * 2 + ')')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM {table}"
    return f"""
    WITH docs AS MATERIALIZED ({words("documents", "doc_id")}),
    items AS (SELECT * FROM ({words("benchmark", "item_id::varchar")}) WHERE k IS NOT NULL),
    asked AS MATERIALIZED (SELECT DISTINCT k, z, array_to_string(ws[i:i + z - 1], ' ') AS w FROM (SELECT k, ws, least(len(ws), {n}) AS z, unnest(range(1, len(ws) - least(len(ws), {n}) + 2)) AS i FROM items WHERE len(ws) > 0)),
    windows AS (SELECT k, z, i, array_to_string(ws[i:i + z - 1], ' ') AS w FROM (SELECT k, ws, z, unnest(range(1, len(ws) - z + 2)) AS i FROM docs, (SELECT DISTINCT z FROM asked) WHERE len(ws) >= z)),
    found AS MATERIALIZED (SELECT d.k, d.z, d.i, a.k AS item FROM windows d JOIN asked a ON a.z = d.z AND a.w = d.w),
    hits AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + z)) AS p FROM found) GROUP BY 1),
    listed AS (SELECT k, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT k, item FROM found) GROUP BY 1)
    SELECT docs.k AS doc_id, len(ws) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(listed.n, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
      coalesce(hits.n, 0) > 0 AND {share} * coalesce(hits.n, 0) >= len(ws) AS contaminated
    FROM docs LEFT JOIN hits ON hits.k = docs.k LEFT JOIN listed ON listed.k = docs.k"""


def ngram_join(n: int = 4, percent: int = 85) -> str:
    return f"""
    WITH RECURSIVE docs AS MATERIALIZED (SELECT doc_id AS d, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^{SPACE}]+') AS ws FROM documents),
    grams AS MATERIALIZED (SELECT DISTINCT d, array_to_string(ws[i:i + {n - 1}], ' ') AS g FROM (SELECT d, ws, unnest(range(1, greatest(len(ws) - {n - 1}, 1) + 1)) AS i FROM docs WHERE len(ws) > 0)),
    sizes AS MATERIALIZED (SELECT d, count(*) AS n FROM grams GROUP BY 1),
    met AS (SELECT x.d AS a, y.d AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.d < y.d GROUP BY 1, 2),
    links AS MATERIALIZED (SELECT a, b FROM met JOIN sizes s ON s.d = a JOIN sizes t ON t.d = b WHERE 100 * c >= {percent} * (s.n + t.n - c)),
    both_ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (SELECT d, d AS r FROM docs UNION SELECT both_ways.a, reach.r FROM reach JOIN both_ways ON both_ways.b = reach.d)
    SELECT docs.d AS doc_id, coalesce(sizes.n, 0) AS n_shingles, x.r AS component_id FROM docs LEFT JOIN sizes ON sizes.d = docs.d JOIN (SELECT d, min(r) AS r FROM reach GROUP BY 1) x ON x.d = docs.d"""


def url_filter(rules: list[tuple[str, str, str]], default: str = "allow") -> str:
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
    WITH rules(h, p, v) AS (VALUES {rows}),
    urls AS (SELECT page_id, {LOWER.format("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    fits AS (SELECT urls.*, h || p AS rule, v FROM urls LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
    SELECT page_id, host, path, rule, coalesce(v, '{default}') AS verdict FROM fits QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST, rule) = 1"""


def suffix_dedup(window: int = 400, passage: int = 51) -> str:
    w, p = window, passage
    return f"""
    WITH docs AS MATERIALIZED (SELECT doc_id AS d, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::bigint AS n FROM documents),
    windows AS MATERIALIZED (SELECT d, i, md5(substr(h, 2 * i + 1, {2 * w})) AS m FROM (SELECT d, h, unnest(range(0, n - {w} + 1)) AS i FROM docs WHERE n >= {w})),
    again AS (SELECT d, i FROM windows SEMI JOIN (SELECT m FROM windows GROUP BY 1 HAVING count(*) > 1) x USING (m)),
    islands AS (SELECT d, i, sum(fresh) OVER (PARTITION BY d ORDER BY i) AS k FROM (SELECT d, i, CASE WHEN i <= lag(i) OVER (PARTITION BY d ORDER BY i) + {w} THEN 0 ELSE 1 END AS fresh FROM again)),
    spans AS MATERIALIZED (SELECT d, min(i) AS lo, max(i) + {w} AS hi FROM islands GROUP BY d, k),
    pieces AS (
      SELECT d, coalesce(lag(hi) OVER (PARTITION BY d ORDER BY lo), 0) AS a, lo AS b FROM spans
      UNION ALL SELECT d, max(hi), 1000000000000 FROM spans GROUP BY 1),
    kept AS (SELECT p.d, string_agg(substr(h, 2 * a + 1, 2 * (least(b, n) - a)), '' ORDER BY a) AS h FROM pieces p JOIN docs ON docs.d = p.d GROUP BY 1),
    gone AS (SELECT d, sum(hi - lo)::bigint AS n, count(*) AS k FROM spans GROUP BY 1),
    words AS (SELECT doc_id AS d, regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') AS ws FROM documents),
    passages AS MATERIALIZED (SELECT d, i, md5(array_to_string(ws[i:i + {p - 1}], ' ')) AS m FROM (SELECT d, ws, unnest(range(1, len(ws) - {p - 2})) AS i FROM words WHERE len(ws) >= {p})),
    held AS (SELECT d, i, lead(i) OVER (PARTITION BY d ORDER BY i) AS next FROM passages SEMI JOIN (SELECT m FROM passages GROUP BY 1 HAVING min(d) < max(d)) x USING (m)),
    shared AS (SELECT d, sum(least({p}, coalesce(next - i, {p})))::bigint AS n FROM held GROUP BY 1)
    SELECT docs.d AS doc_id, docs.n AS n_bytes, coalesce(gone.n, 0) AS n_removed, coalesce(gone.k, 0) AS n_spans, sha256(unhex(coalesce(kept.h, docs.h))) AS kept_sha256, coalesce(shared.n, 0) AS n_shared_words
    FROM docs LEFT JOIN gone ON gone.d = docs.d LEFT JOIN kept ON kept.d = docs.d LEFT JOIN shared ON shared.d = docs.d"""
