"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from terrella.llm.license_scan import PHRASES

_EXACT = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""

_RULES = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
grams AS (SELECT doc_id, i, words[i:i+2] AS g FROM w, unnest(generate_series(1, len(words) - 2)) AS s(i)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, l FROM d, unnest(string_split(text, chr(10))) AS s(l) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dups AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM lines GROUP BY doc_id),
c AS (
  SELECT w.doc_id, host, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(text) - length(replace(text, '!', '')) AS n_bangs,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN dups ON w.doc_id = dups.doc_id LEFT JOIN covered ON w.doc_id = covered.doc_id),
j AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         (10 * n_symbols > word_chars)::INTEGER + (4 * n_symbols > word_chars)::INTEGER + (4 * n_bangs > n_words)::INTEGER + (2 * n_bangs > n_words)::INTEGER
         + (4 * n_dup_lines > n_lines)::INTEGER + (2 * n_dup_lines > n_lines)::INTEGER + (100 * n_repeat_words > 30 * n_words)::INTEGER
         + (n_words > 0 AND (word_chars > 20 * n_words OR word_chars < 2 * n_words))::INTEGER AS points
  FROM c),
h AS (SELECT host, count(*) AS host_docs, CAST(sum((base_failed OR points > 0)::INTEGER) AS BIGINT) AS host_failed FROM j GROUP BY host),
m AS (SELECT count(*)::DOUBLE AS k, sum(host_docs)::DOUBLE AS n, sum(host_failed)::DOUBLE / sum(host_docs)::DOUBLE AS mean, sum(host_docs::DOUBLE * host_docs::DOUBLE) AS nn FROM h),
s AS (SELECT sum(host_docs::DOUBLE * pow(host_failed::DOUBLE / host_docs::DOUBLE - mean, 2)) AS spread FROM h, m),
b AS (SELECT mean, CASE WHEN n - nn / n > 0 THEN (spread - (k - 1) * mean * (1 - mean)) / (n - nn / n) ELSE 0.0::DOUBLE END AS between_ FROM m, s),
p AS (SELECT mean, CASE WHEN between_ > 0 THEN least(1e6::DOUBLE, greatest(1.0::DOUBLE, mean * (1 - mean) / between_ - 1)) ELSE 1e6::DOUBLE END AS weight FROM b)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND points <= CASE WHEN (host_failed + mean * weight) / (host_docs + weight) >= 0.5 THEN 0 WHEN (host_failed + mean * weight) / (host_docs + weight) >= 0.02 THEN 1 ELSE 2 END AS kept,
       points, host_docs, host_failed, round((host_failed + mean * weight) / (host_docs + weight), 6) AS host_rate
FROM j JOIN h ON j.host = h.host, p
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _phrases() -> str:
    """Base columns of op7: places where a phrase's words stand consecutively."""
    places = " || ".join(f"list_transform(list_filter(generate_series(1, len(w)), lambda i: w[i:i + {len(p.split()) - 1}] = {p.split()}), lambda i: {{'at': i - 1, 'label': '{label}'}})" for p, label in PHRASES.items())
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, {places} AS places FROM d)
SELECT doc_id, n_words, len(places) AS n_base, list_min(list_transform(places, lambda x: x.at)) AS first_word, list_max(list_transform(places, lambda x: x.at)) AS last_word,
       array_to_string(list_sort(list_distinct(list_transform(places, lambda x: x.label))), ',') AS base_labels
FROM p
"""


def _secrets() -> str:
    """Base columns of op6: a match begins after the gaps up to it and the matches before it."""
    value = r"[A-Za-z0-9+/_.=-]+"
    assign = rf"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?"""
    kinds = {"assign": (assign + value, f"len(regexp_extract(m, '{assign}({value})', 1)) >= 6"), "access": ("AKIA[A-Z0-9]+", "len(m) >= 20"), "hex": ("[0-9a-f]+", "len(m) >= 24")}
    total = lambda e, upto: f"coalesce(list_sum(list_transform({e}[1:{upto}], lambda v: len(v))), 0)"
    cuts = ", ".join(f"regexp_extract_all(text, '{p}') AS m{i}, string_split_regex(text, '{p}') AS g{i}" for i, (p, _) in enumerate(kinds.values()))
    rows = " UNION ALL ".join(f"SELECT doc_id, {i} AS kind, '{k}' AS name, CAST({total(f'g{i}', 'i')} + {total(f'm{i}', 'i - 1')} AS BIGINT) AS start, m{i}[i] AS m FROM c, unnest(generate_series(1, len(m{i}))) AS s(i) WHERE {keep.replace('m,', f'm{i}[i],').replace('len(m)', f'len(m{i}[i])')}" for i, (k, (_, keep)) in enumerate(kinds.items()))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), c AS (SELECT doc_id, {cuts} FROM d), r AS ({rows}),
j AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(name || ':' || start || ':' || (start + len(m)), ',' ORDER BY start, kind) AS spans FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN j ON d.doc_id = j.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": _RULES, "op9_exact_dedup": _EXACT, "base_secrets": _secrets(), "base_licenses": _phrases()}
