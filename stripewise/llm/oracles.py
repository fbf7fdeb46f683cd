"""DuckDB SQL that gives the rows of the queries; those that SQL cannot express have none."""

from __future__ import annotations

from stripewise.llm.quality_rules import STOP_WORDS

_STOPS = sorted({s for w in STOP_WORDS for s in (w, w.capitalize(), w.upper())})

EXACT_DEDUP = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

QUALITY_RULES = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, unnest(list_transform(range(1, len(words) - 6),
           lambda i: list_aggregate(list_slice(words, i, i + 7), 'string_agg', ' '))) AS w,
         unnest(range(1, len(words) - 6)) AS i
  FROM t WHERE len(words) >= 8
), rep AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
), cov AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id
), m AS (
  SELECT t.doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda w: w IN ({", ".join(f"'{s}'" for s in _STOPS)}))) AS n_stops,
         len(list_filter(words, lambda w: regexp_matches(w, '\p{{L}}'))) AS n_letters,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipses,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣▪]'))) AS n_bullets
  FROM t LEFT JOIN cov ON t.doc_id = cov.doc_id
), b AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND word_chars::DOUBLE / n_words BETWEEN 1.5 AND 25 AND n_symbols::DOUBLE / n_words <= 0.9
       AND n_stops::DOUBLE / n_words >= 0.01 AND n_letters::DOUBLE / n_words >= 0.5
       AND n_dup_lines::DOUBLE / n_lines <= 0.5 AND n_ellipses::DOUBLE / n_lines <= 0.5
       AND n_bullets::DOUBLE / n_lines <= 0.9 AS kept
FROM b
"""

#: The same with the values of quality_rules.RULES.
_JUDGED = QUALITY_RULES.index("       AND word_chars")
QUALITY_RULES_PUBLISHED = QUALITY_RULES[:_JUDGED] + """       AND word_chars::DOUBLE / n_words BETWEEN 3 AND 10 AND n_symbols::DOUBLE / n_words <= 0.1
       AND n_stops::DOUBLE / n_words >= 0.01 AND n_letters::DOUBLE / n_words >= 0.8
       AND n_dup_lines::DOUBLE / n_lines <= 0.3 AND n_ellipses::DOUBLE / n_lines <= 0.3
       AND n_bullets::DOUBLE / n_lines <= 0.9 AS kept
FROM b
"""

NEAR_COPIES = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 1, 2)),
           lambda i: list_aggregate(list_slice(w, i, i + 2), 'string_agg', ' '))) AS shingle
  FROM t WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM t UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
), c AS (
  SELECT x, min(y) AS component_id FROM r GROUP BY x
)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, t.doc_id = component_id AS kept
FROM t JOIN c ON c.x = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id
"""

WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex,
             max(page_id) OVER (PARTITION BY html) AS last_id FROM p),
d AS (SELECT page_id, payload_bytes, last_id,
             list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform(range(4), lambda k:
               substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 1 + ((('0x' || substr(hex, (1 + 5 * g)::INT, 5))::BIGINT // (32 ** (3 - k))::BIGINT) % 32)::INT, 1)),
               'string_agg', '')), 'string_agg', '') AS payload_digest FROM h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last_id THEN last_id END AS refers_to FROM d
"""

ORACLES: dict[str, str] = {
    "op3_warc": WARC,
    "op6_exact_dedup": EXACT_DEDUP,
    "op9_minhash": NEAR_COPIES,
    "op10_quality_rules": QUALITY_RULES,
    "op10_quality_rules_published": QUALITY_RULES_PUBLISHED,
}
