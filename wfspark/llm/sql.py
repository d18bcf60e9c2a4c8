"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from wfspark.llm.license_scan import K, LEAST_COVER, NEAR, template_rows
from wfspark.llm.quality_rules import QualityRules

_WORDS = r"""
words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)
)"""


def quality_rules(rules: QualityRules = QualityRules()) -> str:
    def grams(n: int) -> str:
        return f"""
g{n} AS (
  SELECT doc_id, i, word, string_agg(word, ' ') OVER ahead AS gram, count(*) OVER ahead AS size
  FROM words WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)
),
d{n} AS (SELECT doc_id, i, word, size = {n} AND count(*) OVER (PARTITION BY doc_id, size, gram) > 1 AS again FROM g{n}),
c{n} AS (
  SELECT doc_id, count(*) FILTER (inside) AS n_inside, coalesce(sum(length(word)) FILTER (inside), 0) AS chars_inside
  FROM (SELECT doc_id, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside FROM d{n})
  GROUP BY doc_id
)"""

    sizes = dict.fromkeys([rules.repeat_window, *rules.coverage])
    bad = " OR ".join(
        [
            "base_failed",
            f"100 * dup_line_chars > {rules.max_dup_line_chars_pct} * word_chars",
            f"100 * n_symbols > {rules.max_symbols_pct} * word_chars",
            *(f"100 * dup{n}_chars > {most} * word_chars" for n, most in rules.coverage.items()),
        ]
    )
    return rf"""
WITH {_WORDS.strip()},
{",".join(grams(n) for n in sizes).strip()},
lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
),
again AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS is_again
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
dup_lines AS (
  SELECT doc_id, count(*) FILTER (is_again) AS n, coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) FILTER (is_again), 0) AS chars
  FROM again GROUP BY doc_id
),
measures AS (
  SELECT d.doc_id, coalesce(w.n, 0) AS n_words, coalesce(w.chars, 0) AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(l.n, 0) AS n_dup_lines, coalesce(c{rules.repeat_window}.n_inside, 0) AS n_repeat_words, coalesce(l.chars, 0) AS dup_line_chars,
         {", ".join(f"coalesce(c{n}.chars_inside, 0) AS dup{n}_chars" for n in rules.coverage)}
  FROM documents d
  LEFT JOIN (SELECT doc_id, count(*) AS n, sum(length(word)) AS chars FROM words GROUP BY doc_id) w USING (doc_id)
  LEFT JOIN dup_lines l USING (doc_id)
  {" ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in sizes)}
),
base AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_words_pct} * n_words AS base_failed FROM measures)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, dup_line_chars::BIGINT AS dup_line_chars,
       {", ".join(f"dup{n}_chars::BIGINT AS dup{n}_chars" for n in rules.coverage)}, base_failed, NOT ({bad}) AS kept
FROM base
"""


def substring_dedup(n: int = 13) -> str:
    return f"""
WITH {_WORDS.strip()},
grams AS (
  SELECT doc_id, i, word, string_agg(word, ' ') OVER ahead AS gram, count(*) OVER ahead AS size
  FROM words WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)
),
again AS (SELECT doc_id, i, word, size = {n} AND min(doc_id) OVER (PARTITION BY size, gram) < doc_id AS gone FROM grams),
marked AS (
  SELECT doc_id, i, word, bool_or(gone) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS removed FROM again
),
by_doc AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (removed) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT removed) AS kept FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN by_doc USING (doc_id)
"""


def license_scan() -> str:
    values = ", ".join(f"({k}, '{text}', '{label}', {is_base})" for k, text, label, is_base in template_rows())
    return rf"""
WITH templates AS (SELECT *, string_split(phrase, ' ') AS ws FROM (VALUES {values}) v(template, phrase, label, is_base)),
parts AS (SELECT template, label, is_base, len(ws) - {K - 1} AS n_grams, ws FROM templates),
places AS (SELECT template, unnest(range(0, n_grams)) AS tpos, ws FROM parts),
place_grams AS (SELECT template, tpos, array_to_string(ws[tpos + 1 : tpos + {K}], ' ') AS gram FROM places),
split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
),
counts AS (SELECT doc_id, max(len(ws)) AS n_words FROM split GROUP BY doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos FROM split),
doc_grams AS (
  SELECT doc_id, pos, string_agg(word, ' ') OVER ahead AS gram, count(*) OVER ahead AS size
  FROM words WINDOW ahead AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {K - 1} FOLLOWING)
),
met AS (SELECT DISTINCT doc_id, template, pos - tpos AS diagonal, tpos, pos FROM doc_grams JOIN place_grams USING (gram) WHERE size = {K}),
votes AS (SELECT doc_id, template, diagonal, count(DISTINCT tpos) AS votes, min(pos) AS low, max(pos) AS high FROM met GROUP BY ALL),
apart AS (
  SELECT v.*, label, is_base, n_grams,
         coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {NEAR}, true)::INT AS apart
  FROM votes v JOIN parts USING (template)
),
numbered AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM apart),
covered AS (
  SELECT doc_id, template, span, count(DISTINCT tpos + o) AS n_covered
  FROM met JOIN numbered USING (doc_id, template, diagonal) CROSS JOIN (SELECT unnest(range(0, {K})) AS o) GROUP BY ALL
),
spans AS (
  SELECT doc_id, template, span, any_value(label) AS label, any_value(n_covered)::DOUBLE / (any_value(n_grams) + {K - 1}) AS cover,
         max(high) - min(low) + {K} <= 1.5 * (any_value(n_grams) + {K - 1}) + {NEAR} AS is_close,
         count(*) FILTER (is_base AND votes = n_grams) AS n_base,
         min(diagonal) FILTER (is_base AND votes = n_grams) AS first_word, max(diagonal) FILTER (is_base AND votes = n_grams) AS last_word
  FROM numbered JOIN covered USING (doc_id, template, span) GROUP BY ALL
),
by_doc AS (
  SELECT doc_id, sum(n_base) AS n_base, min(first_word) AS first_word, max(last_word) AS last_word,
         array_to_string(list_sort(list(DISTINCT label) FILTER (n_base > 0)), ',') AS base_labels,
         array_to_string(list_sort(list(DISTINCT label) FILTER (n_base > 0 OR (is_close AND cover >= {LEAST_COVER}))), ',') AS labels,
         max(CASE WHEN n_base > 0 THEN 1.0 WHEN is_close THEN cover END) AS score,
         count(*) FILTER (n_base > 0 OR (is_close AND cover >= {LEAST_COVER})) AS n_spans
  FROM spans GROUP BY doc_id
)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score, coalesce(n_spans, 0)::BIGINT AS n_spans
FROM counts LEFT JOIN by_doc USING (doc_id)
"""
