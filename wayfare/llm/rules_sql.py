"""The quality rules in SQL: measures, exact binomial tests, chosen cutoffs and verdicts."""

from __future__ import annotations

from .rules import CUTOFFS, RULES


def rules_sql(alpha: float = 0.05, delta: float = 0.05, price: float = 3.0) -> str:
    """``op10`` for DuckDB, written from the definitions: windows instead of arrays, sums instead of recurrences."""
    a = alpha / len(RULES)
    cuts = ", ".join(f"({i}, {c})" for i, c in enumerate(CUTOFFS))
    rules = " UNION ALL ".join(f"SELECT doc_id, lang, '{r}' AS rule, {r} AS x FROM m WHERE NOT base_failed" for r in RULES)
    broken = ", ".join(f"CASE WHEN {r} > c_{r} THEN '{r}' END" for r in RULES)
    chosen = ", ".join(f"max(CASE WHEN rule = '{r}' THEN cutoff END) AS c_{r}" for r in RULES)
    blank = r"[\x20\x09-\x0D]"
    return rf"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
  w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '{blank}+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
  u AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
  g AS (SELECT doc_id, i, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  h AS (SELECT doc_id, i, z IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, x, y, z) > 1 AS twice FROM g),
  k AS (SELECT doc_id, max(twice::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS inside FROM h),
  r AS (SELECT doc_id, sum(inside)::BIGINT AS n_repeat_words FROM k GROUP BY 1),
  b AS (SELECT doc_id, lang, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{blank}', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(t, '[^|]', '', 'g')) AS n_pipes,
      length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS n_upper, length(regexp_replace(t, '\P{{L}}', '', 'g')) AS n_letters FROM d JOIN w USING (doc_id) LEFT JOIN r USING (doc_id)),
  m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
      CASE WHEN word_chars > 0 THEN least(1.0, n_symbols::DOUBLE / word_chars) ELSE 0 END AS symbol_share, CASE WHEN n_lines > 0 THEN least(1.0, n_dup_lines::DOUBLE / n_lines) ELSE 0 END AS dup_line_share,
      CASE WHEN n_words > 0 THEN least(1.0, n_repeat_words::DOUBLE / n_words) ELSE 0 END AS repeat_share, CASE WHEN n_letters > 0 THEN least(1.0, n_upper::DOUBLE / n_letters) ELSE 0 END AS shout_share,
      CASE WHEN n_words > 0 THEN least(1.0, n_pipes::DOUBLE / n_words) ELSE 0 END AS pipe_share FROM b),
  q AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY 1),
  s AS (SELECT * FROM ({rules}) JOIN q USING (doc_id)),
  c AS (SELECT lang, rule, i, cutoff, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1 AND x > cutoff) AS lost, count(*) FILTER (quality <> 1 AND x > cutoff) AS bad FROM s, (VALUES {cuts}) AS v(i, cutoff) GROUP BY ALL),
  p AS (SELECT *, CASE WHEN lost >= n * {a} THEN 1.0 ELSE list_sum(list_transform(range(0, lost + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({a}) + (n - j) * ln(1 - {a})))) END
      <= {delta} / ({len(RULES)} * (SELECT count(DISTINCT coalesce(lang, chr(0))) FROM c)) AS passed FROM c),
  e AS (SELECT *, coalesce(min(i) FILTER (NOT passed) OVER (PARTITION BY lang, rule), {len(CUTOFFS)}) AS stop FROM p),
  f AS (SELECT lang, rule, arg_min(cutoff, (-(bad - {price} * lost)) * 1000 + i) AS cutoff FROM e WHERE i < stop GROUP BY 1, 2),
  z AS (SELECT lang, {chosen} FROM f GROUP BY 1),
  y AS (SELECT m.*, coalesce({broken}) AS rule FROM m LEFT JOIN z ON m.lang IS NOT DISTINCT FROM z.lang)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rule IS NULL AS kept, rule FROM y"""
