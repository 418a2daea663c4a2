"""DuckDB SQL of the training-data queries that SQL expresses."""

from __future__ import annotations

from kindred.llm.chat import OP9_SQL
from kindred.llm.embedding_dedup import COSINE
from kindred.llm.hard_negatives import OP11_SQL
from kindred.llm.line_dedup import OP13_SQL
from kindred.llm.mixing import OP6_SQL
from kindred.llm.quality import ERROR, GRID, RISK, RULES, WEAK_RISK
from kindred.llm.vector_codes import OP12_SQL

#: All pairs, which the multi-index finds on these tables without loss.
OP1_SQL = f"""
WITH RECURSIVE v AS (
  SELECT DISTINCT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
    vec_id IS NOT NULL AND label IS NOT NULL AND coalesce(len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS usable
  FROM embeddings
), pairs AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.usable AND b.usable AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}
), reach(id, hit) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.id, p.v FROM reach r JOIN pairs p ON r.hit = p.u
), least AS (SELECT id, min(hit) AS component_id FROM reach GROUP BY id),
degree AS (SELECT u, count(*) AS n FROM pairs GROUP BY u)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, l.component_id, v.vec_id = l.component_id AS kept
FROM v JOIN least l ON v.vec_id = l.id LEFT JOIN degree d ON v.vec_id = d.u
"""

_RULES = " UNION ALL ".join(f"SELECT rid, lang, base_failed, doc_id, '{rule}' AS rule, {x} AS x, {of} AS total FROM m" for rule, (x, of) in RULES.items())
_GRID = ", ".join(f"({i}, CAST({c} AS DOUBLE))" for i, c in enumerate(GRID))



def _tail(p: float) -> str:
    """P(Bin(n, p) <= k), 1 where k >= n p."""
    return f"""CASE WHEN k >= n * {p} THEN 1 ELSE list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda j:
    exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p})))) END"""


OP5_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), windows AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i:i + 4]) AS n FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM d)
), covered AS (
  SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS place FROM windows WHERE n > 1) GROUP BY rid
), m AS (
  SELECT d.rid, doc_id, lang, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
    coalesce(c.n, 0) AS n_repeat_words, length(regexp_replace(text, '[^!]+', '', 'g')) AS n_exclaims, length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) AS n_upper,
    len(words) < 10 OR 100 * coalesce(c.n, 0) > 20 * len(words) AS base_failed
  FROM d LEFT JOIN covered c ON d.rid = c.rid
), long AS ({_RULES}),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = max(quality) AND min(quality) = 1),
grid(step, cut) AS (VALUES {_GRID}),
own AS (
  SELECT lang, rule, step, count(*) AS n, count(*) FILTER (x > cut * total) AS k
  FROM long, grid WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY ALL
), counts AS (
  SELECT false AS pooled, * FROM own UNION ALL SELECT true, NULL, rule, step, sum(n), sum(k) FROM own GROUP BY rule, step
), tails AS (SELECT * REPLACE (CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k), {_tail(RISK)} AS strict_tail, {_tail(WEAK_RISK)} AS weak_tail FROM counts
), level AS (SELECT {ERROR} / ((2 * (SELECT count(*) FROM (SELECT DISTINCT lang FROM own)) + 1) * {len(RULES)}) AS each
), walks AS (
  SELECT pooled, lang, rule, coalesce(min(step) FILTER (strict_tail > each), {len(GRID)}) AS strict, coalesce(min(step) FILTER (weak_tail > each), {len(GRID)}) AS weak
  FROM tails, level GROUP BY ALL
), steps AS (
  SELECT o.lang, o.rule, CASE WHEN o.strict > 0 THEN o.strict ELSE least(o.weak, p.strict) END AS steps FROM walks o JOIN walks p ON o.rule = p.rule AND NOT o.pooled AND p.pooled
), cuts AS (SELECT lang, rule, cut FROM steps JOIN grid ON step = steps - 1),
failed AS (
  SELECT DISTINCT rid FROM long JOIN cuts ON long.lang IS NOT DISTINCT FROM cuts.lang AND long.rule = cuts.rule WHERE x > cut * total
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rid NOT IN (SELECT rid FROM failed) AS kept FROM m
"""

SQL = {"op1_embedding_near_dedup": OP1_SQL, "op5_quality_rules": OP5_SQL, "op6_mix_sources": OP6_SQL, "op9_preference_pairs": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op12_vector_codes": OP12_SQL, "op13_line_dedup": OP13_SQL}
