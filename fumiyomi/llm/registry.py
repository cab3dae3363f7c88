"""Queries of this package, and their SQL where SQL can say the same."""

from __future__ import annotations

from fumiyomi.llm.bpe import op10_bpe
from fumiyomi.llm.fingerprints import op4_fingerprints
from fumiyomi.llm.hard_negatives import op11_hard_negatives
from fumiyomi.llm.jaccard_join import op9_jaccard_join
from fumiyomi.llm.langid import op5_language_id
from fumiyomi.llm.packing import op6_best_fit_packing
from fumiyomi.llm.quality_lm import op8_quality_lm
from fumiyomi.llm.quality_rules import op2_quality_rules
from fumiyomi.llm.spelling_variants import op13_spelling_variants
from fumiyomi.llm.suffix_dedup import op3_suffix_dedup
from fumiyomi.llm.token_counts import op7_token_counts
from fumiyomi.llm.toxicity import op1_toxicity
from fumiyomi.llm.warc import op12_warc

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_quality_rules, op3_suffix_dedup, op4_fingerprints, op5_language_id, op6_best_fit_packing, op7_token_counts, op8_quality_lm, op9_jaccard_join, op10_bpe, op11_hard_negatives, op12_warc, op13_spelling_variants)}
_WORD = r"[^\x20\x09-\x0D]+"

#: The models and searches of the other operators are beyond SQL; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT doc_id, pos, w[pos] || ' ' || w[pos + 1] || ' ' || w[pos + 2] || ' ' || w[pos + 3] || ' ' || w[pos + 4] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS pos FROM d)),
r AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM (SELECT doc_id, pos FROM g JOIN (SELECT doc_id, gram FROM g GROUP BY ALL HAVING count(*) > 1) USING (doc_id, gram)), range(5) AS t(k) GROUP BY doc_id),
l AS (SELECT doc_id, source, array_to_string(regexp_extract_all(lower(line), '{_WORD}'), ' ') AS line, len(regexp_extract_all(line, '{_WORD}')) AS words FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d)),
f AS (SELECT source, line FROM l WHERE line <> '' GROUP BY ALL HAVING count(DISTINCT doc_id) > 100),
lost AS (SELECT doc_id, sum(words) AS n FROM l JOIN f ON l.line = f.line AND l.source IS NOT DISTINCT FROM f.source GROUP BY doc_id),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')))))::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_removed_words FROM d LEFT JOIN r USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_removed_words > 0.5 * n_words OR n_words - n_removed_words < 10) AS kept FROM c
""",
    "op11_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id AS id, list_dot_product(a.v, r.v)::BIGINT AS score FROM e a JOIN e r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5
""",
    "op12_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f
""",
}
