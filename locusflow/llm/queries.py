"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from locusflow.llm.ann import op2_adaptive_scan
from locusflow.llm.decontaminate import op7_ngram_decontamination
from locusflow.llm.line_dedup import op8_fuzzy_lines
from locusflow.llm.lm_scoring import op10_hmm_scores
from locusflow.llm.mixing import op1_soft_mixture
from locusflow.llm.pii import op5_weak_supervision_pii
from locusflow.llm.secrets import op9_markov_secrets
from locusflow.llm.sharding import op6_stratified_shards
from locusflow.llm.simhash import op3_simhash_tiles
from locusflow.llm.toxicity import op4_counterfactual_toxicity

QUERIES = {
    "op1_soft_mixture": op1_soft_mixture,
    "op2_adaptive_scan": op2_adaptive_scan,
    "op3_simhash_tiles": op3_simhash_tiles,
    "op4_counterfactual_toxicity": op4_counterfactual_toxicity,
    "op5_weak_supervision_pii": op5_weak_supervision_pii,
    "op6_stratified_shards": op6_stratified_shards,
    "op7_ngram_decontamination": op7_ngram_decontamination,
    "op8_fuzzy_lines": op8_fuzzy_lines,
    "op9_markov_secrets": op9_markov_secrets,
    "op10_hmm_scores": op10_hmm_scores,
}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE: dict[str, str] = {
    "op7_ngram_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
wins AS (
    SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
places AS (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM wins) WHERE len(w) >= size),
hits AS (
    SELECT p.rid, p.i, p.size, v.item FROM (SELECT rid, i, size, array_to_string(w[i : i + size - 1], ' ') AS win FROM places) AS p
    JOIN wins AS v ON v.size = p.size AND v.win = p.win
),
hit_words AS (
    SELECT rid, count(DISTINCT x) AS n FROM (SELECT DISTINCT rid, i, size FROM hits) AS h, unnest(range(h.i, h.i + h.size)) AS u(x) GROUP BY rid
),
items AS (SELECT rid, count(DISTINCT item) AS n, array_to_string(list_sort(list(DISTINCT item)), ',') AS listed FROM hits GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(t.listed, '')) AS items_sha256,
    coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words AS h USING (rid) LEFT JOIN items AS t USING (rid)""",
}
