"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import alignment, decontaminate, exact_dedup, hard_negatives, language_id, line_dedup, mixing, ngram_join, packing, quality, secret_scans, toxicity, url_filters

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

QUERIES = {
    "op1_secret_scans": secret_scans.op1,
    "op2_ngram_jaccard_join": ngram_join.op2,
    "op3_url_filters": url_filters.op3,
    "op4_quality_classifier": quality.op4,
    "op5_mixing": mixing.op5,
    "op6_language_id": language_id.op6,
    "op7_toxicity": toxicity.op7,
    "op8_benchmark_decontamination": decontaminate.op8,
    "op9_exact_dedup": exact_dedup.op9,
    "op10_line_dedup": line_dedup.op10,
    "op11_hard_negatives": hard_negatives.op11,
    "op12_tokenizer_alignment": alignment.op12,
    "op13_packing": packing.op13,
}

ORACLES = {
    "op3_url_filters": url_filters.OP3_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
}
