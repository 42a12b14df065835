"""The registered queries of the text operators and their SQL twins."""
from __future__ import annotations

import corpus_pipeline

from . import align, classifier, language, lines, mixing, near, overlap, packing, passages, phrases, pii, rules, topk

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op4_repeated_passages": passages.query,
    "op9_line_dedup": lines.query,
    "op6_near_duplicates": near.query,
    "op3_exact_top_k": topk.query,
    "op1_quality_classifier": classifier.query,
    "op5_language_id": language.query,
    "op7_packing": packing.query,
    "op2_pii": pii.query,
    "op8_quality_rules": rules.query,
    "op10_mix_sources": mixing.query,
    "op11_phrase_collocations": phrases.query,
    "op12_ngram_join": overlap.query,
    "op13_align_tokenizers": align.query,
}

SQL: dict[str, str] = {
    "op3_exact_top_k": topk.SQL,
}
