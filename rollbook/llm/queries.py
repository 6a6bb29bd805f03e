"""Registry of this subpackage's queries and their SQL."""

from __future__ import annotations

from . import embedding_dedup, fingerprint, hard_negatives, jaccard_join, language_id, line_dedup, packing, sentencepiece_wfst, spelling_variants, token_files, toxicity, url_filter, warc_zip


def queries() -> dict:
    found = [
        sentencepiece_wfst.op1_sentencepiece,
        line_dedup.op2_line_dedup,
        language_id.op3_language_id,
        embedding_dedup.op4_embedding_dedup,
        url_filter.op5_url_filter,
        warc_zip.op6_warc_zip,
        token_files.op7_token_planes,
        packing.op8_packing,
        fingerprint.op9_fingerprint,
        jaccard_join.op10_ngram_join,
        spelling_variants.op11_spelling_variants,
        toxicity.op12_toxicity,
        hard_negatives.op13_hard_negatives,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": line_dedup.OP2_SQL, "op11_spelling_variants": spelling_variants.OP11_SQL, "op13_hard_negatives": hard_negatives.OP13_SQL}
