"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from cellmosaic.llm import exact_dedup, fingerprints, html_text, importance, merkle, mixing, ngram_join, packing, paragraphs, quality, secrets, simhash, warc


def queries() -> dict:
    return {
        "op1_rule_ensemble": quality.op1,
        "op2_paragraph_banding": paragraphs.op2,
        "op3_chunk_recipe_dedup": exact_dedup.op3,
        "op4_vertical_join": ngram_join.op4,
        "op5_curriculum_mix": mixing.op5,
        "op6_tree_scoring": html_text.op6,
        "op7_multiset_hash": fingerprints.op7,
        "op8_warc_source": warc.op8,
        "op9_decoding_scan": secrets.op9,
        "op10_reduced_best_fit": packing.op10,
        "op11_time_forward_manifest": merkle.op11,
        "op12_regular_sampling": importance.op12,
        "op13_pivot_simhash": simhash.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_chunk_recipe_dedup": exact_dedup.OP3_SQL,
        "op5_curriculum_mix": mixing.OP5_SQL,
        "op11_time_forward_manifest": merkle.OP11_SQL,
        "op12_regular_sampling": importance.OP12_SQL,
    }
