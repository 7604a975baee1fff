"""Queries of this subpackage and the SQL that checks them."""

from . import (alignment, html_extraction, jaccard_join, language_id, lm_scoring, near_vectors, packing,
               personal_data, pieces, quality_classifier, quality_rules, spelling_variants, url_filter)


def llm_queries():
    return {
        "op1_quality_classifier": quality_classifier.op1_quality_classifier,
        "op10_lm_scoring": lm_scoring.op10_lm_scoring,
        "op11_html_extraction": html_extraction.op11_html_extraction,
        "op12_spelling_variants": spelling_variants.op12_spelling_variants,
        "op13_alignment": alignment.op13_alignment,
        "op2_sentencepiece": pieces.op2_sentencepiece,
        "op3_personal_data": personal_data.op3_personal_data,
        "op4_language_id": language_id.op4_language_id,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_packing": packing.op6_packing,
        "op7_jaccard_join": jaccard_join.op7_jaccard_join,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_near_vectors": near_vectors.op9_near_vectors,
    }


def llm_oracles():
    return {"op11_html_extraction": html_extraction.OP11_SQL,
            "op12_spelling_variants": spelling_variants.OP12_SQL, "op5_url_filter": url_filter.OP5_SQL, "op7_jaccard_join": jaccard_join.OP7_SQL,
            "op9_near_vectors": near_vectors.OP9_SQL}
