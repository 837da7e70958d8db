"""Training-data operators. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from placebook.llm import alignment, chat_format, html_text, metric_search, mixing, near_copies, packing, phrases, quality_classifier, quality_rules, sharding, simhash, toxicity


def queries() -> dict:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_near_copies": near_copies.op2_near_copies,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_mixing": mixing.op4_mixing,
        "op5_chat_format": chat_format.op5_chat_format,
        "op6_metric_search": metric_search.op6_metric_search,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_quality_classifier": quality_classifier.op8_quality_classifier,
        "op9_html_text": html_text.op9_html_text,
        "op10_best_fit_packing": packing.op10_best_fit_packing,
        "op11_alignment": alignment.op11_alignment,
        "op12_phrases": phrases.op12_phrases,
        "op13_simhash": simhash.op13_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_sharding": sharding.ORACLE,
        "op4_mixing": mixing.ORACLE,
        "op5_chat_format": chat_format.ORACLE,
        "op6_metric_search": metric_search.ORACLE,
        "op7_quality_rules": quality_rules.ORACLE,
        "op12_phrases": phrases.ORACLE,
    }
