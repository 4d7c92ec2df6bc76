"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from . import ann, chat, langid, lexical, lines, mixing, negatives, pieces, quality, sharding, simhash, substrings, winnow

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_nearest": ann.op5_nearest,
    "op6_suffix_array": substrings.op6_suffix_array,
    "op7_language_id": langid.op7_language_id,
    "op8_simhash": simhash.op8_simhash,
    "op9_mixing": mixing.op9_mixing,
    "op10_chat_formatting": chat.op10_chat_formatting,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_winnowing": winnow.op13_winnowing,
}
ORACLES = {"op1_sharding": sharding.ORACLE, "op4_line_dedup": lines.ORACLE, "op9_mixing": mixing.ORACLE, "op10_chat_formatting": chat.ORACLE, "op11_hard_negatives": negatives.ORACLE, "op12_lexical_search": lexical.ORACLE}
