"""The queries of this subpackage and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from . import language_id, near_dedup, ogg, packing, phrases, repair, sentencepiece, spotsigs, substring_dedup, token_files, toolcalls, toxicity, warc_fixity

QUERIES = {
    "op1_sentencepiece": sentencepiece.op1_sentencepiece,
    "op2_language_id": language_id.op2_language_id,
    "op3_ogg_media": ogg.op3_ogg_media,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_spotsigs": spotsigs.op5_spotsigs,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_tool_calls": toolcalls.op8_tool_calls,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_warc_fixity": warc_fixity.op10_warc_fixity,
    "op11_token_files": token_files.op11_token_files,
    "op12_phrases": phrases.op12_phrases,
    "op13_repair": repair.op13_repair,
}
ORACLE_SQL = {
    "op5_spotsigs": spotsigs.OP5_SQL,
    "op6_substring_dedup": substring_dedup.OP6_SQL,
    "op8_tool_calls": toolcalls.OP8_SQL,
    "op10_warc_fixity": warc_fixity.OP10_SQL,
    "op12_phrases": phrases.OP12_SQL,
    "op13_repair": repair.OP13_SQL,
}
