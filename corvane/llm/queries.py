"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from corvane.llm import alignment, bpe, chat, fingerprints, infill, langid, media, minhash, mixing, quality, suffix, toxicity, warc

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_bpe": bpe.op2_bpe,
    "op3_minhash": minhash.op3_minhash,
    "op4_language_id": langid.op4_language_id,
    "op5_mixing": mixing.op5_mixing,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_suffix_array": suffix.op7_suffix_array,
    "op8_warc": warc.op8_warc,
    "op9_media": media.op9_media,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_fill_in_middle": infill.op11_fill_in_middle,
    "op12_quality_rules": quality.op12_quality_rules,
    "op13_alignment": alignment.op13_alignment,
}

ORACLE_SQL = {
    "op1_chat_formatting": chat.OP1_SQL,
    "op3_minhash": minhash.OP3_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op8_warc": warc.OP8_SQL,
    "op11_fill_in_middle": infill.OP11_SQL,
    "op12_quality_rules": quality.OP12_SQL,
}
