"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, decontam, exact, licenses, lines, lm, minhash, mixing, packing, quality

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_lm_score": lm.op3_lm_score,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_chat_format": chat.op5_chat_format,
    "op6_exact_dedup": exact.op6_exact_dedup,
    "op7_minhash_dedup": minhash.op7_minhash_dedup,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_pack_tokens": packing.op9_pack_tokens,
    "op10_benchmark_leaks": decontam.op10_benchmark_leaks,
}

SQL = {
    "op1_mix_sources": mixing.SQL,
    "op2_license_scan": licenses.sql(),
    "op4_line_dedup": lines.SQL,
    "op5_chat_format": chat.SQL,
    "op6_exact_dedup": exact.SQL,
}
