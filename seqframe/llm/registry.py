"""The queries and SQL of this subpackage, as the driver entry takes them."""

from __future__ import annotations

from . import chat, fingerprint, htmltext, jaccard, langid, packing, tiling, tokencount, tokenids, toxicity


def queries() -> dict:
    return {
        "op1_length_buckets": packing.op1_length_buckets,
        "op2_chat_prefix_targets": chat.op2_chat_prefix_targets,
        "op3_imatch_fingerprints": fingerprint.op3_imatch_fingerprints,
        "op4_divide_skip_join": jaccard.op4_divide_skip_join,
        "op5_prefix_token_counts": tokencount.op5_prefix_token_counts,
        "op6_string_kernel_toxicity": toxicity.op6_string_kernel_toxicity,
        "op7_template_text": htmltext.op7_template_text,
        "op8_streamed_token_ids": tokenids.op8_streamed_token_ids,
        "op9_string_tiling": tiling.op9_string_tiling,
        "op10_ppm_language": langid.op10_ppm_language,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_length_buckets": packing.oracle_sql(),
        "op2_chat_prefix_targets": chat.ORACLE_SQL,
        "op4_divide_skip_join": jaccard.ORACLE_SQL,
    }
