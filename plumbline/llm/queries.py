"""The thin op queries of this subpackage and their SQL."""

from __future__ import annotations

from . import embedding_dedup, exact_dedup, language_id, line_dedup, near_dedup, packing, quality, secret_scan, source_mix, suffix_dedup


def queries() -> dict:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_near_dedup": near_dedup.op2_near_dedup,
        "op3_source_mix": source_mix.op3_source_mix,
        "op4_packing": packing.op4_packing,
        "op5_secret_scan": secret_scan.op5_secret_scan,
        "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
        "op7_quality": quality.op7_quality,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mix": source_mix.OP3_SQL, "op5_secret_scan": secret_scan.OP5_SQL, "op6_embedding_dedup": embedding_dedup.OP6_SQL, "op8_line_dedup": line_dedup.OP8_SQL, "op9_exact_dedup": exact_dedup.OP9_SQL}
