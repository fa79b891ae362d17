"""The subpackage's queries and the SQL that checks them."""

from __future__ import annotations

from . import decontaminate, language_id, license_scan, line_dedup, near_dedup, packing, sharding, token_binary, top_k, url_filter


def queries() -> dict:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_near_dedup": near_dedup.op2_near_dedup,
        "op3_language_id": language_id.op3_language_id,
        "op4_sharding": sharding.op4_sharding,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_token_binary": token_binary.op6_token_binary,
        "op7_license_scan": license_scan.op7_license_scan,
        "op8_best_fit": packing.op8_best_fit,
        "op9_top_k": top_k.op9_top_k,
        "op10_line_dedup": line_dedup.op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": url_filter.oracle(),
        "op7_license_scan": license_scan.oracle(),
        "op9_top_k": top_k.ORACLE,
        "op10_line_dedup": line_dedup.oracle(),
    }
