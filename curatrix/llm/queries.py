"""The registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from . import bitslice, bpe, chat, kmtree, langid, licenses, linededup, packing, simhash, suffix


def queries() -> dict:
    return {
        "op1_language_id": langid.query,
        "op2_packing": packing.query,
        "op3_license_scan": licenses.query,
        "op4_bpe": bpe.query,
        "op5_simhash_near_dedup": simhash.query,
        "op6_exact_topk": bitslice.query,
        "op7_line_dedup": linededup.query,
        "op8_ann_kmeans_tree": kmtree.query,
        "op9_suffix_array_dedup": suffix.query,
        "op10_chat_windows": chat.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_packing": packing.ORACLE,
        "op3_license_scan": licenses.ORACLE,
        "op6_exact_topk": bitslice.ORACLE,
        "op7_line_dedup": linededup.ORACLE,
        "op9_suffix_array_dedup": suffix.ORACLE,
    }
