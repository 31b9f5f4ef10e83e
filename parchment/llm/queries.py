"""The registry of this subpackage's queries and their SQL."""

from __future__ import annotations

from . import bottomk, decontam, html, infill, merkle, mixing, negatives, pii, quality, secrets, simhash, suffix_dedup, window_dedup

QUERIES = {
    "op1_page_differencing": html.op1_page_differencing,
    "op2_simhash_components": simhash.op2_simhash_components,
    "op3_host_quality": quality.op3_host_quality,
    "op4_source_mixing": mixing.op4_source_mixing,
    "op5_token_window_dedup": window_dedup.op5_token_window_dedup,
    "op6_suffix_array_dedup": suffix_dedup.op6_suffix_array_dedup,
    "op7_pii_sanitisation": pii.op7_pii_sanitisation,
    "op8_merkle_fixity": merkle.op8_merkle_fixity,
    "op9_benchmark_decontamination": decontam.op9_benchmark_decontamination,
    "op10_secret_ownership": secrets.op10_secret_ownership,
    "op11_bottom_k_dedup": bottomk.op11_bottom_k_dedup,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_fill_in_middle": infill.op13_fill_in_middle,
}

SQL = {
    "op3_host_quality": quality.OP3_SQL,
    "op5_token_window_dedup": window_dedup.OP5_SQL,
    "op6_suffix_array_dedup": suffix_dedup.OP6_SQL,
    "op8_merkle_fixity": merkle.OP8_SQL,
    "op9_benchmark_decontamination": decontam.OP9_SQL,
    "op10_secret_ownership": secrets.OP10_SQL,
    "op11_bottom_k_dedup": bottomk.OP11_SQL,
    "op12_hard_negatives": negatives.OP12_SQL,
    "op13_fill_in_middle": infill.OP13_SQL,
}
