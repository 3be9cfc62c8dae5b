"""The registered queries of the subpackage and the SQL that checks those that SQL can express."""

from __future__ import annotations

from docquarry.llm import bpe, divergence, html_text, licenses, media, mixing, near_dup, pivots, quality, rans, repeats, token_counts, whitening

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_near_dup": near_dup.op2_near_dup,
    "op3_bpe": bpe.op3_bpe,
    "op4_token_files": rans.op4_token_files,
    "op5_mixing": mixing.op5_mixing,
    "op6_media": media.op6_media,
    "op7_near_vectors": pivots.op7_near_vectors,
    "op8_html": html_text.op8_html,
    "op9_quality": quality.op9_quality,
    "op10_repeats": repeats.op10_repeats,
    "op11_token_counts": token_counts.op11_token_counts,
    "op12_whitening": whitening.op12_whitening,
    "op13_divergence": divergence.op13_divergence,
}

ORACLES: dict[str, str] = {"op5_mixing": mixing.ORACLE, "op13_divergence": divergence.ORACLE}
