"""The registered queries of the subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from norrsken.llm import decontaminate, fingerprints, jaccard, language, licenses, line_dedup, merkle, mixing, nearest, packing, search, substring_dedup, token_counts

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_jaccard_join": jaccard.op4_jaccard_join,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_nearest": nearest.op7_nearest,
    "op8_packing": packing.op8_packing,
    "op9_language_id": language.op9_language_id,
    "op10_mixing": mixing.op10_mixing,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_ranked_search": search.op12_ranked_search,
    "op13_decontamination": decontaminate.op13_decontamination,
}

ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_ranked_search": search.ORACLE,
    "op13_decontamination": decontaminate.ORACLE,
}
