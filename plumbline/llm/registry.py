"""The registered queries of the operators, opN_<name>, and their SQL where SQL can express them."""

from plumbline.llm import byte_bpe, exact_dedup, fingerprints, line_dedup, lm_scoring, merkle, ngram_join, packing, quality, secret_scan, substring_dedup, token_counts, whitening

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_lm_scoring": lm_scoring.op4_lm_scoring,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_byte_bpe": byte_bpe.op6_byte_bpe,
    "op7_packing": packing.op7_packing,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_quality": quality.op9_quality,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_secret_scan": secret_scan.op13_secret_scan,
}
ORACLES = {"op2_exact_dedup": exact_dedup.ORACLE, "op8_line_dedup": line_dedup.ORACLE, "op11_merkle_manifest": merkle.ORACLE}
