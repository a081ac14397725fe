"""The queries of this subpackage and, where SQL can express them, their SQL."""

from . import collocations, decontaminate, exact_dedup, licenses, lm_scoring, mixing, packing, pii, shingle_join, substring_dedup, token_output, toxicity, whitening

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_shingle_join": shingle_join.op2_shingle_join,
    "op3_lm_scoring": lm_scoring.op3_lm_scoring,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_token_output": token_output.op7_token_output,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_pii": pii.op9_pii,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_whitening": whitening.op11_whitening,
    "op12_mixing": mixing.op12_mixing,
    "op13_collocations": collocations.op13_collocations,
}
ORACLES = {
    "op1_decontamination": decontaminate.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op8_substring_dedup": substring_dedup.ORACLE,
    "op12_mixing": mixing.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
