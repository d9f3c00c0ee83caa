"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lodestar.llm import bagminhash, bpe, collocations, feistel_pii, host_rules, importance, kneser_ney, matroska, packing, pu_quality, sharding, suffix_dedup, warc

QUERIES = {
    "op1_pu_quality": pu_quality.op1_pu_quality,
    "op2_bpe_forced_boundary": bpe.op2_bpe_forced_boundary,
    "op3_two_pass_shuffle": sharding.op3_two_pass_shuffle,
    "op4_kneser_ney": kneser_ney.op4_kneser_ney,
    "op5_host_rules": host_rules.op5_host_rules,
    "op6_feistel_pii": feistel_pii.op6_feistel_pii,
    "op7_matroska": matroska.op7_matroska,
    "op8_bagminhash": bagminhash.op8_bagminhash,
    "op9_suffix_family": suffix_dedup.op9_suffix_family,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_collocations": collocations.op11_collocations,
    "op12_legacy_warc": warc.op12_legacy_warc,
    "op13_importance_resampling": importance.op13_importance_resampling,
}
ORACLES: dict[str, str] = {"op5_host_rules": host_rules.ORACLE, "op11_collocations": collocations.ORACLE}
