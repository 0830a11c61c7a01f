"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from . import bpe, decontaminate, licenses, near_dedup, quality, sharding, substring_dedup, token_counts, toxicity, warc

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_minhash_near_dedup": near_dedup.op3_minhash_near_dedup,
    "op4_risk_controlled_quality": quality.op4_risk_controlled_quality,
    "op5_line_substring_dedup": substring_dedup.op5_line_substring_dedup,
    "op6_virtual_slot_sharding": sharding.op6_virtual_slot_sharding,
    "op7_classifier_chain_toxicity": toxicity.op7_classifier_chain_toxicity,
    "op8_winnowing_decontamination": decontaminate.op8_winnowing_decontamination,
    "op9_index_first_warc": warc.op9_index_first_warc,
    "op10_bpe_encoding_and_decoding": bpe.op10_bpe_encoding_and_decoding,
}
ORACLE: dict[str, str] = {
    "op2_license_scan": licenses.OP2_SQL,
    "op4_risk_controlled_quality": quality.OP4_SQL,
    "op5_line_substring_dedup": substring_dedup.OP5_SQL,
    "op8_winnowing_decontamination": decontaminate.OP8_SQL,
    "op9_index_first_warc": warc.OP9_SQL,
}
