"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from emberlens.llm import bpe, chat, exact_dedup, fingerprints, language, licenses, manifest, near_dedup, packing, resampling, sharding, signature_trees, toxicity

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_vector_packing": packing.op2_vector_packing,
    "op3_simhash": fingerprints.op3_simhash,
    "op4_bagminhash": near_dedup.op4_bagminhash,
    "op5_chat_format": chat.op5_chat_format,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_bpe_transducer": bpe.op7_bpe_transducer,
    "op8_toxic_spans": toxicity.op8_toxic_spans,
    "op9_language_mixture": language.op9_language_mixture,
    "op10_extendible_shards": sharding.op10_extendible_shards,
    "op11_signature_tree_join": signature_trees.op11_signature_tree_join,
    "op12_merkle_manifest": manifest.op12_merkle_manifest,
    "op13_importance_resampling": resampling.op13_importance_resampling,
}

ORACLE = {
    "op1_license_scan": licenses.OP1_SQL,
    "op5_chat_format": chat.OP5_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op10_extendible_shards": sharding.OP10_SQL,
    "op11_signature_tree_join": signature_trees.OP11_SQL,
    "op12_merkle_manifest": manifest.OP12_SQL,
    "op13_importance_resampling": resampling.OP13_SQL,
}
