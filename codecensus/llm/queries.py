"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embeddings, fill_in_middle, katz, language_id, licenses, minhash, mixing, pii, quality, rules, sentencepiece_viterbi, token_counts, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.op1_mixing,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_quality_rules": rules.op3_quality_rules,
    "op4_language_id": language_id.op4_language_id,
    "op5_sentencepiece": sentencepiece_viterbi.op5_sentencepiece,
    "op6_minhash_dedup": minhash.op6_minhash_dedup,
    "op7_embedding_dedup": embeddings.op7_embedding_dedup,
    "op8_pii": pii.op8_pii,
    "op9_quality": quality.op9_quality,
    "op10_katz": katz.op10_katz,
    "op11_whitening": whitening.op11_whitening,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_license_scan": licenses.op13_license_scan,
}
ORACLES: dict[str, str] = {
    "op3_quality_rules": rules.ORACLE, "op6_minhash_dedup": minhash.ORACLE, "op7_embedding_dedup": embeddings.ORACLE,
    "op12_fill_in_middle": fill_in_middle.ORACLE,
}
