"""The queries of this subpackage, for registration."""

from __future__ import annotations

from undulo.llm import chat_format, embedding_dedup, license_scan, minhash_dedup, mixing, quality_classifier, quality_rules, sentencepiece_codec, sharding, sql, token_counts

QUERIES = {
    "op1_quality_classifier": quality_classifier.op1_quality_classifier,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_sharding": sharding.op3_sharding,
    "op4_sentencepiece": sentencepiece_codec.op4_sentencepiece,
    "op5_mixing": mixing.op5_mixing,
    "op6_minhash_dedup": minhash_dedup.op6_minhash_dedup,
    "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_token_counts": token_counts.op10_token_counts,
}

#: DuckDB SQL of those that SQL can express.
ORACLES: dict[str, str] = dict(sql.ORACLES)
