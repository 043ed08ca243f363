"""The named queries of this subpackage, and the same in SQL where SQL can say it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from labelsense.llm import (
    decontamination,
    language_id,
    licenses,
    line_dedup,
    mixing,
    ngram_join,
    packing,
    phrases,
    pii,
    quality_rules,
    resampling,
    sharding,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_ngram_jaccard": ngram_join.op2_ngram_jaccard,
    "op3_license_digests": licenses.op3_license_digests,
    "op4_mixed_sources": mixing.op4_mixed_sources,
    "op5_warc_archives": warc.op5_warc_archives,
    "op6_pii_surrogates": pii.op6_pii_surrogates,
    "op7_benchmark_templates": decontamination.op7_benchmark_templates,
    "op8_sharded_documents": sharding.op8_sharded_documents,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_language_id": language_id.op10_language_id,
    "op11_packed_sequences": packing.op11_packed_sequences,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_phrases": phrases.op13_phrases,
}

ORACLES: dict[str, str] = {
    "op3_license_digests": licenses.ORACLE,
    "op4_mixed_sources": mixing.ORACLE,
    "op9_quality_rules": quality_rules.ORACLE,
    "op12_importance_resampling": resampling.ORACLE,
    "op13_phrases": phrases.ORACLE,
}
