"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quorumlens.llm import archives, contamination, grades, language, licences, mixing, perplexity, sharding, simhash, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_sharding": sharding.op2_sharding,
    "op3_mixing": mixing.op3_mixing,
    "op4_quality": grades.op4_quality,
    "op5_licences": licences.op5_licences,
    "op6_perplexity": perplexity.op6_perplexity,
    "op7_archives": archives.op7_archives,
    "op8_language": language.op8_language,
    "op9_simhash": simhash.op9_simhash,
    "op10_contamination": contamination.op10_contamination,
}

ORACLES: dict[str, str] = {
    "op2_sharding": sharding.ORACLE,
    "op3_mixing": mixing.ORACLE,
    "op7_archives": archives.ORACLE,
    "op10_contamination": contamination.ORACLE,
}
