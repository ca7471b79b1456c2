"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, fingerprints, infill, jaccard, language, mixing, periodic, pieces, pii, sharding, substrings, toxicity, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": jaccard.op1_jaccard_join,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_pii": pii.op5_pii,
    "op6_substring_dedup": substrings.op6_substring_dedup,
    "op7_language": language.op7_language,
    "op8_shards": sharding.op8_shards,
    "op9_near_vectors": vectors.op9_near_vectors,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_fingerprints": fingerprints.op12_fingerprints,
    "op13_fill_in_middle": infill.op13_fill_in_middle,
}

#: None: SQL cannot express the query, tests hold it against a brute-force version.
SQL: dict[str, str] = {
    "op2_mix_sources": mixing.SQL,
    "op8_shards": sharding.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op13_fill_in_middle": infill.SQL,
}
