"""Every query of this subpackage, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wrenchlake.llm import (
    archive,
    attention_lm,
    hard_negatives,
    jaccard_join,
    language_id,
    lexical_search,
    merge_rounds,
    mixing,
    packing,
    quality_rules,
    repeats,
    token_counts,
    vector_join,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_archive": archive.op1_archive,
    "op2_vector_join": vector_join.op2_vector_join,
    "op3_repeats": repeats.op3_repeats,
    "op4_language_id": language_id.op4_language_id,
    "op5_mixing": mixing.op5_mixing,
    "op6_packing": packing.op6_packing,
    "op7_attention_lm": attention_lm.op7_attention_lm,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_merge_rounds": merge_rounds.op11_merge_rounds,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

SQL: dict[str, str] = {
    "op5_mixing": mixing.SQL,
    "op10_quality_rules": quality_rules.SQL,
    "op12_lexical_search": lexical_search.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
