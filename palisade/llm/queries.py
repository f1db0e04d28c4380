"""The corpus operators' queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palisade.llm import exact_dedup, line_dedup, lm_score, ngram_join, packing, pieces, quality, sharding, topk, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": ngram_join.op1_ngram_join,
        "op2_topk": topk.op2_topk,
        "op3_lm_score": lm_score.op3_lm_score,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_pieces": pieces.op5_pieces,
        "op6_sharding": sharding.op6_sharding,
        "op7_quality": quality.op7_quality,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_packing": packing.op9_packing,
        "op10_warc": warc.op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_topk": topk.OP2_SQL,
        "op4_exact_dedup": exact_dedup.OP4_SQL,
        "op6_sharding": sharding.OP6_SQL,
        "op8_line_dedup": line_dedup.OP8_SQL,
        "op10_warc": warc.OP10_SQL,
    }
