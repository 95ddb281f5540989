"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, context_mixing, language_id, line_dedup, metric_join, mixing, nearest, resampling, sharding, simhash, token_files, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_nearest": nearest.op1_nearest,
        "op2_context_mixing": context_mixing.op2_context_mixing,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_token_files": token_files.op4_token_files,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_mixing": mixing.op6_mixing,
        "op7_language_id": language_id.op7_language_id,
        "op8_simhash": simhash.op8_simhash,
        "op9_metric_join": metric_join.op9_metric_join,
        "op10_bpe": bpe.op10_bpe,
        "op11_resampling": resampling.op11_resampling,
        "op12_collocations": collocations.op12_collocations,
        "op13_sharding": sharding.op13_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": line_dedup.OP3_SQL,
        "op6_mixing": mixing.OP6_SQL,
        "op9_metric_join": metric_join.OP9_SQL,
        "op11_resampling": resampling.OP11_SQL,
        "op12_collocations": collocations.OP12_SQL,
        "op13_sharding": sharding.OP13_SQL,
    }
