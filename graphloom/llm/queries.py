"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import exact_dedup, line_dedup, media, mixing, near_dup, packing, suffix_dedup, toxicity, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_packing": packing.op3_packing,
    "op4_warc": warc.op4_warc,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_near_dup": near_dup.op6_near_dup,
    "op7_mixing": mixing.op7_mixing,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_media_columns": media.op10_media_columns,
}

SQL: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op2_url_filter": url_filter.OP2_SQL,
    "op4_warc": warc.OP4_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op8_line_dedup": line_dedup.OP8_SQL,
    "op9_suffix_dedup": suffix_dedup.OP9_SQL,
}
