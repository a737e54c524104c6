"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, langid, near_dedup, packing, quality, secrets, tokens, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": tokens.op1,
        "op2_byte_bpe": tokens.op2,
        "op3_secret_scan": secrets.op3,
        "op4_warc": warc.op4,
        "op5_packing": packing.op5,
        "op6_exact_dedup": exact_dedup.op6,
        "op7_language_id": langid.op7,
        "op8_quality_rules": quality.op8,
        "op9_toxicity": toxicity.op9,
        "op10_minhash_near_dedup": near_dedup.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": warc.OP4_SQL, "op6_exact_dedup": exact_dedup.OP6_SQL}
