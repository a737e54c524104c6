"""Key/value workloads as DataFrames: fills, deletions, reads, missing reads and seeks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec

DEFAULTS = {"num": 1_000_000, "reads": None, "key_size": 16, "value_size": 100, "seed": 0, "compression_ratio": 1.0, "seek_nexts": 0}


def _value(size: int, seed: int, ratio: float):
    """``size`` bytes of which about a share ``ratio`` is random and the rest zeros."""
    noise = max(0, min(size, round(size * ratio)))
    blocks = [F.lpad(F.hex(F.xxhash64("id", F.lit(seed), F.lit(i))), 16, "0") for i in range(-(-noise // 8))]
    random = F.substring(F.concat(F.lit(""), *blocks), 1, 2 * noise)
    return F.unhex(F.concat(random, F.lit("00" * (size - noise))))


def _number(kind: str, num: int, seed: int):
    if kind == "sequential":
        return F.col("id")
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(kind)), F.lit(num))


def fill(spark: SparkSession, num: int, order: str = "sequential", key_size: int = 16, value_size: int = 100, seed: int = 0, compression_ratio: float = 1.0) -> DataFrame:
    """Puts in key order ("sequential") or of keys drawn at random ("random", "overwrite")."""
    rows = spark.range(num).withColumn("n", _number(order, num, seed))
    return rows.select(codec.workload_key(F.col("n"), key_size).alias("key"), F.col("id").alias("seq"), F.lit(False).alias("is_tombstone"), _value(value_size, seed, compression_ratio).alias("value"))


def delete_random(spark: SparkSession, num: int, key_size: int = 16, seed: int = 0) -> DataFrame:
    rows = spark.range(num).withColumn("n", _number("delete", num, seed))
    return rows.select(codec.workload_key(F.col("n"), key_size).alias("key"), F.col("id").alias("seq"), F.lit(True).alias("is_tombstone"), F.lit(None).cast("binary").alias("value"))


def probes(spark: SparkSession, num: int, reads: int, missing: bool = False, key_size: int = 16, seed: int = 0) -> DataFrame:
    """Keys to read, drawn at random from [0, num), or for ``missing`` from [num, 2 * num)."""
    n = _number("read", num, seed) + (num if missing else 0)
    return spark.range(reads).select(F.col("id").alias("probe_id"), codec.workload_key(n, key_size).alias("key"))


def percentiles(times: DataFrame, column: str) -> DataFrame:
    """avg, p50, p95, p99 and max by nearest rank."""
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")
    return times.agg(F.avg(column).alias("avg"), rank(0.5).alias("p50"), rank(0.95).alias("p95"), rank(0.99).alias("p99"), F.max(column).alias("max"))
