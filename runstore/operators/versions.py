"""Versions of keys as sets: snapshots, write conflicts and obsolete versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import merge


def snapshot(log: DataFrame, seq: int) -> DataFrame:
    """Live entries as of ``seq``."""
    return merge.current(log, as_of=seq)


def changed_since(log: DataFrame, seq: int, key: str = "key") -> DataFrame:
    """Keys with a write after ``seq``, and the newest one."""
    return log.where(F.col("seq") > seq).groupBy(key).agg(F.max("seq").alias("newest"))


def conflicts(keys: DataFrame, log: DataFrame, seq: int, key: str = "key") -> DataFrame:
    """Those of ``keys`` that were written after ``seq``."""
    return keys.join(log.where(F.col("seq") > seq).select(key), key, "left_semi")


def kept_versions(log: DataFrame, required: list[int], key: str = "key") -> DataFrame:
    """Per key the newest version at or under each required sequence (pins and the published one).

    Sequences sort into the intervals between required ones, so one aggregate per (key, interval) finds them: a key
    with many versions meets no join with the pins.
    """
    pins = sorted(set(required))
    interval = F.lit(None).cast("int")
    for i, r in reversed(list(enumerate(pins))):
        interval = F.when(F.col("seq") <= r, i).otherwise(interval)
    return log.withColumn("_interval", interval).where("_interval IS NOT NULL").groupBy(key, "_interval").agg(F.max("seq").alias("seq")).select(key, "seq")


def obsolete_versions(log: DataFrame, required: list[int], key: str = "key") -> DataFrame:
    """Versions that no required sequence sees; a newest tombstone stays."""
    return log.join(kept_versions(log, required, key), [key, "seq"], "left_anti")


def read_own_writes(staged: DataFrame, committed: DataFrame, key: str = "key") -> DataFrame:
    """Live entries of a transaction: what it staged hides its snapshot's entries."""
    rest = committed.join(staged.select(key), key, "left_anti")
    return staged.where("NOT is_tombstone").select(key, "value").unionByName(rest.select(key, "value"))
