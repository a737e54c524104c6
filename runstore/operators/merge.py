"""Latest write per key, the one relational operator everything else is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounded(log: DataFrame, lower: Column | None = None, upper: Column | None = None, key: str = "key") -> DataFrame:
    """Keys within [lower, upper]; below a merge, so that it reaches the scan."""
    if lower is not None:
        log = log.where(F.col(key) >= lower)
    return log if upper is None else log.where(F.col(key) <= upper)


def among(log: DataFrame, keys: list[bytes] | None, key: str = "key") -> DataFrame:
    """Rows of a short list of keys, if there is one."""
    return log if keys is None else log.where(F.col(key).isin(*map(bytearray, keys)) if keys else F.lit(False))


def latest_per_key(log: DataFrame, as_of: int | Column | None = None, key: str = "key", seq: str = "seq", form: str = "window") -> DataFrame:
    """For each key the row of the greatest ``seq`` (not above ``as_of``), tombstones included.

    ``seq`` must be unique per key. Both forms reduce each map task's rows to one per key before the shuffle, so a key
    that most rows share is no hot spot: ``window`` by a limit on the ranked group, ``aggregate`` by partial max_by.
    """
    if as_of is not None:
        log = log.where(F.col(seq) <= as_of)
    if form == "window":
        newest = Window.partitionBy(key).orderBy(F.desc(seq))
        return log.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")
    rest = [c for c in log.columns if c != key]
    best = log.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_row"))
    return best.select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in log.columns])


def live(merged: DataFrame, tombstone: str = "is_tombstone") -> DataFrame:
    """Without deleted keys; only ever above a merge, else older writes would come back."""
    return merged.where(~F.col(tombstone))


def current(log: DataFrame, as_of: int | Column | None = None, lower: Column | None = None, upper: Column | None = None) -> DataFrame:
    return live(latest_per_key(bounded(log, lower, upper), as_of))
