"""Lookups, ordered scans and seeks over the live entries (a row per key)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


def _limited(rows: DataFrame, order: Column, max_entries: int | None) -> DataFrame:
    if max_entries is not None and max_entries < 0:
        raise ValueError("max_entries is negative")
    rows = rows.orderBy(order)
    return rows if max_entries is None else rows.limit(max_entries)


def scan(live: DataFrame, max_entries: int | None = None, key: str = "key") -> DataFrame:
    """All live entries in key order; deleted keys don't count toward ``max_entries``."""
    return _limited(live, F.asc(key), max_entries)


def seek(live: DataFrame, lower: Column, max_entries: int | None = None, key: str = "key") -> DataFrame:
    """From the inclusive lower bound upward."""
    return _limited(live.where(F.col(key) >= lower), F.asc(key), max_entries)


def reverse_seek(live: DataFrame, upper: Column | None = None, max_entries: int | None = None, key: str = "key") -> DataFrame:
    """From the inclusive upper bound, or the end, downward."""
    return _limited(live if upper is None else live.where(F.col(key) <= upper), F.desc(key), max_entries)


def successor(prefix: bytes) -> bytes | None:
    """The least key above all that begin with ``prefix``; None if there is none."""
    stem = prefix.rstrip(b"\xff")
    return stem[:-1] + bytes([stem[-1] + 1]) if stem else None


def prefix_scan(live: DataFrame, prefix: bytes, max_entries: int | None = None, key: str = "key") -> DataFrame:
    rows, end = live.where(F.col(key) >= F.lit(prefix)), successor(prefix)
    return _limited(rows if end is None else rows.where(F.col(key) < F.lit(end)), F.asc(key), max_entries)


def get(live: DataFrame, wanted: Column, key: str = "key") -> DataFrame:
    """No row or one."""
    return live.where(F.col(key) == wanted)


def multi_get(probes: DataFrame, live: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Every probe with its value, ``found`` and, of binary values, ``length`` (-1 where missing).

    Spark picks by size whether a side is broadcast.
    """
    hit = live.select(key, F.col(value).alias("_value"), F.lit(True).alias("_hit"))
    out = probes.join(hit, key, "left")
    extra = {value: F.col("_value"), "found": F.coalesce("_hit", F.lit(False))}
    if isinstance(live.schema[value].dataType, BinaryType):
        extra["length"] = F.coalesce(F.octet_length("_value"), F.lit(-1))
    return out.withColumns(extra).drop("_value", "_hit")


def missing(probes: DataFrame, live: DataFrame, key: str = "key") -> DataFrame:
    """The probes without a live entry."""
    return probes.join(live.select(key), key, "left_anti")


def batched_seek(probes: DataFrame, live: DataFrame, probe: str = "probe", key: str = "key", ranges: int = 64) -> DataFrame:
    """For every probe the least live key at or above it, null past the end.

    Probes and keys are divided into ranges at sampled keys, and within a range a window finds the next key. Where a
    range has no key above a probe, the answer is the least key of the ranges after it, of which each gives one row.
    """
    bounds = sorted(r[0] for r in live.select(key).orderBy(F.xxhash64(key)).limit(ranges - 1).collect())
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= F.col("at"))) if bounds else F.lit(0)
    both = probes.select(F.col(probe).alias("at"), F.lit(None).cast(live.schema[key].dataType).alias("next"), F.lit(0).alias("kind"))
    both = both.unionByName(live.select(F.col(key).alias("at"), F.col(key).alias("next"), F.lit(1).alias("kind"))).withColumn("part", part)
    # Probes come before an equal key; the frame reads on to the first key.
    ahead = Window.partitionBy("part").orderBy("at", "kind").rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn("next", F.first("next", ignorenulls=True).over(ahead)).where("kind = 0")
    least = both.where("kind = 1").groupBy("part").agg(F.min("at").alias("least"))  # a row a range
    after = Window.orderBy(F.desc("number")).rowsBetween(Window.unboundedPreceding, -1)
    numbers = live.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("number"))
    beyond = numbers.join(least, F.col("number") == F.col("part"), "left").select("number", F.min("least").over(after).alias("beyond"))
    return found.join(F.broadcast(beyond), F.col("part") == F.col("number"), "left").select(F.col("at").alias(probe), F.coalesce("next", "beyond").alias(key))


def take_while(rows: DataFrame, order: Column, goes_on: Column, inclusive: bool = False) -> DataFrame:
    """Rows in order up to the first where ``goes_on`` fails, which ``inclusive`` counts in.

    Meant for rows that a bound or limit has reduced; for a store of any size the place of the first failure is found
    by one aggregate, and only a filter follows.
    """
    keyed = rows.withColumn("_order", order).withColumn("_stop", ~F.coalesce(goes_on, F.lit(False)))
    first = keyed.where("_stop").agg(F.min("_order").alias("_first"))
    within = F.col("_first").isNull() | ((F.col("_order") <= F.col("_first")) if inclusive else (F.col("_order") < F.col("_first")))
    return keyed.crossJoin(F.broadcast(first)).where(within).drop("_order", "_stop", "_first")  # one row


def visit(rows: DataFrame, visitor: Callable[[bytes, bytes], bool], max_entries: int | None = None, key: str = "key", value: str = "value") -> int:
    """Call ``visitor`` on ordered entries until it returns False; the number of calls, the stopping one included."""
    if max_entries is not None and max_entries < 0:
        raise ValueError("max_entries is negative")
    n = 0
    if max_entries != 0:
        for row in scan(rows, max_entries, key).select(key, value).toLocalIterator(prefetchPartitions=True):
            n += 1
            if not visitor(bytes(row[0]), bytes(row[1])):
                break
    return n
