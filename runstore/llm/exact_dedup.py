"""Exact deduplication by two-pass Bloom filtering.

Pass one puts the digest of every text into a two-bit Bloom filter whose slots say "never", "once" or "more than
once"; pass two tests every digest against the slots hit more than once.  Only rows whose digest is possibly
repeated shuffle, the rest pass straight through.  A full filter lets more rows through to the shuffle, never fewer,
so the result is exact at any size; the filter's size is bounded by ``max_bits`` and so is what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Bits that a hash sets.
HASHES = 4
#: The filter is built in segments of so many slots, so that a segment is the unit of merging.
SEGMENT = 1 << 18
MAX_BITS = 1 << 27


def normalised(text: str = "text") -> Column:
    """Texts are equal when identical after no change; null counts as empty."""
    return shared.text_or_empty(text)


def filter_bits(rows: int, max_bits: int = MAX_BITS) -> int:
    """A power of two near 16 bits a row, within [SEGMENT, max_bits]."""
    return int(min(max_bits, max(SEGMENT, 1 << int(np.ceil(np.log2(16 * max(rows, 1)))))))


def slots(h: np.ndarray, bits: int) -> np.ndarray:
    """Row i holds the HASHES slots of hash i (double hashing)."""
    h = h.view(np.uint64)
    step = ((h >> np.uint64(32)) | np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h[:, None] + np.arange(HASHES, dtype=np.uint64)[None, :] * (step >> np.uint64(17))[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def _build(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, more = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for b in batches:
            # A hash seen twice hits each of its slots twice; slots that one hash repeats count once.
            s = np.sort(slots(b.column(0).to_numpy(), bits), axis=1)
            s = s[np.concatenate([np.ones((len(s), 1), bool), s[:, 1:] != s[:, :-1]], axis=1)]
            seen, counts = np.unique(s, return_counts=True)
            word, bit = seen >> 3, (np.uint8(1) << (seen & 7).astype(np.uint8))
            again = (once[word] & bit) != 0
            np.bitwise_or.at(more, word[again | (counts > 1)], bit[again | (counts > 1)])
            np.bitwise_or.at(once, word, bit)
        size = SEGMENT // 8
        for k in range(bits // SEGMENT):
            a = once[k * size : (k + 1) * size]
            if a.any():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([k], pa.int32()), "once": pa.array([a.tobytes()], pa.binary()), "more": pa.array([more[k * size : (k + 1) * size].tobytes()], pa.binary())})

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge each segment's bitmaps, whatever their number; state: the segments that this task owns."""
    kept: dict[int, list[np.ndarray]] = {}
    for b in batches:
        for k, once, more in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            o, m = np.frombuffer(once.as_buffer(), np.uint8), np.frombuffer(more.as_buffer(), np.uint8)
            if k in kept:
                a = kept[k]
                a[1] |= m | (a[0] & o)
                a[0] |= o
            else:
                kept[k] = [o.copy(), m.copy()]
    for k, (o, m) in kept.items():
        yield pa.RecordBatch.from_pydict({"segment": pa.array([k], pa.int32()), "once": pa.array([o.tobytes()], pa.binary()), "more": pa.array([m.tobytes()], pa.binary())})


def repeated_filter(hashes: DataFrame, bits: int, times: int = 2) -> np.ndarray:
    """Bitmap of the slots hit at least ``times`` (1 or 2) times by ``hashes`` (one long column ``h``): bits / 8 bytes."""
    built = hashes.select("h").mapInArrow(_build(bits), "segment int, once binary, more binary")
    merged = built.repartition("segment").mapInArrow(_merge, "segment int, once binary, more binary").select("segment", F.col("once" if times == 1 else "more").alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in merged.toLocalIterator():
        out[r["segment"] * (SEGMENT // 8) : (r["segment"] + 1) * (SEGMENT // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def maybe_repeated(spark: SparkSession, bitmap: np.ndarray):
    """Column function: may the hash ``h`` occur more than once? Never false for one that does."""
    bits, sent = len(bitmap) * 8, spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def test(h):
        import pandas as pd

        s = slots(h.to_numpy(), bits)
        return pd.Series(((sent.value[s >> 3] >> (s & 7).astype(np.uint8)) & 1).all(axis=1))

    return test


def hashed(digest: Column) -> Column:
    return F.xxhash64(digest)


def split(table: DataFrame, digest: str, max_bits: int = MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """``table`` as (rows whose digest surely occurs once, rows whose digest may occur more often)."""
    hashes = table.select(hashed(F.col(digest)).alias("h"))
    bitmap = repeated_filter(hashes, filter_bits(table.count(), max_bits))
    marked = table.withColumn("_maybe", maybe_repeated(table.sparkSession, bitmap)(hashed(F.col(digest))))
    return marked.where("NOT _maybe").drop("_maybe"), marked.where("_maybe").drop("_maybe")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays.  Null texts equal empty ones.  A null doc_id is smaller
    than any other.  Repeated rows with the largest doc_id are all marked kept and all count in group_size.
    An empty table gives no rows.  Other columns of ``docs`` are not read.
    """
    digests = shared.written(docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256)).alias("digest")), "digests")
    single, rest = split(digests, "digest", max_bits)
    groups = shared.written(rest.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    many = groups.where("group_size > 1")
    found = shared.salted_join(rest, groups, "digest", shared.hot_keys(many, "digest", "group_size"), F.col("doc_id"))
    shape = lambda df: df.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    alone = single.withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")})
    return shape(alone).unionByName(shape(found))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The documents that stay, with all their columns; one row of each group of equal texts.

    Rows that pass the filter are never shuffled; of the others each map task sends one row a group.
    """
    columns = docs.columns
    key = F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256))
    digests = shared.written(docs.select(hashed(key).alias("h")), "hashes")
    bitmap = repeated_filter(digests, filter_bits(digests.count(), max_bits))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), key.alias("_digest"))
    packed = packed.withColumn("_maybe", maybe_repeated(docs.sparkSession, bitmap)(hashed(F.col("_digest"))))
    single = packed.where("NOT _maybe").select("_row.*")
    # A row without doc_id loses against any other; max_by ignores rows whose order is null, a struct is never null.
    best = packed.where("_maybe").groupBy("_digest").agg(F.max_by("_row", F.struct(F.col("_row").getField(doc_id))).alias("_row"))
    return single.unionByName(best.select("_row.*"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(shared.table(spark, sf_dir, "documents"))


OP6_SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
