"""The op-log that every operator works on: one row per write, newest ``seq`` wins, a tombstone is a write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPLOG = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("seq", T.LongType()),
    T.StructField("is_tombstone", T.BooleanType()),
    T.StructField("value", T.BinaryType()),
])


def checked(ops: DataFrame, allow_empty_key: bool = False) -> DataFrame:
    """``ops`` in the op-log's columns; a row that breaks its rules fails the job that reads it.

    A key is never null, and not empty unless allowed; the value is null exactly for tombstones.
    """
    missing = [c for c in OPLOG.fieldNames() if c not in ops.columns]
    if missing:
        raise ValueError(f"op-log columns are missing: {missing}")
    bad = F.col("key").isNull() | F.col("seq").isNull() | (F.col("value").isNull() != F.col("is_tombstone"))
    if not allow_empty_key:
        bad |= F.octet_length("key") == 0
    fine = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("not an op-log row: null or empty key, or value against tombstone")).cast("boolean")).otherwise(True)
    return ops.select(*[F.col(f.name).cast(f.dataType) for f in OPLOG.fields]).where(fine)
