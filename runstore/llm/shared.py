"""What several corpus operators need: scratch tables in the shared folder, worker caches, joins safe from hot keys."""

from __future__ import annotations

import atexit
import sys
import tempfile
import types
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with at least this share of the rows counts as hot; so there are at most this many hot keys.
HOT_PARTS = 1024
#: Copies of a hot key's right row, among which its left rows are spread.
SALTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def refuse(df: DataFrame, *names: str) -> None:
    """Fail rather than replace a column of the caller's."""
    for name in {c.lower() for c in df.columns} & set(names):
        raise ValueError(f"the table has a column {name!r} already")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound Arrow batches by rows and bytes, as texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where that is unset a temporary one, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    cache = worker_cache()
    if "folder" not in cache:
        cache["folder"] = "file://" + tempfile.mkdtemp(prefix="runstore-")
    return cache["folder"]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder's owner cleans up
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    worker_cache().setdefault("written", {})[id(out)] = out, path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that nothing will read any more."""
    _delete(df.sparkSession, worker_cache()["written"].pop(id(df))[1])


def worker_cache() -> dict:
    """A dict that lives as long as the Python process, whichever task uses it."""
    home = sys.modules.setdefault("_runstore_cache", types.ModuleType("_runstore_cache"))
    return home.__dict__.setdefault("kept", {})


def shipped(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcast an object of one of our classes; what is returned gives it in a worker, unpickled once a process.

    Broadcasts are pickled by reference, which needs the package on the executors; this one is pickled by value.
    """
    name, data = uuid.uuid4().hex, spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get() -> object:
        cache = worker_cache()
        if cache.get("shipped", ("", None))[0] != name:
            cache["shipped"] = (name, cloudpickle.loads(data.value))
        return cache["shipped"][1]

    return get


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the documents of which no label may be learnt."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def hot_keys(counts: DataFrame, key: str, count: str = "n") -> DataFrame:
    """The keys whose count is at least ``total / HOT_PARTS``: at most HOT_PARTS rows, whatever the input."""
    total = counts.agg(F.sum(count)).first()[0] or 0
    return counts.where(F.col(count) >= max(2, total // HOT_PARTS)).select(F.col(key), F.lit(True).alias("_hot"))


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, spread: Column, how: str = "inner") -> DataFrame:
    """Equi-join of many ``left`` rows with the one ``right`` row of their key, spreading hot keys over SALTS tasks.

    ``hot`` (key, _hot) comes from :func:`hot_keys`; its bound is what makes the broadcast safe.
    """
    hot = F.broadcast(hot)
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = left.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    right = right.join(hot, key, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def sample_limit(ids: DataFrame, key: Column, n: int) -> int | None:
    """The ``n``-th smallest value of ``key`` (a 64-bit hash), or None if there are no more rows than ``n``.

    Rows at or under it are a bounded, deterministic sample.  Only hashes under a first guess from the number of rows
    are ordered, so about ``n`` of them leave the tasks, however many tasks there are.
    """
    total = ids.count()
    if total <= n:
        return None
    guess = int(((n + 10 * n**0.5 + 100) / total) * 2**64) - 2**63
    low = ids.select(key.alias("h")).where(F.col("h") <= min(guess, 2**63 - 1)).orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return -(2**63) if low is None else low
