"""A store: sorted Parquet runs under a manifest, written batch by batch and read as DataFrames."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import codec
from ..operators import merge, scan
from ..plans import compaction, pruning
from ..plans.compaction import Options
from . import manifest
from .files import Files
from .manifest import Manifest, Run


#: Seconds for which files that no manifest names are kept.
RETENTION = 7 * 86_400.0
#: Probe keys up to which a lookup reads only the files and pages that may hold them.
FEW_PROBES = 1_000


class StoreError(RuntimeError):
    pass


class Batch:
    """Puts and deletes that commit together, the last write of a key winning."""

    def __init__(self, store: Store) -> None:
        self._store, self._ops = store, {}

    def put(self, key, value, key_type: str = "bytes", value_type: str = "bytes") -> Batch:
        self._ops[codec.encode_python(key, key_type)] = codec.encode_python(value, value_type)
        return self

    def delete(self, key, key_type: str = "bytes") -> Batch:
        self._ops[codec.encode_python(key, key_type)] = None
        return self

    def __enter__(self) -> Batch:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None and self._ops:
            self._store.write_batch(ops_frame(self._store.spark, self._ops))


def ops_frame(spark: SparkSession, ops: dict[bytes, bytes | None]) -> DataFrame:
    rows = [(bytearray(k), i, v is None, None if v is None else bytearray(v)) for i, (k, v) in enumerate(ops.items())]
    return spark.createDataFrame(rows, schema.OPLOG)


class Store:
    """One writer at a time: a second one, however many commits it is behind, gets an error and has to open the store again.

    Readers are lazy and files are immutable. Manifests are never written twice, and opening or committing deletes nothing,
    so writes in flight and open readers lose no file; what isn't named any more goes when :meth:`vacuum` is called for.
    """

    MODE = "plain"

    def __init__(self, spark: SparkSession, path: str, options: Options, state: Manifest) -> None:
        self.spark, self.path, self.options, self.state = spark, path.rstrip("/"), options, state
        self._files = Files(spark, path)

    # --- opening, committing

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options | None = None, allow_missing: bool = False):
        """Open or create. A run that the manifest names and that is gone fails unless allowed; nothing is deleted."""
        files = Files(spark, path)
        files.make(f"{path}/runs")
        state = cls._latest(files, path) or Manifest(mode=cls.MODE)
        if state.mode != cls.MODE:
            raise StoreError(f"a {state.mode} store can't be opened as {cls.MODE}")
        store = cls(spark, path, options or Options(), state)
        there = {n for n, _ in files.list(f"{path}/runs")}
        lost = [r for r in state.runs() if r.file.split("/")[0] not in there]
        if lost and not allow_missing:
            raise StoreError(f"runs are missing: {[r.file for r in lost]}")
        if lost:
            gone = set(lost)
            keep = lambda groups: tuple(g for g in (tuple(r for r in g if r not in gone) for g in groups) if g)
            store._commit(state.next(l0=keep(state.l0), levels=tuple(tuple(r for r in g if r not in gone) for g in state.levels)))
        return store

    @staticmethod
    def _versions(files: Files, path: str) -> list[int]:
        return sorted(int(n[9:-5]) for n, _ in files.list(path) if n.startswith("manifest-") and n.endswith(".json"))

    @classmethod
    def _latest(cls, files: Files, path: str) -> Manifest | None:
        """The newest manifest that is whole: a commit whose writer is still writing, or ended, isn't one yet."""
        for version in reversed(cls._versions(files, path)):
            try:
                return Manifest.from_json(files.read(f"{path}/{manifest.name(version)}"))
            except json.JSONDecodeError:
                continue
        return None

    def _commit(self, state: Manifest) -> None:
        newer = [v for v in self._versions(self._files, self.path) if v >= state.version]
        if newer or not self._files.put_if_absent(f"{self.path}/{manifest.name(state.version)}", state.to_json()):
            raise StoreError("another writer has committed; open the store again")
        self.state = state

    def vacuum(self, older_than: float = RETENTION) -> None:
        """Delete what has been out of use for ``older_than`` seconds: manifests but the newest, also unfinished ones of
        writers that ended, and run folders that no manifest names. Writes and readers must be younger than that."""
        ages = self._files.ages(self.path)
        whole = self._latest(self._files, self.path)
        kept = []
        for version in self._versions(self._files, self.path):
            name = manifest.name(version)
            if (whole is None or version != whole.version) and ages.get(name, 0.0) >= older_than:
                self._files.delete(f"{self.path}/{name}")
                continue
            try:
                kept.append(Manifest.from_json(self._files.read(f"{self.path}/{name}")))
            except json.JSONDecodeError:
                continue
        named = {r.file.split("/")[0] for m in kept for r in m.runs()}
        for name, age in self._files.ages(f"{self.path}/runs").items():
            if name not in named and age >= older_than:
                self._files.delete(f"{self.path}/runs/{name}")

    def close(self) -> None:
        """Every commit is durable, so nothing is left to flush."""

    # --- writing

    def _write_run(self, rows: DataFrame, files: int | None = None) -> tuple[Run, ...]:
        """Sorted files of disjoint key ranges; all versions of a key are in one."""
        folder = uuid.uuid4().hex
        at = f"{self.path}/runs/{folder}"
        o = self.options
        ranged = rows.repartitionByRange(files, "key") if files else rows.repartitionByRange("key")
        out = ranged.sortWithinPartitions("key", F.desc("seq")).write.option("compression", o.compression).option("parquet.page.size", o.block_bytes)
        if o.bloom_fpp is not None:
            out = out.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(o.bloom_fpp))
        out.parquet(at)
        sizes = {n: size for n, size in self._files.list(at) if n.endswith(".parquet")}
        facts = self.spark.read.schema(schema.OPLOG).parquet(at).groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name")).agg(
            F.hex(F.min("key")).alias("first"), F.hex(F.max("key")).alias("last"), F.count(F.lit(1)).alias("n"),
            F.count_if("is_tombstone").alias("dead"), F.min("seq").alias("low"), F.max("seq").alias("high"),
        )
        found = [Run(f"{folder}/{r['name']}", r["first"], r["last"], r["n"], r["dead"], sizes[r["name"]], r["low"], r["high"]) for r in facts.collect()]
        return tuple(sorted(found, key=lambda r: r.first_key))

    def _numbered(self, ops: DataFrame, order_by: str) -> tuple[DataFrame, int]:
        """``ops`` with sequences behind all committed ones, in the order of a column of whole numbers."""
        low, high = ops.agg(F.min(order_by), F.max(order_by)).first()
        if low is None:
            return ops, self.state.next_seq
        base = self.state.next_seq - low
        return ops.withColumn("seq", F.col(order_by).cast("long") + F.lit(base)), high + base + 1

    def write_batch(self, ops: DataFrame, order_by: str = "seq", source: str | None = None, batch_id: int | None = None) -> bool:
        """Commit rows (key, is_tombstone, value, order_by); of a key's writes the one of the greatest order stays.

        The order must be total within each key; it only decides within the batch, as each batch is newer than those
        before. A batch of a stream (``source``, ``batch_id``) that is committed already is skipped: returns False.
        """
        if source is not None and batch_id is not None and self.state.sources.get(source, -1) >= batch_id:
            return False
        numbered, next_seq = self._numbered(ops, order_by)
        sources = self.state.sources | ({source: batch_id} if source is not None and batch_id is not None else {})
        if next_seq == self.state.next_seq:
            if source is not None:
                self._commit(self.state.next(sources=sources))
            return True
        run = self._write_run(merge.latest_per_key(schema.checked(numbered)))
        self._commit(self.state.next(l0=(*self.state.l0, run), next_seq=next_seq, published=next_seq - 1, sources=sources))
        return True

    def put_frame(self, rows: DataFrame, key: str, value: str, key_type: str, value_type: str, order_by: str) -> bool:
        """Typed bulk put of two columns."""
        return self.write_batch(rows.select(codec.encode(F.col(key), key_type).alias("key"), F.lit(False).alias("is_tombstone"), codec.encode(F.col(value), value_type).alias("value"), F.col(order_by).alias("_order")), "_order")

    def put_files(self, path: str, key: Callable[[Column], Column] | None = None) -> bool:
        """A put per file: its content, whole, under its path (or what ``key`` makes of the path column)."""
        files = self.spark.read.format("binaryFile").load(path)
        name = key(F.col("path")) if key else F.col("path")
        return self.write_batch(files.select(F.encode(name, "UTF-8").alias("key"), F.lit(False).alias("is_tombstone"), F.col("content").alias("value"), F.unix_micros("modificationTime").alias("_order")), "_order")

    def batch(self) -> Batch:
        return Batch(self)

    def put(self, key, value, key_type: str = "bytes", value_type: str = "bytes") -> None:
        with self.batch() as b:
            b.put(key, value, key_type, value_type)

    def delete(self, key, key_type: str = "bytes") -> None:
        """A tombstone, also for a key that isn't there."""
        with self.batch() as b:
            b.delete(key, key_type)

    # --- reading

    def _frame(self, runs: list[Run] | tuple[Run, ...]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], schema.OPLOG)
        return self.spark.read.schema(schema.OPLOG).parquet(*[f"{self.path}/runs/{r.file}" for r in runs])

    def log(self, lower: bytes | None = None, upper: bytes | None = None, as_of: int | None = None) -> DataFrame:
        """Every stored write within the bounds."""
        out = self._frame(pruning.pruned(self.state.runs(), lower, upper, as_of))
        return merge.bounded(out, None if lower is None else F.lit(lower), None if upper is None else F.lit(upper))

    def live(self, lower: bytes | None = None, upper: bytes | None = None, keys: list[bytes] | None = None) -> DataFrame:
        """The latest entries (key, seq, value), deleted keys left out; of ``keys`` alone, if given.

        Files whose ranges meet no other's are read as they are; only the others are merged. Keys are compared for equality,
        which Parquet's Bloom filters serve.
        """
        low, high = (None if x is None else F.lit(x) for x in (lower, upper))
        groups = pruning.components(pruning.holding(pruning.pruned(self.state.runs(), lower, upper), keys))
        alone, mixed = [g[0] for g in groups if len(g) == 1], [r for g in groups if len(g) > 1 for r in g]
        parts = [merge.among(merge.bounded(self._frame(alone), low, high), keys)] if alone or not mixed else []
        if mixed:
            parts.append(merge.latest_per_key(merge.among(merge.bounded(self._frame(mixed), low, high), keys)))
        return merge.live(reduce(DataFrame.unionByName, parts)).select("key", "seq", "value")

    def view(self, name: str) -> None:
        """Make the latest entries a table for SQL."""
        self.live().createOrReplaceTempView(name)

    def get(self, key, key_type: str = "bytes", value_type: str = "bytes", use_default: bool = False):
        """The decoded value, or None (0 of a number type with ``use_default``)."""
        wanted = codec.encode_python(key, key_type)
        row = self.live(keys=[wanted]).select(codec.decode(F.col("value"), value_type)).first()
        if row is None:
            return codec.CODECS[value_type].default if use_default else None
        return bytes(row[0]) if value_type == "bytes" else row[0]

    def length(self, key: bytes) -> int:
        """The value's length, or -1."""
        row = self.live(keys=[key]).select(F.octet_length("value")).first()
        return -1 if row is None else row[0]

    def read_into(self, key: bytes, capacity: int) -> tuple[int, bytes | None]:
        """(length, value), the value left out where it exceeds ``capacity``; (-1, None) where there is none."""
        value = self.get(key)
        return (-1, None) if value is None else (len(value), value if len(value) <= capacity else None)

    def try_read(self, key: bytes, reader: Callable[[bytes], None]) -> bool:
        value = self.get(key)
        if value is not None:
            reader(value)
        return value is not None

    def multi_get(self, probes: DataFrame) -> DataFrame:
        """Every probe with its value, ``found`` and ``length``; at most FEW_PROBES different keys are looked up by themselves,
        more are joined with the whole store."""
        few = [bytes(r[0]) for r in probes.where("key IS NOT NULL").select("key").distinct().limit(FEW_PROBES + 1).collect()]
        return scan.multi_get(probes, self.live(keys=few) if len(few) <= FEW_PROBES else self.live())

    def scan(self, max_entries: int | None = None) -> DataFrame:
        return scan.scan(self.live(), max_entries)

    def seek(self, lower: bytes, max_entries: int | None = None) -> DataFrame:
        return scan.scan(self.live(lower), max_entries)

    def reverse_seek(self, upper: bytes | None = None, max_entries: int | None = None) -> DataFrame:
        return scan.reverse_seek(self.live(None, upper), None, max_entries)

    def prefix_scan(self, prefix: bytes, max_entries: int | None = None) -> DataFrame:
        return scan.prefix_scan(self.live(prefix), prefix, max_entries)

    def visit(self, visitor: Callable[[bytes, bytes], bool], lower: bytes | None = None, max_entries: int | None = None) -> int:
        return scan.visit(self.live(lower), visitor, max_entries)

    # --- maintenance

    def _merged(self, step: compaction.Step) -> DataFrame:
        rows = merge.latest_per_key(self._frame(step.inputs))
        return merge.live(rows) if step.drop_tombstones else rows

    def compact_once(self) -> bool:
        """One merge, if the strategy asks for one."""
        step = compaction.next_step(self.state, self.options)
        if step is None:
            return False
        files = max(1, round(sum(r.bytes for r in step.inputs) / self.options.target_file_bytes))
        self._commit(compaction.applied(self.state, step, self._write_run(self._merged(step), files)))
        return True

    def compact(self) -> int:
        """Merge until the strategy asks for nothing more; the number of merges."""
        n = 0
        while self.compact_once():
            n += 1
        return n

    flush_and_compact = compact
    maintain = compact_once
