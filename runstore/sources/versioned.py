"""A store that keeps versions: snapshots, optimistic transactions and garbage collection.

A commit adds its run and its sequence by one manifest, so an interrupted commit is never seen, also not later.
Isolation is that of snapshots: write skew is prevented for keys read for update only, and phantoms are possible.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import codec
from ..operators import merge, scan, versions
from ..plans import compaction, pruning
from .store import Store, StoreError, ops_frame


class ConflictError(StoreError):
    """Another transaction has written a key since this one began."""


class VersionedStore(Store):
    MODE = "versioned"

    def __init__(self, *args) -> None:
        super().__init__(*args)
        self.pins: Counter[int] = Counter()

    @property
    def published_sequence(self) -> int:
        return self.state.published

    def _publish(self, rows: DataFrame) -> int:
        seq = self.state.next_seq
        run = self._write_run(schema.checked(rows.withColumn("seq", F.lit(seq).cast("long")), allow_empty_key=True))
        self._commit(self.state.next(l0=(*self.state.l0, run), next_seq=seq + 1, published=seq))
        return seq

    def write_batch(self, ops: DataFrame, order_by: str = "seq", source: str | None = None, batch_id: int | None = None) -> bool:
        """As of a plain store, under one sequence."""
        if source is not None and batch_id is not None and self.state.sources.get(source, -1) >= batch_id:
            return False
        last = merge.latest_per_key(ops, seq=order_by)
        seq = self.state.next_seq
        run = self._write_run(schema.checked(last.withColumn("seq", F.lit(seq).cast("long")), allow_empty_key=True))
        sources = self.state.sources | ({source: batch_id} if source is not None and batch_id is not None else {})
        self._commit(self.state.next(l0=(*self.state.l0, run) if run else self.state.l0, next_seq=seq + 1, published=seq, sources=sources))
        return True

    def as_of(self, seq: int, lower: bytes | None = None, upper: bytes | None = None, keys: list[bytes] | None = None) -> DataFrame:
        low, high = (None if x is None else F.lit(x) for x in (lower, upper))
        runs = pruning.holding(pruning.pruned(self.state.runs(), lower, upper, seq), keys)
        rows = merge.among(merge.bounded(self._frame(runs), low, high), keys)
        return merge.live(merge.latest_per_key(rows, as_of=seq)).select("key", "seq", "value")

    def live(self, lower: bytes | None = None, upper: bytes | None = None, keys: list[bytes] | None = None) -> DataFrame:
        return self.as_of(self.state.published, lower, upper, keys)

    def snapshot(self) -> Snapshot:
        return Snapshot(self, self.state.published)

    def transaction(self) -> Transaction:
        return Transaction(self, self.state.published)

    def _merged(self, step: compaction.Step) -> DataFrame:
        """Merging files keeps every version; versions go by garbage collection alone."""
        return self._frame(step.inputs)

    def collect_garbage(self, compact: bool = False) -> int:
        """Delete versions that neither a pin nor the published sequence sees; how many they were."""
        runs = self.state.runs()
        log = self._frame(runs)
        required = [*self.pins, self.state.published]
        kept = log.join(versions.kept_versions(log, required), ["key", "seq"], "left_semi").select(*schema.OPLOG.fieldNames())
        obsolete = sum(r.entries for r in runs) - kept.count()
        if obsolete:
            # The rewritten log takes the place of all files; newest versions stay first within each key.
            self._commit(self.state.next(l0=(self._write_run(kept),), levels=()))
        if compact:
            self.compact()
        return obsolete


class Snapshot:
    """A stable view; as long as it isn't released, garbage collection keeps what it sees."""

    def __init__(self, store: VersionedStore, sequence: int) -> None:
        self._store, self.sequence, self._held = store, sequence, True
        store.pins[sequence] += 1

    def live(self, lower: bytes | None = None, upper: bytes | None = None, keys: list[bytes] | None = None) -> DataFrame:
        if not self._held:
            raise StoreError("the snapshot is released")
        return self._store.as_of(self.sequence, lower, upper, keys)

    def get(self, key, key_type: str = "bytes", value_type: str = "bytes"):
        wanted = codec.encode_python(key, key_type)
        row = self.live(keys=[wanted]).select(codec.decode(F.col("value"), value_type)).first()
        return None if row is None else bytes(row[0]) if value_type == "bytes" else row[0]

    def scan(self, max_entries: int | None = None) -> DataFrame:
        return scan.scan(self.live(), max_entries)

    def seek(self, lower: bytes, max_entries: int | None = None) -> DataFrame:
        return scan.scan(self.live(lower), max_entries)

    def release(self) -> None:
        if self._held:
            self._held = False
            self._store.pins[self.sequence] -= 1
            self._store.pins += Counter()  # drops zeros

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_) -> None:
        self.release()


class Transaction:
    """Buffered writes over a snapshot; at commit, a newer write of a written or tracked key is a conflict."""

    def __init__(self, store: VersionedStore, sequence: int) -> None:
        self._store, self._view = store, Snapshot(store, sequence)
        self._staged: dict[bytes, bytes | None] = {}
        self._tracked: dict[bytes, None] = {}

    def _check(self) -> None:
        if not self._view._held:
            raise StoreError("the transaction is finished")

    def put(self, key, value, key_type: str = "bytes", value_type: str = "bytes") -> None:
        self._check()
        self._staged[codec.encode_python(key, key_type)] = codec.encode_python(value, value_type)

    def delete(self, key, key_type: str = "bytes") -> None:
        self._check()
        self._staged[codec.encode_python(key, key_type)] = None

    def get(self, key, key_type: str = "bytes") -> bytes | None:
        """Its own write if there is one, else what the snapshot has."""
        self._check()
        wanted = codec.encode_python(key, key_type)
        return self._staged[wanted] if wanted in self._staged else self._view.get(wanted)

    def get_for_update(self, key, key_type: str = "bytes") -> bytes | None:
        self._check()
        self._tracked[codec.encode_python(key, key_type)] = None
        return self.get(key, key_type)

    def live(self) -> DataFrame:
        """All it sees, its own writes included."""
        self._check()
        return versions.read_own_writes(ops_frame(self._store.spark, self._staged), self._view.live())

    def try_commit(self) -> bool:
        """All or nothing; either way the transaction is finished. Without writes no sequence is spent."""
        self._check()
        try:
            keys = [*self._staged, *(k for k in self._tracked if k not in self._staged)]
            if keys:
                newer = [r for r in pruning.pruned(self._store.state.runs(), min(keys), max(keys)) if r.max_seq > self._view.sequence]
                if newer:
                    wanted = self._store.spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
                    if not versions.conflicts(wanted, self._store._frame(newer), self._view.sequence).isEmpty():
                        return False
            if self._staged:
                self._store._publish(ops_frame(self._store.spark, self._staged))
            return True
        finally:
            self.rollback()

    def commit(self) -> None:
        if not self.try_commit():
            raise ConflictError("a key was written since the transaction began")

    def rollback(self) -> None:
        self._view.release()
