"""Behaviour of stores, with hand-written expectations."""

import random

import pytest
from pyspark.sql import functions as F

from runstore.functions import codec
from runstore.plans import compaction, pruning
from runstore.plans.compaction import Options
from runstore.sources.manifest import Manifest, Run
from runstore.sources.store import Store, StoreError
from runstore.sources.versioned import ConflictError, VersionedStore


def filled(spark, path, runs, cls=Store, **options):
    """runs: dicts of int keys to int values, None for a deletion; oldest first."""
    store = cls.open(spark, str(path), Options(**options))
    for run in runs:
        with store.batch() as b:
            for k, v in run.items():
                if v is None:
                    b.delete(k, "int")
                elif isinstance(v, bytes):
                    b.put(k, v, "int", "bytes")
                else:
                    b.put(k, v, "int", "int")
    return store


def pairs(rows):
    return [(int.from_bytes(r.key, "big") - (1 << 31), int.from_bytes(r.value, "big") - (1 << 31)) for r in rows.collect()]


def k(n):
    return (n + (1 << 31)).to_bytes(4, "big")


def test_latest_write_wins_in_both_directions(spark, tmp_path):
    s = filled(spark, tmp_path, [{5: 4}, {1: 1, 2: 2, 3: 3}, {2: None, 3: 4, 4: 5}])
    assert pairs(s.scan()) == [(1, 1), (3, 4), (4, 5), (5, 4)]
    assert [p[0] for p in pairs(s.reverse_seek())] == [5, 4, 3, 1]
    assert [p[0] for p in pairs(s.reverse_seek(k(4)))] == [4, 3, 1]
    assert s.get(2, "int", "int") is None and s.get(2, "int", "int", use_default=True) == 0
    s = Store.open(spark, str(tmp_path))
    assert pairs(s.scan()) == [(1, 1), (3, 4), (4, 5), (5, 4)]


def test_seek_is_inclusive_and_skips_deleted(spark, tmp_path):
    s = filled(spark, tmp_path, [{10: 100}, {20: 200}, {30: 44}])
    assert pruning.disjoint(s.state.runs())
    assert "Window" not in s.live()._jdf.queryExecution().executedPlan().toString()
    assert [p[0] for p in pairs(s.seek(k(15)))] == [p[0] for p in pairs(s.seek(k(20)))] == [20, 30]
    assert pairs(s.seek(k(99))) == [] and pairs(s.seek(k(0), 1)) == [(10, 100)]
    s.delete(20, "int")
    assert pairs(s.seek(k(20), 1)) == [(30, 44)]
    with pytest.raises(ValueError):
        s.scan(-1)


def test_visitor_counts_the_entry_it_stops_at(spark, tmp_path):
    s = filled(spark, tmp_path, [{i: i + 100 for i in range(1, 41)}])
    assert s.visit(lambda *_: False) == 1 and s.visit(lambda *_: True) == 40 and s.visit(lambda *_: True, max_entries=0) == 0
    assert pairs(s.seek(k(25), 3)) == [(25, 125), (26, 126), (27, 127)]


def test_empty_value_is_live_and_empty_key_is_refused(spark, tmp_path):
    s = filled(spark, tmp_path, [{1: 10}, {1: b""}])
    assert s.length(k(1)) == 0 and s.length(k(2)) == -1 and s.get(k(1)) == b"" and s.read_into(k(1), 0) == (0, b"")
    with pytest.raises(Exception, match="op-log"):
        s.put(b"", b"x")
    assert Store.open(spark, str(tmp_path)).length(k(1)) == 0


def test_tiered_merge_of_newest_keeps_tombstones(spark, tmp_path):
    sizes = [100_000, 100, 100, 100]
    assert compaction.tiered_start(sizes, Options(max_compaction_tiers=4)) == 1
    assert compaction.tiered_start([10, 10, 10], Options(max_compaction_tiers=4)) is None
    assert compaction.tiered_start([10, 10, 10, 10], Options(max_compaction_tiers=4)) == 0
    s = filled(spark, tmp_path, [{i: i for i in range(1000, 1500)}, {1: 1}, {1000: None}, {3: 3}])
    batches = tuple(tuple(Run(**(r.__dict__ | {"bytes": size})) for r in b) for b, size in zip(s.state.l0, sizes))
    step = compaction.tiered_step(Manifest(l0=batches), Options(max_compaction_tiers=4))
    assert step.start == 1 and not step.drop_tombstones
    s._commit(compaction.applied(s.state, step, s._write_run(s._merged(step))))
    assert len(s.state.l0) == 2 and s.get(1000, "int", "int") is None and s.get(1001, "int", "int") == 1001 and s.get(1, "int", "int") == 1
    assert sum(r.tombstones for r in s.state.runs()) == 1


def test_all_deleted_leaves_no_file(spark, tmp_path):
    s = filled(spark, tmp_path, [{1: 1}, {1: None}], max_compaction_tiers=2)
    assert s.compact() == 1 and s.state.runs() == [] and s.scan().count() == 0


def test_tombstones_stay_above_deeper_levels_and_strategies_change(spark, tmp_path):
    o = dict(compaction_strategy="leveled", level0_compaction_threshold=2, base_level_target_bytes=1)
    s = filled(spark, tmp_path, [{1: 100}, {2: 200}], **o)
    s.compact_once()
    s.compact_once()
    assert [len(x) for x in s.state.levels][-1] >= 1
    filled(spark, tmp_path, [{1: None}, {3: 300}], **o).compact_once()
    s = Store.open(spark, str(tmp_path), Options(max_compaction_tiers=2))
    assert pairs(s.scan()) == [(2, 200), (3, 300)]
    s = filled(spark, tmp_path, [{2: None}, {4: 400}], max_compaction_tiers=2)
    s.compact()
    assert pairs(Store.open(spark, str(tmp_path)).scan()) == [(3, 300), (4, 400)]


@pytest.mark.parametrize("strategy", ["none", "tiered", "leveled"])
def test_compaction_never_changes_a_scan(spark, tmp_path, strategy):
    rng, model = random.Random(strategy), {}
    s = Store.open(spark, str(tmp_path), Options(compaction_strategy=strategy, max_compaction_tiers=3, level0_compaction_threshold=2, base_level_target_bytes=2000, target_file_bytes=2000))
    for _ in range(4):
        ops = {rng.randrange(30): rng.choice([None, rng.randrange(99)]) for _ in range(12)}
        model |= ops
        s = filled(spark, tmp_path, [ops], **{f: getattr(s.options, f) for f in ("compaction_strategy", "max_compaction_tiers", "level0_compaction_threshold", "base_level_target_bytes", "target_file_bytes")})
        want = sorted((a, b) for a, b in model.items() if b is not None)
        assert pairs(s.scan()) == want
        s.compact()
        assert pairs(s.scan()) == want
        for level in s.state.levels:
            assert pruning.disjoint(list(level))


@pytest.mark.parametrize("behind", [1, 2, 5])
def test_a_stale_writer_gets_an_error_however_far_behind(spark, tmp_path, behind):
    filled(spark, tmp_path, [{0: 0}])
    stale, other = Store.open(spark, str(tmp_path)), Store.open(spark, str(tmp_path))
    for i in range(behind):
        other.put(i + 1, i, "int", "int")
    with pytest.raises(StoreError, match="another writer"):
        stale.put(99, 99, "int", "int")
    s = Store.open(spark, str(tmp_path))
    assert s.state.version == other.state.version and [p[0] for p in pairs(s.scan())] == list(range(behind + 1))


def test_opening_deletes_no_write_in_flight(spark, tmp_path, monkeypatch):
    s, reader = filled(spark, tmp_path, [{1: 1}, {2: 2}]), Store.open(spark, str(tmp_path))
    commit, before = Store._commit, reader.scan()
    monkeypatch.setattr(Store, "_commit", lambda self, state: (Store.open(spark, str(tmp_path)), commit(self, state))[1])
    s.put(3, 3, "int", "int")
    s.compact()
    assert [p[0] for p in pairs(Store.open(spark, str(tmp_path)).scan())] == [1, 2, 3] and [p[0] for p in pairs(before)] == [1, 2]


def test_an_unfinished_manifest_is_no_commit(spark, tmp_path):
    s = filled(spark, tmp_path, [{1: 1}, {2: 2}])
    unfinished = tmp_path / f"manifest-{s.state.version + 1:012d}.json"
    unfinished.write_text('{"format": 1, "vers')
    s = Store.open(spark, str(tmp_path))
    assert [p[0] for p in pairs(s.scan())] == [1, 2]
    with pytest.raises(StoreError, match="another writer"):
        s.put(3, 3, "int", "int")
    s.vacuum(older_than=0)
    Store.open(spark, str(tmp_path)).put(3, 3, "int", "int")
    assert [p[0] for p in pairs(Store.open(spark, str(tmp_path)).scan())] == [1, 2, 3]


def test_lookups_compare_keys_for_equality_and_open_only_files_that_may_hold_them(spark, tmp_path):
    s = Store.open(spark, str(tmp_path))
    for low in (0, 1000):
        s.put_frame(spark.range(low, low + 1000).selectExpr("id", "cast(id AS string) AS v"), "id", "v", "long", "string", "id")
    wanted = codec.encode_python(17, "long")
    found = s.live(keys=[wanted])
    assert len(found.inputFiles()) < len(s.log().inputFiles())
    assert "EqualTo(key" in found._jdf.queryExecution().toString() and s.get(17, "long", "string") == "17" and s.get(5000, "long", "string") is None
    probes = spark.createDataFrame([(bytearray(codec.encode_python(k, "long")),) for k in (3, 1500, 7000)], "key binary")
    assert sorted(r.found for r in s.multi_get(probes).collect()) == [False, True, True]
    assert s.live(keys=[]).count() == 0


def test_canonical_key_bytes_and_order(spark):
    """Bytes as the formats define them, and order over negatives and bounds."""
    values = {"int": [-(2**31), -1, 0, 0x01020304, 2**31 - 1], "long": [-(2**63), -1, 0, 0x0102030405060708, 2**63 - 1], "ushort": [0, 258, 65535], "uint": [0, 0x01020304, 2**32 - 1]}
    for kind, xs in values.items():
        rows = spark.createDataFrame([(x,) for x in xs], "x long").select(codec.encode(F.col("x").cast("int") if kind == "int" else F.col("x"), kind).alias("b"), "x").collect()
        got = {r.x: bytes(r.b) for r in rows}
        assert [got[x] for x in xs] == sorted(got.values()) and all(got[x] == codec.encode_python(x, kind) for x in xs)
    assert codec.encode_python(0x01020304, "int").hex() == "81020304" and codec.encode_python(0x0102030405060708, "long").hex() == "8102030405060708"
    assert codec.encode_python(258, "ushort").hex() == "0102" and codec.encode_python(-1, "int").hex() == "7fffffff"


def test_recovery(spark, tmp_path):
    s = filled(spark, tmp_path, [{1: 1}, {2: 2}])
    (tmp_path / "runs" / "orphan").mkdir()
    s = Store.open(spark, str(tmp_path))
    s.vacuum()
    assert (tmp_path / "runs" / "orphan").exists()
    s.vacuum(older_than=0)
    assert not (tmp_path / "runs" / "orphan").exists() and [p[0] for p in pairs(s.scan())] == [1, 2]
    other = Store.open(spark, str(tmp_path))
    other.put(3, 3, "int", "int")
    with pytest.raises(StoreError, match="another writer"):
        s.put(4, 4, "int", "int")
    s = Store.open(spark, str(tmp_path))
    assert [p[0] for p in pairs(s.scan())] == [1, 2, 3]
    import shutil

    shutil.rmtree(tmp_path / "runs" / s.state.l0[0][0].file.split("/")[0])
    with pytest.raises(StoreError, match="missing"):
        Store.open(spark, str(tmp_path))
    assert [p[0] for p in pairs(Store.open(spark, str(tmp_path), allow_missing=True).scan())] == [2, 3]
    with pytest.raises(StoreError, match="plain"):
        VersionedStore.open(spark, str(tmp_path))


def test_bulk_put_prunes_files_and_pushes_bounds_down(spark, tmp_path):
    s = Store.open(spark, str(tmp_path))
    rows = spark.range(1000).select("id", (F.col("id") * 2).cast("int").alias("v"))
    s.put_frame(rows, "id", "v", "long", "int", "id")
    assert s.get(77, "long", "int") == 154 and s.scan().count() == 1000
    assert len(pruning.pruned(s.state.runs(), b"\xff" * 8, None)) == 0
    key = (77 + (1 << 63)).to_bytes(8, "big")
    assert "GreaterThanOrEqual(key,[B" in s.live(key, key)._jdf.queryExecution().executedPlan().toString()
    probes = spark.createDataFrame([(bytearray(key),), (bytearray(b"zz"),)], "key binary")
    assert sorted((r.found, r.length) for r in s.multi_get(probes).collect()) == [(False, -1), (True, 4)]


def test_files_become_values(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"\x00\xff")
    s = Store.open(spark, str(tmp_path / "store"))
    s.put_files(str(tmp_path / "in"), lambda p: F.element_at(F.split(p, "/"), -1))
    assert s.get("a.bin", "string") == b"\x00\xff"


def test_snapshots_transactions_and_garbage(spark, tmp_path):
    s = VersionedStore.open(spark, str(tmp_path))
    for key, v in ((b"\x01", b"a"), (b"\x01\x00", b"b"), (b"\x02", b"c")):
        s.put(key, v)
    snap = s.snapshot()
    s.put(b"\x01", b"new")
    s.delete(b"\x02")
    s.put(b"\x03", b"d")
    assert [(bytes(r.key), bytes(r.value)) for r in snap.scan().collect()] == [(b"\x01", b"a"), (b"\x01\x00", b"b"), (b"\x02", b"c")]
    assert snap.seek(b"\x01\x00").count() == 2
    assert [bytes(r.key) for r in s.scan().collect()] == [b"\x01", b"\x01\x00", b"\x03"]

    one, two = s.transaction(), s.transaction()
    one.put(b"k", b"1")
    two.put(b"k", b"2")
    assert one.get(b"k") == b"1" and two.try_commit() and not one.try_commit() and s.get(b"k") == b"2"
    with pytest.raises(StoreError, match="finished"):
        one.get(b"k")
    reader = s.transaction()
    assert reader.get_for_update(b"\x01") == b"new"
    s.put(b"\x01", b"newer")
    reader.put(b"w", b"x")
    with pytest.raises(ConflictError):
        reader.commit()
    assert s.get(b"w") is None
    only = s.transaction()
    only.get_for_update(b"\x01")
    before = s.published_sequence
    assert only.try_commit() and s.published_sequence == before

    assert s.collect_garbage() == 1  # the middle version of 01; what the snapshot sees stays
    assert bytes(snap.get(b"\x02")) == b"c"
    snap.release()
    assert s.collect_garbage(compact=True) == 2 and s.collect_garbage() == 0
    s = VersionedStore.open(spark, str(tmp_path))
    assert [bytes(r.key) for r in s.scan().collect()] == [b"\x01", b"\x01\x00", b"\x03", b"k"]
    s.put(b"", b"empty key")
    assert s.get(b"") == b"empty key"


def test_interrupted_commit_stays_hidden(spark, tmp_path):
    s = VersionedStore.open(spark, str(tmp_path))
    s.put(b"a", b"1")
    run = s._write_run(spark.createDataFrame([(bytearray(b"b"), s.state.next_seq, False, bytearray(b"lost"))], "key binary, seq long, is_tombstone boolean, value binary"))
    assert run
    s = VersionedStore.open(spark, str(tmp_path))
    s.put(b"c", b"2")
    assert [bytes(r.key) for r in s.scan().collect()] == [b"a", b"c"]


def test_streaming_commits_each_batch_once(spark, tmp_path):
    from runstore.streaming.ingest import ingest

    s = Store.open(spark, str(tmp_path / "store"), Options(max_compaction_tiers=3))
    for i in range(4):
        spark.range(5).select(F.encode(F.col("id").cast("string"), "UTF-8").alias("key"), (F.col("id") == i).alias("is_tombstone"), F.when(F.col("id") != i, F.lit(str(i).encode())).alias("value"), F.col("id").alias("seq")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("key binary, is_tombstone boolean, value binary, seq long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = ingest(stream, s, str(tmp_path / "ckpt"), "in")
        q.awaitTermination(120)
        assert q.exception() is None
    assert [(bytes(r.key), bytes(r.value)) for r in s.scan().collect()] == [(b"0", b"3"), (b"1", b"3"), (b"2", b"3"), (b"4", b"3")]
    version = s.state.version
    assert not s.write_batch(spark.createDataFrame([], "key binary, is_tombstone boolean, value binary, seq long"), source="in", batch_id=0) and s.state.version == version
