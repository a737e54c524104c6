"""Queries over the sample tables, with the SQL they must agree with.

The events are an op-log: key user_id, seq event_id + 1, an error deletes, runs are thousands of events. Stores that a
query writes go to the shared folder named by ``spark.checkpoint.dir``, or to a temporary one where that is unset.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bloom, codec
from ..operators import merge, scan, versions, workloads
from ..sources.store import Store
from ..sources.versioned import VersionedStore
from .compaction import Options

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_local: list[str] = []

LOG = """log AS (SELECT user_id AS k, event_id + 1 AS seq, event_type = 'error' AS tomb, value AS v,
                       event_id // 1000 AS run_id FROM events)"""
LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1), live AS (SELECT k, seq, v FROM latest WHERE NOT tomb)"
WITH = f"WITH {LOG}, {LATEST}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("k"), (F.col("event_id") + 1).alias("seq"), (F.col("event_type") == "error").alias("tomb"),
        F.col("value").alias("v"), F.expr("event_id div 1000").alias("run_id"),
    )


def live(spark: SparkSession, sf: str) -> DataFrame:
    return merge.live(merge.latest_per_key(log(spark, sf), key="k"), "tomb").select("k", "seq", "v")


def folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="runstore-"))
            atexit.register(shutil.rmtree, _local[0], True)
        base = "file://" + _local[0]
    return f"{base}/store-{uuid.uuid4().hex}"


def probes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select((F.col("c_nationkey") * 7).cast("long").alias("p")).distinct()


PROBES = "probes AS (SELECT DISTINCT CAST(c_nationkey * 7 AS BIGINT) AS p FROM customer)"


@query("e1_scan_latest", f"{WITH} SELECT k, seq, v FROM live")
def _(spark, sf):
    return scan.scan(live(spark, sf), key="k")


@query("e1_max_by", f"WITH {LOG} SELECT k, max_by(v, seq) AS v, max_by(tomb, seq) AS tomb, max(seq) AS seq FROM log GROUP BY k")
def _(spark, sf):
    return merge.latest_per_key(log(spark, sf), key="k", form="aggregate").select("k", "v", "tomb", "seq")


@query("e2_merge_backward", f"{WITH} SELECT k, seq, v FROM live ORDER BY k DESC")
def _(spark, sf):
    return scan.reverse_seek(live(spark, sf), key="k")


@query("e5_batch_upsert", f"WITH {LOG}, batch AS (SELECT * FROM log) SELECT run_id, k, max_by(v, seq) AS v, max(seq) AS seq FROM batch GROUP BY run_id, k")
def _(spark, sf):
    # Every batch by itself: the latest write of each key within it.
    rows = log(spark, sf).groupBy("run_id", "k").agg(F.max_by(F.struct("v", "seq"), "seq").alias("x"))
    return rows.select("run_id", "k", "x.v", "x.seq")


@query("c2_seek_limit", f"{WITH} SELECT k, v FROM live WHERE k >= 100 ORDER BY k LIMIT 10")
def _(spark, sf):
    return scan.seek(live(spark, sf), F.lit(100), 10, "k").select("k", "v")


@query("c3_seek_one", f"{WITH} SELECT k, v FROM live WHERE k >= 50 ORDER BY k LIMIT 1")
def _(spark, sf):
    return scan.seek(live(spark, sf), F.lit(50), 1, "k").select("k", "v")


@query("c7_reverse_seek", f"{WITH} SELECT k, v FROM live WHERE k <= 100 ORDER BY k DESC LIMIT 10")
def _(spark, sf):
    return scan.reverse_seek(live(spark, sf), F.lit(100), 10, "k").select("k", "v")


@query("c8_empty_range", f"{WITH} SELECT k, v FROM live WHERE k >= 20 AND k <= 10")
def _(spark, sf):
    return merge.bounded(live(spark, sf), F.lit(20), F.lit(10), "k").select("k", "v")


_WHILE = f"{WITH}, s AS (SELECT k, v, sum(CASE WHEN v >= 2 THEN 0 ELSE 1 END) OVER (ORDER BY k"


@query("c11_take_while", f"{_WHILE}) AS stopped FROM live) SELECT k, v FROM s WHERE stopped = 0")
def _(spark, sf):
    return scan.take_while(live(spark, sf), F.col("k"), F.col("v") >= 2).select("k", "v")


@query("c11_take_while_inclusive", f"{_WHILE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stopped FROM live) SELECT k, v FROM s WHERE coalesce(stopped, 0) = 0")
def _(spark, sf):
    return scan.take_while(live(spark, sf), F.col("k"), F.col("v") >= 2, inclusive=True).select("k", "v")


@query("prefix_scan", """WITH log AS (SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') || ':' || event_type AS k, event_id AS seq, value < 10 AS tomb, value AS v FROM events),
    latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1)
    SELECT k, v FROM latest WHERE NOT tomb AND starts_with(k, '00001')""")  # fmt: skip
def _(spark, sf):
    key = F.concat(F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit(":"), F.col("event_type"))
    ops = table(spark, sf, "events").select(codec.encode(key, "string").alias("k"), F.col("event_id").alias("seq"), (F.col("value") < 10).alias("tomb"), F.col("value").alias("v"))
    rows = merge.live(merge.latest_per_key(ops, key="k"), "tomb")
    return scan.prefix_scan(rows, b"00001", key="k").select(codec.decode(F.col("k"), "string").alias("k"), "v")


@query("b1_get", f"{WITH} SELECT k, v FROM live WHERE k = 42")
def _(spark, sf):
    return scan.get(merge.live(merge.latest_per_key(log(spark, sf).where("k = 42"), key="k"), "tomb"), F.lit(42), "k").select("k", "v")


@query("b7_multi_get", f"{WITH}, {PROBES} SELECT p, v, v IS NOT NULL AS found FROM probes LEFT JOIN live ON p = k")
def _(spark, sf):
    return scan.multi_get(probes(spark, sf).withColumnRenamed("p", "k"), live(spark, sf), "k", "v").select(F.col("k").alias("p"), "v", "found")


@query("d6_missing", f"{WITH}, {PROBES} SELECT p FROM probes WHERE p NOT IN (SELECT k FROM live)")
def _(spark, sf):
    return scan.missing(probes(spark, sf).withColumnRenamed("p", "k"), live(spark, sf), "k").select(F.col("k").alias("p"))


@query("l4_batched_seek", f"{WITH}, {PROBES} SELECT p, (SELECT min(k) FROM live WHERE k >= p) AS next_key FROM probes")
def _(spark, sf):
    return scan.batched_seek(probes(spark, sf), live(spark, sf), "p", "k").select("p", F.col("k").alias("next_key"))


@query("g5_snapshot", f"WITH {LOG}, s AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log WHERE seq <= (SELECT max(seq) // 2 FROM log)) SELECT k, seq, v FROM s WHERE rn = 1 AND NOT tomb")
def _(spark, sf):
    rows = log(spark, sf)
    half = (rows.agg(F.max("seq")).first()[0] or 0) // 2
    return merge.live(merge.latest_per_key(rows, as_of=half, key="k"), "tomb").select("k", "seq", "v")


_STAGED = "staged AS (SELECT CAST(c_custkey AS BIGINT) AS k, c_acctbal AS v, c_acctbal < 0 AS tomb FROM customer)"


@query("g8_read_own_writes", f"{WITH}, {_STAGED} SELECT k, v FROM staged WHERE NOT tomb UNION ALL SELECT k, v FROM live WHERE k NOT IN (SELECT k FROM staged)")
def _(spark, sf):
    staged = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("value"), (F.col("c_acctbal") < 0).alias("is_tombstone"))
    return versions.read_own_writes(staged, live(spark, sf).withColumnRenamed("v", "value"), "k").select("k", F.col("value").alias("v"))


@query("g10_conflict", f"WITH {LOG} SELECT k, max(seq) AS newest FROM log WHERE seq > 500 GROUP BY k")
def _(spark, sf):
    return versions.changed_since(log(spark, sf), 500, "k")


@query("g10_conflicting_keys", f"WITH {LOG}, {PROBES} SELECT p FROM probes WHERE p IN (SELECT k FROM log WHERE seq > 500)")
def _(spark, sf):
    return versions.conflicts(probes(spark, sf).withColumnRenamed("p", "k"), log(spark, sf), 500, "k").select(F.col("k").alias("p"))


@query("g13_gc_obsolete", f"""WITH {LOG}, req AS (SELECT * FROM (VALUES (200), (500), (1000000000)) t(r)),
    keep AS (SELECT l.k, max(l.seq) AS seq FROM log l JOIN req ON l.seq <= req.r GROUP BY l.k, req.r)
    SELECT l.k, l.seq FROM log l WHERE NOT EXISTS (SELECT 1 FROM keep q WHERE q.k = l.k AND q.seq = l.seq)""")  # fmt: skip
def _(spark, sf):
    return versions.obsolete_versions(log(spark, sf), [200, 500, 1_000_000_000], "k").select("k", "seq")


@query("a12_run_meta", f"WITH {LOG} SELECT run_id, min(k) AS first_key, max(k) AS last_key, count(DISTINCT k) AS entries, max(seq) AS max_seq FROM log GROUP BY run_id")
def _(spark, sf):
    # A first aggregate makes (run, key) unique, so counting needs no second shuffle by key.
    keys = log(spark, sf).groupBy("run_id", "k").agg(F.max("seq").alias("seq"))
    return keys.groupBy("run_id").agg(F.min("k").alias("first_key"), F.max("k").alias("last_key"), F.count(F.lit(1)).alias("entries"), F.max("seq").alias("max_seq"))


@query("f3_partial_merge", f"WITH {LOG} SELECT k, max(seq) AS seq, max_by(tomb, seq) AS tomb FROM log WHERE run_id >= (SELECT max(run_id) * 7 // 10 FROM log) GROUP BY k")
def _(spark, sf):
    # The newest runs, three tenths of all, as a tiered merge takes them.
    rows = log(spark, sf)
    first = (rows.agg(F.max("run_id")).first()[0] or 0) * 7 // 10
    return merge.latest_per_key(rows.where(F.col("run_id") >= first), key="k").select("k", "seq", "tomb")


def _stored(spark: SparkSession, sf: str, options: Options, cls=Store, parts: int = 4):
    """A store of the events, written in ``parts`` batches by event_id."""
    store = cls.open(spark, folder(spark), options)
    ops = log(spark, sf).select(codec.encode(F.col("k"), "long").alias("key"), "seq", F.col("tomb").alias("is_tombstone"), F.when(~F.col("tomb"), codec.encode(F.col("v").cast("string"), "string")).alias("value"))
    last = table(spark, sf, "events").agg(F.max("event_id")).first()[0] or 0
    step = last // parts + 1
    for i in range(parts):
        store.write_batch(ops.where((F.col("seq") > i * step) & (F.col("seq") <= (i + 1) * step)))
    return store


def _decoded(rows: DataFrame) -> DataFrame:
    return rows.select(codec.decode(F.col("key"), "long").alias("k"), codec.decode(F.col("value"), "string").cast("double").alias("v"))


_LIVE_SQL = f"{WITH} SELECT k, v FROM live"


@query("a11_flush_roundtrip", _LIVE_SQL)
def _(spark, sf):
    store = _stored(spark, sf, Options(compaction_strategy="none"))
    return _decoded(Store.open(spark, store.path).scan())


@query("f3_tiered_compaction", _LIVE_SQL)
def _(spark, sf):
    store = _stored(spark, sf, Options(max_compaction_tiers=2))
    store.compact()
    return _decoded(store.scan())


@query("f7_leveled_compaction", _LIVE_SQL)
def _(spark, sf):
    store = _stored(spark, sf, Options(compaction_strategy="leveled", level0_compaction_threshold=2, base_level_target_bytes=1, level_size_multiplier=1000))
    store.compact()
    return _decoded(store.scan())


@query("g4_versioned_scan", _LIVE_SQL)
def _(spark, sf):
    return _decoded(_stored(spark, sf, Options(), VersionedStore).scan())


@query("b7_store_multi_get", f"{WITH}, {PROBES} SELECT p, v, live.k IS NOT NULL AS found FROM probes LEFT JOIN live ON live.k = p")
def _(spark, sf):
    store = _stored(spark, sf, Options(max_compaction_tiers=2))
    store.compact()
    wanted = probes(spark, sf).select("p", codec.encode(F.col("p"), "long").alias("key"))
    return store.multi_get(wanted).select("p", codec.decode(F.col("value"), "string").cast("double").alias("v"), "found")


@query("c2_store_seek", f"{WITH} SELECT k, v FROM live WHERE k >= 40")
def _(spark, sf):
    return _decoded(_stored(spark, sf, Options()).seek(codec.encode_python(40, "long")))


@query("c7_store_reverse_seek", f"{WITH} SELECT k, v FROM live WHERE k <= 90")
def _(spark, sf):
    return _decoded(_stored(spark, sf, Options()).reverse_seek(codec.encode_python(90, "long")))


@query("b1_store_get", f"{WITH}, {PROBES} SELECT p, v FROM (SELECT min(p) AS p FROM probes UNION SELECT max(p) FROM probes) LEFT JOIN live ON live.k = p")
def _(spark, sf):
    store = _stored(spark, sf, Options())
    low, high = probes(spark, sf).agg(F.min("p"), F.max("p")).first()
    found = [(p, store.get(p, "long", "string")) for p in sorted({low, high})]
    return spark.createDataFrame([(p, None if v is None else float(v)) for p, v in found], "p long, v double")


_STEP = "s AS (SELECT max(event_id) // 4 + 1 AS step FROM events)"


@query("g5_store_snapshot", f"WITH {LOG}, {_STEP}, old AS (SELECT * FROM log, s WHERE seq <= 2 * step), l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM old) SELECT k, v FROM l WHERE rn = 1 AND NOT tomb")
def _(spark, sf):
    # Each of the four batches is one commit; the snapshot is of the second.
    store = _stored(spark, sf, Options(), VersionedStore)
    return _decoded(store.as_of(2))


@query("g13_store_gc", f"{WITH} SELECT k, v FROM live")
def _(spark, sf):
    store = _stored(spark, sf, Options(), VersionedStore)
    store.collect_garbage(compact=True)
    return _decoded(store.scan())


@query("g8_store_transaction", f"{WITH} SELECT k, v FROM live WHERE k <> (SELECT min(k) FROM live) UNION ALL SELECT -1 AS k, 2.5 AS v")
def _(spark, sf):
    store = _stored(spark, sf, Options(), VersionedStore)
    first = store.scan(1).select(codec.decode(F.col("key"), "long")).first()
    change = store.transaction()
    if first is not None:
        change.delete(first[0], "long")
    change.put(-1, "2.5", "long", "string")
    change.commit()
    return _decoded(store.scan())


@query("a18_mixed_codecs", _LIVE_SQL)
def _(spark, sf):
    store = _stored(spark, sf, Options(compaction_strategy="none", compression="zstd"), parts=2)
    # Opened again with another codec and without filters, the latest half is written once more.
    store = Store.open(spark, store.path, Options(compaction_strategy="none", compression="none", bloom_fpp=None))
    store.write_batch(store.log().withColumnRenamed("seq", "order").select("key", "is_tombstone", "value", "order"), "order")
    return _decoded(Store.open(spark, store.path).scan())


@query("c4_disjoint_scan", "SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey >= 100 AND o_orderkey <= 5000")
def _(spark, sf):
    store = Store.open(spark, folder(spark))
    rows = table(spark, sf, "orders")
    for part in (F.col("o_orderkey") <= 2000, F.col("o_orderkey") > 2000):
        store.put_frame(rows.where(part).withColumn("v", F.col("o_totalprice").cast("string")), "o_orderkey", "v", "long", "string", "o_orderkey")
    return _decoded(store.live(codec.encode_python(100, "long"), codec.encode_python(5000, "long")))


@query("h1_key_encode", """SELECT o_orderkey, lpad(upper(to_hex(o_orderkey + (1::UBIGINT << 63)::HUGEINT)), 16, '0') AS long_key,
    lpad(upper(to_hex(CAST(o_orderkey AS BIGINT) + 2147483648)), 8, '0') AS int_key, lpad(upper(to_hex(o_orderkey)), 8, '0') AS uint_key,
    lpad(upper(to_hex(o_orderkey)), 16, '0') AS ulong_key, upper(to_hex(encode(o_orderpriority))) AS string_key FROM orders""")  # fmt: skip
def _(spark, sf):
    k = F.col("o_orderkey")
    kinds = [F.hex(codec.encode(k, n)).alias(f"{n}_key") for n in ("long", "int", "uint", "ulong")]
    return table(spark, sf, "orders").select("o_orderkey", *kinds, F.hex(codec.encode(F.col("o_orderpriority"), "string")).alias("string_key"))


@query("h1_key_decode", "SELECT o_orderkey AS k, o_orderkey AS l, CAST(o_orderkey AS INTEGER) AS i, CAST(o_orderkey % 65536 AS INTEGER) AS s, o_orderpriority AS t FROM orders")
def _(spark, sf):
    k = F.col("o_orderkey")
    back = lambda c, n: codec.decode(codec.encode(c, n), n)
    return table(spark, sf, "orders").select(k.alias("k"), back(k, "long").alias("l"), back(k, "int").alias("i"), back(k % 65536, "ushort").alias("s"), back(F.col("o_orderpriority"), "string").alias("t"))


@query("h4_varint", "SELECT event_id, event_id * 1000003 AS n FROM events")
def _(spark, sf):
    n = F.col("event_id") * 1000003
    return table(spark, sf, "events").select("event_id", codec.from_varint(codec.varint(n)).alias("n"))


@query("h5_value_code", "SELECT event_id, CASE WHEN event_type = 'error' THEN 0 WHEN event_type = 'view' THEN -1 ELSE octet_length(encode(props)) END AS code FROM events")
def _(spark, sf):
    value = F.when(F.col("event_type") == "view", F.lit(b"")).otherwise(F.encode("props", "UTF-8"))
    return table(spark, sf, "events").select("event_id", codec.value_code(value, F.col("event_type") == "error").alias("code"))


@query("h9_workload_key", "SELECT c_custkey, lpad(upper(to_hex(c_custkey)), 16, '0') || repeat('30', 8) AS key FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.hex(codec.workload_key(F.col("c_custkey"))).alias("key"))


@query("a6_json_value", "SELECT event_id, json_extract_string(props, '$.k') AS value FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.decode(codec.json_scalar(F.col("props"), "$.k"), "UTF-8").alias("value"))


@query("a5_concat_segments", "SELECT c_custkey, upper(to_hex(encode(c_name || c_mktsegment))) AS value FROM customer")
def _(spark, sf):
    parts = F.array(F.encode("c_name", "UTF-8"), F.encode("c_mktsegment", "UTF-8"))
    return table(spark, sf, "customer").select("c_custkey", F.hex(codec.concatenated(parts)).alias("value"))


@query("g14_version_key", """WITH x AS (SELECT c_custkey, lpad(upper(to_hex(c_custkey)), 8, '0') AS key FROM customer)
    SELECT c_custkey, key, c_custkey AS seq, '01' || regexp_replace(regexp_replace(regexp_replace(key, '(..)', '\\1 ', 'g'), '00 ', '00FF', 'g'), ' ', '', 'g')
    || '0000' || lpad(upper(to_hex(18446744073709551615::HUGEINT - c_custkey)), 16, '0') AS version_key FROM x""")  # fmt: skip
def _(spark, sf):
    key, seq = F.unhex(F.lpad(F.hex("c_custkey"), 8, "0")), F.col("c_custkey")
    rows = table(spark, sf, "customer").withColumn("vk", codec.version_key(key, seq))
    back, number = codec.version_key_parts(F.col("vk"))
    return rows.select("c_custkey", F.hex("vk").alias("version_key"), F.hex(back).alias("key"), number.alias("seq"))


@query("i1_bloom_sizing", """WITH s AS (SELECT n, p, CAST(ceil(-(n * ln(p)) / (ln(2) * ln(2))) AS BIGINT) AS m FROM (VALUES (1000), (10000)) a(n), (VALUES (0.01), (0.05), (0.1), (0.5)) b(p)),
    f AS (SELECT *, greatest(1, floor(ln(2) * m / n)) AS lo, greatest(1, ceil(ln(2) * m / n)) AS hi FROM s)
    SELECT CAST(n AS BIGINT) AS n, CAST(p AS DOUBLE) AS p, m, CAST(CASE WHEN pow(1 - exp(-lo * n / m), lo) <= pow(1 - exp(-hi * n / m), hi) THEN lo ELSE hi END AS BIGINT) AS k FROM f""")  # fmt: skip
def _(spark, sf):
    rows = [(n, p, bloom.bits(n, p), bloom.hashes(n, bloom.bits(n, p))) for n in (1000, 10000) for p in (0.01, 0.05, 0.1, 0.5)]
    return spark.createDataFrame(rows, "n long, p double, m long, k long")


@query("l1_fill_overwrite_delete")
def _(spark, sf):
    """Fill, overwrite and delete; what is left, with its length."""
    store = Store.open(spark, folder(spark), Options(max_compaction_tiers=3))
    for ops in (workloads.fill(spark, 20_000), workloads.fill(spark, 20_000, "overwrite"), workloads.delete_random(spark, 5_000)):
        store.write_batch(ops)
    store.compact()
    return store.scan().select(F.hex("key").alias("key"), F.octet_length("value").alias("bytes"))


@query("l2_read_random_and_missing", "SELECT * FROM (VALUES (false, 2000, 2000), (true, 2000, 0)) t(missing, reads, found)")
def _(spark, sf):
    store = Store.open(spark, folder(spark))
    store.write_batch(workloads.fill(spark, 10_000))
    both = workloads.probes(spark, 10_000, 2_000).withColumn("missing", F.lit(False)).unionByName(workloads.probes(spark, 10_000, 2_000, missing=True).withColumn("missing", F.lit(True)))
    return store.multi_get(both).groupBy("missing").agg(F.count(F.lit(1)).cast("int").alias("reads"), F.count_if("found").cast("int").alias("found"))


@query("l6_percentiles", """SELECT avg(value) AS avg, min(CASE WHEN r >= ceil(0.5 * n) THEN value END) AS p50, min(CASE WHEN r >= ceil(0.95 * n) THEN value END) AS p95,
    min(CASE WHEN r >= ceil(0.99 * n) THEN value END) AS p99, max(value) AS max
    FROM (SELECT value, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS n FROM events)""")  # fmt: skip
def _(spark, sf):
    return workloads.percentiles(table(spark, sf, "events"), "value")
