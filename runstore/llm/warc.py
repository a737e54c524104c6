"""Content-addressed web archive.

An archive is a folder of two tables.  ``payloads`` holds the bytes of every distinct payload once, under their
SHA-256, which is verified whenever they are read; ``records`` holds the exact header block of every WARC record and
the address of its payload.  Original records are rebuilt by joining the two.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, shared

HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def base32(hex160: Column) -> Column:
    """RFC 4648 base32 of 160 bits given as 40 hexadecimal digits."""
    group = lambda k: F.lpad(F.conv(F.substring(hex160, 1 + 10 * k, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*[group(k) for k in range(4)]), HEX32, BASE32)


def _uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def _header() -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    response = F.col("record_type") == "response"
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("about:blank")), "[\\r\\n]", "%0A")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _uri(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", url),
        F.when(response, F.lit("")).otherwise(F.concat(line("WARC-Refers-To", _uri(F.col("winner"))), line("WARC-Profile", F.lit(PROFILE)))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(response, F.col("bytes")).otherwise(F.lit(0)).cast("string")),
        F.lit("\r\n"),
    )


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> None:
    """Archive ``pages`` under ``path``: a record per row, its payload the html in UTF-8 (null: empty).

    Of records with equal payloads of at least ``min_bytes`` bytes that with the largest page_id is a response and the
    others revisit it; smaller ones are all responses.  Repeated rows with the largest page_id are all responses, and
    share the one stored payload.  A null page_id is smaller than any other.  An empty table gives an empty archive.
    Payloads that surely occur once go to the archive without a shuffle; of the others only row keys shuffle.
    """
    raw = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    raw = raw.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    meta = shared.written(raw.select("page_id", "url", "digest", base32(F.upper(F.sha1("payload"))).alias("sha1"), F.octet_length("payload").cast("long").alias("bytes")), "pages")
    bitmap = exact_dedup.repeated_filter(meta.select(exact_dedup.hashed(F.col("digest")).alias("h")), exact_dedup.filter_bits(meta.count()))
    test = exact_dedup.maybe_repeated(pages.sparkSession, bitmap)

    marked = meta.withColumn("maybe", test(exact_dedup.hashed(F.col("digest"))))
    once, rest = marked.where("NOT maybe"), marked.where("maybe")
    groups = shared.written(rest.groupBy("digest").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n")), "winners")
    found = shared.salted_join(rest, groups.drop("n"), "digest", shared.hot_keys(groups.where("n > 1"), "digest"), F.col("page_id"))
    roles = once.withColumn("winner", F.col("page_id")).unionByName(found)
    response = (F.col("bytes") < min_bytes) | F.col("page_id").eqNullSafe(F.col("winner"))
    roles = roles.withColumn("record_type", F.when(response, "response").otherwise("revisit"))
    roles.select("digest", _header().alias("header")).write.parquet(f"{path}/records")

    stored = raw.select("page_id", "digest", "payload").withColumn("maybe", test(exact_dedup.hashed(F.col("digest"))))
    # Keyed by page too, so that a payload which a third of all pages share is no hot key; then one copy of each.
    winners = groups.select(F.col("winner").alias("page_id"), "digest")
    chosen = stored.where("maybe").join(winners, (stored["page_id"].eqNullSafe(winners["page_id"])) & (stored["digest"] == winners["digest"]), "left_semi")
    chosen = chosen.groupBy("digest").agg(F.first("payload").alias("payload"))
    payloads = stored.where("NOT maybe").select("digest", "payload").unionByName(chosen.select("digest", "payload"))
    payloads.write.option("compression", "zstd").parquet(f"{path}/payloads")


def _field(name: str, header: str = "header") -> Column:
    """A field's value; lines end at CR LF alone, which no value holds, so that none can pass for a line of its own."""
    return F.regexp_extract(header, f"\\r\\n{name}: ([^\\r\\n]*)\\r\\n", 1)


def _number(uri: Column) -> Column:
    return F.regexp_extract(uri, "^<urn:page:(-?\\d+)>$", 1).try_cast("long")


def records(spark: SparkSession, path: str) -> DataFrame:
    """The archive's records with parsed headers: header, digest, page_id, record_type."""
    return spark.read.parquet(f"{path}/records").select("digest", "header", _number(_field("WARC-Record-ID")).alias("page_id"), _field("WARC-Type").alias("record_type"))


def verified(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads; one whose bytes don't have their address as digest fails the job."""
    return spark.read.parquet(f"{path}/payloads").where(
        F.when(F.unhex(F.sha2("payload", 256)) == F.col("digest"), True).otherwise(F.raise_error(F.concat(F.lit("corrupt payload "), F.hex("digest"))).cast("boolean"))
    )


def _joined(spark: SparkSession, path: str, payloads: DataFrame) -> DataFrame:
    left = records(spark, path)
    counts = spark.read.parquet(f"{path}/records").groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    # Hot digests are at most HOT_PARTS, so what salting copies of their payloads is bounded.
    return shared.salted_join(left, payloads, "digest", shared.hot_keys(counts, "digest"), F.col("page_id"))


def rebuilt(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record (the exact WARC record: header block, payload of a response, two line ends), payload (also of a revisit)."""
    found = _joined(spark, path, verified(spark, path))
    end = F.lit(b"\r\n\r\n")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return found.select("page_id", "record_type", F.concat(F.encode("header", "UTF-8"), body, end).alias("record"), "payload")


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, from the rebuilt records.

    Each record is parsed anew: its header block, and the body of the length that is left.  A record whose
    body isn't of its Content-Length, or whose payload hasn't the digest that its header names, fails the job.
    """
    parsed = rebuilt(spark, path).select("record", "payload", F.concat(F.substring_index(F.col("record").cast("string"), "\r\n\r\n", 1), F.lit("\r\n")).alias("head"))
    parsed = parsed.select("head", "payload", F.expr("substring(record, octet_length(head) + 3, octet_length(record) - octet_length(head) - 6)").alias("body"))
    parsed = parsed.select("head", "body", _field("WARC-Type", "head").alias("record_type"), F.when(_field("WARC-Type", "head") == "response", F.col("body")).otherwise(F.col("payload")).alias("payload"))
    out = parsed.select(
        _number(_field("WARC-Record-ID", "head")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.upper(F.sha1("payload"))).alias("payload_digest"),
        "record_type", _number(_field("WARC-Refers-To", "head")).alias("refers_to"), F.octet_length("body").cast("string").alias("_length"),
        _field("Content-Length", "head").alias("_named"), F.substring(_field("WARC-Payload-Digest", "head"), 6, 32).alias("_digest"),
    )
    agrees = F.when((F.col("_length") == F.col("_named")) & (F.col("_digest") == F.col("payload_digest")), True)
    return out.where(agrees.otherwise(F.raise_error(F.concat(F.lit("a record that its header doesn't describe: "), F.col("page_id").cast("string"))).cast("boolean"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def export(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Write the rebuilt records as ``.warc.gz`` members, a file per task, to ``folder`` (on a file system that all
    executors mount); returns file and records written.  A repeated task writes the same name anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip
        import os

        from pyspark import TaskContext

        os.makedirs(folder, exist_ok=True)
        name, n = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0
        with open(f"{name}.{os.getpid()}.tmp", "wb") as out:
            for b in batches:
                for x in b.column(0):
                    out.write(gzip.compress(x.as_py(), 6, mtime=0))
                    n += 1
        os.replace(out.name, name)
        yield pa.RecordBatch.from_pydict({"file": [name], "n": pa.array([n], pa.int64())})

    return rebuilt(spark, path).select("record").mapInArrow(run, "file string, n long")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.scratch_path(spark, "archive")
    write(shared.table(spark, sf_dir, "pages"), path, min_bytes=0)
    return read(spark, path)


_GROUP = "lpad(to_base(('0x' || substr(h, {0}, 10))::BIGINT, 32), 8, '0')"
OP4_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS winner
  FROM pages
)
SELECT page_id,
       CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       translate({" || ".join(_GROUP.format(1 + 10 * k) for k in range(4))}, '{HEX32}', '{BASE32}') AS payload_digest,
       CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> winner THEN winner END AS refers_to
FROM p
"""
