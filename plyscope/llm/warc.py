"""WARC archives without repeated payloads.

Only headers (key and payload digest) are shuffled by digest to find each
payload's first record; they are written once, and what many records share
(an empty page) is looked up in a small broadcast table.  The payloads
themselves move once, by key, which no popular payload can skew.  Every later
record of a payload becomes a revisit with fresh headers that refer to the
response.  Archives are written by Spark's text writer, so task retries and
commits are Spark's, in files of about ARCHIVE bytes of payload.  They are
streamed back record by record after their Content-Length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import looked_up, ship, width, written

#: The alphabet of base 32 (fixed value).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: What a record begins with and what stands between two (fixed values).
BEGIN, BETWEEN = "WARC/1.1\r\n", "\r\n\r\n"
#: Bytes of payload in an archive, about.
ARCHIVE = 128 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "

RECORDS = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("key", T.LongType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("refers_to_id", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def base32(sha1: Column) -> Column:
    """Bare upper-case base 32 of a SHA-1 in hex, by eight characters from ten hex digits."""
    digits = F.concat(*(F.lpad(F.conv(F.substring(sha1, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)))
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def resolve(pages: DataFrame, key: str = "page_id", payload: str = "html", uri: str = "url", least_bytes: int = 0) -> DataFrame:
    """Decide which records are responses and which revisit an earlier one.

    Returns key, uri, payload, payload_bytes, payload_digest, refers_to: the
    smallest key with the same payload, or null for a response.  Payloads
    under ``least_bytes`` are never revisited.  Null payloads count as empty;
    a record with a null key is a response that nothing refers to; rows that
    repeat a response's key and payload are responses too, those that repeat
    a revisit's are revisits.  An empty table gives no rows; other columns
    aren't read.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(uri).cast("string").alias("uri"), body.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1(F.col("payload").cast("binary")))
    heads = written(rows.select("key", "payload_bytes", "sha1"), "warc-heads")
    total, size = heads.agg(F.count(F.lit(1)), F.sum("payload_bytes")).first()
    known = heads.where((F.col("payload_bytes") >= least_bytes) & F.col("key").isNotNull()).select("key", "sha1")
    first = written(known.groupBy("sha1").agg(F.min("key").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1"), "warc-first")
    later = looked_up(known, "sha1", first, total).where("key > refers_to").distinct()
    parts = max(width(spark), -(-(size or 0) // ARCHIVE))
    keyed = rows.where(F.col("key").isNotNull()).repartition(parts, "key", "sha1")
    joined = keyed.join(later, ["key", "sha1"], "left")
    # rows without a key stay where they are: a join would send them to one task
    out = joined.unionByName(rows.where(F.col("key").isNull()).withColumn("refers_to", F.lit(None).cast("long")))
    return out.select("key", "uri", "payload", "payload_bytes", base32(F.col("sha1")).alias("payload_digest"), "refers_to")


def record_id(key: Column, digest: Column) -> Column:
    """A record's URN, of its key and payload."""
    h = F.md5(F.concat_ws(":", key.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def write(resolved: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", records_per_file: int = 0) -> None:
    """Write the records that resolve() returns as gzip-compressed WARC files, with at most so many records, if told.

    A revisit has the HTTP head of its response and no body.  Line breaks in
    a URI are percent-encoded; without a URI the header is left out.
    """
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(F.lit(HTTP), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, head).otherwise(F.concat(head, "payload"))
    uri = F.regexp_replace(F.regexp_replace("uri", "\r", "%0D"), "\n", "%0A")
    record = F.concat(
        F.lit(BEGIN),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("key"), F.col("payload_digest"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        F.coalesce(line("Source-Key", F.col("key").cast("string")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", record_id(F.col("refers_to"), F.col("payload_digest"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    resolved.select(record.alias("value")).write.option("lineSep", BETWEEN).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse(chunks: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """File, headers (names in lower case) and block of each record, from what stands between BEGINs in files.

    A block that holds BEGIN itself comes in several chunks, which its length
    puts together again.
    """
    begin = BEGIN.encode()
    for file, chunk in chunks:
        if not chunk:  # before the first record of a file
            continue
        end = chunk.index(b"\r\n\r\n")
        head = {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in chunk[:end].decode().split("\r\n"))}
        size = int(head["content-length"])
        parts, have = [chunk[end + 4 :]], len(chunk) - end - 4
        while have < size:
            other, more = next(chunks, (None, b""))
            if other != file:
                raise ValueError(f"{file}: the record {head.get('warc-record-id')} is cut off")
            parts += [begin, more]
            have += len(begin) + len(more)
        yield file, head, b"".join(parts)[:size]


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all gzip-compressed archives under ``path`` (RECORDS).

    payload_bytes and payload_digest of a response are measured on what was
    read and checked against its header; of a revisit they are its headers'.
    ``payloads=False`` leaves the column payload null.  An archive is
    streamed: a task holds a few records of it at once.
    """
    ship(spark)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ((f, c.as_py()) for b in batches for f, c in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        out, held = [], 0
        for name, head, block in parse(chunks):
            http, _, payload = block.partition(b"\r\n\r\n")
            said = head["warc-payload-digest"].removeprefix("sha1:")
            if head["warc-type"] == "response":
                if base64.b32encode(hashlib.sha1(payload).digest()).decode() != said:
                    raise ValueError(f"{name}: the payload of {head['warc-record-id']} doesn't have its digest")
                size = len(payload)
            else:
                size, payload = int(http.rpartition(b":")[2]), None
            key = head.get("source-key")
            out.append((head["warc-record-id"], head["warc-type"], None if key is None else int(key), head.get("warc-target-uri"), head.get("warc-refers-to"), size, said, payload if payloads else None))
            held += size * payloads
            if len(out) == 512 or held > 16 << 20:
                yield batch(out)
                out, held = [], 0
        yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], RECORDS.names)

    found = spark.read.option("lineSep", BEGIN).option("pathGlobFilter", "*.gz").text(path)
    return found.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")).mapInArrow(rows, RECORDS)


def joined_revisits(records: DataFrame) -> DataFrame:
    """``records`` with refers_to: the key of the response that a revisit names.

    Records are read several times; those just read from archives should be written first.
    """
    plain = records.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    revisits = records.where("record_type = 'revisit'")
    named = revisits.groupBy("refers_to_id").agg(F.count(F.lit(1)).alias("n"))
    responses = plain.groupBy(F.col("record_id").alias("refers_to_id")).agg(F.min("key").alias("to"))
    table = written(named.join(responses, "refers_to_id", "left"), "warc-named")
    found = looked_up(revisits, "refers_to_id", table, records.count()).withColumnRenamed("to", "refers_to")
    loose = revisits.where("refers_to_id is null").withColumn("refers_to", F.lit(None).cast("long"))
    return plain.unionByName(found.select(*plain.columns)).unionByName(loose.select(*plain.columns))
