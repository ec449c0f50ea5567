"""Content-addressed web archive: payload bytes stored once, exact record headers apart, records rebuilt by joins.

``write`` makes two tables in a shared folder. ``payloads`` has every distinct payload once, under its SHA-256;
``headers`` has the exact header bytes of every record and the address of its payload. ``read`` joins them, rebuilds
the records and verifies both digests; a payload that does not match its address fails the read.

Of the records with equal payloads of at least ``least`` bytes, that with the largest id is a response and the others
are revisits of it; records with smaller payloads are all responses.

Defined results: a null payload counts as empty; rows that repeat the largest id are all responses; a null id is
smaller than any other (if a payload has only null ids, its rows are all responses); a null url has no target line,
and line breaks in a url are percent-encoded; further columns are not archived.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STAGED, shared_dir

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2026-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1, without padding: 160 bits are eight groups of 20 bits, of four letters each."""
    code = F.sha1(payload)
    letters = F.lit(BASE32)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: _letter(code, letters, i)), "")


def _letter(code: Column, letters: Column, i: Column) -> Column:
    group = F.conv(F.substring(code, F.floor(i / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("int")
    shift = F.lit(32) ** (3 - i % 4)
    return F.substring(letters, (F.floor(group / shift) % 32).cast("int") + 1, F.lit(1))


def write(records: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, date: str = DATE) -> None:
    """Archive one record per row under ``path``."""
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    own = records.select(F.col(key).alias("record_key"), F.col(url).alias("record_url"), body.alias("payload")).withColumn("address", F.sha2("payload", 256))
    stored = own.groupBy("address").agg(F.first("payload").alias("payload"), F.max("record_key").alias("response_key"))
    stored.withColumns({"payload_sha1": base32_sha1(F.col("payload")), "payload_bytes": F.octet_length("payload").cast("long")}).write.parquet(f"{path}/payloads")
    index = records.sparkSession.read.parquet(f"{path}/payloads").drop("payload")
    every = own.select("record_key", "record_url", "address").join(index, "address")
    response = (F.col("payload_bytes") < least) | F.col("record_key").eqNullSafe(F.col("response_key"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    target = F.replace(F.replace(F.col("record_url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(response, "response").otherwise("revisit")), line("WARC-Record-ID", name("record_key")),
        F.when(~response, line("WARC-Refers-To", name("response_key"))).otherwise(""), F.coalesce(line("WARC-Target-URI", target), F.lit("")), line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_sha1"))), line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.when(response, F.col("payload_bytes")).otherwise(0) + len(HTTP)).cast("string")), F.lit("\r\n" + HTTP),
    )
    every.select("record_key", F.encode(header, "UTF-8").alias("header"), "address").write.parquet(f"{path}/headers")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The archived records: record_key, record_type, refers_to, payload, payload_digest and record (bytes as in a WARC file).

    Payloads and headers meet once; a common payload's headers are many rows on one side of that join only, which
    adaptive execution splits.
    """
    payloads = spark.read.parquet(f"{path}/payloads").select("address", "payload")
    fault = F.raise_error(F.concat(F.lit("payload does not match its digest: "), F.col("address")))
    checked = payloads.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(fault))
    every = spark.read.parquet(f"{path}/headers").join(checked, "address")
    text = F.decode("header", "UTF-8")
    field = lambda pattern: F.regexp_extract(text, rf"\r\n{pattern}\r\n", 1)
    every = every.withColumns({"record_type": field("WARC-Type: (\\w+)"), "payload_digest": field("WARC-Payload-Digest: sha1:(\\w+)"), "refers": field("WARC-Refers-To: <urn:page:(.*?)>")})
    kind = every.schema["record_key"].dataType
    ends = F.encode(F.lit("\r\n\r\n"), "UTF-8")
    record = F.when(F.col("record_type") == "response", F.concat("header", "payload", ends)).otherwise(F.concat("header", ends))
    return every.select("record_key", "record_type", F.nullif("refers", F.lit("")).cast(kind).alias("refers_to"), "payload", "payload_digest", record.alias("record"))


def export(spark: SparkSession, path: str, out: str) -> None:
    """Write the archive as gzipped WARC files, through Spark's own writer (payloads must be UTF-8 text)."""
    text = F.decode("record", "UTF-8")
    read(spark, path).select(F.substring(text, F.lit(1), F.length(text) - 4).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(out)


def archived(records: DataFrame, **options: object) -> DataFrame:
    """Write the records into a new archive in the shared folder, and read it back."""
    path = f"{shared_dir(records.sparkSession)}/warc-{uuid.uuid4().hex}"
    STAGED.append(path)
    write(records, path, **options)
    return read(records.sparkSession, path)
