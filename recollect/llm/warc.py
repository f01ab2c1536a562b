"""Content-addressed WARC archive.

A record is an exact header block and a payload. ``archive`` keeps the header
blocks in one table and each distinct payload once in another, addressed by
SHA-256; ``reconstruct`` joins them back to the original record bytes.

Digests are verified: the payload table carries the length and a second,
independent hash, and a digest under which two payloads differ raises when it
is read (``assert_true``), as does a stored payload that no longer hashes to its
address.

Payloads are bytes, so binary ones and ones that aren't UTF-8 come back byte for
byte; text is taken as its UTF-8 bytes. Records are bytes too.

Defined results: a null payload has no digest, takes no payload row and
reconstructs to its header alone; an empty payload is a payload of length 0.
A null url leaves out the target line. Repeated rows are separate records that
share a payload. Extra columns are ignored; an empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EOL = "\r\n"


def header(record: Column, url: Column, payload: Column) -> Column:
    """The header block of a response record, up to and including the blank line."""
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(EOL))
    digest = F.sha2(payload, 256)
    m = F.md5(F.coalesce(record.cast("string"), F.lit("")))
    uuid = F.concat_ws("-", *(F.substring(m, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.concat(
        F.lit("WARC/1.1" + EOL + "WARC-Type: response" + EOL),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), uuid, F.lit(">" + EOL)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        F.coalesce(line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)), F.lit("")),
        F.lit("Content-Type: text/html" + EOL),
        F.concat(F.lit("Content-Length: "), F.coalesce(F.octet_length(payload), F.lit(0)).cast("string"), F.lit(EOL + EOL)),
    )


def records(pages: DataFrame) -> DataFrame:
    """(page_id, header, payload) of every page."""
    return pages.select("page_id", header(F.col("page_id"), F.col("url"), F.col("html")).alias("header"), F.col("html").cast("binary").alias("payload"))


def split(raw: DataFrame, column: str = "record") -> DataFrame:
    """Adds ``header`` (text) and ``payload`` (bytes) to rows that hold whole records; the header ends at the first blank line."""
    body = F.col(column).cast("binary")
    at = F.instr(F.decode(body, "ISO-8859-1"), EOL + EOL)  # a character a byte
    cutoff = F.when(at > 0, at + 3).otherwise(F.octet_length(body))
    return raw.withColumns({"header": F.substr(body, F.lit(1), cutoff).cast("string"), "payload": F.substr(body, cutoff + 1)})


def archive(recs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads): headers keep every record, payloads each content once."""
    addressed = recs.withColumn("payload", F.col("payload").cast("binary")).withColumn("digest", F.sha2("payload", 256))
    headers = addressed.select("page_id", "header", "digest")
    check = F.struct(F.octet_length("payload").alias("n"), F.xxhash64("payload").alias("h"))
    payloads = (
        addressed.where(F.col("digest").isNotNull())
        .withColumn("check", check)
        .groupBy("digest")
        .agg(F.first("payload").alias("payload"), F.min("check").alias("lo"), F.max("check").alias("hi"), F.count("*").alias("copies"))
        .withColumn("same", F.assert_true(F.col("lo") == F.col("hi"), F.lit("two payloads under one digest")))
        .select("digest", "payload", "copies", F.coalesce("same", F.lit(None)).cast("string").alias("verified"))
    )
    return headers, payloads


def reconstruct(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(page_id, digest, copies, header, record): original record bytes by a join on the digest.

    The payload table is already hashed by digest, so only the narrow headers move.
    """
    sound = F.coalesce(
        F.assert_true(F.sha2("payload", 256) == F.col("digest"), F.lit("a payload does not match its digest")).cast("string"),
        F.col("verified"),
        F.lit(""),
    ).cast("binary")
    joined = headers.join(payloads, "digest", "left")
    none = F.lit("").cast("binary")
    return joined.select(
        "page_id",
        "digest",
        F.coalesce("copies", F.lit(0)).cast("bigint").alias("copies"),
        "header",
        F.concat(F.col("header").cast("binary"), F.coalesce("payload", none), F.when(F.col("payload").isNotNull(), sound).otherwise(none)).alias("record"),
    )


SQL = """
WITH r AS (
  SELECT page_id, html, sha256(html) AS digest, md5(coalesce(CAST(page_id AS VARCHAR), '')) AS m, url FROM pages
), h AS (
  SELECT page_id, html, digest,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:uuid:' || substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) || '>' || chr(13) || chr(10)
    || coalesce('WARC-Target-URI: ' || url || chr(13) || chr(10), '')
    || coalesce('WARC-Payload-Digest: sha256:' || digest || chr(13) || chr(10), '')
    || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || CAST(coalesce(strlen(html), 0) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) AS header
  FROM r
)
SELECT page_id, digest, CASE WHEN digest IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY digest) END AS copies,
  header, header || coalesce(html, '') AS record
FROM h
"""
