"""Content-addressed WARC archive.

Two tables make an archive: payloads (key, payload), each payload once under its SHA-256,
and headers (record's exact header bytes with the key of its payload). Records are
rebuilt by joining the two, and each payload's digest is computed again as it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import written

#: Payloads of fewer bytes are stored once too, but each of their records is a response.
REVISIT_FROM = 1000
END = "\r\n\r\n"


def _header(row_id, url, kind, digest, refers_to, length, date: str):
    lines = [
        F.lit("WARC/1.1\r\nWARC-Type: "), kind,
        F.concat(F.lit("\r\nWARC-Record-ID: <urn:x-page:"), F.coalesce(row_id.cast("string"), F.lit("null")), F.lit(">")),
        F.concat(F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20]", "%20")),
        F.concat(F.lit("\r\nWARC-Payload-Digest: sha1:"), digest),
        F.when(refers_to.isNotNull(), F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:x-page:"), refers_to.cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), length.cast("string"), F.lit(END),
    ]
    return F.concat(*lines)


def archive(pages: DataFrame, revisit_from: int = REVISIT_FROM, date: str = "2024-01-01T00:00:00Z") -> tuple[DataFrame, DataFrame]:
    """(headers, payloads) written to the shared folder.

    Null html is empty. Of equal payloads of revisit_from bytes or more the record with the
    largest page_id is the response (rows that repeat it are responses too; a null id counts
    as the smallest); null urls are empty. An empty table gives empty tables."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    keyed = pages.withColumn("key", F.sha2("payload", 256))
    facts = keyed.select("page_id", "url", "key", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("n"))
    first = facts.where(F.col("n") >= revisit_from).groupBy("key").agg(F.max("page_id").alias("response_id"))
    joined = facts.join(first, "key", "left")
    revisit = (F.col("n") >= revisit_from) & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    kind = F.when(revisit, "revisit").otherwise("response")
    refers_to = F.when(revisit, F.col("response_id"))
    length = F.when(revisit, F.lit(0)).otherwise(F.col("n"))
    headers = joined.select("key", _header(F.col("page_id"), F.col("url"), kind, F.col("digest"), refers_to, length, date).cast("binary").alias("header"))
    payloads = keyed.groupBy("key").agg(F.first("payload").alias("payload"))
    return written(headers, "warc-headers"), written(payloads, "warc-payloads")


def verified(payloads: DataFrame) -> DataFrame:
    """payloads with SHA-1 and length, after their SHA-256 is found to be their key; else the read fails."""
    checked = F.when(F.sha2("payload", 256) == F.col("key"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload doesn't match its digest "), F.col("key"))).cast("binary"))
    return payloads.withColumn("payload", checked)


def records(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """record: the original record's bytes; a revisit has its header alone. payload: the full payload either way.

    A header whose payload is missing has no row; headers that repeat give a record each."""
    head = F.decode("header", "UTF-8")
    body = F.when(head.contains("\r\nWARC-Type: revisit\r\n"), F.lit(b"")).otherwise(F.col("payload"))
    return headers.join(verified(payloads), "key").select("key", "header", "payload", F.concat("header", body, F.lit(END.encode())).alias("record"))


def _field(head, name: str):
    value = F.regexp_extract(head, rf"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(value != "", value)


def page_id_of(uri):
    return F.regexp_extract(uri, r"<urn:x-page:(-?\d+)>", 1).try_cast("long")


def read(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of an archive.

    Each record is rebuilt and cut at its header's end again; one whose body isn't as long as it says, or whose full payload
    hasn't the digest that it names, or that doesn't end as records do, fails the read."""
    ended = F.octet_length("record") - len(END)
    at = F.octet_length("header")
    parsed = records(headers, payloads).select(
        "key", F.substring_index(F.decode("header", "UTF-8"), END, 1).alias("head"), F.col("record").substr(at + 1, ended - at).alias("body"),
        (F.col("record").substr(ended + 1, F.lit(len(END))) == F.lit(END.encode())).alias("whole"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("full"),
    )
    parsed = parsed.select(
        "key", "whole", "payload_bytes", "full", F.octet_length("body").cast("long").alias("body_bytes"), page_id_of(_field("head", "WARC-Record-ID")).alias("page_id"), _field("head", "WARC-Type").alias("record_type"),
        page_id_of(_field("head", "WARC-Refers-To")).alias("refers_to"), _field("head", "WARC-Payload-Digest").alias("said"), _field("head", "Content-Length").cast("long").alias("length"),
    )
    body = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("payload_bytes"))
    good = F.col("whole") & (F.col("said") == F.concat(F.lit("sha1:"), "full")) & (F.col("length") == F.col("body_bytes")) & (F.col("body_bytes") == body)
    digest = F.when(good, F.col("full")).otherwise(F.raise_error(F.concat(F.lit("a header doesn't match its payload "), F.col("key"))).cast("string"))
    return parsed.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
