"""A content-addressed WARC archive, in DataFrame operations.

Two Parquet tables in shared storage: `payloads` has each distinct payload once, under its SHA-256; `headers` has
the exact header bytes of every record. A record is its header, and the payload found by a join on the digest.
HTML is shuffled once, to bring each digest's one stored copy out; all else moves ids and digests only. Whoever
reads a payload recomputes its digest, so a damaged or mistaken payload stops the read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.shared import cut, new_path

#: Smaller payloads are never replaced by a revisit record.
LEAST = 1000
#: WARC 1.1 record types, field names, line ends and the revisit profile: fixed values of the format.
VERSION, CRLF = "WARC/1.1", "\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uuid(key: Column) -> Column:
    h = F.md5(key)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), _uuid(F.concat(F.lit("record:"), page.cast("string"))), F.lit(">"))


def _header(kind: Column, page: Column, url: Column, size: Column, sha1: Column, sha256: Column, refers: Column) -> Column:
    """The bytes before a record's block, empty line included. Line ends in a URL would end the field and are escaped."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    target = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "\r", "%0D"), "\n", "%0A")
    revisit = kind == "revisit"
    fields = [
        line("WARC-Type", kind),
        line("WARC-Record-ID", _record_id(page)),
        line("WARC-Target-URI", target),
        line("X-Page-ID", F.coalesce(page.cast("string"), F.lit(""))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        line("X-Payload-SHA256", sha256),
        line("X-Payload-Length", size.cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT)), line("WARC-Refers-To", _record_id(refers)), line("X-Refers-To-Page-ID", refers.cast("string")))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, "0").otherwise(size.cast("string"))),
        F.lit(CRLF),
    ]
    return F.encode(F.concat(F.lit(VERSION + CRLF), *fields), "UTF-8")


def write_archive(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Writes one record per row of pages (page_id, url, html) to `path`.

    Of equal payloads of `least` bytes or more, the row with the largest page_id is a response and the others
    revisit it. Rows without a page_id, and rows that repeat a page_id with the same payload, are responses of their
    own. A null html is an empty payload, a null url an empty field, other columns aren't archived.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    each = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload")).select("page_id", "url", "payload", F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size"))
    facts = cut(each.drop("payload"))
    first = facts.groupBy("sha256", "size").agg(F.max("page_id").alias("last"))
    known = facts.join(first, ["sha256", "size"])
    revisit = (F.col("size") >= least) & (F.col("page_id") != F.col("last"))
    kind = F.when(F.coalesce(revisit, F.lit(False)), "revisit").otherwise("response")
    header = _header(kind, F.col("page_id"), F.col("url"), F.col("size"), F.col("sha1"), F.col("sha256"), F.col("last"))
    known.select("page_id", "sha256", header.alias("header")).write.parquet(f"{path}/headers")
    # one copy of each payload: copies that stand in one task are merged before the shuffle
    each.select("sha256", "payload").groupBy("sha256").agg(F.any_value("payload").alias("payload")).write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, header, payload: the original records, each with its full payload, verified against its digest."""
    stored = spark.read.parquet(f"{path}/payloads")
    same = F.sha2("payload", 256) == F.col("sha256")
    checked = stored.select("sha256", F.when(same, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload differs from its digest"))).alias("payload"))
    return spark.read.parquet(f"{path}/headers").join(checked, "sha256").select("page_id", "header", "payload")


def warc_bytes(records: DataFrame) -> DataFrame:
    """page_id, record: the bytes of each record as they stand in a WARC file."""
    end = F.encode(F.lit(CRLF + CRLF), "UTF-8")
    body = F.when(_field("WARC-Type") == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    return records.select("page_id", F.concat("header", body, end).alias("record"))


def _field(name: str) -> Column:
    text = F.decode("header", "UTF-8")
    return F.nullif(F.regexp_extract(text, rf"(?m)^{name}: ([^\r\n]*)\r?$", 1), F.lit(""))


def index(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url: what the archive says of each record.

    Length and digests are computed anew from each stored payload, once per distinct payload, and must agree with
    the headers.
    """
    stored = spark.read.parquet(f"{path}/payloads")
    facts = stored.select("sha256", F.sha2("payload", 256).alias("own"), F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    headers = spark.read.parquet(f"{path}/headers").select(
        _field("X-Page-ID").cast("long").alias("page_id"), _field("WARC-Type").alias("record_type"), _field("X-Refers-To-Page-ID").cast("long").alias("refers_to"), _field("X-Payload-SHA256").alias("sha256"),
        F.substring(_field("WARC-Payload-Digest"), 6, 40).alias("said"), _field("X-Payload-Length").cast("long").alias("size"), F.coalesce(_field("WARC-Target-URI"), F.lit("")).alias("url"),
    )
    agrees = (F.col("own") == F.col("sha256")) & (F.col("said") == F.col("payload_digest")) & (F.col("size") == F.col("payload_bytes"))
    digest = F.when(agrees, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record and its payload differ")))
    return headers.join(facts, "sha256").select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to", "url")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT page_id, html, CAST(strlen(html) AS BIGINT) AS n, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM f
"""
