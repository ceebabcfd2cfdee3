"""Content-addressed WARC archive.

An archive is two tables in one folder: ``payloads`` holds each distinct
payload once under its SHA-256, ``headers`` the exact header block of every
record beside the digest it points to.  A record is rebuilt by joining the two
and is byte for byte what a flat WARC file would hold; the digest is verified
when it is read.

Rows first agree on their digest's owner by a pre-aggregated minimum over
(digest, id), which moves no payload.  Payloads move once, in the join that
keeps each owner's; its hot digests can be split, as nothing above it needs a
digest's rows together.

Defined cases: a null payload is empty; a null id is written as an empty
record id and never owns a payload before a row with an id; rows repeated with
one id are separate records of which the first owns; an empty table gives an
empty archive.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, quoted, text_or_empty

#: Payloads of fewer bytes are always stored as responses.
REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def _record_uri(page_id: Column) -> Column:
    """Ids are percent-encoded, so that none breaks its line or its brackets."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(page_id.cast("string")), F.lit("")), F.lit(">"))


def _header(date: str) -> Column:
    """The header block of a record, exactly as it stands before the payload."""
    revisit = F.col("__type") == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("__type")),
        F.concat(F.lit("WARC-Record-ID: "), _record_uri(F.col("__id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce(F.col("__uri"), F.lit("")), r"[\r\n]+", " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("__digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_uri(F.col("__owner")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("__bytes").cast("string"))),
        F.concat(F.lit("X-Payload-Length: "), F.col("__bytes").cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF)).cast("binary")


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", revisit_bytes: int = REVISIT_BYTES, date: str | None = None) -> None:
    """Write one record per row to the archive at ``path``; date: of all its records, the time of writing by default.

    Pages are read twice: for digests alone, and for the payloads of owners.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = text_or_empty(quoted(payload_col)).cast("binary")
    rows = pages.select(
        F.col(quoted(id_col)).alias("__id"),
        (F.col(quoted(uri_col)) if uri_col in pages.columns else F.lit(None)).cast("string").alias("__uri"),
        F.octet_length(payload).cast("long").alias("__bytes"),
        F.sha2(payload, 256).alias("__digest"),
        payload.alias("__payload"),
    )
    light = rows.drop("__payload").withColumn("__row", F.monotonically_increasing_id())
    order = F.struct(F.col("__id").isNull().alias("n"), F.col("__id").alias("id"), F.col("__row").alias("row"))
    staged = f"{path}/_staged"
    light.write.parquet(staged)
    light = pages.sparkSession.read.schema(light.schema).parquet(staged)
    owners = light.groupBy("__digest").agg(F.min(order).alias("__best"))
    typed = light.join(owners, "__digest").withColumns(
        {
            "__type": F.when((F.col("__bytes") >= revisit_bytes) & (F.col("__best.row") != F.col("__row")), "revisit").otherwise("response"),
            "__owner": F.col("__best.id"),
        }
    )
    typed.select(_header(date).alias("header"), F.col("__digest").alias("digest"), (F.col("__best.row") == F.col("__row")).alias("introduces"), F.col("__id").alias("record")).write.parquet(f"{path}/headers")
    # a payload goes with its owner only; the row is found again by (digest, id), and repeats of one id hold the same bytes
    written_headers = pages.sparkSession.read.parquet(f"{path}/headers").filter("introduces").select(F.col("digest").alias("__digest"), F.col("record").alias("__owner"))
    owned = rows.select("__id", "__digest", "__payload").join(written_headers, "__digest").filter(F.col("__id").eqNullSafe(F.col("__owner")))
    once = owned.select(F.col("__digest").alias("digest"), F.col("__payload").alias("payload"))
    repeated = light.groupBy("__digest", "__id").count().filter("count > 1")
    if not repeated.isEmpty():
        once = once.dropDuplicates(["digest"])
    once.write.parquet(f"{path}/payloads")
    jvm = pages.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(staged)
    target.getFileSystem(pages.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record of an archive: header, digest, payload (of revisits too), verified (payload hashes to the digest), record (its bytes in a WARC file)."""
    headers = spark.read.parquet(f"{path}/headers").select("header", "digest")
    payloads = spark.read.parquet(f"{path}/payloads").withColumn("verified", F.sha2("payload", 256) == F.col("digest"))
    joined = headers.join(payloads, "digest")
    empty = F.lit("").cast("binary")
    body = F.when(header_field("WARC-Type") == "revisit", empty).otherwise(F.col("payload"))
    return joined.select("header", "digest", "payload", "verified", F.concat("header", body, F.lit(CRLF + CRLF).cast("binary")).alias("record"))


def header_field(name: str) -> Column:
    """A named field of the column ``header``; null where the record has none."""
    found = F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def archive_index(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """One row per record, from its header and its rebuilt payload."""
    number = lambda field: F.regexp_extract(header_field(field), r"^<urn:page:(.*)>$", 1)
    given = lambda c: F.when(c != "", F.url_decode(c)).cast(id_type)
    return read_archive(spark, path).select(
        given(number("WARC-Record-ID")).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(F.col("verified"), F.regexp_extract(header_field("WARC-Payload-Digest"), "^sha256:(.*)$", 1)).alias("payload_digest"),
        header_field("WARC-Type").alias("record_type"),
        given(number("WARC-Refers-To")).alias("refers_to"),
    )


def archive_pages(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write pages to a new archive in the shared folder and index it from what was written."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archive(pages, path, id_col, uri_col, payload_col)
    kind = dict(pages.dtypes)[id_col]
    return archive_index(spark, path, kind)
