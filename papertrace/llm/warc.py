"""A content-addressed WARC archive in two tables.

`payloads` holds each distinct payload once, under its SHA-256; `records` holds each record's exact header
block, and the SHA-256 it points to. Reading joins the two, puts each record's bytes together as they stand in a
.warc file, parses them, and checks lengths and digests. A record whose payload another record responds with is a
revisit. Digests that a large part of all records share are split over tasks, payloads with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ready, text_of

#: Payloads below so many bytes are kept as responses, each on its own.
LEAST_REVISIT = 1000
_CRLF = "\r\n"
#: A digest of more than one in so many records is split; so no more than that many are.
SPLIT = 200


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))).otherwise(F.lit(""))


def _id(page_id: Column, rid: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), rid.cast("string"), F.lit(">"))


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str | None = None) -> DataFrame:
    """(page_id, header, sha256): the exact header block of a record per row, and its payload's digest.

    A null html is an empty payload. Among records with equal payloads of at least LEAST_REVISIT bytes that
    with the largest page_id is the response and the others revisit it. Rows that repeat that page_id are
    responses too, and so is a row without a page_id; each has a record id of its own. Line breaks in a url are
    percent-encoded; a null url leaves its header out. date is the records' WARC-Date, by default the time of
    writing. A payload of any length is digested whole; other columns are ignored; no pages, no records. Only
    digests and ids are shuffled, and summed by digest before."""
    payload = text_of(html).cast("binary")
    clean = F.regexp_replace(F.regexp_replace(F.col(url).cast("string"), "\r", "%0D"), "\n", "%0A")
    rows = pages.select(F.col(page_id).alias("page_id"), clean.alias("url"), F.sha2(payload, 256).alias("sha256"), F.sha1(payload).alias("sha1"), F.length(payload).alias("n"), F.monotonically_increasing_id().alias("rid"))
    rows = cut(rows)
    per = rows.groupBy("sha256").agg(F.count(F.lit(1)).alias("_many"), F.max(F.struct("page_id", "rid")).alias("holder"))
    total = rows.count()
    hot = F.broadcast(per.where(F.col("_many") * SPLIT > total))
    rows = rows.join(hot, "sha256").unionByName(rows.join(hot, "sha256", "left_anti").join(per.where(F.col("_many") * SPLIT <= total), "sha256"))
    revisit = F.coalesce((F.col("n") >= LEAST_REVISIT) & (F.col("page_id") != F.col("holder.page_id")), F.lit(False))
    when = F.lit(date) if date else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    header = F.concat(
        F.lit("WARC/1.1" + _CRLF), _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise("response")), _header("WARC-Record-ID", _id(F.col("page_id"), F.col("rid"))), _header("WARC-Date", when),
        _header("WARC-Target-URI", F.col("url")), _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        _header("WARC-Refers-To", F.when(revisit, _id(F.col("holder.page_id"), F.col("holder.rid")))), _header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _header("Content-Type", F.lit("text/html; charset=utf-8")), _header("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))), F.lit(_CRLF),
    )
    return rows.select("page_id", header.alias("header"), "sha256")


def payloads(pages: DataFrame, html: str = "html") -> DataFrame:
    """(sha256, many, payload): each distinct payload once, and the number of records that point to it; equal ones
    are merged before the shuffle."""
    payload = text_of(html).cast("binary")
    return pages.select(F.sha2(payload, 256).alias("sha256"), payload.alias("payload")).groupBy("sha256").agg(F.count(F.lit(1)).alias("many"), F.first("payload").alias("payload"))


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str | None = None) -> str:
    """Write the archive of pages at path (tables `records` and `payloads`, zstd Parquet), as records() says, and
    return the path."""
    ready(pages.sparkSession)
    for name, t in (("records", records(pages, page_id, url, html, date)), ("payloads", payloads(pages, html))):
        t.write.option("compression", "zstd").parquet(f"{path}/{name}")
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, header, payload, record): every original record: its header block, its full payload, joined in by
    digest (a revisit's too), and its bytes. A payload that does not have the digest it is stored under fails the
    read; so do a record without its payload, and one whose parsed block has not the length or digest it says."""
    stored = spark.read.parquet(f"{path}/payloads")
    total = stored.agg(F.sum("many")).first()[0] or 0
    hot = F.broadcast(stored.where(F.col("many") * SPLIT > total).select("sha256", F.ceil(F.col("many") * SPLIT / F.lit(max(1, total))).cast("int").alias("_parts")))
    stored = stored.select("sha256", F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload is not what its digest says: "), "sha256"))).alias("payload"))
    stored = stored.join(hot, "sha256", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    out = spark.read.parquet(f"{path}/records").join(hot, "sha256", "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("header"), F.col("_parts")).cast("int"), F.lit(0)))
    out = out.join(stored, ["sha256", "_part"], "left")
    out = out.select("page_id", "header", F.coalesce("payload", F.raise_error(F.concat(F.lit("payload is missing: "), "sha256"))).alias("payload"))
    return parse(stream(out))


def parse(records: DataFrame) -> DataFrame:
    """records (page_id, payload, record) with header as it stands in the record's bytes; the block behind it must
    have the length that the header says, and a response's the digest."""
    text = F.col("record").cast("string")
    header = F.substring(text, F.lit(1), F.instr(text, _CRLF * 2) + 3)
    rows = records.select("page_id", "payload", "record", header.alias("header"))
    body = F.substring(F.col("record"), F.octet_length("header") + 1, F.octet_length("record") - F.octet_length("header") - 4)
    right = (F.octet_length(body) == field("Content-Length").cast("int")) & (F.concat(F.lit("sha1:"), F.sha1("payload")) == field("WARC-Payload-Digest")) & ((field("WARC-Type") == "revisit") | (body == F.col("payload")))
    return rows.select("page_id", F.when(right, F.col("header")).otherwise(F.raise_error(F.concat(F.lit("a record is not what its header says: "), "header"))).alias("header"), "payload", "record")


def field(name: str, header: str = "header") -> Column:
    """A header field's value, null where the record has none."""
    return F.nullif(F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def stream(records: DataFrame) -> DataFrame:
    """records with `record`: the bytes of each record as they stand in a .warc file (a revisit without its
    payload, after its header block, and the two line breaks that end a record)."""
    block = F.when(field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.withColumn("record", F.concat(F.col("header").cast("binary"), block, F.lit((_CRLF * 2).encode())))
