"""Content-addressed WARC archive: payload bytes once by verified strong digest, record headers beside them.

``write_archive`` stores two tables under one path of the shared folder: ``payloads``
(SHA-256, bytes; each payload once) and ``headers`` (the exact WARC header and HTTP header
of every record, with the digest of its payload). ``read_archive`` joins them and gives
the original records back byte for byte; a stored payload whose digest doesn't match its
address raises an error, and so does a header whose digest or length doesn't fit the payload
it is joined with. ``records`` rebuilds every record and reads it as a stranger would: the
header up to the first empty line, a block of Content-Length bytes, the payload after the
HTTP header, whose digest must be the one the header names. All it gives comes from there.

The archive's own fields come before the target URI, and control bytes and spaces in a URI are
percent-encoded when a header is written, so no URI can end a header line or add one.

Of the records with equal payloads the one with the smallest page id is the response, the
others are revisits that refer to it. Equal payloads collapse to one before they travel, and
are dealt out by digest once; responses meet them there. Revisits need only length and
digest, so a very common payload never travels to its copies, and their join may be split.

Defined results: null html is an empty payload; a null page id counts as the largest;
repeated rows of one page are written each as the same type; a null url is an empty
target; extra columns are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import finished, new_path, note, read_table

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LAST = 0x7FFFFFFFFFFFFFFF


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: eight groups of 20 bits, four letters each."""
    hexa = F.sha1(payload)
    group = [F.conv(F.substring(hexa, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    letter = lambda v, shift: F.substring(F.lit(BASE32), F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.concat(*(letter(v, shift) for v in group for shift in (15, 10, 5, 0)))


def record_id(sha256: Column, page_id: Column) -> Column:
    """A URI with the page's id and the address of its payload."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), F.substring(sha256, 1, 32), F.lit(">"))


def escaped(url: Column) -> Column:
    """Control bytes and spaces percent-encoded; all else as it is."""
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), reduce(lambda c, i: F.replace(c, F.lit(chr(i)), F.lit(f"%{i:02X}")), [*range(0x21), 0x7F], url)).otherwise(url)


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = DATE, table: str | None = None) -> None:
    """One WARC record for each row of ``pages``; with ``table`` the payloads are also known by that name, bucketed by digest."""
    spark = pages.sparkSession
    payload = F.coalesce(F.encode(F.col(f"`{html}`").cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"),
        F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")).alias("url"),
        payload.alias("payload"),
    ).withColumns({"sha256": F.sha2("payload", 256), "k": F.coalesce("page_id", F.lit(LAST))})
    whole = rows.groupBy("sha256").agg(F.min("payload").alias("payload")).write.option("compression", "zstd")
    if table is None:
        whole.parquet(f"{path}/payloads")
    else:
        whole.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "sha256").option("path", f"{path}/payloads").saveAsTable(table)

    # Digest, letters and length once for each row; the payload itself isn't shuffled for them.
    narrow = rows.select("page_id", "k", "url", "sha256", F.length("payload").cast("long").alias("n"), base32_sha1(F.col("payload")).alias("sha1"))
    narrow.groupBy("sha256").agg(F.min("k").alias("first_k")).write.parquet(f"{path}/first")
    first = spark.read.parquet(f"{path}/first")
    typed = narrow.join(first, "sha256").withColumn("response", F.col("k") == F.col("first_k"))
    origin = F.when(F.col("first_k") != LAST, F.col("first_k"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit(HTTP), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.octet_length(http).cast("long") + F.when(F.col("response"), F.col("n")).otherwise(0)
    head = reduce(
        F.concat,
        [
            F.lit("WARC/1.1\r\n"),
            line("WARC-Type", F.when(F.col("response"), F.lit("response")).otherwise("revisit")),
            line("WARC-Record-ID", record_id(F.col("sha256"), F.col("page_id"))),
            line("WARC-Date", F.lit(date)),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
            F.when(F.col("response"), F.lit("")).otherwise(
                F.concat(line("WARC-Refers-To", record_id(F.col("sha256"), origin)), line("WARC-Profile", F.lit(PROFILE)))
            ),
            F.lit("Content-Type: application/http; msgtype=response\r\n"),
            line("Content-Length", block.cast("string")),
            line("WARC-Target-URI", escaped(F.col("url"))),
            F.lit("\r\n"),
        ],
    )
    typed.select(
        "page_id", "url", "sha256", head.alias("warc_header"), http.alias("http_header"),
    ).write.option("compression", "zstd").parquet(f"{path}/headers")


def header_field(name: str, header: str = "warc_header") -> Column:
    """The value of a line of a WARC header, null where there is none."""
    found = F.regexp_extract(header, rf"(?:^|\r\n){name}: ([^\r\n]*)(?:\r\n|$)", 1)
    return F.when(found != "", found)


def page_of(uri: Column) -> Column:
    """The page id in a record's URI."""
    return F.regexp_extract(uri, "^<urn:page:(-?[0-9]*):[0-9a-f]*>$", 1).try_cast("long")


def stored_payloads(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """``sha256, payload, payload_bytes, payload_digest``; a payload that isn't what its address says is an error.

    Length and digests are computed from the stored bytes before any join, so a reader of
    only those columns shuffles no payload.
    """
    checked = F.when(F.sha2("payload", 256) == F.col("sha256"), F.length("payload").cast("long")).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256"))).cast("long")
    )
    found = spark.table(table) if table else spark.read.parquet(f"{path}/payloads")
    return found.select("sha256", "payload", checked.alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))


def stored_headers(spark: SparkSession, path: str) -> DataFrame:
    fields = {"record_type": header_field("WARC-Type"), "refers_to": page_of(header_field("WARC-Refers-To"))}
    return spark.read.parquet(f"{path}/headers").withColumns(fields)


def rebuilt(body: Column) -> Column:
    utf8 = lambda c: F.encode(F.col(c), "UTF-8")
    return F.concat(utf8("warc_header"), utf8("http_header"), body, F.lit(b"\r\n\r\n"))


def damaged(what: Column) -> Column:
    return F.raise_error(F.concat(F.lit("damaged header of payload "), what))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record: ids, type, digest and length of its full payload, the payload, and the record's bytes."""
    headers = stored_headers(spark, path).withColumns({"content_length": header_field("Content-Length").cast("long"), "said": header_field("WARC-Payload-Digest")})
    response = F.col("record_type") == "response"
    record = rebuilt(F.when(response, F.col("payload")).otherwise(F.lit(b"")))
    length = F.octet_length("http_header").cast("long") + F.when(response, F.col("payload_bytes")).otherwise(0)
    fits = (F.col("content_length") == length) & (F.col("said") == F.concat(F.lit("sha1:"), F.col("payload_digest"))) & F.col("record_type").isin("response", "revisit")
    joined = headers.join(stored_payloads(spark, path), "sha256").withColumn("record_type", F.when(fits, F.col("record_type")).otherwise(damaged(F.col("sha256"))))
    return joined.withColumn("record", record).drop("said", "content_length")


def parsed(rows: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the records in the column ``record``.

    ``payload_bytes`` and ``payload_digest`` are those that the headers name; for a response
    the block's payload must have them. A record that doesn't is an error.
    """
    text = lambda c: F.col(c).cast("string")
    end = F.lit("\r\n\r\n")
    # The casts between bytes and text keep all bytes; places and lengths are of bytes.
    r = rows.withColumn("head", F.substring_index(text("record"), "\r\n\r\n", 1))
    r = r.withColumns({"at": F.octet_length("head") + 4, "content_length": header_field("Content-Length", "head").cast("int")})
    r = r.withColumn("block", F.substring(F.col("record"), F.col("at") + 1, F.col("content_length")))
    r = r.withColumn("http", F.substring_index(text("block"), "\r\n\r\n", 1))
    r = r.withColumns(
        {
            "body": F.substring(F.col("block"), F.octet_length("http") + 5, F.col("content_length")),
            "n": header_field("Content-Length", "http").cast("long"),
            "kind": header_field("WARC-Type", "head"),
            "said": F.regexp_extract(header_field("WARC-Payload-Digest", "head"), "^sha1:(.*)$", 1),
        }
    )
    whole = F.concat(F.encode("head", "UTF-8"), F.encode(end, "UTF-8"), F.col("block"), F.encode(end, "UTF-8")) == F.col("record")
    response = (F.col("kind") == "response") & (F.length("body") == F.col("n")) & (base32_sha1(F.col("body")) == F.col("said"))
    fits = whole & (response | ((F.col("kind") == "revisit") & (F.length("body") == 0)))
    own = page_of(header_field("WARC-Record-ID", "head"))
    return r.select(
        *rows.drop("record").columns, own.alias("page_id"), F.col("n").alias("payload_bytes"), F.col("said").alias("payload_digest"),
        F.when(fits, F.col("kind")).otherwise(damaged(F.col("head"))).alias("record_type"), page_of(header_field("WARC-Refers-To", "head")).alias("refers_to"),
    )


def records(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """What the rebuilt records say: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    payloads = stored_payloads(spark, path, table)
    headers = stored_headers(spark, path).select("sha256", "warc_header", "http_header", "record_type")
    responses = headers.filter("record_type = 'response'").join(payloads.select("sha256", "payload"), "sha256").select(rebuilt(F.col("payload")).alias("record"))
    # A revisit's record holds no payload; what it says of it must be true of the one stored.
    facts = payloads.select("sha256", F.col("payload_bytes").alias("true_bytes"), F.col("payload_digest").alias("true_digest"))
    revisits = headers.filter("record_type IS DISTINCT FROM 'response'").join(facts, "sha256").select("sha256", "true_bytes", "true_digest", rebuilt(F.lit(b"")).alias("record"))
    same = (F.col("payload_bytes") == F.col("true_bytes")) & (F.col("payload_digest") == F.col("true_digest"))
    revisits = parsed(revisits).withColumn("record_type", F.when(same, F.col("record_type")).otherwise(damaged(F.col("sha256"))))
    return parsed(responses).unionByName(revisits.drop("sha256", "true_bytes", "true_digest"))


def query(spark, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        path, table = new_path(spark, "warc"), f"payloads_{uuid.uuid4().hex[:12]}"
        note("table", table)
        write_archive(read_table(spark, sf_dir, "pages"), path, table=table)
        return records(spark, path, table)

    return finished(spark, "warc-records", make)


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr('{BASE32}', (((('0x' || substr(x, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> ((3 - i % 4) * 5)::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to
FROM q
"""
