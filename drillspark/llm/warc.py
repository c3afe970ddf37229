"""WARC archives without repeated payloads.

Headers are shuffled by payload digest to find the first record of each payload; all later ones become revisit records,
which refer to it and carry no payload. Payloads themselves are never shuffled. Archives are written by Spark's text
writer, whose line separator is the blank lines after a WARC record, and read back record by record.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage_table
from .frames import for_long_texts, if_small, ordered, ship

ship(__name__)

END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The digits of a number to base 32 as Spark writes them, and those of RFC 4648.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def payload_digest(payload: Column) -> Column:
    """SHA-1 in base 32: four times 40 bits, which are ten hexadecimal digits or eight of base 32."""
    sha = F.sha1(F.encode(payload, "UTF-8"))
    parts = [F.lpad(F.conv(F.substring(sha, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def record_id(page_id: Column, digest: Column) -> Column:
    """A name that follows from the page and its payload, so a repeated task writes the same record."""
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("-")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def with_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, digest, bytes, refers_page, refers_url`` of pages (page_id, url, html).

    Of payloads that are equal and have ``least_bytes`` or more, the record with the smallest page_id is kept whole (a
    missing id counts as largest); rows that repeat that page_id with that payload are kept whole too. ``refers_page`` is
    a struct, null for records kept whole.
    """
    given = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    given = given.withColumn("digest", payload_digest(F.col("payload"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    heads = given.where(F.col("bytes") >= least_bytes).select("digest", ordered(F.col("page_id")).alias("page"), "url")
    firsts = heads.groupBy("digest").agg(F.min(F.struct("page", "url")).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = stage_table(firsts.select(F.col("digest").alias("of"), "first"), "first-records")
    met = given.join(if_small(firsts), F.col("digest") == F.col("of"), "left")
    later = F.col("first").isNotNull() & ~F.col("first.page").eqNullSafe(ordered(F.col("page_id"))) & (F.col("bytes") >= least_bytes)
    return met.select(
        "page_id", "url", "payload", "digest", "bytes", F.when(later, F.col("first.page")).alias("refers_page"), F.when(later, F.col("first.url")).alias("refers_url")
    )


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(END))).otherwise(F.lit(""))


def records(typed: DataFrame, date: str) -> DataFrame:
    """One text column: header, blank line and block of each record."""
    clean = lambda url: F.regexp_replace(url, r"[\x00-\x20\x7f]", "%20")  # noqa: E731  a line break would end the header
    later = F.col("refers_page").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END + END)
    )
    block = F.when(later, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _line("WARC-Type", F.when(later, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", clean(F.col("url"))),
        _line("WARC-Page-ID", F.col("page_id").cast("string")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Profile", F.when(later, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(later, record_id(F.col("refers_page.id"), F.col("digest")))),
        _line("WARC-Refers-To-Target-URI", F.when(later, clean(F.col("refers_url")))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block).cast("string")),
    )
    return typed.select(F.concat(head, F.lit(END), block).alias("value"))


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0, per_file: int = 500) -> None:
    """Gzipped archives of at most ``per_file`` records each below ``path``, without repeated payloads."""
    writer = records(with_types(pages, least_bytes), date).write.mode("overwrite")
    writer.option("compression", "gzip").option("lineSep", END + END).option("maxRecordsPerFile", per_file).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive; lengths, not blank lines, tell where a block ends."""
    stream = gzip.open(io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8").partition(":")
            head[name.lower()] = value.strip()
        yield head, stream.read(int(head["content-length"]))


def _parsed(batches) -> Iterator[pa.RecordBatch]:
    import base64
    import hashlib

    names = ["record", "page_id", "type", "refers", "digest", "bytes"]
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for head, block in parse(content.as_py()):
                payload = block.partition(b"\r\n\r\n")[2]
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                if head["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"payload and digest of {head['warc-record-id']} differ")
                rows.append((head["warc-record-id"], head.get("warc-page-id"), head["warc-type"], head.get("warc-refers-to"), digest, len(payload)))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.string()] * 5 + [pa.int64()]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def read(spark: SparkSession, path: str, page_type: str = "bigint") -> DataFrame:
    """One row for each record below ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to.

    ``payload_bytes`` of a revisit is that of the record it refers to, ``refers_to`` that record's page_id.
    """
    for_long_texts(spark, 64)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    found = files.mapInArrow(_parsed, "record string, page_id string, type string, refers string, digest string, bytes long")
    found = stage_table(found, "warc-records").withColumn("page_id", F.col("page_id").cast(page_type))
    # responses refer to nothing and are not joined; of them, only those that revisits refer to are looked up
    revisits, responses = found.where("type = 'revisit'"), found.where("type = 'response'")
    whole = responses.groupBy("record").agg(F.min("page_id").alias("of_page"), F.max("bytes").alias("of_bytes"))
    whole = whole.join(revisits.select(F.col("refers").alias("record")).distinct(), "record", "left_semi")
    whole = if_small(stage_table(whole.withColumnRenamed("record", "refers"), "referred"))
    met = revisits.join(whole, "refers", "left").select("page_id", "of_bytes", "digest", "type", "of_page")
    kept = responses.select("page_id", F.col("bytes").alias("of_bytes"), "digest", "type", F.lit(None).cast(page_type).alias("of_page"))
    return met.unionByName(kept).select(
        "page_id",
        F.col("of_bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("of_page").alias("refers_to"),
    )
