"""WARC archives and transaction assembly (operator 4).

Every page becomes a transaction of three records: the response (or a revisit of an
equal payload stored elsewhere), its request and a metadata record, tied together by
``WARC-Concurrent-To``. Records are built from DataFrame expressions and written by
Spark's text writer, whose record separator is the two line ends after a WARC
record, so files are plain WARC/1.1 (gzip over the file) on any file system. They
are read back through ``binaryFile`` and cut by ``Content-Length``. Assembly joins the
records by their concurrent-to identifiers into one nested row per capture.

Copies of a payload are found by a partial aggregate on the digest; texts are never
shuffled for it. Small per-digest rows are stored before the join, so a digest with
a third of all pages is an ordinary skewed join.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunked, pick, scratch, stored, written

CRLF = "\r\n"
MIN_REVISIT = 100
# Records a file: three for each page, so a file holds few thousand pages.
FILE_RECORDS = 6_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = ("record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, "
          "digest string, head string, payload binary")


def record_id(kind: str, *parts: F.Column) -> F.Column:
    """A uuid-shaped identifier that follows from what the record is about."""
    h = F.sha2(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def order_key(page: str, url: str) -> F.Column:
    """Pages by id, then by url; nulls last."""
    p, u = F.col(page), F.col(url)
    return F.struct(p.isNull().alias("no_page"), p.alias("page"), u.isNull().alias("no_url"), u.alias("url"))


def record(kind: str, fields: dict[str, F.Column | str | None], block: F.Column) -> F.Column:
    """Text of one record without the two line ends after it; null fields are left out."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}")]
    for k, v in fields.items():
        v = F.lit(v) if isinstance(v, str) else v
        lines.append(F.concat(F.lit(f"{k}: "), v))
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html", min_revisit: int = MIN_REVISIT, date: str = DATE,
                  file_records: int = FILE_RECORDS) -> None:
    """Write every page's records. Of pages with equal payloads of ``min_revisit`` bytes or more
    the first by id, then url (nulls last) is the response, the others revisit it.

    A null html is an empty payload; a null id or url leaves that field out; line
    ends in a url are percent-encoded. Rows equal in id, url and payload are one
    capture written as often as it stands there. An empty table gives no records.
    """
    src = pick(pages, page_id=id_col, url=url_col, html=html_col).selectExpr(
        "cast(page_id as long) page_id", "url", "coalesce(html, '') html")
    src = src.withColumn("url", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")))
    src = src.withColumn("n", F.octet_length("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    copies = (src.where(F.col("n") >= min_revisit).groupBy("digest")
                 .agg(F.min(order_key("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("copies"))
                 .where("copies > 1").select("digest", "first"))
    rows = src.join(stored(copies), "digest", "left")
    again = F.col("first").isNotNull() & (order_key("page_id", "url") != F.col("first"))
    own = record_id("capture", F.col("page_id"), F.col("url"), F.col("digest"))
    target = record_id("capture", F.col("first.page"), F.col("first.url"), F.col("digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("n").cast("string"), F.lit(CRLF * 2))
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    common = {"WARC-Target-URI": F.col("url"), "WARC-Date": date}
    response = record("response", {"WARC-Record-ID": own, **common, "WARC-Payload-Digest": digest,
                                   "Content-Type": "application/http; msgtype=response"},
                      F.concat(http, F.col("html")))
    revisit = record("revisit", {"WARC-Record-ID": own, **common, "WARC-Payload-Digest": digest,
                                 "WARC-Profile": PROFILE, "WARC-Refers-To": target,
                                 "WARC-Refers-To-Target-URI": F.col("first.url"),
                                 "Content-Type": "application/http; msgtype=response"}, http)
    place = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    request = record("request", {"WARC-Record-ID": record_id("request", F.col("page_id"), F.col("url"), F.col("digest")),
                                 **common, "WARC-Concurrent-To": own,
                                 "Content-Type": "application/http; msgtype=request"},
                     F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{CRLF}Host: "),
                              place, F.lit(CRLF * 2)))
    fields = F.concat_ws(CRLF, F.concat(F.lit("page-id: "), F.col("page_id").cast("string")),
                         F.concat(F.lit("payload-length: "), F.col("n").cast("string")), F.lit(""))
    metadata = record("metadata", {"WARC-Record-ID": record_id("metadata", F.col("page_id"), F.col("url"),
                                                               F.col("digest")),
                                   **common, "WARC-Concurrent-To": own, "Content-Type": "application/warc-fields"},
                      fields)
    out = rows.select(F.explode(F.array(request, F.when(again, revisit).otherwise(response), metadata)).alias("value"))
    (out.write.option("lineSep", CRLF * 2).option("compression", "gzip")
        .option("maxRecordsPerFile", file_records).text(path))


def parse(stream) -> Iterator[tuple]:
    """Records of one archive stream, in the order of :data:`RECORD`'s columns."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a WARC record was expected, not {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a WARC record ends early")
        kind, top, payload = head.get("warc-type"), None, block
        if head.get("content-type", "").startswith("application/http"):
            a, _, payload = block.partition(b"\r\n\r\n")
            top = a.decode("utf-8", "replace")
        yield (head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"),
               head.get("warc-target-uri"), head.get("warc-date"), head.get("warc-payload-digest"), top, payload)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under ``path`` (gzip or plain), one row each. One file is
    held by a task at a time, its records a few hundred at a time."""
    def work(batches: Iterator) -> Iterator:
        import gzip
        import io

        import pyarrow as pa

        names = [c.split()[0] for c in RECORD.split(", ")]
        types = [pa.string()] * 8 + [pa.binary()]
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(0)[i].as_py()
                raw = io.BytesIO(data)
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if data[:2] == b"\x1f\x8b" else raw
                for rows in chunked(parse(stream), 600):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return (spark.read.format("binaryFile").load(path).where("length > 0").select("content")
            .mapInArrow(work, RECORD))


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``record_id, type, target_uri, date, refers_to, digest`` and the
    main record's further columns, ``request`` and ``metadata`` (structs of those records;
    of several concurrent ones the smallest, null if there is none).

    Records that name no known capture give no row; a capture that stands there
    twice gives two rows. Null identifiers match nothing.
    """
    main = records.where(F.col("type").isin("response", "revisit")).drop("concurrent_to")
    parts = F.struct("record_id", "target_uri", "date", "head", F.col("payload").cast("string").alias("block"))
    side = (records.where(F.col("type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
                   .groupBy("concurrent_to")
                   .agg(*[F.min(F.when(F.col("type") == k, parts)).alias(k) for k in ("request", "metadata")]))
    return main.join(side, main.record_id == side.concurrent_to, "left").drop("concurrent_to")


def page_digests(pages: DataFrame, path: str | None = None, **kw) -> DataFrame:
    """Write ``pages``, read the archives back, assemble the captures and resolve revisits:
    ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Payloads are digested where they are parsed; only requests' and metadata's short
    blocks are kept beside the digests.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archive(pages, path, **kw)
    main = F.col("type").isin("response", "revisit")
    small = read_archive(spark, path).select(
        "record_id", "type", "concurrent_to", "refers_to", "target_uri", "date", "digest", "head",
        F.when(main, F.octet_length("payload").cast("long")).alias("bytes"),
        F.when(main, F.sha2("payload", 256)).alias("sha"),
        F.when(~main, F.col("payload")).alias("payload"))
    page = F.regexp_extract(F.col("metadata.block"), r"(?m)^page-id: (-?[0-9]+)", 1)
    caps = written(transactions(written(small, "warc-records")).select(
        "record_id", "type", "refers_to", "bytes", "sha",
        F.when(page != "", page.cast("long")).alias("page_id")), "warc-captures")
    there = (caps.where("type = 'response'").groupBy("record_id")
                 .agg(F.min(F.struct("page_id", "bytes", "sha")).alias("to")))
    there = stored(there.withColumnRenamed("record_id", "key"))
    back = caps.where("type = 'revisit'").join(there, F.col("refers_to") == F.col("key"), "left").select(
        "page_id", F.col("to.bytes").alias("payload_bytes"), F.col("to.sha").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("to.page_id").alias("refers_to"))
    return caps.where("type = 'response'").select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("sha").alias("payload_digest"),
        F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(back)
