"""WARC archives with revisit records.

Headers (page_id, url, digest, length) are shuffled by payload digest; of equal payloads of at least ``least_bytes`` the one with the
largest id stays a response, and the headers of others are joined to it and become revisits, with fresh headers that refer to it. Payloads are not part of this:
a revisit is written from its header alone, and the payloads that are written are those of the rows that are no revisits.
Archives are written and read by Spark alone, so any of its file systems will do: a record ends with two line ends, which are
the separator of the text writer, and an archive is read as a binary file, inflated as a stream and cut by Content-Length. An archive
is one gzip stream, not one per record. ``archive_bytes`` bounds the uncompressed bytes of an archive by what one reading task may hold; a longer
record has an archive of its own.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as c

#: Fixed values of the format.
_END = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


_HEADER = ["page_id", "url", "payload_digest", "payload_bytes"]


def revisits(headers: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """(page_id, url, payload_digest, payload_bytes, refers_to, refers_url) of the headers (its first four) that are revisits.

    A digest that a large share of all pages have is split among tasks by page_id. Rows that repeat the largest id of a digest are all responses.
    """
    long = headers.select(*_HEADER).where(F.col("payload_bytes") >= least_bytes)
    heads = long.groupBy("payload_digest").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("first")).where("n > 1 and first.page_id is not null")
    heads = c.saved(heads, "heads")
    total = heads.agg(F.sum("n")).first()[0] or 0
    joined = c.skew_join(long, heads.select("payload_digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")), ["payload_digest"], heads.select("payload_digest", "n"), total, ["page_id", "url"])
    return joined.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(*_HEADER, "refers_to", "refers_url")


def resolve_revisits(records: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Rows (page_id, url, payload, payload_digest, payload_bytes) with record_type, refers_to and refers_url; a revisit has no payload any more."""
    again = c.saved(revisits(records, least_bytes), "revisits")
    marks = again.select(F.coalesce("page_id", F.lit(-1)).alias("_id"), F.col("page_id").isNull().alias("_none"), F.col("payload_digest").alias("_digest")).distinct()
    kept = records.join(marks, (F.coalesce("page_id", F.lit(-1)) == F.col("_id")) & (F.col("page_id").isNull() == F.col("_none")) & (F.col("payload_digest") == F.col("_digest")), "left_anti")
    kept = kept.select(*_HEADER, "payload", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"))
    return kept.union(again.select(*_HEADER, F.lit(None).cast("string").alias("payload"), F.lit("revisit").alias("record_type"), "refers_to", "refers_url"))


def _urn(page_id, kind: str = "response"):
    """The id of a page's record with the payload at hand; rows that repeat both are the same capture and share it."""
    h = F.md5(F.concat(F.lit(f"{kind}:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), F.col("payload_digest")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _archives(most: int):
    """A function of record sizes: the archive of each record, counted within a task, by the running sum of bytes."""

    def number(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        archive, held = 0, 0
        for sizes in batches:
            out = []
            for n in sizes.to_pylist():
                if held and held + n > most:
                    archive, held = archive + 1, 0
                held += n
                out.append(archive)
            yield pa.array(out, pa.int64())

    # the sizes alone go to Python; a record's place in its task decides, so it is asked for once
    return F.arrow_udf(number, "long").asNondeterministic()


def write_warc(records: DataFrame, path: str, date: str | None = None, records_per_archive: int = 4000, archive_bytes: int = 1 << 26) -> None:
    """Write resolved records, dated ``date`` or else now, as gzip archives, each of at most ``records_per_archive`` records and ``archive_bytes`` bytes before compression, or of one longer record."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_END * 2))
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_END))
    one_line = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), "[\r\n]", " ")
    head = F.concat(
        F.lit(f"WARC/1.1{_END}"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.when(revisit, _urn(F.col("page_id"), "revisit")).otherwise(_urn(F.col("page_id")))), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", one_line(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), line("Content-Type", F.lit("application/http; msgtype=response")),
        F.when(F.col("page_id").isNotNull(), line("X-Page-ID", F.col("page_id").cast("string"))).otherwise(""),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Refers-To", _urn(F.col("refers_to"))), line("WARC-Refers-To-Target-URI", one_line(F.col("refers_url"))), line("X-Refers-To-Page-ID", F.col("refers_to").cast("string")))).otherwise(""),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit(_END),
    )
    rows = records.select(F.concat(head, block).alias("value")).withColumn("archive", _archives(archive_bytes)((F.octet_length("value") + 4).cast("long")))
    rows.write.partitionBy("archive").option("lineSep", _END * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_archive).text(path)


_READ = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload string"


def _records(raw: bytes):
    """(headers, block) of each record of an archive, inflated one by one."""
    with gzip.GzipFile(fileobj=io.BytesIO(raw)) as f:
        while f.readline():  # the version
            head = {}
            while (line := f.readline()) not in (b"\r\n", b""):
                name, value = line.decode()[:-2].split(": ", 1)
                head[name] = value
            size = int(head["Content-Length"])
            block = f.read(size)
            if len(block) != size:
                raise ValueError(f"an archive ends within a record: {head}")
            yield head, block
            f.read(4)


def read_warc(spark, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives: a response's digest and size are those of the payload read; a revisit has its header's digest and no payload yet."""

    def parse(batches):
        for batch in batches:
            for raw in batch.column(0):
                rows, held = [], 0
                for head, block in _records(raw.as_py()):
                    kind = head["WARC-Type"]
                    body = block.split(b"\r\n\r\n", 1)[1]
                    own = kind == "response"
                    rows.append((int(head["X-Page-ID"]) if "X-Page-ID" in head else None, head["WARC-Target-URI"], kind, hashlib.sha1(body).hexdigest() if own else head["WARC-Payload-Digest"][5:], len(body) if own else None, int(head["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in head else None, body.decode("utf-8", "replace") if own and payloads else None))
                    held += len(body) if payloads else 0
                    if len(rows) == 1000 or held > c.STEP * 8:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, _READ)


def _batch(rows) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _READ.split(", ")])


def follow_revisits(records: DataFrame) -> DataFrame:
    """Give every revisit the payload, size and digest of the response that it refers to, through a join on (page_id, digest).

    A response that a large share of all records refers to is repeated for the tasks that they are split among.
    """
    has = [x for x in ("payload_bytes", "payload") if x in records.columns]
    back = records.where("record_type = 'revisit'")
    counts = c.saved(back.groupBy(F.col("refers_to").alias("_id"), F.col("payload_digest").alias("_digest")).agg(F.count("*").alias("n")), "referred")
    total = counts.agg(F.sum("n")).first()[0] or 0
    first = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest")).agg(*(F.first(x).alias(f"_{x}") for x in has))
    first = first.join(counts.select("_id", "_digest"), ["_id", "_digest"], "left_semi")
    back = c.skew_join(back.drop(*has).withColumn("_id", F.col("refers_to")).withColumn("_digest", F.col("payload_digest")), first, ["_id", "_digest"], counts, total, ["page_id", "url"], "left")
    back = back.select(*(F.col(f"_{x}").alias(x) if x in has else F.col(x) for x in records.columns))
    return records.where("record_type = 'response'").unionByName(back)


def archive_pages(pages: DataFrame, path: str, least_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = 1 << 26) -> None:
    """Write pages (null html: an empty payload; null url: an empty target; null ids refer to nothing but may revisit) as archives without repeated payloads."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    records = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(F.encode(payload, "UTF-8")).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    write_warc(resolve_revisits(records, least_bytes), path, archive_bytes=archive_bytes)


def pages_through_warc(pages: DataFrame, **options) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back.

    Returns page_id, payload_bytes, payload_digest (hex SHA-1), record_type and refers_to, one row per page; rows that repeat the largest
    page_id of a payload are all responses. An empty table gives an empty table.
    """
    path = c.place(pages.sparkSession, "warc")
    archive_pages(pages, path, **options)
    return follow_revisits(read_warc(pages.sparkSession, path, payloads=False).drop("payload")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
