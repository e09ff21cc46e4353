"""WARC: archives of request, response or revisit, and metadata records, and their assembly.

Archives are written by Spark's text sink with the record separator as line separator, so any
store that Spark writes to holds them, and read back as whole files whose records are cut by
their Content-Length. Transactions are put together through WARC-Concurrent-To: response,
revisit and metadata records name the request they belong to.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import materialize, shared_path

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Captures in one archive file, which a reader holds as a whole.
CAPTURES_PER_FILE = 2000
#: Revisits that may be broadcast to their pages; more are joined by shuffle.
BROADCAST_ROWS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
_RECORD = "kind string, record_id string, concurrent_to string, refers_to string, uri string, date string, page_id long, payload_bytes long, payload_digest string, payload binary, file string, offset long"


def base32_sha1(text: Column) -> Column:
    """SHA-1 in base 32: 5 hex digits are 20 bits, which are 4 base-32 digits."""
    h = F.sha1(text)
    parts = [F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid_of(*of: Column) -> Column:
    m = F.md5(F.concat_ws("|", *of))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: Column, rid: Column, block: Column, *fields: tuple[str, Column | None]) -> Column:
    """A record without its closing separator; fields that are null are left out."""
    head = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), rid), F.lit(f"WARC-Date: {DATE}")]
    head += [F.concat(F.lit(f"{k}: "), v) for k, v in fields]
    head.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(CRLF, *head), F.lit(CRLF * 2), block)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, least_bytes: int = 0, captures_per_file: int = CAPTURES_PER_FILE) -> None:
    """Writes one capture for each row: request, response or revisit, metadata.

    Of rows whose payloads (html in UTF-8, null: empty) are equal and have at least least_bytes
    bytes, those of the largest id are responses and all others revisit it. Rows repeating both
    that id and the payload are all responses. A null id is smaller than any other."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.col(url_col), r"[\x00-\x20\x7f]", "").alias("uri"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    narrow = rows.select("id", F.sha2("payload", 256).alias("sha"), F.octet_length("payload").alias("bytes"))
    groups = narrow.where(F.col("bytes") >= least_bytes).groupBy("sha").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = narrow.join(groups, "sha").where("id < top OR (id IS NULL AND top IS NOT NULL)").select(F.col("id").alias("i"), F.col("sha").alias("s"), "top").distinct()
    again = materialize(again, "warc-revisits")
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    full = rows.withColumn("sha", F.sha2("payload", 256)).join(again, F.col("id").eqNullSafe(F.col("i")) & (F.col("sha") == F.col("s")), "left")
    revisit = F.col("top").isNotNull()
    full = full.withColumn("request", F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))
    null = F.lit(None).cast("string")

    def response_id(page: Column) -> Column:
        return _uuid_of(F.coalesce(page.cast("string"), F.lit("null")), F.col("sha"))

    own = F.when(revisit, F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))).otherwise(response_id(F.col("id")))
    http = F.concat(F.lit(HTTP), F.octet_length("payload").cast("string"), F.lit(CRLF * 2))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    text = F.concat_ws(
        CRLF * 2,
        _record(F.lit("request"), F.col("request"), F.lit("GET / HTTP/1.1\r\n\r\n"), ("WARC-Target-URI", F.col("uri")), ("Content-Type", F.lit("application/http; msgtype=request"))),
        _record(kind, own, F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload"))), ("WARC-Target-URI", F.col("uri")), ("WARC-Concurrent-To", F.col("request")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("payload")))), ("WARC-Refers-To", F.when(revisit, response_id(F.col("top")))), ("WARC-Profile", F.when(revisit, F.lit(PROFILE)).otherwise(null)), ("Content-Type", F.lit("application/http; msgtype=response"))),
        _record(F.lit("metadata"), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")), F.concat(F.lit("page-id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(CRLF)), ("WARC-Target-URI", F.col("uri")), ("WARC-Concurrent-To", F.col("request")), ("Content-Type", F.lit("application/warc-fields"))),
    )
    full.select(text.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", captures_per_file).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(header fields by lower-case name, block, offset) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            if data[at:].strip():
                raise ValueError(f"record at {at} has no end of header")
            return
        lines = data[at:end].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        stop = start + int(head["content-length"])
        if stop > len(data):
            raise ValueError(f"record at {at} is cut short")
        yield head, data[start:stop], at
        at = stop
        while data[at : at + 2] == b"\r\n":
            at += 2


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def read_warc(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """One row for each record of the archives at path, plain or gzip.

    A response's digest is taken from the bytes read and must equal its header; a revisit's
    digest and length come from its headers."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [x.split()[0] for x in _RECORD.split(", ")]
    types = [pa.string()] * 6 + [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, raw in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = raw.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows = []
                for head, block, at in parse_records(data):
                    kind, page, size, digest, payload = head["warc-type"], None, None, None, None
                    if kind in ("response", "revisit"):
                        cut = block.find(b"\r\n\r\n") + 4
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response":
                            payload = block[cut:]
                            size = len(payload)
                            if _digest(payload) != digest:
                                raise ValueError(f"{file}, record at {at}: the payload's digest differs")
                        else:
                            size = next(int(x[15:]) for x in block[:cut].decode().split(CRLF) if x.lower().startswith("content-length:"))
                    elif kind == "metadata":
                        value = block.decode().partition(":")[2].strip()
                        page = int(value) if value else None
                    rows.append((kind, head["warc-record-id"], head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), head["warc-date"], page, size, digest, payload if with_payload else None, file, at))
                    if len(rows) >= 1024:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return files.mapInArrow(run, _RECORD)


def assemble_captures(records: DataFrame) -> DataFrame:
    """One nested row for each capture: page_id, request, response, metadata, refers_to.

    Records meet under their request's id. response is the response or revisit record;
    refers_to is the page id of the response that a revisit names, else null. A capture of which
    a record is missing has null there; where a kind is repeated, one of them is taken."""
    key = F.when(F.col("kind") == "request", F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))

    def of(test: Column, *columns: str) -> Column:
        return F.first(F.when(test, F.struct(*columns)), ignorenulls=True)

    kind = F.col("kind")
    whole = records.groupBy(key.alias("capture_id")).agg(
        of(kind == "request", "record_id", "uri", "date", "file", "offset").alias("request"),
        of(kind.isin("response", "revisit"), "kind", "record_id", "refers_to", "payload_bytes", "payload_digest", "payload", "file", "offset").alias("response"),
        of(kind == "metadata", "record_id", "page_id", "file", "offset").alias("metadata"),
    )
    whole = whole.withColumn("page_id", F.col("metadata.page_id"))
    named = whole.where("response.kind = 'response'").groupBy(F.col("response.record_id").alias("r")).agg(F.max("page_id").alias("refers_to"))
    return whole.join(named, F.when(F.col("response.kind") == "revisit", F.col("response.refers_to")) == F.col("r"), "left").select("page_id", "capture_id", "request", "response", "metadata", "refers_to")


def archive_and_read(pages: DataFrame, *, with_payload: bool = False, **columns) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads their captures back.

    Null html: empty payload; null url: no target URI; null id: none in the metadata record.
    Empty table: no captures. Other columns are not archived."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_warc(pages, path, **columns)
    records = read_warc(spark, path, with_payload=with_payload)
    return assemble_captures(materialize(records, "warc-records") if not with_payload else records)
