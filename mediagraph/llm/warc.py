"""WARC archives: pages to records and back, and transactions assembled through concurrent-to identifiers.

Each page gives a request, a response (or a revisit of an equal payload) and a metadata record. Records are written by Spark's text
writer, gzipped, with the blank lines that end a record as the separator; they are read by their stated lengths, so nothing in a
payload can pass for a record.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediagraph.llm.common import saved, scratch_path

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"
#: Three records for each page; an archive is one row when it is read, so its length is bounded.
RECORDS_PER_FILE = 30_000
#: Digests of repeated payloads that go to every task; more of them are joined by a shuffle.
REPEATED_SENT = 1_000_000


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a string's UTF-8 bytes: 5 hex digits make 4 characters."""
    hexed = F.sha1(text.cast("binary"))

    def letter(i: Column) -> Column:
        group = F.conv(F.substring(hexed, F.floor(i / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("long")
        digit = F.floor(group / F.element_at(F.array(*[F.lit(1 << s).cast("long") for s in (15, 10, 5, 0)]), (i % 4 + 1).cast("int"))) % 32
        return F.substring(F.lit(BASE32), digit.cast("int") + 1, F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("/", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _header_value(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "\r", "%0D"), "\n", "%0A")


def _record(kind: Column | str, record_id: Column, headers: list[Column], block: Column) -> Column:
    """One record without the blank lines that end it. headers that are null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), *headers, F.concat(F.lit("Content-Length: "), F.octet_length(block))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A column `record` with three records for each row.

    Null html is an empty payload, a null url leaves the target out, a null id leaves the page id out of the metadata. Of equal
    payloads the row with the largest id (of equal ids, the largest url) is the response; of rows that are alike in all three one is.
    Record ids follow from id, url and payload, so a task that runs again gives the same ones. Only digests are compared: a payload goes
    to another task at most once, and where few payloads repeat (REPEATED_SENT), only those do.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.unhex(F.sha2(payload.cast("binary"), 256)).alias("same"))
    light = rows.select("same", "page_id", "url", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    alike = light.groupBy("same", "page_id", "url").agg(F.count("*").alias("rows"), F.first("digest").alias("digest"), F.first("bytes").alias("bytes"))
    rank = F.max(F.struct("page_id", "url"))
    repeated = saved(alike.groupBy("same").agg(rank.alias("last"), F.sum("rows").alias("n")).filter("n > 1").select("same", "last"), "repeated")
    few = repeated.count() <= REPEATED_SENT
    known = F.broadcast(repeated) if few else repeated
    alone = rows.join(known.select("same"), "same", "left_anti")
    # keyed by id too, so that the copies of one payload are spread; rows alike in everything are one here
    last = known.select(F.col("same").alias("l_same"), F.col("last.page_id").alias("l_id"), F.col("last.url").alias("l_url"))
    at = F.expr("same = l_same and page_id <=> l_id and url <=> l_url")
    first = rows.join(last, at).groupBy("same", "page_id", "url").agg(F.first("payload").alias("payload"))
    answers = alone.select("same", "page_id", "url", "payload").unionByName(first.select("same", "page_id", "url", "payload"))
    answers = answers.select("*", F.lit(0).alias("copy"), base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"), F.lit(None).cast(repeated.schema["last"].dataType).alias("last"))
    is_last = F.col("page_id").eqNullSafe(F.col("last.page_id")) & F.col("url").eqNullSafe(F.col("last.url"))
    more = alike.join(known, "same").withColumn("least", F.when(is_last, 1).otherwise(0).cast("long")).filter("rows > least")
    more = more.withColumn("copy", F.explode(F.expr("sequence(least, rows - 1)"))).withColumn("copy", F.col("copy").cast("int"))
    both = answers.unionByName(more.select("same", "page_id", "url", F.lit("").alias("payload"), "copy", "digest", "bytes", "last"))
    revisit = F.col("last").isNotNull()
    name = lambda i, u, copy: _urn(F.lit("answer"), F.hex("same"), F.coalesce(i.cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit("+"), u), F.lit("-")), copy.cast("string"))
    own, origin = name(F.col("page_id"), F.col("url"), F.col("copy")), name(F.col("last.page_id"), F.col("last.url"), F.lit(0))
    target, when = F.concat(F.lit("WARC-Target-URI: "), _header_value(F.col("url"))), F.lit(f"WARC-Date: {date}")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit("\r\n\r\n"))
    answer = _record(
        F.when(revisit, "revisit").otherwise("response"), own,
        [when, target, F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")), F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), origin)), F.when(revisit, F.lit(f"WARC-Profile: {IDENTICAL}")), F.lit("Content-Type: application/http; msgtype=response")],
        F.concat(http, F.col("payload")),
    )
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), own)
    place = F.coalesce(_header_value(F.col("url")), F.lit("/"))
    request = _record("request", _urn(F.lit("request"), own), [when, target, concurrent, F.lit("Content-Type: application/http; msgtype=request")], F.concat(F.lit("GET "), place, F.lit(" HTTP/1.1\r\n\r\n")))
    fields = F.concat(F.coalesce(F.concat(F.lit("pageId: "), F.col("page_id"), F.lit("\r\n")), F.lit("")), F.lit("payloadBytes: "), F.col("bytes"), F.lit("\r\n"))
    metadata = _record("metadata", _urn(F.lit("metadata"), own), [when, target, concurrent, F.lit("Content-Type: application/warc-fields")], fields)
    return both.select(F.explode(F.array(request, answer, metadata)).alias("record"))


def write_archives(pages: DataFrame, path: str, **columns: str) -> None:
    page_records(pages, **columns).write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


class _Bytes:
    """The unzipped bytes of an archive, a piece at a time; archives that aren't zipped are read as they are."""

    def __init__(self, content: bytes):
        self.rest, self.out, self.zipped = memoryview(content), bytearray(), content[:2] == b"\x1f\x8b"
        self.unzip = zlib.decompressobj(31)

    def more(self) -> bool:
        if not len(self.rest):
            return False
        piece, self.rest = self.rest[: 1 << 18], self.rest[1 << 18 :]
        if not self.zipped:
            self.out += piece
            return True
        self.out += self.unzip.decompress(piece)
        while self.unzip.eof and self.unzip.unused_data:  # the next member
            left, self.unzip = self.unzip.unused_data, zlib.decompressobj(31)
            self.out += self.unzip.decompress(left)
        if self.unzip.eof:
            self.unzip = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        at = 0
        while (found := self.out.find(mark, at)) < 0:
            at = max(0, len(self.out) - len(mark))
            if not self.more():
                return None
        return self.take(found + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.out) < n and self.more():
            pass
        taken = bytes(self.out[:n])
        del self.out[:n]
        return taken


def records_of(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers (lower-case names) and the block of each record of an archive; what isn't a record ends it."""
    source = _Bytes(content)
    while (head := source.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").strip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            return
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = source.take(int(headers.get("content-length", 0)))
        source.take(4)
        yield headers, block


RECORDS = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, stated_digest string, head string, payload binary, payload_bytes long, payload_digest string"


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record. head is the HTTP head, the request or the metadata fields; lengths and digests are of the payload read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = {"payload": pa.binary(), "payload_bytes": pa.int64()}

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

        for batch in batches:
            for cell in batch.column(0):
                rows, held = [], 0
                for h, block in records_of(cell.as_py()):
                    payload, head = None, block
                    if h.get("warc-type") in ("response", "revisit"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                    if h.get("warc-type") == "revisit":
                        payload = None
                    digest = None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    kept = payload if with_payload else None
                    rows.append((h.get("warc-record-id"), h.get("warc-type"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, head.decode("utf-8", "replace"), kept, None if payload is None else len(payload), digest))
                    held += len(kept or b"") + 500
                    if held > 8 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(read, RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One nested row for each capture: its answer, and the requests and metadata that name the answer as concurrent.

    Records that name an answer that isn't there give a capture without an answer.
    """
    answered = F.col("type").isin("response", "revisit")
    answer = F.struct("record_id", "type", "target_uri", "date", "refers_to", "stated_digest", F.col("head").alias("http_head"), "payload", "payload_bytes", "payload_digest")
    beside = F.struct("record_id", "target_uri", "date", F.col("head").alias("content"))
    keyed = records.withColumn("capture_id", F.when(answered, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id")))
    return keyed.groupBy("capture_id").agg(
        F.first(F.when(answered, answer), ignorenulls=True).alias("answer"),
        F.collect_list(F.when(F.col("type") == "request", beside)).alias("requests"),
        F.collect_list(F.when(F.col("type") == "metadata", beside)).alias("metadata"),
    )


def field(captured: str, name: str) -> Column:
    """A field of the first metadata record."""
    return F.nullif(F.regexp_extract(F.get(captured, F.lit(0))["content"], rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))


def archived_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the pages' archives, reads them back and gives a row for each capture: page_id, payload_bytes, payload_digest, record_type and refers_to."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "archives")
    write_archives(pages, path)
    done = captures(read_records(spark, path, with_payload=False))
    flat = saved(
        done.select(
            "capture_id", field("metadata", "pageId").cast("long").alias("page_id"),
            F.coalesce(F.col("answer.payload_bytes"), field("metadata", "payloadBytes").cast("long")).alias("payload_bytes"),
            F.coalesce("answer.payload_digest", "answer.stated_digest").alias("payload_digest"),
            F.col("answer.type").alias("record_type"), F.col("answer.refers_to").alias("refers_to_record"),
        ),
        "captures",
    )
    referred = flat.filter("refers_to_record is not null").select(F.col("refers_to_record").alias("capture_id")).distinct()
    first = flat.join(referred, "capture_id", "left_semi").select(F.col("capture_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"))
    return flat.join(first, "refers_to_record", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
