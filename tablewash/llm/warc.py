"""Web archives: writing and reading WARC records, and resolving revisits.

An archive is a folder of gzip files, each a sequence of WARC/1.1 records.  Spark's text
writer writes them, with the two line breaks that end a record as line separator, so a
lost executor leaves no half-written file behind.  Files are read as a whole and parsed
record by record by their ``Content-Length``; a file holds ``FILE_RECORDS`` records at most.

Revisit resolution shuffles headers only: by payload digest to the first response of each
payload, and by record id to decide what each record becomes.  Counting the first response
combines on the map side and is joined back, so a payload shared by a third of all pages
is split like any skewed join.  The deduplicated archive has new records with new headers.

Defined cases: a NULL payload is empty; records with equal payloads of ``min_bytes`` or more
keep the one with the smallest page id as response (ties: the smallest record id; records
without a page id come last); line breaks in a URL are percent-encoded and a NULL URL is
left out; repeated rows are records of their own.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import forget, new_path, written

FILE_RECORDS = 5_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = ("record_id string, type string, page bigint, uri string, date string, digest string, payload_bytes bigint,"
           " refers_to string")
_FIELDS = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("page", pa.int64()), ("uri", pa.string()), ("date", pa.string()),
                     ("digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string())])


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(
    kind: str, record_id: str, date: str, payload: bytes | None, digest: str, payload_bytes: int,
    page: int | None = None, uri: str | None = None, original: dict | None = None,
) -> bytes:
    """One record without the line breaks that end it; a revisit holds the HTTP header but no payload."""
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {payload_bytes}\r\n\r\n").encode()
    if kind == "response":
        block += payload or b""
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date}
    if uri is not None:
        fields["WARC-Target-URI"] = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", uri)
    if page is not None:
        fields["X-Page-ID"] = str(page)
    fields["WARC-Payload-Digest"] = f"sha1:{digest}"
    if original:
        fields["WARC-Profile"] = PROFILE
        fields["WARC-Refers-To"] = f"<{original['record_id']}>"
        if original.get("uri"):
            fields["WARC-Refers-To-Target-URI"] = original["uri"]
        if original.get("date"):
            fields["WARC-Refers-To-Date"] = original["date"]
    fields["Content-Type"] = "application/http; msgtype=response"
    fields["Content-Length"] = str(len(block))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + block


def parse(file: io.BufferedIOBase) -> Iterator[tuple[dict, bytes]]:
    """(fields in lower case, block) of each record of an uncompressed stream."""
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {}
        while (line := file.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = file.read(length)
        if len(block) != length or file.read(4) != b"\r\n\r\n":
            raise ValueError("cut record")
        yield fields, block


class _Unzip(io.RawIOBase):
    """A gzip byte string as a stream, never unpacked as a whole."""

    def __init__(self, packed: bytes):
        self.packed, self.at, self.rest, self.unzip = packed, 0, b"", zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.rest:
            if self.unzip.eof:
                left = self.unzip.unused_data or self.packed[self.at:]
                if not left:
                    return 0
                self.packed, self.at, self.unzip = left, 0, zlib.decompressobj(31)
            part = self.unzip.unconsumed_tail
            if not part:
                part, self.at = self.packed[self.at:self.at + (1 << 16)], self.at + (1 << 16)
                if not part:
                    return 0
            self.rest = self.unzip.decompress(part, 1 << 20)
        n = min(len(into), len(self.rest))
        into[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def _row(fields: dict, block: bytes) -> tuple[dict, bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    http = dict(line.partition(":")[::2] for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    kind = fields["warc-type"]
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    digest = payload_digest(payload) if kind == "response" else stated
    if stated and stated != digest:
        raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
    size = len(payload) if kind == "response" else int(http.get("Content-Length", "0"))
    return {"record_id": fields["warc-record-id"].strip("<>"), "type": kind, "page": int(fields["x-page-id"]) if "x-page-id" in fields else None,
            "uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "digest": digest, "payload_bytes": size,
            "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None}, payload


def reader(with_payload: bool):
    schema = _FIELDS.append(pa.field("payload", pa.binary())) if with_payload else _FIELDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for fields, block in parse(io.BufferedReader(_Unzip(content.as_py()), 1 << 18)):
                    row, payload = _row(fields, block)
                    if with_payload:
                        row["payload"] = zlib.compress(payload, 1)
                        size += len(row["payload"])
                    rows.append(row)
                    if len(rows) >= 1000 or size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)
    return run


def read_archive(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of an archive; digests are computed from the payloads and checked.  ``payload`` is zlib data."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(reader(with_payload), HEADERS + (", payload binary" if with_payload else ""))


def write_archive(records: DataFrame, path: str) -> None:
    """Write a column ``value`` of records."""
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED") \
        .option("maxRecordsPerFile", FILE_RECORDS).text(path)


def write_pages(pages: DataFrame, path: str, date: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> None:
    """An archive with a response for each page, whose payload is the html."""
    run_id = uuid.uuid4()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            values = []
            for page, uri, payload in zip(*(batch.column(c).to_pylist() for c in ("page", "uri", "payload")), strict=True):
                payload = payload or b""
                values.append(record("response", uuid.uuid5(run_id, f"{part}-{n}").urn, date, payload, payload_digest(payload), len(payload), page, uri))
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()).cast(pa.string())], ["value"])

    rows = pages.select(F.col(id_column).cast("bigint").alias("page"), F.col(url_column).cast("string").alias("uri"),
                        F.col(html_column).cast("string").cast("binary").alias("payload"))
    write_archive(rows.mapInArrow(run, "value string"), path)


def resolve_revisits(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """What each record becomes: record_id, new_type, and ``original`` (record_id, uri, date, page) for revisits."""
    order = F.struct(F.col("page").isNull(), "page", "record_id")
    original = F.struct("record_id", "uri", "date", "page")
    first = heads.where((F.col("type") == "response") & (F.col("payload_bytes") >= min_bytes)).groupBy("digest", "payload_bytes").agg(
        F.min_by(original, order).alias("original"))
    found = heads.where(F.col("payload_bytes") >= min_bytes).join(first, ["digest", "payload_bytes"], "left")
    same = F.col("original.record_id") == F.col("record_id")
    found = found.withColumn("original", F.when(~same, F.col("original")))
    small = heads.where(F.col("payload_bytes") < min_bytes).withColumn("original", F.lit(None).cast(found.schema["original"].dataType))
    both = found.unionByName(small)
    # A revisit whose original is in none of the archives stays what it is.
    new_type = F.when(F.col("original").isNotNull() | (F.col("type") == "revisit"), "revisit").otherwise("response")
    return both.select("record_id", new_type.alias("new_type"), "original")


def write_deduplicated(spark: SparkSession, source: str, target: str, date: str, min_bytes: int = 0) -> None:
    """Read the archive ``source`` and write ``target``: each payload once, all other records as revisits with fresh headers."""
    heads = written(read_archive(spark, source), "headers")
    decided = resolve_revisits(heads, min_bytes)
    run_id = uuid.uuid4()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for r in batch.to_pylist():
                original = r["original"] and {**r["original"], "record_id": uuid.uuid5(run_id, r["original"]["record_id"]).urn, "date": date}
                # The original of an unresolved revisit is in another archive and keeps its name.
                original = original or ({"record_id": r["refers_to"]} if r["refers_to"] else None)
                payload = zlib.decompress(r["payload"]) if r["new_type"] == "response" else None
                values.append(record(r["new_type"], uuid.uuid5(run_id, r["record_id"]).urn, date, payload, r["digest"], r["payload_bytes"], r["page"], r["uri"],
                                     original if r["new_type"] == "revisit" else None))
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()).cast(pa.string())], ["value"])

    full = read_archive(spark, source, with_payload=True)
    write_archive(full.join(decided, "record_id").mapInArrow(run, "value string"), target)
    forget(heads)


def resolved_pages(spark: SparkSession, path: str) -> DataFrame:
    """Per record of a deduplicated archive: page, payload_bytes, digest, type, and the page of the response it refers to."""
    heads = written(read_archive(spark, path), "headers")
    responses = heads.where("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page").alias("refers_page"))
    revisits = heads.where("type = 'revisit'").join(responses, "refers_to", "left")
    plain = heads.where("type <> 'revisit'").withColumn("refers_page", F.lit(None).cast("bigint"))
    return plain.unionByName(revisits).select(
        "page", "uri", "record_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"),
        F.col("refers_page").alias("refers_to"))


def archive_and_deduplicate(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", min_bytes: int = 0) -> DataFrame:
    """Write all pages to an archive, deduplicate it, and read the result back, one row per page."""
    spark = pages.sparkSession
    source, target = new_path(spark, "crawl"), new_path(spark, "warc")
    write_pages(pages, source, date)
    write_deduplicated(spark, source, target, date, min_bytes)
    return resolved_pages(spark, target)
