"""WARC archives: records written by each task to files of its own, read back as a table of payload chunks."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipflow.llm import text as T
from shipflow.session import shared_path, stored

CHUNK_BYTES = 64 * 1024
FILE_BYTES = 64 * 1024 * 1024  # a file is closed once it has so many bytes
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"  # pages carry no time of capture

INDEX = "path string, records long, bytes long"
CHUNKS = (
    "page_id {id}, record_id string, record_type string, uri string, refers_to string, declared_digest string, "
    "chunk_no int, chunk_bytes int, total_bytes long, running_digest string, is_last boolean{data}"
)


def base32_digest(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Page rows as records: page_id, url, digest (hex SHA-1), payload_bytes, refers_to, html (only in responses).

    Of equal payloads of at least least_bytes the row with the smallest (page_id, url) is the response, the others
    revisit it; of rows equal in both, one is the response. Null html is an empty payload; a null page_id orders
    first. The payload travels once, to where its digest is; copies are reduced to one before they travel.
    """
    frame = T.needed(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    frame = frame.select(
        "page_id", "url", "html", F.sha1("html").alias("digest"), F.octet_length("html").cast("long").alias("payload_bytes")
    )
    shared = frame.filter(F.col("payload_bytes") >= least_bytes)
    first = shared.groupBy("digest").agg(F.min_by(F.struct("page_id", "url", "html"), F.struct("page_id", "url")).alias("f"))
    nobody = F.lit(None).cast(frame.schema["page_id"].dataType)
    responses = first.select(
        "f.page_id", "f.url", "digest", F.octet_length("f.html").cast("long").alias("payload_bytes"), nobody.alias("refers_to"), "f.html"
    )
    rows = shared.groupBy("page_id", "url", "digest", "payload_bytes").agg(F.count("*").alias("rows"))
    targets = rows.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.sum("rows").alias("copies"))
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))
    revisits = (
        rows.join(targets.filter("copies > 1"), "digest")
        .withColumn("times", F.col("rows") - is_first.cast("long"))
        .filter("times > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
        .select("page_id", "url", "digest", "payload_bytes", F.col("first.page_id").alias("refers_to"), F.lit(None).cast("string").alias("html"))
    )
    small = frame.filter(F.col("payload_bytes") < least_bytes)
    small = small.select("page_id", "url", "digest", "payload_bytes", nobody.alias("refers_to"), "html")
    parts = [responses, revisits] + ([small] if least_bytes > 0 else [])
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


class _Archive:
    """Gzip members, one per record, in a new file."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        filesystem, place = fs.FileSystem.from_uri(self.path)
        self._out, self.records, self.bytes = filesystem.open_output_stream(place, compression=None), 0, 0

    def add(self, headers: dict[str, str], payload: bytes) -> None:
        lines = "".join(f"{name}: {value}\r\n" for name, value in headers.items() if value is not None)
        member = io.BytesIO()
        with gzip.GzipFile(fileobj=member, mode="wb", compresslevel=2, mtime=0) as packed:
            packed.write(f"{VERSION}\r\n{lines}Content-Length: {len(payload)}\r\n\r\n".encode())
            packed.write(payload)
            packed.write(b"\r\n\r\n")
        self._out.write(member.getbuffer())
        self.records, self.bytes = self.records + 1, self.bytes + member.tell()

    def close(self) -> tuple[str, int, int]:
        self._out.close()
        return self.path, self.records, self.bytes


def _one_line(value) -> str | None:
    """A header value; line ends inside would end the header."""
    return None if value is None else str(value).replace("\r", "%0D").replace("\n", "%0A")


def _written(folder: str, file_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    archive, closed = None, []
    for batch in batches:
        for row in batch.to_pylist():
            archive = archive or _Archive(folder)
            revisit = row["html"] is None
            digest = base32_digest(row["digest"])
            archive.add(
                {
                    "WARC-Type": "revisit" if revisit else "response",
                    "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
                    "WARC-Date": DATE,
                    "WARC-Target-URI": _one_line(row["url"]),
                    "WARC-Payload-Digest": f"sha1:{digest}",
                    "WARC-Profile": REVISIT_PROFILE if revisit else None,
                    "Page-ID": _one_line(row["page_id"]),
                    "Refers-To-Page-ID": _one_line(row["refers_to"]) if revisit else None,
                    "Payload-Length": str(row["payload_bytes"]) if revisit else None,
                    "Content-Type": "text/html; charset=utf-8",
                },
                b"" if revisit else row["html"].encode(),
            )
            if archive.bytes >= file_bytes:
                closed, archive = [*closed, archive.close()], None
    if archive:
        closed.append(archive.close())
    if closed:
        yield pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*closed)], ["path", "records", "bytes"])


def write(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write records below folder, a URI that pyarrow and all executors can open; returns the stored list of files.

    Only listed files count: a task that is lost or runs twice leaves files that no list names.
    """
    spark = rows.sparkSession
    T.small_batches(spark)
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    filesystem, place = fs.FileSystem.from_uri(f"{uri}/archives")
    filesystem.create_dir(place, recursive=True)
    listed = f"{folder}/list"
    rows.mapInArrow(partial(_written, f"{uri}/archives", file_bytes), INDEX).write.parquet(listed)
    return spark.read.schema(INDEX).parquet(listed)


def _header(stream) -> dict[str, str] | None:
    """The next record's headers, or None at the end of the file."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    headers = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode().partition(":")
        headers[name.strip().lower()] = value.strip()
    return headers


def _read(as_number: bool, chunk_bytes: int, with_data: bool, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64() if as_number else pa.string(), *[pa.string()] * 5, pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        for path in batch["path"].to_pylist():
            filesystem, place = fs.FileSystem.from_uri(path)
            with filesystem.open_input_stream(place, compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(raw, 1 << 20)) as packed:
                stream = io.BufferedReader(packed, 1 << 17)
                while (headers := _header(stream)) is not None:
                    page = headers.get("page-id")
                    fixed = (
                        int(page) if as_number and page is not None else page,
                        headers["warc-record-id"],
                        headers["warc-type"],
                        headers.get("warc-target-uri"),
                        headers.get("refers-to-page-id"),
                        headers.get("warc-payload-digest", "").removeprefix("sha1:"),
                    )
                    left, total, number, digest = int(headers["content-length"]), 0, 0, hashlib.sha1()
                    while True:
                        data = stream.read(min(chunk_bytes, left))
                        if len(data) < min(chunk_bytes, left):
                            raise EOFError(f"{path}: record {headers['warc-record-id']} is cut off")
                        left, total = left - len(data), total + len(data)
                        digest.update(data)
                        running = base64.b32encode(digest.digest()).decode()
                        row = (*fixed, number, len(data), total, running, left == 0)
                        held.append((*row, data) if with_data else row)
                        size, number = size + 300 + len(data) * with_data, number + 1
                        if size >= 4 * 1024 * 1024:
                            yield batch_of(held)
                            held, size = [], 0
                        if left == 0:
                            break
    if held:
        yield batch_of(held)


def chunks(files: DataFrame, page_type: str = "bigint", chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """Listed archives as chunk rows: a record is its chunks 0, 1, ... of at most chunk_bytes.

    total_bytes and running_digest (base 32 SHA-1) hold for the payload up to and with the chunk, so those of the last
    chunk are the payload's. No task holds more than some chunks. An empty payload is one empty chunk; a revisit
    too, its declared_digest is that of the payload it stands for. One task reads one file.
    """
    as_number = page_type in ("bigint", "int", "smallint", "tinyint")
    schema = CHUNKS.format(id="long" if as_number else "string", data=", data binary" if with_data else "")
    names = [part.split()[0] for part in schema.split(", ")]
    paths = files.select("path").repartition(max(1, files.count()), "path")
    return paths.mapInArrow(partial(_read, as_number, chunk_bytes, with_data, names), schema)


def payloads(chunk_rows: DataFrame) -> DataFrame:
    """Whole payloads from chunks with data, for records that fit a cell: record_id, payload."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", "data")))
    return chunk_rows.groupBy("record_id").agg(ordered.alias("parts")).select(
        "record_id", F.aggregate("parts", F.lit(b""), lambda whole, part: F.concat(whole, part["data"])).alias("payload")
    )


def round_trip(pages: DataFrame, least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write all pages, read them back: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest of a response are those of the bytes read; a revisit has those of the response it names, found
    by digest among the records read.
    """
    spark: SparkSession = pages.sparkSession
    page_type = pages.schema["page_id"].dataType
    files = write(records(pages, least_bytes), shared_path(spark, "warc"))
    # the archives are read once; what is kept of them is a row per record
    last = stored(chunks(files, page_type.simpleString(), chunk_bytes, with_data=False).filter("is_last"), "records")
    response = F.col("record_type") == "response"
    read = last.filter(response).select("page_id", "uri", "total_bytes", "running_digest", "record_type", F.lit(None).cast("string").alias("refers_to"))
    # a digest belongs to one response, or to several of a size too small to be revisited; their sizes are equal
    sizes = last.filter(response).groupBy("running_digest").agg(F.max("total_bytes").alias("total_bytes"))
    again = last.filter(~response).select("page_id", "uri", "record_type", "refers_to", F.col("declared_digest").alias("running_digest"))
    read = read.unionByName(again.join(sizes, "running_digest"))
    return read.select(
        F.col("page_id").cast(page_type).alias("page_id"),
        F.col("uri").alias("url"),
        F.col("total_bytes").alias("payload_bytes"),
        F.col("running_digest").alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast(page_type).alias("refers_to"),
    )
