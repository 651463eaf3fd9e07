"""WARC archives in Zstandard: writer with revisit records, and a validating reader.

An archive file is one leading skippable frame that holds the dictionary, then one Zstandard
frame for each record. Writing gives each task its own archive files in a shared folder and a
manifest with one row for each finished file; only files in the manifest are read, so a task
that ran twice leaves nothing behind that counts.

Defined cases: a null payload is empty; the smallest page_id of equal payloads is the response
and the others are revisits of it; rows that repeat that smallest page_id are responses too; a
row without page_id is always a response and nothing refers to it; a very long payload is held whole
by its task. An empty table gives an empty folder, which reads as an empty table. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightwell.llm.shared import file_system, make_dir, shared_path, small_batches

SKIPPABLE = 0x184D2A5D  # fixed value: the skippable frame kind that holds a dictionary
FRAME = 0xFD2FB528  # fixed value: the magic number of a Zstandard frame
WRITTEN = "page_id long, file string, offset long, length long"
READ = "page_id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string"


class WarcError(ValueError):
    """The archive breaks the format."""


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, uri: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit carries no payload, only its digest and length."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Header fields and payload of one record, with every length and digest checked."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not sep or lines[0] != "WARC/1.1":
        raise WarcError("no WARC/1.1 header")
    fields = {}
    for line in lines[1:]:
        key, colon, value = line.partition(": ")
        if not colon:
            raise WarcError(f"header line without a colon: {line!r}")
        fields[key] = value
    for key in ("WARC-Type", "WARC-Record-ID", "WARC-Payload-Digest", "X-Payload-Length", "Content-Length"):
        if key not in fields:
            raise WarcError(f"no {key}")
    length = int(fields["Content-Length"])
    if rest[length:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {length}, but {len(rest) - 4} bytes follow")
    payload = rest[:length]
    page = lambda x: int(x[len("<urn:page:") : -1]) if x[len("<urn:page:") : -1] else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        if int(fields["X-Payload-Length"]) != length or digest32(payload) != digest:
            raise WarcError("payload differs from its length or digest")
    elif fields["WARC-Type"] != "revisit" or length or "WARC-Refers-To" not in fields:
        raise WarcError("not a response, nor a revisit without payload")
    return {
        "page_id": page(fields["WARC-Record-ID"]),
        "payload": payload if fields["WARC-Type"] == "response" else None,
        "payload_bytes": int(fields["X-Payload-Length"]),
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
        "uri": fields.get("WARC-Target-URI"),
    }


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the samples' own bytes where there are too few to train on."""
    samples = [x for x in samples if len(x) >= 8]
    total = sum(map(len, samples))
    if len(samples) >= 16 and total >= 8 * size:
        try:
            return zstandard.train_dictionary(size, samples, k=200, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[:size]


def open_dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data)


class ArchiveWriter:
    """Writes one archive; the dictionary comes from its own first records."""

    def __init__(self, sink, samples: list[bytes], dictionary_bytes: int, level: int):
        self.sink, self.at = sink, 0
        held = train_dictionary(samples, dictionary_bytes)
        self._put(struct.pack("<II", SKIPPABLE, len(held)) + held)
        kept = {}
        if held:
            kept["dict_data"] = open_dictionary(held)
            kept["dict_data"].precompute_compress(level=level)
        self.compressor = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True, **kept)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, record: bytes) -> tuple[int, int]:
        start = self.at
        self._put(self.compressor.compress(record))
        return start, self.at - start


def frame_end(view: memoryview, at: int) -> int:
    """Where the frame that starts at byte at ends, from its block headers."""
    if len(view) - at < 6 or struct.unpack_from("<I", view, at)[0] != FRAME:
        raise WarcError(f"no frame at byte {at}")
    checksum = 4 if view[at + 4] & 4 else 0
    try:
        end = at + zstandard.frame_header_size(view[at : at + 18])
    except zstandard.ZstdError as error:
        raise WarcError(str(error)) from error
    last = 0
    while not last:
        if end + 3 > len(view):
            raise WarcError(f"frame at byte {at} is cut short")
        head = int.from_bytes(view[end : end + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        end += 3 + (1 if kind == 1 else size)
    if end + checksum > len(view):
        raise WarcError(f"frame at byte {at} is cut short")
    return end + checksum


def read_archive(data) -> Iterator[dict]:
    """Records of an archive held in memory, one frame each; WarcError if anything is amiss."""
    view = memoryview(data)
    if len(view) < 8:
        raise WarcError("no leading skippable frame")
    magic, size = struct.unpack_from("<II", view, 0)
    if magic != SKIPPABLE or 8 + size > len(view):
        raise WarcError("no leading skippable frame")
    held = bytes(view[8 : 8 + size])
    try:
        if held[:4] == struct.pack("<I", FRAME):
            held = zstandard.ZstdDecompressor().decompress(held)
        inflate = zstandard.ZstdDecompressor(**({"dict_data": open_dictionary(held)} if held else {}))
    except zstandard.ZstdError as error:
        raise WarcError(f"dictionary: {error}") from error
    at = 8 + size
    while at < len(view):
        end = frame_end(view, at)
        try:
            claimed = zstandard.get_frame_parameters(view[at : at + 18]).content_size
            step = inflate.decompressobj()
            record = step.decompress(view[at:end])
        except zstandard.ZstdError as error:
            raise WarcError(str(error)) from error
        if not step.eof or claimed not in (len(record), zstandard.CONTENTSIZE_UNKNOWN):
            raise WarcError(f"frame at byte {at} differs from its stated size")
        yield parse_record(record)
        at = end


def _writer(folder: str, archive_bytes: int, sample_bytes: int, dictionary_bytes: int, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        waiting: list[tuple] = []
        held, sink, writer, name, done = 0, None, None, "", []

        def begin():
            nonlocal sink, writer, name
            name = f"{uuid.uuid4().hex}.warc.zst"
            fs.create_dir(root, recursive=True)
            sink = fs.open_output_stream(f"{root}/{name}", compression=None)
            writer = ArchiveWriter(sink, [x[1] for x in waiting], dictionary_bytes, level)
            for page_id, record in waiting:
                done.append((page_id, name, *writer.add(record)))
            waiting.clear()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string()), pa.array([x[2] for x in done], pa.int64()), pa.array([x[3] for x in done], pa.int64())], names=["page_id", "file", "offset", "length"])
            done.clear()
            return out

        for batch in batches:
            for page_id, uri, html, first in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                refers = first if page_id is not None and first is not None and first != page_id else None
                record = record_bytes(page_id, uri, b"" if refers is not None else payload, digest32(payload), len(payload), refers)
                if writer is None:
                    waiting.append((page_id, record))
                    held += len(record)
                    if held >= sample_bytes:
                        begin()
                        held = 0
                else:
                    done.append((page_id, name, *writer.add(record)))
                    if writer.at >= archive_bytes:
                        sink.close()
                        writer = None
                        yield rows()
        if waiting:
            begin()
        if writer is not None:
            sink.close()
        if done:
            yield rows()

    return write


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_payload_bytes: int = 0, archive_bytes: int = 64 << 20, sample_bytes: int = 1 << 20, dictionary_bytes: int = 16 << 10, level: int = 3) -> DataFrame:
    """Write one record for each page into archives in folder; gives the written manifest.

    Pages whose payload (of min_payload_bytes at least) equals that of a smaller page_id become
    revisit records. Payloads are compared by SHA-256, counted with map-side combining, and only
    payloads that occur twice go to the join, so most of its rows have no partner; Spark splits
    a payload that holds a large share of the rows. Columns beside the three named are ignored.
    """
    small_batches(pages.sparkSession)
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).cast("string").alias("uri"), F.col(payload_col).cast("string").alias("html"))
    rows = rows.withColumn("body", F.unhex(F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256)))
    long_enough = F.octet_length(F.coalesce("html", F.lit(""))) >= min_payload_bytes
    firsts = rows.where(F.col("page_id").isNotNull() & long_enough).groupBy("body").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("body", "first")
    marked = rows.join(firsts, "body", "left").select("page_id", "uri", "html", F.when(long_enough, F.col("first")).alias("first"))
    make_dir(spark, folder)  # without a page no task does
    manifest = marked.mapInArrow(_writer(folder, archive_bytes, sample_bytes, dictionary_bytes, level), WRITTEN)
    at = shared_path(spark, "warc-manifest")
    manifest.write.parquet(at)
    return spark.read.schema(manifest.schema).parquet(at)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri"]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    for batch in batches:
        for i in range(batch.num_rows):
            found, size = [], 0
            content = batch.column("content")[i].as_buffer()
            for record in read_archive(content):
                found.append(record)
                size += record["payload_bytes"]
                if size > 8 << 20 or len(found) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], k) for n, k in zip(names, kinds, strict=True)], names=names)
                    found, size = [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], k) for n, k in zip(names, kinds, strict=True)], names=names)


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """Records of all archives in folder, or of those the manifest names, checked while decoding."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    if manifest is not None:
        names = manifest.select(F.col("file").alias("named")).distinct()
        if names.count() <= 200_000:  # of 41 bytes each; else a plain join
            names = F.broadcast(names)
        files = files.join(names, F.element_at(F.split("path", "/"), -1) == F.col("named"), "left_semi")
    return files.select("content").mapInArrow(_reader, READ)
