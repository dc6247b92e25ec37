"""WARC archives compressed record by record with zstandard, and a reader for them.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself a zstandard frame or plain;
then each record is one frame.  Writers keep archives under ``archive_bytes`` of payload, in the folder all executors
share, and write under a name of their own attempt, so a lost or repeated task leaves no half archive behind: only
the archives named by the finished job's manifest are read.  The reader streams an archive frame by frame and checks the
version line, the mandatory headers, the declared lengths, and the digests of payloads that are there.

Of records with equal payloads the one with the smallest id is a ``response``, the others are ``revisit`` records
without the payload, which name the first.  Each page is read, hashed and compressed once, into a table of frames in the
shared folder.  Copies are found by digest with a minimum that combines before the shuffle; only (row, id, digest) take part,
and what a row has to be comes back to its frame by the row's own key, so a payload that a third of the pages share does not
gather in one task.

Defined results: a null payload is empty; rows equal in id, url and payload are each the first of their payload, if
they are; a null id is smallest of all; very long payloads are one record; of the table's columns only the named ones are
read, so others cannot clash; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, file_system, row_key, shared_dir, tidy

# Fixed values of the format.
SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
_MANDATORY = (b"warc-type", b"warc-record-id", b"warc-date", b"content-length")
_DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that breaks the format."""


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(id_: object, url: str | None, payload: bytes | None, size: int, payload_digest: str, refers_to: str | None = None) -> bytes:
    """One record's bytes; without a payload a revisit, which has the HTTP headers only and names the record it repeats."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    headers = [
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{id_}')}>",
        f"WARC-Date: {_DATE}",
        "WARC-Target-URI: " + " ".join((url or "urn:none").split()),
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Page-ID: {'' if id_ is None else id_}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if payload is None:
        headers[4:4] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"WARC-Refers-To-Page-ID: {refers_to}"]
    return b"WARC/1.1\r\n" + "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive_head(dictionary: bytes) -> bytes:
    """The skippable frame that holds the dictionary, compressed."""
    body = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_archive(stream, chunk: int = 1 << 18) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(headers, block) of each record of an open archive, one frame at a time."""
    head = stream.read(8)
    dictionary = None
    rest = head
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
        (size,) = struct.unpack("<I", head[4:])
        body = stream.read(size)
        if len(body) != size:
            raise WarcError("the dictionary's frame is cut short")
        if body[:4] == FRAME:
            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        dictionary = zstandard.ZstdCompressionDict(body)
        rest = b""
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    while True:
        rest = rest or stream.read(chunk)
        if not rest:
            return
        frame, out = decompressor.decompressobj(), io.BytesIO()
        while not frame.eof:
            if not rest:
                raise WarcError("a record's frame is cut short")
            out.write(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else stream.read(chunk)
        yield parse_record(out.getvalue())


def parse_record(data: bytes) -> tuple[dict[bytes, bytes], bytes]:
    """Headers (names in lower case) and block, checked."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError("no WARC version line")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError("a header without a colon")
        headers[name.strip().lower()] = value.strip()
    if missing := [m for m in _MANDATORY if m not in headers]:
        raise WarcError(f"missing headers: {missing}")
    if not headers[b"content-length"].isdigit() or int(headers[b"content-length"]) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("the length of the block is not the one declared")
    return headers, rest[:-4]


def page_of(headers: dict[bytes, bytes], block: bytes) -> tuple:
    """(id, payload_bytes, payload_digest, record_type, refers_to), checked against the block."""
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = [int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    kind = headers[b"warc-type"].decode()
    said = headers[b"warc-payload-digest"].decode().removeprefix("sha1:")
    if len(declared) != 1 or (kind == "response" and (len(payload) != declared[0] or digest(payload) != said)) or (kind == "revisit" and payload):
        raise WarcError("the payload is not the one declared")
    number = lambda name: int(headers[name]) if headers.get(name) else None
    return number(b"warc-page-id"), declared[0], said, kind, number(b"warc-refers-to-page-id")


def train_dictionary(pages: DataFrame, payload_col: str = "html", samples: int = 400, most_chars: int = 50_000, size: int = 65_536) -> bytes:
    """A dictionary from at most ``samples`` payloads of at most ``most_chars`` characters each; without enough
    of them, some plain bytes."""
    rows = pages.select(F.col(payload_col).alias("p")).where(F.length("p").between(1, most_chars))
    share = max(1, rows.count() // samples)
    some = rows.where(F.pmod(F.xxhash64("p"), F.lit(share)) == 0).limit(samples).collect()
    try:
        return zstandard.train_dictionary(size, [r["p"].encode() for r in some]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"<!DOCTYPE html><html><head><title></title></head><body></body></html>"


def write_archives(pages: DataFrame, folder: str, dictionary: bytes, archive_bytes: int = 64 << 20, level: int = 3) -> DataFrame:
    """Writes the rows of ``with_revisits`` and returns the manifest (path, records)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        compressor = _compressor(dictionary, level)
        head = archive_head(dictionary)
        paths, counts = [], []
        out, size = None, 0
        for batch in batches:
            for id_, url, bytes_, sha, frame, refers, again in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or size > archive_bytes:
                    if out is not None:
                        out.close()
                    fs.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out, size = fs.open_output_stream(f"{root}/{name}"), 0
                    out.write(head)
                    paths.append(f"{folder}/{name}")
                    counts.append(0)
                if again:
                    frame = compressor.compress(record(id_, url, None, bytes_, sha, "" if refers is None else str(refers)))
                out.write(frame)
                size += bytes_
                counts[-1] += 1
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], ["path", "records"])

    return cut(pages.mapInArrow(emit, "path string, records long"))


def read_archives(manifest: DataFrame) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of each record of the manifest's archives."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, name = file_system(path)
                rows = []
                with fs.open_input_stream(name) as stream:
                    for headers, block in read_archive(stream):
                        rows.append(page_of(headers, block))
                if len(rows) != records:
                    raise WarcError(f"{path}: {len(rows)} records, {records} in the manifest")
                c = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return manifest.mapInArrow(emit, "id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), level=level)


def _frames(dictionary: bytes, level: int):
    """Each payload's response record as it will be in an archive: what moves between tasks is compressed."""

    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = _compressor(dictionary, level)
        for batch in batches:
            payloads = as_bytes(batch.column("payload"))
            shas = [digest(p) for p in payloads]
            frames = [compressor.compress(record(i, u, p, len(p), s)) for i, u, p, s in zip(batch.column("id").to_pylist(), batch.column("url").to_pylist(), payloads, shas)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), batch.column("row"), pa.array(map(len, payloads), pa.int64()), pa.array(shas, pa.string()), pa.array(frames, pa.binary())], ["id", "url", "row", "bytes", "digest", "frame"])

    return emit


def with_revisits(pages: DataFrame, folder: str, dictionary: bytes, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, level: int = 3) -> DataFrame:
    """(id, url, bytes, digest, frame, refers_to, again): of equal payloads of at least ``min_bytes`` bytes all but the
    first are revisits (``again``), without a frame."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("string").alias("payload"), row_key(F.col(id_col), F.col(url_col), F.col(payload_col)).alias("row"))
    framed = rows.mapInArrow(_frames(dictionary, level), "id long, url string, row binary, bytes long, digest string, frame binary")
    # The frames are compressed already.
    framed.write.option("compression", "none").parquet(f"{folder}/frames")
    framed = spark.read.parquet(f"{folder}/frames")
    order = F.struct(F.col("id").isNotNull().alias("known"), "id", "row")
    large = framed.where(F.col("bytes") >= min_bytes)
    first = large.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("of"), F.col("first.id").alias("first_id"), F.col("first.row").alias("first_row"))
    marks = large.select("row", "digest").join(first, F.col("digest") == F.col("of")).where("row <> first_row").select(F.col("row").alias("later"), "first_id").dropDuplicates(["later"])
    again = F.col("later").isNotNull()
    return framed.join(marks, framed["row"] == marks["later"], "left").select("id", "url", "bytes", "digest", F.when(~again, F.col("frame")).alias("frame"), F.when(again, F.col("first_id")).alias("refers_to"), again.alias("again"))


def round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, **columns: str) -> DataFrame:
    """Writes all pages to archives and reads them back."""
    folder = folder or f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    dictionary = train_dictionary(pages, columns.get("payload_col", "html"))
    return read_archives(write_archives(with_revisits(pages, folder, dictionary, min_bytes=min_bytes, **columns), folder, dictionary))
