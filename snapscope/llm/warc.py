"""WARC in seekable Zstandard bundles.

Records are gathered into frames that can be decompressed alone; a bundle is a run of frames followed by a seek
table in a skippable frame, so any zstd tool reads a bundle and a reader with the seek table reads one frame. Where
a record lies is kept beside the bundles: (record, bundle, frame, offset in the frame, length).

Equal payloads of at least MIN_REVISIT bytes are stored once, with the smallest page_id; the others become revisit
records that carry the digest, the length and the id they refer to.

Recovery: a task writes bundles under a name of its own attempt and returns the records' places; only bundles named
in the committed places are ever read. Bundles and frames are bounded in size, so a task holds one of each.

Defined results: null html is an empty payload; a null page_id has no record id of its own and is never referred to;
equal ids with equal payloads are all responses when they hold the smallest id; a null URL leaves out its header.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapscope.llm.common import bounded_batches, fresh_path, join_small_groups, stored

MIN_REVISIT = 100
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 24
BUNDLE_RECORDS = 50_000
# Fixed values of the seekable format: magic numbers of the skippable frame and of the seek table.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

PLACES = "record_id long, bundle string, frame int, offset int, length int"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, bundle string, frame int, offset int"


def with_record_types(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, n_bytes, first_id): first_id is the response's id, null for responses."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("n_bytes"))
    repeated = (
        rows.where(F.col("n_bytes") >= min_revisit).groupBy("digest")
        .agg(F.count("*").alias("copies"), F.min("page_id").alias("first_id"))
        .where("copies > 1 AND first_id IS NOT NULL")
    )
    joined = join_small_groups(rows, repeated, ["digest"], "copies", F.xxhash64("page_id"))
    other = ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.withColumn("first_id", F.when(other, F.col("first_id")))


def _header(name: str, value: object) -> str:
    return f"{name}: {value}\r\n"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, n_bytes: int, first_id: int | None) -> bytes:
    """One record. A revisit keeps the HTTP header with the full length and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    body = http if first_id is not None else http + payload
    head = "WARC/1.1\r\n" + _header("WARC-Type", "response" if first_id is None else "revisit")
    if page_id is not None:
        head += _header("WARC-Record-ID", f"<urn:page:{page_id}>")
    if url is not None:
        head += _header("WARC-Target-URI", quote(url, safe="".join(map(chr, range(0x21, 0x7F))).replace("%", "")))
    head += _header("WARC-Payload-Digest", f"sha256:{digest}")
    if first_id is not None:
        head += _header("WARC-Refers-To", f"<urn:page:{first_id}>")
        head += _header("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head += _header("Content-Type", "application/http; msgtype=response") + _header("Content-Length", len(body))
    return head.encode() + b"\r\n" + body + b"\r\n\r\n"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """Skippable frame with the (compressed, decompressed) size of each frame and a footer."""
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    footer = struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def read_seek_table(bundle: pa.NativeFile) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame, from the end of a bundle."""
    n, flags, magic = struct.unpack("<IBI", bundle.read_at(9, bundle.size() - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end")
    width = 12 if flags & 0x80 else 8
    entries = bundle.read_at(n * width, bundle.size() - 9 - n * width)
    found, start = [], 0
    for i in range(n):
        size, full = struct.unpack_from("<II", entries, i * width)
        found.append((start, size, full))
        start += size
    return found


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """Spark writes file:/x where others want file:///x."""
    return pafs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and "://" not in folder else folder)


class BundleWriter:
    """Packs records into frames and frames into bundles; hands out places as bundles close."""

    def __init__(self, folder: str, frame_bytes: int, bundle_bytes: int):
        self.folder, self.frame_bytes, self.bundle_bytes = folder, frame_bytes, bundle_bytes
        self.attempt, self.bundles = uuid.uuid4().hex, 0
        self.zstd = zstandard.ZstdCompressor(level=3)
        self.fs, self.path = file_system(folder)
        self._clear()

    def _clear(self) -> None:
        self.out, self.frames, self.places = bytearray(), [], []
        self.frame = bytearray()

    def add(self, record_id: int | None, record: bytes) -> list[tuple] | None:
        """The places of a bundle that this record has filled."""
        self.places.append((record_id, len(self.frames), len(self.frame), len(record)))
        self.frame += record
        if len(self.frame) >= self.frame_bytes:
            self._close_frame()
        if len(self.out) >= self.bundle_bytes or len(self.places) >= BUNDLE_RECORDS:
            return self.close()
        return None

    def _close_frame(self) -> None:
        packed = self.zstd.compress(bytes(self.frame))
        self.frames.append((len(packed), len(self.frame)))
        self.out += packed
        self.frame = bytearray()

    def close(self) -> list[tuple]:
        if self.frame:
            self._close_frame()
        if not self.frames:
            return []
        name = f"{self.attempt}-{self.bundles:06d}.warc.zst"
        with self.fs.open_output_stream(f"{self.path}/{name}", compression=None) as out:
            out.write(bytes(self.out) + seek_table(self.frames))
        places = [(i, name, f, at, n) for i, f, at, n in self.places]
        self.bundles += 1
        self._clear()
        return places


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


PLACES_ARROW = pa.schema([("record_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())])
READ_ARROW = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("payload", pa.binary()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()),
])


def write_bundles(pages: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes the bundles of (page_id, url, html) under folder; returns the places of all records, stored."""
    bounded_batches(pages)
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(folder, frame_bytes, bundle_bytes)
        for batch in batches:
            for i in range(batch.num_rows):
                row = [c[i].as_py() for c in batch.columns]
                places = writer.add(row[0], warc_record(*row))
                if places:
                    yield _batch(places, PLACES_ARROW)
        yield _batch(writer.close(), PLACES_ARROW)

    records = with_record_types(pages).select("page_id", "url", F.when(F.col("first_id").isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"), "digest", "n_bytes", "first_id")
    return stored(records.mapInArrow(write, PLACES), "warc-places")


def _parse(record: bytes) -> dict:
    head, _, body = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = body[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    fields["http"] = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    fields["payload"] = payload
    return fields


def _id(text: str | None) -> int | None:
    return None if text is None else int(text[len("<urn:page:"):-1])


def read_bundles(places: DataFrame, folder: str) -> DataFrame:
    """Every record that places name, fetched by bundle, frame and offset: only a bundle's places move, its frames
    are read where they are needed. Digests of responses are taken from the payload as read, those of revisits from
    their header; a response that isn't what its header says is an error."""
    wanted = places.groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("frame", "offset", "length"))).alias("wanted"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        zstd = zstandard.ZstdDecompressor()
        for batch in batches:
            for name, places in zip(batch.column(0), batch.column(1)):
                name = name.as_py()
                with fs.open_input_file(f"{path}/{name}") as bundle:
                    starts, open_frame, data, rows, held = read_seek_table(bundle), -1, b"", [], 0
                    for place in places:
                        frame, offset, length = (x.as_py() for x in place.values())
                        if frame != open_frame:
                            start, size, full = starts[frame]
                            data, open_frame = zstd.decompress(bundle.read_at(size, start), max_output_size=full), frame
                        fields = _parse(data[offset : offset + length])
                        payload, digest = fields["payload"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        n = int(fields["http"]["Content-Length"])
                        if fields["WARC-Type"] == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{name}: the payload at {frame}/{offset} isn't what its header says")
                        url = fields.get("WARC-Target-URI")
                        rows.append((_id(fields.get("WARC-Record-ID")), url and unquote(url), n, digest, fields["WARC-Type"], _id(fields.get("WARC-Refers-To")), payload, name, frame, offset))
                        held += len(payload)
                        if held > 4 << 20:
                            yield _batch(rows, READ_ARROW)
                            rows, held = [], 0
                yield _batch(rows, READ_ARROW)

    return wanted.mapInArrow(read, READ)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Writes pages to fresh bundles in the shared folder and reads them back."""
    folder = fresh_path(pages.sparkSession, "warc-bundles")
    return read_bundles(write_bundles(pages, folder), folder)
