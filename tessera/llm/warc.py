"""WARC archives in seekable Zstandard bundles.

Each task writes bundles: records are grouped into frames of about
``FRAME_BYTES`` that decompress on their own, then a skippable frame with the
seek table of the public seekable format (compressed and plain size of each
frame) ends the file. The index table maps each record to (bundle, frame,
offset inside the plain frame, length). Bundles carry the task attempt in
their name and only the index, committed by Spark, says which are valid, so a
lost executor leaves at most unreferenced files.

Of records with equal payloads (SHA-1 and length) of at least ``min_bytes`` the
one with the smallest page_id is a ``response``; the others are ``revisit``
records without a body that refer to it.

Defined results: null html is an empty payload; a null page_id counts as larger
than any other and is null again when read; rows that repeat both page_id and
payload of the response are responses too; an empty table gives no bundle and
no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid

from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import shared_folder, small_batches, store, text_of

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 128 << 20
# fixed values of the seekable format
SKIPPABLE, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id {kind}, bundle string, frame int, record_offset long, record_length long"
READ = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def filesystem(folder: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder)


def _clean(value) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in str(value))


def record(page_id, url, payload: bytes, digest: str, refers_to, is_revisit: bool) -> bytes:
    urn = lambda x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{x}')}>"
    head = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", urn(page_id)),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Bytes", len(payload))]
    if url is not None:
        head.append(("WARC-Target-URI", _clean(url)))
    if page_id is not None:
        head.append(("X-Page-Id", _clean(page_id)))
    if is_revisit:
        head += [("WARC-Refers-To", urn(refers_to)), ("X-Refers-To-Page", _clean(refers_to)),
                 ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if is_revisit else payload)
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(body))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "replace") + b"\r\n" + body + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """(headers, body after the HTTP head, end) of the record at an offset."""
    cut = data.index(b"\r\n\r\n", at)
    head = dict(line.split(": ", 1) for line in data[at:cut].decode().split("\r\n")[1:])
    a, n = cut + 4, int(head["Content-Length"])
    body = data[a:a + n]
    return head, body[body.index(b"\r\n\r\n") + 4:], a + n + 4


class Bundle:
    """One file: frames, then the seek table."""

    def __init__(self, stream):
        import zstandard
        self.stream, self.pack = stream, zstandard.ZstdCompressor(level=3)
        self.sizes: list[tuple[int, int]] = []
        self.held, self.plain, self.written = [], 0, 0

    def add(self, rec: bytes) -> tuple[int, int]:
        if self.plain and self.plain + len(rec) > FRAME_BYTES:
            self.flush()
        place = (len(self.sizes), self.plain)
        self.held.append(rec)
        self.plain += len(rec)
        return place

    def flush(self):
        if self.plain:
            frame = self.pack.compress(b"".join(self.held))
            self.stream.write(frame)
            self.sizes.append((len(frame), self.plain))
            self.written += len(frame)
            self.held, self.plain = [], 0

    def close(self):
        self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEK_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.stream.close()


def seek_table(stream, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame, from the footer."""
    stream.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", stream.read(9))
    if magic != SEEK_MAGIC or flags:
        raise ValueError("not a seekable bundle")
    stream.seek(size - 9 - 8 * n)
    at, out = 0, []
    for packed, plain in struct.iter_unpack("<II", stream.read(8 * n)):
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(stream, frame: tuple[int, int, int]) -> bytes:
    import zstandard
    stream.seek(frame[0])
    return zstandard.ZstdDecompressor().decompress(stream.read(frame[1]), max_output_size=max(1, frame[2]))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write all pages as WARC bundles under ``folder``; returns the index."""
    small_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    body = text_of("html").cast("binary")
    base = pages.select("page_id", F.col("url").cast("string").alias("url"), body.alias("payload")) \
        .withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("n", F.length("payload"))
    first = base.where(F.col("n") >= min_bytes).groupBy(F.col("digest").alias("d"), F.col("n").alias("m")) \
        .agg(F.min("page_id").alias("refers_to"))
    joined = base.join(first, (F.col("digest") == F.col("d")) & (F.col("n") == F.col("m")), "left").select(
        "page_id", "url", "payload", "digest", "refers_to",
        (F.col("refers_to").isNotNull() & ~F.col("refers_to").eqNullSafe(F.col("page_id"))).alias("is_revisit"))

    def write(batches):
        import base64

        import pyarrow as pa
        from pyspark import TaskContext
        task = TaskContext.get()
        system, root = filesystem(folder)
        system.create_dir(root, recursive=True)
        open_bundle, name, seq = None, None, 0
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for r in batch.to_pylist():
                if open_bundle is None:
                    name = f"bundle-{task.partitionId():05d}-{task.taskAttemptId()}-{seq:03d}.warc.zst"
                    open_bundle = Bundle(system.open_output_stream(f"{root}/{name}", compression=None))
                rec = record(r["page_id"], r["url"], r["payload"], base64.b32encode(r["digest"]).decode(), r["refers_to"], r["is_revisit"])
                frame, offset = open_bundle.add(rec)
                for c, v in zip(rows, (r["page_id"], name, frame, offset, len(rec))):
                    c.append(v)
                if open_bundle.written >= BUNDLE_BYTES:
                    open_bundle.close()
                    open_bundle, seq = None, seq + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], batch.schema.field("page_id").type), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int32()),
                 pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.int64())],
                names=["page_id", "bundle", "frame", "record_offset", "record_length"])
        if open_bundle is not None:
            open_bundle.close()

    return store(joined.mapInArrow(write, INDEX.format(kind=kind)), "warc-index")


def _records_of(folder: str):
    """mapInArrow: the records of the bundles named in ``bundle``."""
    def read(batches):
        import base64
        import hashlib

        import pyarrow as pa
        system, root = filesystem(folder)
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                path = f"{root}/{name}"
                size = system.get_file_info(path).size
                with system.open_input_file(path) as stream:
                    for frame in seek_table(stream, size):
                        data, at, rows = read_frame(stream, frame), 0, []
                        while at < len(data):
                            head, body, at = parse(data, at)
                            digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                            if head["WARC-Type"] == "response":
                                if digest != base64.b32encode(hashlib.sha1(body).digest()).decode() or len(body) != int(head["X-Payload-Bytes"]):
                                    raise ValueError(f"damaged record in {path}")
                            rows.append((head.get("X-Page-Id"), int(head["X-Payload-Bytes"]), digest, head["WARC-Type"], head.get("X-Refers-To-Page")))
                        cols = list(zip(*rows))
                        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                                         names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return read


def read_archives(index: DataFrame, folder: str, kind: str = "bigint") -> DataFrame:
    """Every record of every indexed bundle, payloads checked against digests."""
    spark = index.sparkSession
    bundles = index.select("bundle").distinct().repartition(spark.sparkContext.defaultParallelism * 4, "bundle")
    rows = bundles.mapInArrow(_records_of(folder), READ)
    return rows.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})


def fetch(index: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """Payloads of the ``wanted`` page_ids: only the frames that hold them are
    read. Returns page_id, record_type, payload (binary; null for revisits)."""
    kind = index.schema["page_id"].dataType.simpleString()
    places = index.join(wanted.select("page_id").distinct(), "page_id").repartition("bundle", "frame") \
        .sortWithinPartitions("bundle", "frame", "record_offset")

    def read(batches):
        import pyarrow as pa
        system, root = filesystem(folder)
        opened, frames, held, data, stream = None, [], None, b"", None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["bundle"] != opened:
                    path = f"{root}/{r['bundle']}"
                    stream = system.open_input_file(path)
                    opened, held, frames = r["bundle"], None, seek_table(stream, system.get_file_info(path).size)
                if r["frame"] != held:
                    held, data = r["frame"], read_frame(stream, frames[r["frame"]])
                head, body, _ = parse(data, r["record_offset"])
                rows.append((r["page_id"], head["WARC-Type"], body if head["WARC-Type"] == "response" else None))
            cols = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field("page_id").type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary())],
                                             names=["page_id", "record_type", "payload"])

    return places.mapInArrow(read, f"page_id {kind}, record_type string, payload binary")


def archive_pages(pages: DataFrame) -> DataFrame:
    """The digest of op8: written, then read back."""
    folder = shared_folder(pages.sparkSession, "warc")
    index = write_archives(pages, folder)
    return read_archives(index, folder, pages.schema["page_id"].dataType.simpleString())
