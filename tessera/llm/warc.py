"""WARC archives compressed record by record with a Zstandard dictionary that each file carries in its first frame."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, shared_dir, small_enough

# Fixed values of the Zstandard frame format and of its WARC profile.
SKIPPABLE_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Records are buffered up to this many bytes before the first is written; the dictionary is built from them.
SAMPLE_BYTES = 4 << 20
DICT_BYTES = 64 << 10
#: Uncompressed bytes after which a task begins another file.
FILE_BYTES = 256 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, '#'.join(map(str, parts))).urn}>"


def warc_record(own: str, page_id: int | None, url: str | None, payload: bytes, first: tuple[int, str | None] | None, date: str) -> bytes:
    """One response, or a revisit of first, a page id and a record id. A revisit has the HTTP head with the payload's
    length, but not the payload."""
    revisit = first is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    target = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "about:blank")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {own}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To-Page-ID: {first[0]}"]
        if first[1]:
            head.append(f"WARC-Refers-To: {first[1]}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained from the samples; where they are too few for that, the start of the samples itself."""
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, samples)) // 8)), samples)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[:DICT_BYTES] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Writer:
    """Writes archives one after another; a file gets its final name when it is whole."""

    def __init__(self, folder: str, stem: str, level: int):
        self.fs, self.path = _filesystem(folder)
        self.stem, self.level, self.no, self.done = stem, level, 0, []
        self.buffer: list[bytes] = []
        self.size, self.out = 0, None

    def add(self, record: bytes) -> None:
        self.size += len(record)
        if self.out is not None:
            self.out.write(self.compressor.compress(record))
            self.rows += 1
        else:
            self.buffer.append(record)
            if self.size >= SAMPLE_BYTES:
                self.open()
        if self.size >= FILE_BYTES:
            self.close()

    def open(self) -> None:
        self.fs.create_dir(self.path, recursive=True)
        self.name = f"{self.path}/{self.stem}-{self.no:05d}.warc.zst"
        self.out = self.fs.open_output_stream(self.name + ".part", compression=None)
        d = dictionary(self.buffer)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=d, write_checksum=True)
        packed = zstandard.ZstdCompressor(level=self.level).compress(d.as_bytes())
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(packed)) + packed)
        for r in self.buffer:
            self.out.write(self.compressor.compress(r))
        self.rows, self.buffer = len(self.buffer), []

    def close(self) -> None:
        if self.out is None and self.buffer:
            self.open()
        if self.out is not None:
            self.out.close()
            self.fs.move(self.name + ".part", self.name)
            self.done.append((self.name, self.rows))
            self.out, self.size, self.no = None, 0, self.no + 1


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
    level: int = 3,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Write one WARC record per row of pages; (path, records) of each finished archive, as a durable table.

    The payload is the html in UTF-8; null counts as empty. Of records with equal payloads of at least min_bytes, the
    one with the smallest id is a response and the others revisit it; smaller payloads are all responses. Rows that
    repeat the smallest id, and rows without an id, are responses; each record has an id of its own, and a revisit
    names that of its response unless rows repeat it. Only digests are compared. Where more digests repeat than executors may hold (BROADCAST_ROWS), pages are shuffled by id and digest, which no
    hot key has, to meet their verdict; else they stay in their partition. A task writes one set of archives. Names hold the task attempt, so that a task that runs again
    leaves no half-written archive in the result: readers use the returned table, not the folder's listing. folder
    must be one that all executors share; by default a new one beside the checkpoints. An empty table writes none.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    src = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), html.alias("_html"), F.sha1(html).alias("_digest"))
    keys = src.filter(F.octet_length("_html") >= min_bytes).filter("_id IS NOT NULL").groupBy("_digest", "_id").agg(F.count("*").alias("_n"))
    same = keys.groupBy("_digest").agg(F.min(F.struct("_id", "_n")).alias("_to"), F.sum("_n").alias("_all")).filter("_all > 1")
    same = durable(same.select("_digest", F.col("_to._id").alias("_first"), (F.col("_to._n") > 1).alias("_twice")))
    if small_enough(same):
        rows = src.join(F.broadcast(same), "_digest", "left")
    else:
        rows = src.join(durable(keys.join(same, "_digest").select("_id", "_digest", "_first", "_twice")), ["_id", "_digest"], "left")
    rows = rows.select("_id", "_url", "_html", F.when(F.octet_length("_html") >= min_bytes, F.col("_first")).alias("_first"), "_digest", "_twice")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get()
        no, out = 0, Writer(folder, f"part-{at.partitionId():06d}-{at.taskAttemptId()}", level)
        for b in batches:
            for columns in zip(*(c for c in b.columns), strict=True):
                page_id, url, payload, first, digest, twice = (c.as_py() for c in columns)
                no += 1
                own, target = record_id(folder, "row", at.partitionId(), at.taskAttemptId(), no), record_id(folder, first, digest)
                if page_id is None or first is None:
                    out.add(warc_record(own, page_id, url, payload, None, date))
                elif page_id == first:
                    out.add(warc_record(own if twice else target, page_id, url, payload, None, date))
                else:
                    out.add(warc_record(own, page_id, url, payload, (first, None if twice else target), date))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in out.done], type=pa.string()), pa.array([d[1] for d in out.done], type=pa.int64())], names=["path", "records"])

    return durable(rows.mapInArrow(write, "path string, records long").withColumn("folder", F.lit(folder)))


def frames(data: io.BufferedIOBase) -> Iterator[bytes]:
    """The records of one archive, decompressed one at a time with the dictionary of its first frame."""
    magic, size = struct.unpack("<II", data.read(8))
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    d = data.read(size)
    if d[:4] == ZSTD_MAGIC:
        d = zstandard.ZstdDecompressor().decompress(d)
    # a dictionary without the magic number of trained ones is raw content
    known = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO)
    decompressor = zstandard.ZstdDecompressor(dict_data=known)
    left = b""
    while True:
        one, parts = decompressor.decompressobj(), []
        while not one.eof:
            left = left or data.read(1 << 20)
            if not left:
                if parts:
                    raise ValueError("the archive ends inside a record")
                return
            parts.append(one.decompress(left))
            left = one.unused_data if one.eof else b""
        yield b"".join(parts)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload) per record of the archives.

    archives has a path and its folder per row, as write_archives returns them. A response's digest is computed anew
    from its payload and must be the one in its head; a revisit's digest and length are those in its head. Repeated
    rows give repeated records; no archives, no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for b in batches:
            for path, folder in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                files, _ = _filesystem(folder)
                rows, size = [], 0
                with files.open_input_stream(path, compression=None) as f:
                    for fields, block in map(parse_record, frames(f)):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        revisit = fields["warc-type"] == "revisit"
                        if not revisit and (len(payload) != length or base32_sha1(payload) != digest):
                            raise ValueError(f"{path}: a payload differs from its digest")
                        page, to = fields.get("warc-page-id"), fields.get("warc-refers-to-page-id")
                        rows.append((page and int(page), fields["warc-target-uri"], fields["warc-type"], digest, length, to and int(to), None if revisit else payload))
                        size += len(payload)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    spread = max(1, archives.rdd.getNumPartitions())
    return archives.select("path", "folder").repartition(spread, "path").mapInArrow(
        read, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
    )
