"""Media columns: 8-bit images in archives, read by a Spark data source over byte ranges.

An archive is two files in one folder: `NAME.arc`, the stored members one after the other, and `NAME.dir`, its
directory with an entry of fixed width for each member in the order of their offsets. A folder's `MANIFEST.json` names the archives that count; files of
task attempts that failed are not in it.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tidemark.llm.common import documents, release, require_whole, shared_dir

#: Payloads fill whole images of 24 x 24 samples.
SIDE = 24
BLOCK = SIDE * SIDE
PAD = 0xFF
#: Of a directory: key, 1 if the key is null, offset, stored bytes, CRC-32 of them, unpadded bytes.
ENTRY = struct.Struct("<qqqqqq")
#: Bytes of an archive after which a task begins the next, bytes of members that a read partition covers about, and bytes that one read or one batch holds about.
ARCHIVE_BYTES, RANGE_BYTES, READ_BYTES = 128 << 20, 16 << 20, 4 << 20
#: Read partitions of a folder, about; more bytes make them larger, and one may span archives, so that the driver's list of them stays short.
MOST_RANGES = 50_000
#: How often a member is read again on its own.
RETRIES = 3
LEVEL = 1
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode(text: bytes, level: int = LEVEL) -> bytes:
    """A grey 8-bit PNG, 576 samples wide, of `text` padded with bytes 255 to a positive multiple of 576."""
    rows = max(1, -(-len(text) // BLOCK))
    padded = np.full(rows * BLOCK, PAD, dtype=np.uint8)
    padded[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    lines = np.zeros((rows, BLOCK + 1), dtype=np.uint8)  # each line begins with its filter, 0 for none
    lines[:, 1:] = padded.reshape(rows, BLOCK)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", BLOCK, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> bytes:
    """The samples of an image that `encode` made; every chunk's CRC is checked."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, shape = 8, [], None
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    if shape is None or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey image")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("lines are filtered")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean and deviation of the samples and an average hash: the payload in 64 equal parts, a bit for each whose mean is above the whole mean."""
    x = np.frombuffer(payload, dtype=np.uint8)
    parts = x.reshape(64, -1).mean(axis=1)
    bits = np.packbits(parts > x.mean()).tobytes().hex()
    return f"{x.mean():.4f}:{x.std():.4f}:{bits}"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class ArchiveWriter:
    """Appends members to archives of about ARCHIVE_BYTES under names of its own."""

    def __init__(self, folder: str):
        self.fs, self.folder = file_system(folder)
        self.done: list[tuple[str, int, int]] = []
        self.out = None

    def add(self, key: int | None, media: bytes, n_bytes: int) -> None:
        if self.out is None:
            self.name, self.entries, self.offset = uuid.uuid4().hex, [], 0
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}.arc")
        self.out.write(media)
        self.entries.append(ENTRY.pack(key or 0, key is None, self.offset, len(media), zlib.crc32(media), n_bytes))
        self.offset += len(media)
        if self.offset >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            with self.fs.open_output_stream(f"{self.folder}/{self.name}.dir") as f:
                f.write(b"".join(self.entries))
            self.done.append((self.name, len(self.entries), self.offset))
            self.out = None


def write_archives(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> None:
    """Stores every row's text (null: empty) as an image in archives under `folder`. Keys are whole numbers or null; other types are an error.

    Each task writes files of its own; the driver gets a line for each archive and writes the manifest.
    """
    require_whole(df, key)
    fs, at = file_system(folder)
    fs.create_dir(at, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        writer = ArchiveWriter(folder)
        for batch in batches:
            for k, t in zip(batch["key"], batch["text"]):
                raw = (t.as_py() or "").encode()
                writer.add(k.as_py(), encode(raw), len(raw))
        writer.close()
        names, entries, sizes = zip(*writer.done) if writer.done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(entries, pa.int64()), pa.array(sizes, pa.int64())], names=["name", "entries", "bytes"])

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "name string, entries long, bytes long").collect()
    with fs.open_output_stream(f"{at}/MANIFEST.json") as f:
        f.write(json.dumps(sorted([r["name"], r["entries"], r["bytes"]] for r in rows)).encode())


@dataclass
class ByteRange(InputPartition):
    """Entries [first, last) of the directories of archives: (name, first, last) each."""

    parts: list[tuple[str, int, int]]


class ArchiveReader(DataSourceReader):
    """Plans from archive sizes alone; a partition reads its part of the directory and then the members' bytes, in pieces."""

    def __init__(self, options: dict, open_file: Callable | None = None):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.retries = int(options.get("retries", RETRIES))
        self.open_file = open_file

    def _open(self, name: str):
        fs, at = file_system(self.folder)
        return (self.open_file or fs.open_input_file)(f"{at}/{name}")

    def partitions(self) -> list[ByteRange]:
        with self._open("MANIFEST.json") as f:
            archives = json.loads(f.read())
        wanted = max(self.range_bytes, sum(size for _, _, size in archives) // MOST_RANGES)
        out, parts, held = [], [], 0
        for name, entries, size in archives:
            pieces = max(1, min(entries, -(-size // wanted)))
            cuts = [entries * i // pieces for i in range(pieces + 1)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                piece = size * (b - a) // entries
                if parts and held + piece > wanted:
                    out.append(ByteRange(parts))
                    parts, held = [], 0
                parts.append((name, a, b))
                held += piece
        return [*out, ByteRange(parts)]

    def _member(self, name: str, entry: tuple) -> bytes:
        """One member, read on its own by its offset; tried `retries` times."""
        error: Exception = OSError("no try was allowed")
        for _ in range(self.retries):
            try:
                with self._open(f"{name}.arc") as f:
                    f.seek(entry[2])
                    media = f.read(entry[3])
                if len(media) == entry[3] and zlib.crc32(media) == entry[4]:
                    return media
                error = OSError("its bytes do not fit its CRC")
            except OSError as e:
                error = e
        raise OSError(f"member at offset {entry[2]} of {self.folder}/{name}.arc can't be read: {error}")

    def _members(self, name: str, first: int, last: int) -> Iterator[tuple[tuple, bytes]]:
        with self._open(f"{name}.dir") as f:
            f.seek(first * ENTRY.size)
            entries = list(ENTRY.iter_unpack(f.read((last - first) * ENTRY.size)))
        at = 0
        while at < len(entries):
            end = at + 1
            while end < len(entries) and entries[end][2] + entries[end][3] - entries[at][2] <= READ_BYTES:
                end += 1
            start = entries[at][2]
            try:
                with self._open(f"{name}.arc") as f:
                    f.seek(start)
                    raw = f.read(entries[end - 1][2] + entries[end - 1][3] - start)
            except OSError:
                raw = b""
            for e in entries[at:end]:
                media = raw[e[2] - start : e[2] - start + e[3]]
                yield e, media if len(media) == e[3] and zlib.crc32(media) == e[4] else self._member(name, e)
            at = end

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=["key", "archive", "offset", "n_bytes", "media"])

        for name, first, last in part.parts:
            for e, media in self._members(name, first, last):
                rows.append((None if e[1] else e[0], name, e[2], e[5], media))
                size += len(media)
                if size >= READ_BYTES:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class ArchiveSource(DataSource):
    """spark.read.format("media_archive").load(folder): key, archive, offset, n_bytes, media.

    Options: rangeBytes (bytes of members in a partition, about), retries (further reads of a member whose bytes don't fit). A member that can't be
    read fails its task, so no row is ever left out.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "key long, archive string, offset long, n_bytes long, media binary"

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").load(folder)


def digests(stored: DataFrame) -> DataFrame:
    """Of stored members the columns of `media_columns`, from the bytes as they were read."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        import hashlib

        for batch in batches:
            rows = []
            for m in batch["media"]:
                media = m.as_py()
                payload = decode(media)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch["key"], batch["n_bytes"], *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["key", "n_bytes", *names])

    return stored.select("key", "n_bytes", "media").mapInArrow(run, "key long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """A row for each row of `df`: key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Texts are stored as images in archives under `folder` (a new one in the shared folder if None), which are written when this is called, whether or not the result is read, and stay until the folder is cleared; they are then read back.
    Null and empty texts are one image of padding, very long ones one large image. Keys are whole numbers or null. Equal texts give equal values; repeated rows stay, an empty table gives an empty result, other columns are not read.
    """
    spark = df.sparkSession
    folder = folder or f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    write_archives(df, folder, key, text)
    return digests(read_archives(spark, folder)).withColumnRenamed("key", key)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as stored media, read back."""
    return media_columns(documents(spark, sf_dir))
