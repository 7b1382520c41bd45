"""WARC archives: writing pages with revisits, and a reader that salvages what damage leaves.

An archive is a file of records, each a gzip member of its own (`.warc.gz`) or plain (`.warc`). A record is kept if all checks hold: the member's CRC and length,
a version line, a header with type, id and Content-Length, the two line ends after the block, and the block's digest where there is one.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tidemark.llm.common import release, require_whole, shared_dir
from tidemark.llm.media import file_system

VERSION = b"WARC/1.1"
#: Payloads of fewer bytes are always stored.
LEAST_REVISIT = 100
#: Bytes of an archive after which a task begins the next, bytes of an archive that a read partition covers about, bytes that one read or one batch holds about, and bytes of a header at most.
ARCHIVE_BYTES, RANGE_BYTES, READ_BYTES, HEADER_BYTES = 64 << 20, 16 << 20, 2 << 20, 1 << 20
#: Read partitions, about; more bytes make them larger. A partition may span archives.
MOST_RANGES = 50_000
LEVEL = 1
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: How a record begins: a gzip member, or a version line.
MEMBER = b"\x1f\x8b\x08"
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
LINE = re.compile(rb"WARC/1\.[0-9]\r\n")


def _field(value: str) -> str:
    """`value` for a header line: line ends and other controls percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", value)


def _unfield(value: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), value)


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """A response record, or a revisit record, whose block ends with the HTTP header and has no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda k: f"<urn:page:{'' if k is None else k}>"
    lines = [
        VERSION.decode(), f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(key)}", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_field(url)}"] if url is not None else []), "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"] if revisit else []), f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _digest_fits(told: str, block: bytes) -> bool:
    """Whether a labelled digest (base 32 or hexadecimal) is that of `block`; labels of unknown algorithms are not judged."""
    kind, _, value = told.partition(":")
    if kind.lower() not in ("sha1", "sha256", "md5"):
        return True
    raw = hashlib.new(kind.lower(), block).digest()
    return value.lower() == raw.hex() or value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=")


class Damaged(ValueError):
    """What stands at an offset is no whole record."""


class Archive:
    """One open archive, read in pieces of READ_BYTES."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.at, self.piece = 0, b""

    def read(self, offset: int, n: int) -> bytes:
        """Up to `n` bytes from `offset`."""
        if not self.at <= offset or offset + n > self.at + len(self.piece):
            self.file.seek(offset)
            self.at, self.piece = offset, self.file.read(min(max(n, READ_BYTES), self.size - offset))
        return self.piece[offset - self.at : offset - self.at + n]

    def record(self, offset: int) -> tuple[int, dict[str, str], bytes]:
        """(end, header fields in lower case, block) of the record at `offset`; Damaged if any check fails."""
        if self.read(offset, 3) == MEMBER:
            raw, end = self._member(offset)
            fields, block, used = self._parsed(raw)
            if used != len(raw):
                raise Damaged("member goes on after its record")
            return end, fields, block
        head = self.read(offset, 8 << 10)
        if b"\r\n\r\n" not in head:
            head = self.read(offset, HEADER_BYTES)
        fields, start, length = self._header(head)
        if offset + start + length + 4 > self.size:
            raise Damaged("record is cut off")
        body = self.read(offset + start, length + 4)
        return offset + start + length + 4, fields, self._block(fields, body, 0, length)

    def _member(self, offset: int) -> tuple[bytes, int]:
        inflate, out, at = zlib.decompressobj(wbits=31), [], offset
        try:
            while not inflate.eof:
                piece = self.read(at, min(64 << 10, self.size - at))
                if not piece:
                    raise Damaged("member is cut off")
                out.append(inflate.decompress(piece))
                at += len(piece)
                if out[0][:7] != b"WARC/1."[: len(out[0])]:
                    raise Damaged("member holds no record")
        except zlib.error as e:
            raise Damaged(f"member: {e}") from e
        return b"".join(out), at - len(inflate.unused_data)

    def _header(self, raw: bytes) -> tuple[dict[str, str], int, int]:
        """(fields, where the block begins, its length) of a record that `raw` begins with."""
        end = raw.find(b"\r\n\r\n", 0, HEADER_BYTES)
        if not LINE.match(raw) or end < 0:
            raise Damaged("no version line or no end of header")
        fields = {}
        for line in raw[:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if not colon:
                raise Damaged("a header line has no name")
            name = name.strip().lower()
            if name in fields and name != "warc-concurrent-to":
                raise Damaged("a header field is repeated, as where one header runs into another")
            fields[name] = value.strip()
        if not {"warc-type", "warc-record-id"} <= fields.keys() or not re.fullmatch("[0-9]{1,18}", fields.get("content-length", "")):
            raise Damaged("header lacks a type, an id or a length")
        return fields, end + 4, int(fields["content-length"])

    def _parsed(self, raw: bytes) -> tuple[dict[str, str], bytes, int]:
        fields, start, length = self._header(raw)
        return fields, self._block(fields, raw, start, length), start + length + 4

    def _block(self, fields: dict[str, str], raw: bytes, start: int, length: int) -> bytes:
        if raw[start + length : start + length + 4] != b"\r\n\r\n":
            raise Damaged("block does not end where its length says")
        block = raw[start : start + length]
        if not _digest_fits(fields.get("warc-block-digest", ""), block):
            raise Damaged("block does not fit its digest")
        return block

    def next_valid(self, offset: int) -> int:
        """Where the next whole record begins at or after `offset`; the size of the archive if there is none."""
        while offset < self.size:
            window = self.read(offset, READ_BYTES)
            for m in START.finditer(window):
                try:
                    self.record(offset + m.start())
                    return offset + m.start()
                except Damaged:
                    pass
            offset += max(1, len(window) - 6) if offset + len(window) < self.size else len(window)
        return self.size

    def salvaged(self, first: int, last: int) -> Iterator[tuple[int, int, dict[str, str] | None, bytes | str]]:
        """(start, end, fields, block) of the records that begin in [first, last), and (start, end, None, reason) of the gaps that follow them or the archive's beginning.

        A part that begins inside the archive begins with its first whole record; what stands before that belongs to the part before. So each record and each gap is told once, however an archive is cut.
        """
        at = self.next_valid(first) if first else 0
        owned = first == 0
        while at < self.size and (at < last or owned):
            try:
                end, fields, block = self.record(at)
                if at >= last:
                    return
                yield at, end, fields, block
                at, owned = end, True
            except Damaged as e:
                after = self.next_valid(at + 1)
                yield at, after, None, str(e)
                at, owned = after, False


@dataclass
class Span(InputPartition):
    """Parts (name, size of the archive, first, last) of archives."""

    parts: list[tuple[str, int, int, int]]


class WarcReader(DataSourceReader):
    """Plans from the sizes of the archives in a folder; what a write left out of the folder's MANIFEST.json is not read, where there is one."""

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))

    def archives(self) -> list[tuple[str, int]]:
        fs, at = file_system(self.folder)
        sizes = {i.base_name: i.size for i in fs.get_file_info(pa.fs.FileSelector(at)) if re.search(r"\.warc(\.gz)?$", i.base_name)}
        try:
            with fs.open_input_file(f"{at}/MANIFEST.json") as f:
                return sorted((name, sizes[name]) for name in json.loads(f.read()))
        except FileNotFoundError:
            return sorted(sizes.items())

    def partitions(self) -> list[Span]:
        archives = self.archives()
        wanted = max(self.range_bytes, sum(size for _, size in archives) // MOST_RANGES)
        out, parts, room = [], [], wanted
        for name, size in archives:
            first = 0
            while first < size:
                last = min(size, first + room)
                parts.append((name, size, first, last))
                room -= last - first
                first = last
                if not room:
                    out.append(Span(parts))
                    parts, room = [], wanted
        return [*out, Span(parts)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        fs, at = file_system(self.folder)
        rows, held = [], 0
        for name, size, first, last in span.parts:
            with fs.open_input_file(f"{at}/{name}") as f:
                for start, end, fields, block in Archive(f, size).salvaged(first, last):
                    rows.append((name, start, end - start, block if fields is None else None, fields and list(fields.items()), None if fields is None else block))
                    held += len(block)
                    if held >= READ_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


KINDS = {"archive": pa.string(), "offset": pa.int64(), "length": pa.int64(), "reason": pa.string(), "fields": pa.map_(pa.string(), pa.string()), "block": pa.binary()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KINDS.values())], names=list(KINDS))


class WarcSource(DataSource):
    """spark.read.format("warc_salvage").load(folder): archive, offset, length, reason, fields, block.

    A row for each whole record (its header fields by lower-case name and its block) and one for each quarantined gap (its reason, null fields and block).
    Option: rangeBytes (bytes of archives in a partition, about).
    """

    @classmethod
    def name(cls) -> str:
        return "warc_salvage"

    def schema(self) -> str:
        return "archive string, offset long, length long, reason string, fields map<string,string>, block binary"

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))


def read_warc(spark: SparkSession, folder: str, **options) -> DataFrame:
    """All rows of the archives in `folder`, records and gaps. An empty folder gives no row.

    After a failed check the reader looks for the next gzip member or version line at which a whole record stands and goes on there. Plain archives
    may quote whole records inside payloads: those are found only where the search passes through them, after damage or at the beginning of a part.
    """
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc_salvage").options(**options).load(folder)


def gaps(stored: DataFrame) -> DataFrame:
    """The quarantined byte gaps: archive, offset, length, reason."""
    return stored.filter("reason IS NOT NULL").select("archive", "offset", "length", "reason")


def roles(df: DataFrame, key: str = "page_id", payload: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """`df` with `_first`, the least key of the rows with an equal payload of `least` bytes or more; null for the others and for payloads that are there once.

    Digests are counted first and the repeated ones joined back by their digest; payloads go over the network only where those are too many to broadcast.
    """
    raw = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    digest = F.when(F.length(raw) >= least, F.sha2(raw, 256))
    seen = df.select(digest.alias("_digest"), F.col(key).alias("key")).filter("_digest IS NOT NULL").groupBy("_digest").agg(F.min("key").alias("_first"), F.count("*").alias("n"))
    at = f"{shared_dir(df.sparkSession)}/repeated-{uuid.uuid4().hex}"
    seen.filter("n > 1").select(F.col("_digest").alias("_of"), "_first").write.parquet(at)
    repeated = df.sparkSession.read.parquet(at)  # of known size, so that few are broadcast and payloads stay where they are
    return df.withColumn("_digest", digest).join(repeated, F.col("_digest") == F.col("_of"), "left").drop("_digest", "_of")


def write_warc(df: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", compress: bool = True) -> None:
    """Stores every row of `df` as a record under `folder`: of equal payloads of LEAST_REVISIT bytes or more that of the least key as a response, the others as revisits that refer to it.

    Null payloads are empty, null URLs are left out of the header. Rows that share payload and least key are all responses, as are rows without a key that no row with a key precedes. Keys are whole numbers or null.
    Each task writes archives of its own names; the driver gets their names and writes the manifest, so that files of failed attempts don't count.
    """
    require_whole(df, key)
    fs, at = file_system(folder)
    fs.create_dir(at, recursive=True)
    told = roles(df.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.col(payload).cast("string").alias("payload")), "key", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        names, out, size = [], None, 0
        for batch in batches:
            for k, u, p, first in zip(batch["key"], batch["url"], batch["payload"], batch["_first"]):
                k, first = k.as_py(), first.as_py()
                raw = record(k, u.as_py(), (p.as_py() or "").encode(), first, first is not None and first != k)
                if compress:
                    deflate = zlib.compressobj(LEVEL, wbits=31)
                    raw = deflate.compress(raw) + deflate.flush()
                if out is None:
                    names.append(f"{uuid.uuid4().hex}.warc{'.gz' if compress else ''}")
                    out, size = fs.open_output_stream(f"{at}/{names[-1]}", compression=None), 0  # members are compressed one by one
                out.write(raw)
                size += len(raw)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    names = [r["name"] for r in told.mapInArrow(run, "name string").collect()]
    with fs.open_output_stream(f"{at}/MANIFEST.json") as f:
        f.write(json.dumps(sorted(names)).encode())


def pages_of(stored: DataFrame, key: str = "page_id") -> DataFrame:
    """A row for each HTTP record that `write_warc` made: key, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits).

    Length and digest of a response are computed from the payload as it was read, and must fit what the header says; a revisit has those of its header, which are of the full payload. Gaps are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        number = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?[0-9]+)>", name or "")) else None
        for batch in batches:
            rows = []
            for f, b in zip(batch["fields"], batch["block"]):
                fields, block = dict(f.as_py()), b.as_py()
                head, _, payload = block.partition(b"\r\n\r\n")
                kind, told = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha256:")
                length = int(re.search(rb"(?im)^content-length: *([0-9]+)", head)[1])
                digest = told if kind == "revisit" else hashlib.sha256(payload).hexdigest()
                if digest != told or (kind != "revisit" and length != len(payload)):
                    raise ValueError(f"payload of {fields['warc-record-id']} does not fit its header")
                url = fields.get("warc-target-uri")
                rows.append((number(fields["warc-record-id"]), None if url is None else _unfield(url), length, digest, kind, number(fields.get("warc-refers-to")), None if kind == "revisit" else payload))
            cols = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    http = stored.filter("reason IS NULL AND fields['warc-type'] IN ('response', 'revisit')").select("fields", "block")
    return http.mapInArrow(run, "key long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary").withColumnRenamed("key", key)


def with_payloads(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """`pages_of` rows with the payload of revisits filled from the response that they refer to; null where that was lost."""
    told = pages.filter("record_type = 'response'").select(F.col(key).alias("_of"), F.col("payload").alias("_payload")).dropDuplicates(["_of"])
    return pages.join(told, F.col("refers_to") == F.col("_of"), "left").withColumn("payload", F.coalesce("payload", "_payload")).drop("_of", "_payload")


def archived(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", folder: str | None = None) -> DataFrame:
    """The rows of `df` written as WARC records under `folder` (a new one in the shared folder if None) when this is called, and read back: key, payload_bytes, payload_digest, record_type, refers_to.

    Null and empty payloads are empty responses, very long ones one record each; repeated rows stay. An empty table gives an empty result, other columns are not read.
    """
    spark = df.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(df, folder, key, url, payload)
    return pages_of(read_warc(spark, folder), key).drop("url", "payload")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back from the archives."""
    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages), d AS (SELECT page_id, octet_length(raw) AS n, sha256(raw) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM f"""
