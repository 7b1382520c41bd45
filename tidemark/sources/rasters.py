"""Raster files: GeoTIFF tiles as rows, and points sampled from the tiles that they lie in."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Tags of a TIFF directory, and the sizes and codes of their types.
WIDTH, LENGTH, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, NODATA = 33550, 33922, 42113
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
NO_COMPRESSION, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
#: Tiles of a read partition, and decoded tiles that a task keeps.
TILES_AT_ONCE, KEPT_TILES = 64, 16


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def unpacked(data: bytes) -> bytes:
    """LZW as TIFF has it: codes of 9 to 12 bits, the most significant bit first; 256 clears the table, 257 ends."""
    bits, held, at, width = 0, 0, 0, 9
    table, before, out = [bytes([i]) for i in range(256)] + [b"", b""], b"", []
    while True:
        while held < width and at < len(data):
            bits, held, at = (bits << 8) | data[at], held + 8, at + 1
        if held < width:
            return b"".join(out)
        code = (bits >> (held - width)) & ((1 << width) - 1)
        held -= width
        bits &= (1 << held) - 1
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, width, before = table[:258], 9, b""
            continue
        entry = table[code] if code < len(table) else before + before[:1]
        out.append(entry)
        if before:
            table.append(before + entry[:1])
        before = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1


@dataclass
class Raster:
    """The first directory of a TIFF: its shape, its tiles (or strips) and how longitudes and latitudes become columns and rows."""

    path: str
    height: int
    width: int
    tile_height: int
    tile_width: int
    offsets: np.ndarray
    counts: np.ndarray
    kind: np.dtype
    samples: int
    compression: int
    predictor: int
    origin: tuple[float, float] | None
    size: tuple[float, float] | None
    nodata: float | None
    order: str = field(default="<")

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_width)

    def tile(self, index: int) -> np.ndarray:
        """The values of one tile, edge tiles at full size; a tile without bytes holds zeros."""
        shape = (self.tile_height, self.tile_width, self.samples)
        if not self.counts[index]:
            return np.zeros(shape[:2])
        fs, at = file_system(self.path)
        with fs.open_input_file(at) as f:
            f.seek(int(self.offsets[index]))
            raw = f.read(int(self.counts[index]))
        if self.compression in (DEFLATE, OLD_DEFLATE):
            raw = zlib.decompress(raw)
        elif self.compression == LZW:
            raw = unpacked(raw)
        row = self.tile_width * self.samples * self.kind.itemsize
        rows = len(raw) // row  # the last strip is shorter
        if self.predictor == 3:
            shuffled = np.frombuffer(raw[: rows * row], dtype=np.uint8).reshape(rows, row // self.samples, self.samples)
            planes = np.cumsum(shuffled, axis=1, dtype=np.uint8).reshape(rows, self.kind.itemsize, -1)
            values = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(self.kind.newbyteorder(">")).reshape(rows, *shape[1:])
        else:
            values = np.frombuffer(raw[: rows * row], dtype=self.kind).reshape(rows, *shape[1:])
            if self.predictor == 2:
                values = np.cumsum(values, axis=1, dtype=values.dtype.newbyteorder("="))
        out = np.zeros(shape[:2])
        out[:rows] = values[..., 0]
        return out


@lru_cache(maxsize=8)
def opened(path: str) -> Raster:
    """The directory of a TIFF or BigTIFF file: only its header and tag values are read."""
    fs, at = file_system(path)
    with fs.open_input_file(at) as f:

        def read(offset: int, n: int) -> bytes:
            f.seek(offset)
            return f.read(n)

        head = read(0, 16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if order is None or struct.unpack(order + "H", head[2:4])[0] not in (42, 43):
            raise ValueError(f"{path} is no TIFF file")
        big = struct.unpack(order + "H", head[2:4])[0] == 43
        start = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
        count, entry, word = (8, 20, "Q") if big else (2, 12, "I")
        n = struct.unpack(order + ("Q" if big else "H"), read(start, count))[0]
        body, tags = read(start + count, n * entry), {}
        for k in range(n):
            tag, code, many = struct.unpack_from(order + "HH" + word, body, k * entry)
            if code not in TYPES:
                continue
            form = f"{order}{many}{TYPES[code]}"
            room, size = 8 if big else 4, struct.calcsize(form)
            inline = body[(k + 1) * entry - room : (k + 1) * entry]
            raw = inline[:size] if size <= room else read(struct.unpack(order + word, inline)[0], size)
            tags[tag] = b"".join(struct.unpack(form, raw)) if code == 2 else struct.unpack(form, raw)
    one = lambda tag, default: tags[tag][0] if tag in tags else default
    if one(COMPRESSION, 1) not in (NO_COMPRESSION, LZW, DEFLATE, OLD_DEFLATE) or one(PREDICTOR, 1) not in (1, 2, 3) or one(PLANAR, 1) != 1:
        raise ValueError(f"{path}: compression {one(COMPRESSION, 1)}, predictor {one(PREDICTOR, 1)} or planes are not supported")
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[one(SAMPLE_FORMAT, 1)]}{one(BITS, 8) // 8}")
    height, width = one(LENGTH, 0), one(WIDTH, 0)
    tiled = TILE_OFFSETS in tags
    nodata = None
    if NODATA in tags:
        try:
            nodata = float(tags[NODATA].split(b"\0")[0])
        except ValueError:
            pass
    scale, tie = tags.get(PIXEL_SCALE), tags.get(TIEPOINT)
    return Raster(
        path, height, width, one(TILE_LENGTH, height) if tiled else min(height, one(ROWS_PER_STRIP, height)), one(TILE_WIDTH, width) if tiled else width, np.array(tags[TILE_OFFSETS if tiled else STRIP_OFFSETS]), np.array(tags[TILE_COUNTS if tiled else STRIP_COUNTS]),
        kind, one(SAMPLES, 1), one(COMPRESSION, 1), one(PREDICTOR, 1), (tie[3], tie[4]) if tie else None, (scale[0], scale[1]) if scale else None, nodata, order,
    )


def write_raster(path: str, values: np.ndarray, origin: tuple[float, float], size: tuple[float, float], nodata: float | None = None, tile: int | None = 64, compression: int = DEFLATE, predictor: int = 1) -> None:
    """A little-endian TIFF of one band of 64-bit floats, in tiles of `tile` x `tile` or, if None, in strips of 16 rows; deflated or not, predictor 1 or 3."""
    height, width = values.shape
    th, tw = (tile, tile) if tile else (16, width)
    blocks = []
    for r in range(0, height, th):
        for c in range(0, width, tw):
            part = values[r : r + th, c : c + tw].astype("<f8")
            block = np.zeros((th, tw) if tile else part.shape, dtype="<f8")
            block[: part.shape[0], : part.shape[1]] = part
            raw = block.tobytes()
            if predictor == 3:
                planes = block.astype(">f8").view(np.uint8).reshape(*block.shape, 8).transpose(0, 2, 1).reshape(block.shape[0], -1)
                raw = np.diff(planes, axis=1, prepend=np.zeros((len(planes), 1), dtype=np.uint8)).astype(np.uint8).tobytes()
            blocks.append(zlib.compress(raw) if compression == DEFLATE else raw)
    places = TILE_OFFSETS if tile else STRIP_OFFSETS, TILE_COUNTS if tile else STRIP_COUNTS
    tags = {WIDTH: ("I", [width]), LENGTH: ("I", [height]), BITS: ("H", [64]), COMPRESSION: ("H", [compression]), SAMPLES: ("H", [1]), PREDICTOR: ("H", [predictor]), SAMPLE_FORMAT: ("H", [3]), PIXEL_SCALE: ("d", [*size, 0.0]), TIEPOINT: ("d", [0.0, 0.0, 0.0, *origin, 0.0])}
    tags |= {TILE_WIDTH: ("H", [tw]), TILE_LENGTH: ("H", [th])} if tile else {ROWS_PER_STRIP: ("I", [th])}
    if nodata is not None:
        tags[NODATA] = ("c", [bytes([b]) for b in f"{nodata}\0".encode()])
    at, offsets = 8, []
    for b in blocks:
        offsets.append(at)
        at += len(b)
    tags |= {places[0]: ("I", offsets), places[1]: ("I", [len(b) for b in blocks])}
    codes = {v: k for k, v in reversed(TYPES.items()) if k not in (13, 18)}
    directory, extra, after = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag in sorted(tags):
        form, numbers = tags[tag]
        raw = struct.pack(f"<{len(numbers)}{form}", *numbers)
        directory += struct.pack("<HHI", tag, codes[form], len(numbers))
        if len(raw) <= 4:
            directory += raw.ljust(4, b"\0")
        else:
            directory += struct.pack("<I", after + len(extra))
            extra += raw
    fs, name = file_system(path)
    with fs.open_output_stream(name) as f:
        f.write(struct.pack("<2sHI", b"II", 42, at) + b"".join(blocks) + struct.pack("<H", len(tags)) + directory + b"\0" * 4 + extra)


@dataclass
class Tiles(InputPartition):
    first: int
    last: int


class RasterReader(DataSourceReader):
    """Plans ranges of tiles from the file's directory alone."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.at_once = int(options.get("tiles", TILES_AT_ONCE))

    def partitions(self) -> list[Tiles]:
        n = len(opened(self.path).offsets)
        return [Tiles(a, min(n, a + self.at_once)) for a in range(0, n, self.at_once)] or [Tiles(0, 0)]

    def read(self, part: Tiles) -> Iterator[pa.RecordBatch]:
        r = opened(self.path)
        for t in range(part.first, part.last):
            top, left = t // r.across * r.tile_height, t % r.across * r.tile_width
            v = r.tile(t)[: r.height - top, : r.width - left]
            row, col = np.indices(v.shape)
            missing = np.isnan(v) | (v == r.nodata if r.nodata is not None else False)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(v.size, t, dtype=np.int32)), pa.array((row + top).reshape(-1).astype(np.int32)), pa.array((col + left).reshape(-1).astype(np.int32)), pa.array(v.reshape(-1), mask=missing.reshape(-1))], names=["tile", "row", "col", "value"])


class RasterSource(DataSource):
    """spark.read.format("raster_cells").load(file): tile, row, col, value, a row for each cell; null where there is no data. Option: tiles (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "raster_cells"

    def schema(self) -> str:
        return "tile int, row int, col int, value double"

    def reader(self, schema: StructType) -> RasterReader:
        return RasterReader(dict(self.options))


def read_raster(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(RasterSource)
    return spark.read.format("raster_cells").options(**options).load(path)


def sample_file(points: DataFrame, path: str, lon: str = "longitude", lat: str = "latitude", out: str = "sampled_m") -> DataFrame:
    """`points` with the value of the cell that each lies in (truncated towards zero); null outside, for nodata, NaN and null coordinates.

    Points are put in ranges of tiles, a tile that many share in several, so a task decodes the tiles of its own points only, one after the other.
    """
    r = opened(path)
    if r.origin is None or r.size is None:
        raise ValueError(f"{path} tells no place and size of its pixels")
    col = ((F.col(lon) - r.origin[0]) / r.size[0]).try_cast("long")
    row = ((F.lit(r.origin[1]) - F.col(lat)) / r.size[1]).try_cast("long")
    inside = F.col("_row").between(0, r.height - 1) & F.col("_col").between(0, r.width - 1)
    keyed = points.withColumns({"_row": row, "_col": col}).withColumn("_tile", F.when(inside, (F.floor(F.col("_row") / r.tile_height) * r.across + F.floor(F.col("_col") / r.tile_width)).cast("int")))
    dealt = keyed.repartitionByRange("_tile", F.xxhash64("_row", "_col", F.rand(1))).sortWithinPartitions("_tile")
    schema, names = points.withColumn(out, F.lit(None).cast("double")).schema, points.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = lru_cache(maxsize=KEPT_TILES)(opened(path).tile)
        for batch in batches:
            tiles = batch["_tile"].to_numpy(zero_copy_only=False)
            value = np.full(batch.num_rows, np.nan)
            for t in np.unique(tiles[~np.isnan(tiles)]).astype(int) if tiles.dtype.kind == "f" else np.unique(tiles):
                at = np.flatnonzero(tiles == t)
                rows, cols = (np.asarray(batch[c].take(pa.array(at))) for c in ("_row", "_col"))
                value[at] = tile(int(t))[rows - t // r.across * r.tile_height, cols - t % r.across * r.tile_width]
            missing = np.isnan(value) | (value == r.nodata if r.nodata is not None else False)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(value, mask=missing)], names=[*names, out])

    return dealt.mapInArrow(run, schema)
