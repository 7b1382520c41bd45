"""Raster files against the arrays that they were made of."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from tidemark.sources import rasters


@pytest.mark.parametrize("tile, compression, predictor", [(16, rasters.DEFLATE, 1), (32, rasters.DEFLATE, 3), (None, rasters.NO_COMPRESSION, 1), (None, rasters.DEFLATE, 3)])
def test_samples_and_cells(spark, tmp_path, tile, compression, predictor):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(50, 71))
    v[3, 4], v[10, 11] = np.nan, -9999.0
    path = str(tmp_path / "a.tif")
    rasters.write_raster(path, v, (-20.0, 30.0), (0.5, 0.25), -9999.0, tile, compression, predictor)
    cells = {(r["row"], r["col"]): r["value"] for r in rasters.read_raster(spark, path, tiles=2).collect()}
    assert len(cells) == v.size and all(cells[i, j] == (None if (i, j) in ((3, 4), (10, 11)) else v[i, j]) for i in range(50) for j in range(71))
    points = [(i, float(rng.uniform(-22, 17)), float(rng.uniform(16, 31)), "clash") for i in range(500)] + [(500, -20.1, 30.1, ""), (501, None, 20.0, ""), (502, -17.9, 29.2, ""), (503, 1e30, 20.0, "")] + [(600 + i, -19.9, 29.9, "") for i in range(50)]
    df = spark.createDataFrame(points, "id long, longitude double, latitude double, _x string").repartition(3)
    got = {r["id"]: r["sampled_m"] for r in rasters.sample_file(df, path).collect()}
    assert len(got) == len(points)
    for i, lon, lat, _ in points:
        col, row = (None, None) if lon is None else (int((lon + 20) / 0.5), int((30 - lat) / 0.25))
        inside = lon is not None and 0 <= row < 50 and 0 <= col < 71
        want = v[row, col] if inside and (row, col) not in ((3, 4), (10, 11)) else None
        assert got[i] == want


def packed(data: bytes) -> bytes:
    """LZW without growing codes: the table is cleared before it would need 10 bits."""
    bits, n, out = 0, 0, bytearray()
    for k, b in enumerate(data):
        for code in ([256] if k % 200 == 0 else []) + [b]:
            bits, n = (bits << 9) | code, n + 9
    bits, n = (bits << 9) | 257, n + 9
    bits <<= -n % 8
    return bits.to_bytes(-(-n // 8), "big")


def grown(data: bytes) -> bytes:
    """LZW with codes that grow to 12 bits."""
    table, width, n, bits, now = {bytes([i]): i for i in range(256)}, 9, 0, 0, b""
    size = 258

    def put(code):
        nonlocal bits, n
        bits, n = (bits << width) | code, n + width

    put(256)
    for b in data:
        if now + bytes([b]) in table:
            now += bytes([b])
            continue
        put(table[now])
        table[now + bytes([b])] = size
        size += 1
        if size == (1 << width) and width < 12:
            width += 1
        elif size >= 4094:
            put(256)
            table, width, size = {bytes([i]): i for i in range(256)}, 9, 258
        now = bytes([b])
    put(table[now])
    size += 1
    if size == (1 << width) and width < 12:
        width += 1
    put(257)
    bits <<= -n % 8
    return bits.to_bytes(-(-n // 8), "big")


def test_lzw():
    rng = np.random.default_rng(3)
    for data in (b"abcabcabc" * 30, rng.integers(0, 256, 3000, dtype=np.uint8).tobytes(), bytes(20_000), rng.integers(0, 4, 30_000, dtype=np.uint8).tobytes()):
        assert rasters.unpacked(packed(data)) == data
        assert rasters.unpacked(grown(data)) == data


def test_other_files_are_errors(tmp_path):
    (tmp_path / "x.tif").write_bytes(b"no raster at all")
    with pytest.raises(ValueError):
        rasters.opened(str(tmp_path / "x.tif"))
    head = struct.pack("<2sHIH", b"II", 42, 8, 1) + struct.pack("<HHIHH", rasters.COMPRESSION, 3, 1, 7, 0) + b"\0" * 4
    (tmp_path / "y.tif").write_bytes(head)
    with pytest.raises(ValueError):
        rasters.opened(str(tmp_path / "y.tif"))
