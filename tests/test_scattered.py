"""Interpolation on scattered places against a triangulation by brute force."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pytest

from tidemark.operators import fields, scattered


def brute(qx, qy, x, y, m):
    """The value from the triangle with no place in its circumcircle that holds the point, else that of the nearest place."""
    sx, sy = scattered.shifted(x, y)
    triangles = np.array(list(combinations(range(len(x)), 3)))
    cx, cy, r = scattered.circles(sx, sy, triangles)
    with np.errstate(invalid="ignore"):
        inside = (np.hypot(sx - cx[:, None], sy - cy[:, None]) < r[:, None] * (1 - 1e-12)) & ~(np.arange(len(x)) == triangles[:, :, None]).any(axis=1)
    triangles = triangles[np.isfinite(r) & ~inside.any(axis=1)]
    out = []
    for px, py in zip(qx, qy):
        best = (-1.0, None)
        for a, b, c in triangles:
            area = (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])
            if abs(area) < 1e-9:
                continue
            v = ((px - x[a]) * (y[c] - y[a]) - (py - y[a]) * (x[c] - x[a])) / area
            w = ((py - y[a]) * (x[b] - x[a]) - (px - x[a]) * (y[b] - y[a])) / area
            best = max(best, (min(v, w, 1 - v - w), (1 - v - w) * m[a] + v * m[b] + w * m[c]), key=lambda t: t[0])
        near = min(range(len(x)), key=lambda i: ((x[i] - px) ** 2 + (y[i] - py) ** 2, y[i], x[i]))
        out.append(best[1] if best[0] >= -scattered.SLACK else m[near])
    return out


def frames(spark, x, y, m, qx, qy):
    field = spark.createDataFrame([(float(b), float(a), float(c)) for a, b, c in zip(x, y, m)], "lat double, lon double, m double")
    points = spark.createDataFrame([(i, float(b), float(a), "clash") for i, (a, b) in enumerate(zip(qx, qy))], "id long, lat double, lon double, q string")
    return points.repartition(3), field.repartition(3)


def values(df):
    return [r["m"] for r in sorted(df.collect(), key=lambda r: r["id"])]


@pytest.mark.parametrize("kind", ["random", "grid", "clustered"])
@pytest.mark.parametrize("tile, last", [(1_000, 4_000), (6, 4)])
def test_values_against_brute_force(spark, monkeypatch, kind, tile, last):
    """With small tiles most points lie near seams, and large triangles are found on later levels only."""
    monkeypatch.setattr(scattered, "TILE_PLACES", tile)
    monkeypatch.setattr(scattered, "LAST_PLACES", last)
    rng = np.random.default_rng(len(kind))
    if kind == "grid":
        x, y = (g.reshape(-1).astype(float) for g in np.meshgrid(np.arange(-20, 21, 8), np.arange(-20, 21, 8)))
    elif kind == "random":
        x, y = rng.uniform(-30, 30, 45), rng.uniform(-20, 20, 45)
    else:
        x, y = np.concatenate([rng.normal(-20, 1, 25), rng.normal(25, 6, 20)]), np.concatenate([rng.normal(0, 1, 25), rng.normal(5, 9, 20)])
    m = np.sin(x) + y
    qx = np.concatenate([rng.uniform(-45, 45, 150), x[:10], [x[0], x[1]]])
    qy = np.concatenate([rng.uniform(-35, 35, 150), y[:10], [y[0] + 1e-9, (y[0] + y[1]) / 2]])
    got = values(scattered.interpolated(*frames(spark, x, y, m, qx, qy)))
    assert np.allclose(got, brute(qx, qy, x, y, m), atol=1e-5)


def test_tiles_agree_with_one_triangulation(spark, monkeypatch):
    """Many places in many tiles give what all of them together give, and a plane comes back as it is."""
    rng = np.random.default_rng(3)
    x, y = rng.uniform(-180, 180, 3000), rng.uniform(-85, 85, 3000)
    x[:1500] = rng.normal(10, 2, 1500)
    m = 3 * x - 2 * y + 1
    qx, qy = rng.uniform(-179, 179, 4000), rng.uniform(-84, 84, 4000)
    whole = scattered.located(qx, qy, x, y, np.cos(m), scattered.triangulated(*scattered.shifted(x, y))[0])
    monkeypatch.setattr(scattered, "TILE_PLACES", 60)
    monkeypatch.setattr(scattered, "LAST_PLACES", 100)
    monkeypatch.setattr(scattered, "LOT", 50)
    points, field = frames(spark, x, y, np.cos(m), qx, qy)
    got = np.array(values(scattered.interpolated(points, field)))
    held = ~np.isnan(whole)
    assert held.mean() > 0.9 and np.allclose(got[held], whole[held], atol=1e-5)
    points, field = frames(spark, x, y, m, qx, qy)
    assert np.allclose(np.array(values(scattered.interpolated(points, field)))[held], (3 * qx - 2 * qy + 1)[held], atol=1e-3)


def test_triangles_have_empty_circles():
    rng = np.random.default_rng(9)
    for x, y in ((rng.normal(size=200), rng.normal(size=200)), tuple(g.reshape(-1).astype(float) for g in np.meshgrid(np.arange(12), np.arange(12)))):
        x, y = scattered.shifted(x, y)
        triangles, hull = scattered.triangulated(x, y)
        assert len(triangles) == 2 * len(x) - 2 - hull.sum()  # Euler
        cx, cy, r = scattered.circles(x, y, triangles)
        gap = np.hypot(x - cx[:, None], y - cy[:, None]) - r[:, None]
        assert (gap > -1e-7 * np.maximum(1, r[:, None])).all()


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "lat double, lon double, m double")
    points = spark.createDataFrame([(0, 1.0, 1.0), (1, None, 1.0), (2, 1.0, 1.0), (3, 5.0, math.nan)], "id long, lat double, lon double")
    assert values(scattered.interpolated(points, empty)) == [None] * 4
    line = spark.createDataFrame([(float(i), 0.0, float(i)) for i in range(5)], "lat double, lon double, m double")
    assert values(scattered.interpolated(points, line))[:3] == [1.0, None, 1.0]
    assert values(scattered.interpolated(points, line.limit(1)))[0] == 0.0
    assert scattered.interpolated(points.limit(0), line).count() == 0


def test_bilinear_keeps_repeated_points(spark):
    grid = spark.createDataFrame([(float(a), float(o), float(a * 10 + o)) for a in range(3) for o in range(3)], "lat double, lon double, m double")
    points = spark.createDataFrame([(1, 0.5, 0.5)] * 3 + [(2, 1.25, 0.0), (3, None, 1.0), (4, 9.0, 9.0)], "id long, lat double, lon double")
    got = sorted((r["id"], r["m"]) for r in fields.bilinear(points, grid, 1.0).collect() if r["m"] is not None)
    assert got == [(1, 5.5)] * 3 + [(2, 12.5)] and fields.bilinear(points, grid, 1.0).count() == 6
