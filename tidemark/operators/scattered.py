"""Fields given at scattered places: linear interpolation on their Delaunay triangulation, the nearest place's value beyond its hull.

Longitude and latitude are taken as plane coordinates. Places are dealt to tiles with a halo of half a tile, and each tile is triangulated by itself. A triangle
whose circumcircle lies within the tile and its halo has no place of the whole field inside that circle, so it belongs to the triangulation of all places. Points in no such triangle
go on to tiles twice as large, together with the places that still have an open triangle; the places of larger triangles are always among these. The few that are left at the end are triangulated together.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.placing import kept

#: Places of a tile, about; places that are triangulated at the end together; tiles whose list is broadcast for the search of nearest places.
TILE_PLACES, LAST_PLACES, MOST_TILES = 1_000, 4_000, 1_000_000
#: Places are shifted by up to so many degrees, by a hash of their coordinates, before they are triangulated, so that no four lie on a circle and all tiles agree on grids.
SHIFT = 1e-6
#: How far beyond a triangle's edge, in barycentric weights, a point still counts as inside.
SLACK = 1e-6
#: Pairs of points and triangles that are held at once, and points that one task looks up in a tile at most, about; a tile with more is triangulated by several.
BLOCK, LOT = 1 << 20, 200_000


def shifted(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places moved by less than SHIFT, by their coordinates alone."""
    bits = x.astype(np.float64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (y.astype(np.float64).view(np.uint64) + np.uint64(0x7F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    bits ^= bits >> np.uint64(31)
    bits *= np.uint64(0x94D049BB133111EB)
    bits ^= bits >> np.uint64(29)
    low, high = (bits & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2**32, (bits >> np.uint64(32)).astype(np.float64) / 2**32
    return x + SHIFT * (low - 0.5), y + SHIFT * (high - 0.5)


def triangulated(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(triangles, hull): the Delaunay triangles of places in general position, counter-clockwise, and whether a place is on the hull.

    Places are added one by one; the triangles whose circumcircle holds the new one give way to those between it and their outline. Beyond each hull edge stands a triangle with a place at
    infinity, whose circle is the half plane beyond the edge. A row of `test` gives, for a triangle, the numbers whose product with (x, y, x^2 + y^2, 1) is positive inside its circle.
    """
    n = len(x)
    first = _first_triangle(x, y)
    if first is None:
        return np.empty((0, 3), dtype=np.int64), np.ones(n, dtype=bool)
    px, py = (x - x.mean()).tolist(), (y - y.mean()).tolist()
    test = np.zeros((4 * n + 16, 4))
    test[:, 3] = -1.0
    corner: list[tuple[int, int, int] | None] = [None] * len(test)
    free = list(range(len(test) - 1, -1, -1))

    def put(i: int, j: int, k: int) -> None:
        if i == n or j == n:
            i, j, k = (j, k, i) if i == n else (k, i, j)
        at = free.pop()
        corner[at] = (i, j, k)
        ux, uy = px[j] - px[i], py[j] - py[i]
        if k == n:
            test[at] = -uy, ux, 0.0, uy * px[i] - ux * py[i]
            return
        w = px[i] * px[i] + py[i] * py[i]
        vx, vy = px[k] - px[i], py[k] - py[i]
        uw, vw = px[j] * px[j] + py[j] * py[j] - w, px[k] * px[k] + py[k] * py[k] - w
        a, b, c = uy * vw - uw * vy, uw * vx - ux * vw, ux * vy - uy * vx
        test[at] = -a, -b, -c, a * px[i] + b * py[i] + c * w

    i, j, k = first
    put(i, j, k)
    for a, b in ((j, i), (k, j), (i, k)):
        put(a, b, n)
    for p in range(n):
        if p in first:
            continue
        hit = np.flatnonzero(test @ (px[p], py[p], px[p] * px[p] + py[p] * py[p], 1.0) > 0).tolist()
        edges = set()
        for at in hit:
            a, b, c = corner[at]
            for edge in ((a, b), (b, c), (c, a)):
                if edge[::-1] in edges:
                    edges.remove(edge[::-1])
                else:
                    edges.add(edge)
            corner[at] = None
            test[at] = 0.0, 0.0, 0.0, -1.0
            free.append(at)
        for a, b in edges:
            put(a, b, p)
    hull = np.zeros(n + 1, dtype=bool)
    for t in corner:
        if t is not None and t[2] == n:
            hull[[t[0], t[1]]] = True
    return np.array([t for t in corner if t is not None and t[2] != n], dtype=np.int64).reshape(-1, 3), hull[:n]


def _first_triangle(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int] | None:
    """Three places that are not in a line, counter-clockwise: the first, the farthest from it and the farthest from the line between them."""
    if len(x) < 3:
        return None
    j = int(((x - x[0]) ** 2 + (y - y[0]) ** 2).argmax())
    side = (x[j] - x[0]) * (y - y[0]) - (y[j] - y[0]) * (x - x[0])
    k = int(np.abs(side).argmax())
    if abs(side[k]) <= 1e-12:
        return None
    return (0, j, k) if side[k] > 0 else (0, k, j)


def circles(x: np.ndarray, y: np.ndarray, triangles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centers (x, y) and radii of the triangles' circumcircles."""
    a, b, c = triangles.T
    bx, by, cx, cy = x[b] - x[a], y[b] - y[a], x[c] - x[a], y[c] - y[a]
    d = 2 * (bx * cy - by * cx)
    with np.errstate(divide="ignore", invalid="ignore"):
        ux = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d
        uy = (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
    return x[a] + ux, y[a] + uy, np.hypot(ux, uy)


def _listed(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value): the whole numbers from first to last of each row, in order."""
    n = last - first + 1
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]


def located(qx: np.ndarray, qy: np.ndarray, x: np.ndarray, y: np.ndarray, m: np.ndarray, triangles: np.ndarray) -> np.ndarray:
    """The interpolated value at each query point, from the triangle that holds it; nan where none does.

    Triangles are listed in the cells of a grid that they reach into, about two for each cell, and a point meets those of its own cell only.
    """
    out = np.full(len(qx), np.nan)
    a, b, c = triangles.T
    bx, by, cx, cy = x[b] - x[a], y[b] - y[a], x[c] - x[a], y[c] - y[a]
    area = bx * cy - by * cx
    some = np.abs(area) >= 1e-9
    a, b, c, bx, by, cx, cy, area = (v[some] for v in (a, b, c, bx, by, cx, cy, area))
    if not len(a) or not len(qx):
        return out
    ends = []
    for v in (x, y):
        low, high = np.minimum(np.minimum(v[a], v[b]), v[c]), np.maximum(np.maximum(v[a], v[b]), v[c])
        reach = 4 * SLACK * (high - low) + 1e-12
        ends.append((low - reach, high + reach))
    side = max(1, int(np.sqrt(len(a) / 2)))
    cells = []
    for low, high in ends:
        start, step = low.min(), max((high.max() - low.min()) / side, 1e-12)
        cells.append(lambda v, start=start, step=step: np.clip(np.floor((v - start) / step), 0, side - 1).astype(np.int64))
    row, column = _listed(cells[0](ends[0][0]), cells[0](ends[0][1]))
    at, line = _listed(cells[1](ends[1][0])[row], cells[1](ends[1][1])[row])
    cell, triangle = column[at] * side + line, row[at]
    order = np.argsort(cell, kind="stable")  # of equally good triangles the first still counts
    triangle = triangle[order]
    start = np.searchsorted(cell[order], np.arange(side * side + 1))
    own = cells[0](qx) * side + cells[1](qy)
    n = (start[1:] - start[:-1])[own]
    asked = np.flatnonzero(n)
    upto = np.cumsum(n[asked])
    at = 0
    while at < len(asked):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK, side="right")))
        q = asked[at:to]
        point, k = _listed(start[own[q]], start[own[q] + 1] - 1)
        t = triangle[k]
        dx, dy = qx[q[point]] - x[a[t]], qy[q[point]] - y[a[t]]
        v, w = (dx * cy[t] - dy * cx[t]) / area[t], (dy * bx[t] - dx * by[t]) / area[t]
        least = np.minimum(np.minimum(v, w), 1 - v - w)
        heads = np.cumsum(n[q]) - n[q]
        most = np.maximum.reduceat(least, heads)
        tied = np.flatnonzero(least == most[point])
        best = tied[np.searchsorted(tied, heads)]
        v, w, t = v[best], w[best], t[best]
        value = (1 - v - w) * m[a[t]] + v * m[b[t]] + w * m[c[t]]
        out[q] = np.where(most >= -SLACK, value, np.nan)
        at = to
    return out


def _around(axis: Column, start: float, step: float) -> Column:
    """The numbers of the tiles along one axis that hold a coordinate, halo included."""
    u = (axis - start) / step
    return F.sequence(F.ceil(u - 1.5).cast("long"), F.floor(u + 0.5).cast("long"))


def _dealt(df: DataFrame, lat0: float, lon0: float, step: float) -> DataFrame:
    return df.withColumn("a", F.explode(_around(F.col("lat"), lat0, step))).withColumn("o", F.explode(_around(F.col("lon"), lon0, step)))


def _tile(lat0: float, lon0: float, step: float):
    """What a tile tells: a row (q, m) for each point that a triangle within its halo holds, and a row (lat, lon, m, no q) for each of its own places that has an open triangle."""

    def run(key, places: pa.Table, points: pa.Table) -> pa.Table:
        a, o, lot = (k.as_py() for k in key)
        x, y, m = (places[c].to_numpy() for c in ("lon", "lat", "m"))
        sx, sy = shifted(x, y)
        triangles, hull = triangulated(sx, sy)
        cx, cy, r = circles(sx, sy, triangles)
        south, west = lat0 + (a - 0.5) * step, lon0 + (o - 0.5) * step
        with np.errstate(invalid="ignore"):
            closed = (cx - r > west + SHIFT) & (cx + r < west + 2 * step - SHIFT) & (cy - r > south + SHIFT) & (cy + r < south + 2 * step - SHIFT)
        value = located(points["lon"].to_numpy(), points["lat"].to_numpy(), x, y, m, triangles[closed])
        found = ~np.isnan(value)
        open_ = hull.copy()
        open_[triangles[~closed].reshape(-1)] = True
        own = open_ & (np.floor((y - lat0) / step) == a) & (np.floor((x - lon0) / step) == o) & (lot == 0)
        n, k = int(found.sum()), int(own.sum())
        nothing = lambda size: np.full(size, np.nan)
        columns = [np.concatenate(c) for c in ((nothing(n), y[own]), (nothing(n), x[own]), (value[found], m[own]))]
        q = pa.array(np.concatenate([points["q"].to_numpy()[found], np.zeros(k, dtype=np.int64)]), mask=np.arange(n + k) >= n)
        return pa.Table.from_arrays([q, *map(pa.array, columns)], names=["q", "lat", "lon", "m"])

    return run


def _tile_step(field: DataFrame, lat0: float, lon0: float, height: float, width: float, n: int) -> float:
    """A tile size at which no tile has more than about four times TILE_PLACES places; one row of the largest count comes to the driver for each halving."""
    step = max(np.sqrt(max(height, 1e-6) * max(width, 1e-6) * TILE_PLACES / n), max(height, width, 1e-6) / 2**20)
    while True:
        most = field.groupBy(F.floor((F.col("lat") - lat0) / step), F.floor((F.col("lon") - lon0) / step)).count().agg(F.max("count")).first()[0]
        if most <= 4 * TILE_PLACES:
            return float(step)
        step /= 2


def _met(points: DataFrame, other: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by a shuffle of both sides: points that were exploded from few rows look small to the planner, which would send all of them to the driver to broadcast them."""
    return points.hint("merge").join(other.hint("merge"), on, how)


def interpolated(points: DataFrame, field: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """`points` with `m`: the value of `field` (lat, lon, m; places are unique) on its triangulation, beyond its hull that of the nearest place, of equally near ones the first by latitude and longitude.

    Points with a null coordinate get a null m, as do all where the field is empty; other columns stay, repeated points too. Where fewer than three places or only places in a line are given, all take the nearest.
    """
    spark = points.sparkSession
    field = kept(field.select(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.col("m").cast("double").alias("m")).dropna())
    lat0, lat1, lon0, lon1, n = field.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon"), F.count("*")).first()
    if not n:
        return points.withColumn("m", F.lit(None).cast("double"))
    asked = kept(points.select(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).dropna().distinct().withColumn("q", F.monotonically_increasing_id()))
    step = first_step = _tile_step(field, lat0, lon0, lat1 - lat0, lon1 - lon0, n)
    left, open_, found = asked, field, []
    while (count := open_.count()) > LAST_PLACES and step < 2 * max(lat1 - lat0, lon1 - lon0):
        points_ = _dealt(left, lat0, lon0, step)
        lots = kept(points_.groupBy("a", "o").agg(F.ceil(F.count("*") / LOT).alias("lots")))
        places = _dealt(open_, lat0, lon0, step).join(lots, ["a", "o"], "left").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("lots", F.lit(1).cast("long")) - 1)))
        points_ = _met(points_, lots, ["a", "o"]).withColumn("lot", F.pmod(F.xxhash64("q"), F.col("lots")))
        met = places.groupBy("a", "o", "lot").cogroup(points_.groupBy("a", "o", "lot"))
        told = kept(met.applyInArrow(_tile(lat0, lon0, step), "q long, lat double, lon double, m double"))
        found.append(told.filter("q IS NOT NULL").groupBy("q").agg(F.min("m").alias("m")))
        left = kept(_met(left, found[-1].select("q"), "q", "left_anti"))
        open_ = told.filter("q IS NULL").select("lat", "lon", "m")
        step *= 2
    if count > 8 * LAST_PLACES:
        raise ValueError(f"{count} places have open triangles at the scale of the whole field; they are too many to be triangulated together")
    found.append(_located_last(left, open_))
    outside = _met(left, found[-1].select("q"), "q", "left_anti")
    found.append(nearest(outside, field, lat0, lon0, first_step))
    values = found[0]
    for more in found[1:]:
        values = values.unionByName(more)
    placed = _met(asked, values, "q").select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "m")
    return _met(points, placed, (F.col(lat).cast("double") == F.col("_lat")) & (F.col(lon).cast("double") == F.col("_lon")), "left").drop("_lat", "_lon")


def _located_last(left: DataFrame, open_: DataFrame) -> DataFrame:
    """(q, m) of the points that lie in a triangle of the open places, whose number is checked; they are triangulated once and broadcast."""
    pdf = open_.toPandas()
    x, y, m = pdf["lon"].to_numpy(), pdf["lat"].to_numpy(), pdf["m"].to_numpy()
    held = left.sparkSession.sparkContext.broadcast((x, y, m, triangulated(*shifted(x, y))[0]))

    def run(batches):
        x, y, m, triangles = held.value
        for pdf in batches:
            value = located(pdf["lon"].to_numpy(), pdf["lat"].to_numpy(), x, y, m, triangles)
            yield pd.DataFrame({"q": pdf["q"], "m": value})[~np.isnan(value)]

    return kept(left.mapInPandas(run, "q long, m double"))


def nearest(points: DataFrame, field: DataFrame, lat0: float, lon0: float, step: float) -> DataFrame:
    """(q, m) of the nearest place of each point (q, lat, lon).

    A place of each tile of the field is broadcast; the nearest of these bounds a point's distance, and the point then meets the places of the tiles that reach into that distance.
    """
    cell = lambda axis, start: F.floor((F.col(axis) - start) / step)
    tiled = field.withColumns({"a": cell("lat", lat0), "o": cell("lon", lon0)})
    tiles = tiled.groupBy("a", "o").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.min_by("lat", F.struct("lat", "lon")).alias("lat"), F.min_by("lon", F.struct("lat", "lon")).alias("lon")).toPandas()
    if len(tiles) > MOST_TILES:
        raise ValueError("too many tiles to broadcast; give larger ones")
    held = points.sparkSession.sparkContext.broadcast(tiles)

    def run(batches):
        t = held.value
        corners = {c: t[c].to_numpy() for c in ("south", "north", "west", "east", "lat", "lon")}
        for pdf in batches:
            rows: list[pd.DataFrame] = []
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64]
                y, x = part["lat"].to_numpy()[:, None], part["lon"].to_numpy()[:, None]
                bound = ((x - corners["lon"]) ** 2 + (y - corners["lat"]) ** 2).min(axis=1)
                gap = np.maximum(0, np.maximum(corners["west"] - x, x - corners["east"])) ** 2 + np.maximum(0, np.maximum(corners["south"] - y, y - corners["north"])) ** 2
                i, j = np.nonzero(gap <= bound[:, None] * (1 + 1e-12))
                rows.append(pd.DataFrame({"q": part["q"].to_numpy()[i], "qlat": part["lat"].to_numpy()[i], "qlon": part["lon"].to_numpy()[i], "a": t["a"].to_numpy()[j], "o": t["o"].to_numpy()[j]}))
            yield pd.concat(rows) if rows else pd.DataFrame({"q": [], "qlat": [], "qlon": [], "a": [], "o": []})

    met = _met(points.mapInPandas(run, "q long, qlat double, qlon double, a long, o long"), tiled, ["a", "o"])
    gap = (F.col("qlat") - F.col("lat")) * (F.col("qlat") - F.col("lat")) + (F.col("qlon") - F.col("lon")) * (F.col("qlon") - F.col("lon"))
    return met.groupBy("q").agg(F.min_by("m", F.struct(gap, "lat", "lon")).alias("m"))


def along_paths(axes: DataFrame, field: DataFrame, keys: Sequence[str], threshold: float, step: float = 2.0) -> DataFrame:
    """`fields.path_metrics` of the great circles of `axes` through a scattered field."""
    from tidemark.operators.fields import path_metrics, sweep

    return path_metrics(interpolated(sweep(axes, step), field), keys, threshold, step)
