"""Fits of many replicates of a table at once: bootstrap draws and permuted values as matrix products over places.

A replicate gives each place a number of rows and the sums of its values. A task multiplies blocks of places, terms by places with places by replicates, and keeps
the products only, so the places are read once however many replicates and candidates there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.placing import kept
from tidemark.operators.fits import best, pole_grid
from tidemark.operators.statistics import quantiles

#: Places that are multiplied at once, and numbers that a task keeps for each of its sums at most.
BLOCK, MOST_KEPT = 2_048, 4_000_000
DEGREES, KMAX = 3, 8


def by_place(draws: DataFrame, z: str = "z_m", rep: str = "rep") -> DataFrame:
    """A row for each place of `draws`: latitude, longitude and `each`, an array of (rep, n, sz, szz) with an entry for each replicate that has the place.

    Rows without coordinates or value go. Rows are summed by place and replicate before places are gathered, so an array is no longer than there are replicates.
    """
    rows = draws.select(F.col(rep).cast("int").alias("rep"), "latitude", "longitude", F.col(z).cast("double").alias("z")).dropna()
    sums = rows.groupBy("latitude", "longitude", "rep").agg(F.count("*").cast("double").alias("n"), F.sum("z").alias("sz"), F.sum(F.col("z") * F.col("z")).alias("szz"))
    return kept(sums.groupBy("latitude", "longitude").agg(F.collect_list(F.struct("rep", "n", "sz", "szz")).alias("each")))


def _blocks(batches: Iterator[pa.RecordBatch], reps: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(unit vectors, longitudes in radians, n, sz, szz by place and replicate 1..reps) of blocks of places."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            lat, lon = (np.radians(part[c].to_numpy()) for c in ("latitude", "longitude"))
            unit = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])
            flat = part["each"].flatten()
            place = np.repeat(np.arange(part.num_rows), part["each"].value_lengths().to_numpy())
            rep = flat.field("rep").to_numpy() - 1
            dense = []
            for name in ("n", "sz", "szz"):
                m = np.zeros((part.num_rows, reps))
                m[place, rep] = flat.field(name).to_numpy()
                dense.append(m)
            yield unit, lon, *dense


def _summed(told: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Arrays of equal length summed by `key`: each task sends one for each key."""

    def run(table: pa.Table) -> pa.Table:
        cols = [np.sum([np.asarray(v) for v in table[n].to_pylist()], axis=0) for n in names]
        return pa.Table.from_arrays([table[key].combine_chunks()[:1], *(pa.array([c.tolist()], pa.list_(pa.float64())) for c in cols)], names=[key, *names])

    return told.groupBy(key).applyInArrow(run, f"{key} int, " + ", ".join(f"{n} array<double>" for n in names))


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).reshape(-1)))


def planes(places: DataFrame, reps: int, step: float = 4.0) -> DataFrame:
    """(rep, pole_lat, pole_lon, n, r2, slope): the plane rescan of every replicate 1..reps over the grid of poles.

    Poles are taken in parts of MOST_KEPT / reps, each part a pass over the places; a task sends three numbers for each pole and replicate.
    """
    spark = places.sparkSession
    grid = sorted((r["pole_lat"], r["pole_lon"]) for r in pole_grid(spark, step).collect())
    parts = -(-len(grid) * reps // MOST_KEPT)
    size = -(-len(grid) // parts)
    return reduce(DataFrame.unionByName, (_planes_of(places, reps, grid[at : at + size]) for at in range(0, len(grid), size)))


def _planes_of(places: DataFrame, reps: int, grid: list[tuple[float, float]]) -> DataFrame:
    lat, lon = (np.radians([g[i] for g in grid]) for i in (0, 1))
    poles = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)
    held = places.sparkSession.sparkContext.broadcast(poles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poles = held.value
        sx, sxx, sxz = (np.zeros((len(poles), reps)) for _ in range(3))
        own = np.zeros((3, reps))
        for unit, _, n, sz, szz in _blocks(batches, reps):
            d = np.degrees(np.arcsin(np.clip(poles @ unit, -1, 1)))
            sx += d @ n
            sxz += d @ sz
            sxx += (d * d) @ n
            own += [m.sum(axis=0) for m in (n, sz, szz)]
        if not own[0].any():
            return
        for at in range(0, len(poles), 512):
            k = np.arange(at, min(at + 512, len(poles)), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(k), *(_lists(m[k]) for m in (sx, sxx, sxz)), *(_lists(np.repeat(m[None], len(k), axis=0)) for m in own)], names=["pole", *NAMES])

    def scored(table: pa.Table) -> pa.Table:
        k = table["pole"][0].as_py()
        sx, sxx, sxz, n, sz, szz = (np.sum(np.asarray(table[c].combine_chunks().flatten()).reshape(table.num_rows, reps), axis=0) for c in NAMES)
        with np.errstate(invalid="ignore", divide="ignore"):
            xx, xz, zz = sxx - sx * sx / n, sxz - sx * sz / n, szz - sz * sz / n
            r2, slope = np.where(xx * zz > 0, xz * xz / (xx * zz), np.nan), np.where(xx > 0, xz / xx, np.nan)
        columns = [np.arange(1, reps + 1, dtype=np.int32), np.full(reps, grid[k][0]), np.full(reps, grid[k][1]), n.astype(np.int64), r2, slope]
        return pa.Table.from_arrays([pa.array(c, from_pandas=True) for c in columns], names=["rep", "pole_lat", "pole_lon", "n", "r2", "slope"])

    told = places.mapInArrow(run, "pole int, " + ", ".join(f"{c} array<double>" for c in NAMES))
    return told.groupBy("pole").applyInArrow(scored, "rep int, pole_lat double, pole_lon double, n long, r2 double, slope double").filter("n > 0")


NAMES = ["sx", "sxx", "sxz", "n", "sz", "szz"]


def best_planes(places: DataFrame, reps: int, step: float = 4.0) -> DataFrame:
    """For each replicate the plane of the greatest r2 (rounded to ten digits, then the first pole): an aggregate with map-side minima. Replicates without a fit are left out."""
    return best(planes(places, reps, step), by=("rep",))


def terms(unit: np.ndarray, lon: np.ndarray, kmax: int) -> np.ndarray:
    """1, the real spherical harmonics of degree 1 to 3, and cos k lon, sin k lon for k = 1..kmax: a row for each term."""
    x, y, z = unit
    rows = [
        np.ones_like(x), x, y, z, x * y, y * z, 3 * z * z - 1, x * z, x * x - y * y,
        y * (3 * x * x - y * y), x * y * z, y * (5 * z * z - 1), z * (5 * z * z - 3), x * (5 * z * z - 1), z * (x * x - y * y), x * (x * x - 3 * y * y),
    ]
    for k in range(1, kmax + 1):
        rows += [np.cos(k * lon), np.sin(k * lon)]
    return np.stack(rows)


def _fit(gram: np.ndarray, rhs: np.ndarray, total: np.ndarray, columns: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, r2) of each replicate on some columns, of least norm where they depend on each other; r2 is nan where the values don't vary."""
    a, b = gram[:, columns][:, :, columns], rhs[:, columns]
    beta = (np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ b[..., None])[..., 0]
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = rhs[:, 0] ** 2 / gram[:, 0, 0]
        spread = total - mean
        return beta, np.where(spread > 1e-12 * np.maximum(total, 1e-300), ((beta * b).sum(axis=1) - mean) / spread, np.nan)


def _harmonics(gram: np.ndarray, rhs: np.ndarray, total: np.ndarray, kmax: int) -> tuple[np.ndarray, ...]:
    """k, r2, amplitude and phase of the best longitude harmonic of each replicate, of equally good ones (to ten digits) the lowest."""
    fits = [_fit(gram, rhs, total, [0, 14 + 2 * k, 15 + 2 * k]) for k in range(1, kmax + 1)]
    r2 = np.stack([f[1] for f in fits], axis=1)
    at = np.where(np.isnan(r2), -np.inf, np.round(r2, 10)).argmax(axis=1)
    rows = np.arange(len(at))
    beta = np.stack([f[0] for f in fits], axis=1)[rows, at]
    return at + 1, r2[rows, at], np.hypot(beta[:, 1], beta[:, 2]), np.degrees(np.arctan2(-beta[:, 2], beta[:, 1]))


SPECTRA = "rep int, n long, z_mean double, spherical_r2 double, spherical_rmse double, axis_lat double, axis_lon double, l1_r2 double, l2_r2 double, l3_r2 double, l2_gain double, l3_gain double, raw_k int, raw_r2 double, raw_amplitude double, raw_phase_deg double, residual_k int, residual_r2 double"


def spectra(places: DataFrame, reps: int, kmax: int = KMAX) -> DataFrame:
    """A row for each replicate: the spherical fit and its axis, r2 and gain of the spherical degrees, the best longitude harmonic of the values and of what degree 1 leaves of them.

    All come from one matrix of sums of products for each replicate, made by one matrix product over the places; the replicates' matrices are solved stacked. Replicates without rows are left out.
    """
    size = 16 + 2 * kmax
    upper = np.triu_indices(size)
    lot = max(1, MOST_KEPT // len(upper[0]))
    if reps > lot:
        raise ValueError(f"{reps} replicates are more than {lot}; fit them in parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, rhs, own = np.zeros((reps, len(upper[0]))), np.zeros((reps, size)), np.zeros(reps)
        for unit, lon, n, sz, szz in _blocks(batches, reps):
            t = terms(unit, lon, kmax)
            gram += n.T @ (t[upper[0]] * t[upper[1]]).T
            rhs += sz.T @ t.T
            own += szz.sum(axis=0)
        some = np.flatnonzero(gram[:, 0])
        for at in range(0, len(some), 256):
            k = some[at : at + 256]
            yield pa.RecordBatch.from_arrays([pa.array((k + 1).astype(np.int32)), _lists(gram[k]), _lists(rhs[k]), _lists(own[k, None])], names=["rep", "gram", "rhs", "szz"])

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            gram = np.zeros((batch.num_rows, size, size))
            gram[:, upper[0], upper[1]] = gram[:, upper[1], upper[0]] = batch["gram"].flatten().to_numpy().reshape(batch.num_rows, -1)
            rhs, total = batch["rhs"].flatten().to_numpy().reshape(batch.num_rows, size), batch["szz"].flatten().to_numpy()
            (beta, l1), (_, l2), (_, l3) = (_fit(gram, rhs, total, list(range(d))) for d in (4, 9, 16))
            norm = np.sqrt((beta[:, 1:] ** 2).sum(axis=1))
            with np.errstate(invalid="ignore", divide="ignore"):
                lat = np.degrees(np.arcsin(np.clip(beta[:, 3] / norm, -1, 1)))
            lon = (np.degrees(np.arctan2(beta[:, 2], beta[:, 1])) + 180) % 360 - 180
            left = rhs - (gram[:, :, :4] @ beta[..., None])[..., 0]
            left_total = total - 2 * (beta * rhs[:, :4]).sum(axis=1) + np.einsum("ri,rij,rj->r", beta, gram[:, :4, :4], beta)
            raw, residual = _harmonics(gram, rhs, total, kmax), _harmonics(gram, left, left_total, kmax)
            n = gram[:, 0, 0]
            rmse = np.sqrt(np.maximum(left_total, 0) / n)
            columns = [batch["rep"], n.astype(np.int64), rhs[:, 0] / n, l1, rmse, lat, lon, l1, l2, l3, l2 - l1, l3 - l2, raw[0].astype(np.int32), *raw[1:], residual[0].astype(np.int32), residual[1]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, from_pandas=True) for c in columns], names=[c.split()[0] for c in SPECTRA.split(", ")])

    told = places.mapInArrow(run, "rep int, gram array<double>, rhs array<double>, szz array<double>")
    return _summed(told, "rep", ["gram", "rhs", "szz"]).mapInArrow(solved, SPECTRA)


def evaluated(draws: DataFrame, reps: int, z: str = "z_m", step: float = 4.0, kmax: int = KMAX) -> DataFrame:
    """All fits of the replicates in `draws` (rep, latitude, longitude, z): `spectra`, the best plane (best_plane_r2, pole_lat, pole_lon, plane_slope), and z_min, z_max, z_median (exact, by ranges of values)."""
    places = by_place(draws, z)
    planes = best_planes(places, reps, step).select("rep", F.col("r2").alias("best_plane_r2"), "pole_lat", "pole_lon", F.col("slope").alias("plane_slope"))
    rows = draws.dropna(subset=["latitude", "longitude", z])
    ends = rows.groupBy("rep").agg(F.min(z).alias("z_min"), F.max(z).alias("z_max"))
    middle = quantiles(rows.select("rep", z), z, {"z_median": 0.5}, ["rep"]).select("rep", "z_median")
    return spectra(places, reps, kmax).join(planes, "rep", "left").join(ends, "rep", "left").join(middle, "rep", "left")
