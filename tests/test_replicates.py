"""Replicates and groups fitted by matrix products against one fit at a time."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import fits, replicates

REPS = 7


@pytest.fixture(scope="module")
def draws(spark):
    rng = np.random.default_rng(2)
    rows = []
    for rep in range(1, REPS + 1):
        n = 0 if rep == 4 else 60
        rows += [(rep, float(rng.integers(-8, 9) * 10), float(rng.integers(-17, 18) * 10), float(rng.normal() * 50 - 100)) for _ in range(n)]
    rows += [(1, None, 3.0, 1.0), (2, 3.0, 3.0, None)]
    return spark.createDataFrame(rows, "rep int, latitude double, longitude double, z_m double").repartition(3)


def test_planes_of_replicates(draws, monkeypatch):
    monkeypatch.setattr(replicates, "MOST_KEPT", 900)
    monkeypatch.setattr(replicates, "BLOCK", 16)
    places = replicates.by_place(draws)
    got = {(r["rep"], r["pole_lat"], r["pole_lon"]): r for r in replicates.planes(places, REPS, 22.0).collect()}
    best = {r["rep"]: r for r in replicates.best_planes(places, REPS, 22.0).collect()}
    assert sorted(best) == [1, 2, 3, 5, 6, 7]
    for rep in best:
        one = draws.filter(F.col("rep") == rep).dropna()
        want = fits.plane_rescan(one, 22.0)
        for r in want.collect():
            g = got[rep, r["pole_lat"], r["pole_lon"]]
            assert g["n"] == r["n"] and np.isclose(g["r2"], r["r2"], atol=1e-10) and np.isclose(g["slope"], r["slope"], atol=1e-10)
        w = fits.best(want).first()
        assert (best[rep]["pole_lat"], best[rep]["pole_lon"]) == (w["pole_lat"], w["pole_lon"])


def test_spectra_of_replicates(draws, monkeypatch):
    monkeypatch.setattr(replicates, "BLOCK", 16)
    got = {r["rep"]: r for r in replicates.evaluated(draws, REPS, step=44.0).collect()}
    assert sorted(got) == [1, 2, 3, 5, 6, 7]
    for rep, g in got.items():
        one = draws.filter(F.col("rep") == rep).dropna()
        degrees = [r["r2"] for r in fits.spectral(one).collect()]
        assert np.allclose([g["l1_r2"], g["l2_r2"], g["l3_r2"]], degrees, atol=1e-8)
        ball = fits.spherical(one).first()
        assert np.allclose([g["axis_lat"], g["axis_lon"], g["spherical_r2"]], [ball["axis_lat"], ball["axis_lon"], ball["r2"]], atol=1e-7)
        pdf = one.toPandas()
        lat, lon, z = np.radians(pdf["latitude"]), np.radians(pdf["longitude"]), pdf["z_m"].to_numpy()
        a = np.column_stack([np.ones(len(z)), np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])
        left = z - a @ np.linalg.lstsq(a, z, rcond=None)[0]
        for values, k, r2 in ((z, "raw_k", "raw_r2"), (left, "residual_k", "residual_r2")):
            scan = []
            for j in range(1, 9):
                h = np.column_stack([np.ones(len(z)), np.cos(j * lon), np.sin(j * lon)])
                e = values - h @ np.linalg.lstsq(h, values, rcond=None)[0]
                scan.append(1 - (e**2).sum() / ((values - values.mean()) ** 2).sum())
            assert g[k] == int(np.argmax(scan)) + 1 and abs(g[r2] - max(scan)) < 1e-9


def test_groups_of_low_rank_have_least_norm(spark):
    rng = np.random.default_rng(6)
    rows = [(g, float(rng.uniform(-80, 80)), float(rng.uniform(-180, 180)), float(rng.normal())) for g, n in (("a", 40), ("b", 5), ("c", 1), (None, 3)) for _ in range(n)]
    rows += [("d", 10.0, 20.0, 7.0)] * 4 + [("e", None, 1.0, 2.0), ("f", 1.0, 2.0, None)]
    df = spark.createDataFrame(rows, "g string, latitude double, longitude double, z_m double")
    got = {r["g"]: r for r in fits.grouped_fits(df, ["g"], fits.harmonic_terms(2)).collect()}
    assert sorted(got, key=str) == [None, "a", "b", "c", "d"] or set(got) == {None, "a", "b", "c", "d"}
    for g, r in got.items():
        part = [x for x in rows if x[0] == g and None not in x[1:]]
        lat, lon = np.radians([x[1] for x in part]), np.radians([x[2] for x in part])
        x, y, z = np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)
        a = np.column_stack([np.ones(len(part)), x, y, z, x * y, y * z, 3 * z * z - 1, x * z, x * x - y * y])
        want, _, rank, _ = np.linalg.lstsq(a, np.array([p[3] for p in part]), rcond=1e-7)
        assert (r["n"], r["rank"]) == (len(part), rank) and np.allclose(r["coefficients"], want, atol=1e-5)
        assert (r["r2"] is None) == (g in ("c", "d"))


def test_leave_one_out_compiles(spark):
    """The closed form is generated code, not the interpreted way that Spark falls back to."""
    rng = np.random.default_rng(4)
    rows = [(f"c{i % 9}", float(rng.uniform(-80, 80)), float(rng.uniform(-180, 180)), float(rng.normal())) for i in range(200)]
    df = spark.createDataFrame(rows, "cell string, latitude double, longitude double, z_m double")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        got = {r["left_out"]: r for r in fits.leave_one_out(df, "cell").collect()}
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    for c in ("c0", "c5"):
        want = fits.spherical(df.filter(F.col("cell") != c)).first()
        assert np.isclose(got[c]["r2"], want["r2"], atol=1e-9) and np.isclose(got[c]["axis_lon"], want["axis_lon"], atol=1e-7)
