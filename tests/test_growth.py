"""Work that must grow no faster than the tables: what meets what, in how many tasks, and how often a text is read."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.operators import fields, merge, tables
from tidemark.plans.mining import table_items


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_lookup_meets_the_first_row_of_each_form_only(spark):
    """2 000 rows under one form are one row before records meet them."""
    table = spark.range(2_000).select(F.col("id").alias("seq"), F.lit("07").alias("key")).unionByName(spark.createDataFrame([(-1, "k-1"), (-2, "k1")], "seq long, key string"))
    records = spark.createDataFrame([(1, "7"), (2, "07"), (3, "K1"), (4, "9")], "id long, n string")
    got = merge.lookup(records, table, ["n"], ["key"], "seq")
    assert sorted((r["id"], r["seq"], r["matched_key"]) for r in got.collect()) == [(1, 0, "07"), (2, 0, "07"), (3, -2, "k1")]
    before_join = _plan(got).split("Optimized Logical Plan")[1].split("Physical Plan")[0]
    assert "min(seq" in before_join


def test_inverse_makes_no_row_for_a_pair(spark):
    """The same as a row for each site and pole, at the edge too, without such rows."""
    sites = spark.createDataFrame([(1, 10.0, 20.0, -5.0), (1, 10.0, 20.0, -5.0), (2, -45.0, 100.0, 60.0), (3, 20.0, 0.0, 900.0), (5, 3.0, 4.0, None), (6, 1.0, 1.0, 9e9)], "id long, latitude double, longitude double, z_m double")
    grid = spark.range(1).select(F.explode(geo.steps(0.0, 19, 5.0)).alias("offset_deg")).select("offset_deg", F.explode(geo.steps(0.0, 36, 10.0)).alias("azimuth_deg"))
    poles = grid.select("*", *(c.alias(n) for c, n in zip(geo.displaced_pole("offset_deg", "azimuth_deg"), ("px", "py", "pz"))))
    got = fields.inverse(sites, poles, 25.0)
    want: dict[int, list[float]] = {}
    for s in sites.collect():
        v = [math.cos(math.radians(s["latitude"])) * math.cos(math.radians(s["longitude"])), math.cos(math.radians(s["latitude"])) * math.sin(math.radians(s["longitude"])), math.sin(math.radians(s["latitude"]))]
        for p in poles.collect():
            if s["z_m"] is not None and abs(round(s["z_m"] + 11_000 * (v[2] ** 2 - (v[0] * p["px"] + v[1] * p["py"] + v[2] * p["pz"]) ** 2), 5)) <= 25:
                want.setdefault(s["id"], []).append(p["offset_deg"])
    assert {r["id"]: (r["n"], r["least_offset_deg"], r["most_offset_deg"]) for r in got.collect()} == {k: (len(o), min(o), max(o)) for k, o in want.items()}
    assert "NestedLoopJoin" not in _plan(got)
    edge = spark.createDataFrame([(1, 0.0, 0.0, 25.000004), (2, 0.0, 0.0, 25.000005), (3, 0.0, 0.0, -25.000004), (4, 0.0, 0.0, -25.000005)], "id long, latitude double, longitude double, z_m double")
    assert sorted(r["id"] for r in fields.inverse(edge, poles.filter("offset_deg = 0"), 25.0).collect()) == [1, 3]


def test_points_of_paths_are_never_broadcast(spark):
    """Points exploded from a few axes look small to the planner; joins on them shuffle."""
    from tidemark.operators import scattered

    field = spark.createDataFrame([(float(a), float(o), float(a * o)) for a in range(-40, 41, 20) for o in range(-80, 81, 40)], "lat double, lon double, m double")
    axes = spark.range(3).select(F.col("id").alias("axis_id"), (F.col("id") * 20.0).alias("axis_lat"), (F.col("id") * 30.0).alias("axis_lon"))
    got = scattered.interpolated(fields.sweep(axes, 90.0), field)
    assert got.count() == 15 and got.filter("m IS NULL").count() == 0
    executed = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in executed and "BroadcastHashJoin" not in executed


def test_points_meet_the_triangles_of_their_cell_only(spark, monkeypatch):
    """The value at a point is that of the triangle that holds it, however few pairs are held at once."""
    import numpy as np

    from tidemark.operators import scattered

    r = np.random.default_rng(3)
    x, y = r.uniform(0, 10, (2, 300))
    triangles, _ = scattered.triangulated(x, y)
    q = r.uniform(-1, 11, (2, 2_000))
    whole = scattered.located(*q, x, y, 2 * x - 3 * y + 1, triangles)
    monkeypatch.setattr(scattered, "BLOCK", 7)
    assert np.array_equal(whole, scattered.located(*q, x, y, 2 * x - 3 * y + 1, triangles), equal_nan=True)
    inside = ~np.isnan(whole)
    assert 1_000 < inside.sum() < 2_000 and np.allclose(whole[inside], (2 * q[0] - 3 * q[1] + 1)[inside])


def test_pages_of_tables_are_read_once(spark, sf):
    """No kind of table reads the pages again: the mined records' plan splits none."""
    plan = tables.mined(*table_items(spark, sf), specimen_sources=["whales"])._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan
