"""Scalar fields on grids: sampling, paths over them, and preference grids of candidate poles."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions import geo
from tidemark.functions.placing import in_parts, spread

#: Pairs of sites and poles that a task holds at once.
PAIRS = 1 << 19
LAT_NAMES = ("lat", "latitude", "y")
LON_NAMES = ("lon", "longitude", "long", "x")
VALUE_NAMES = ("m", "mach", "value", "z")


def infer_column(names: Sequence[str], aliases: Sequence[str]) -> str:
    """The first of `names` that is one of the aliases, whatever its case."""
    by_lower = {n.lower().strip(): n for n in reversed(names)}
    for a in aliases:
        if a in by_lower:
            return by_lower[a]
    raise ValueError(f"none of {aliases} among {list(names)}")


def load_field(df: DataFrame) -> DataFrame:
    """(lat, lon, m) of a table with columns of other names: numbers only, longitudes wrapped, one row a place (the least m)."""
    lat, lon, m = (F.col(f"`{infer_column(df.columns, a)}`").cast("string").try_cast("double") for a in (LAT_NAMES, LON_NAMES, VALUE_NAMES))
    out = df.select(lat.alias("lat"), geo.wrap_longitude(lon).alias("lon"), m.alias("m")).dropna()
    return out.groupBy("lat", "lon").agg(F.min("m").alias("m"))


def bilinear(points: DataFrame, field: DataFrame, step: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds `m` from the four grid points around each point; beyond the grid or its holes, from those that are there, by weight. Equi-joins on cells; no place meets the whole grid. Repeated points stay, null coordinates give a null `m`."""
    places = points.select(F.col(lat).alias("_lat"), F.col(lon).alias("_lon")).dropna().distinct()
    a, o = F.floor(F.col("_lat") / step), F.floor(F.col("_lon") / step)
    corner = F.array(*(F.struct((a + i).alias("a"), (o + j).alias("o"), ((1 - F.abs(F.col("_lat") / step - (a + i))) * (1 - F.abs(F.col("_lon") / step - (o + j)))).alias("w")) for i in (0, 1) for j in (0, 1)))
    keyed = places.select("_lat", "_lon", F.explode(corner).alias("c")).select("_lat", "_lon", F.col("c.a").alias("_a"), F.col("c.o").alias("_o"), F.col("c.w").alias("_w")).filter("_w > 0")
    grid = field.select(F.round(F.col("lat") / step).cast("long").alias("_a"), F.round(F.col("lon") / step).cast("long").alias("_o"), F.col("m").alias("_m"))
    met = keyed.join(grid, ["_a", "_o"], "left").groupBy("_lat", "_lon").agg((F.sum(F.col("_w") * F.col("_m")) / F.nullif(F.sum(F.when(F.col("_m").isNotNull(), F.col("_w"))), F.lit(0.0))).alias("m"))
    return points.join(met, (F.col(lat) == F.col("_lat")) & (F.col(lon) == F.col("_lon")), "left").drop("_lat", "_lon")


def sweep(axes: DataFrame, step: float = 2.0) -> DataFrame:
    """Each axis (axis_lat, axis_lon) with the points of its great circle: theta from 0 to 360, both ends, lat, lon."""
    n = int(round(360 / step)) + 1
    a = geo.unit("axis_lat", "axis_lon")
    pole = F.abs(a[2]) < 0.9
    ref = (F.when(pole, 0.0).otherwise(1.0), F.lit(0.0), F.when(pole, 1.0).otherwise(0.0))
    e = geo.cross(ref, a)
    size = F.sqrt(geo.dot(e, e))
    e = tuple(x / size for x in e)
    g = geo.cross(a, e)
    frame = {f"_{n}{i}": x for n, v in (("e", e), ("g", g)) for i, x in enumerate(v)}
    each = spread(axes).withColumns(frame).withColumn("theta", F.explode(geo.steps(0.0, n, step)))  # an axis's own vectors are worked out once, before its points are made
    t = F.radians("theta")
    v = tuple(F.col(f"_e{i}") * F.cos(t) + F.col(f"_g{i}") * F.sin(t) for i in range(3))
    return each.withColumns({"lat": geo.latitude(v), "lon": geo.longitude(v)}).drop(*frame)


def path_metrics(paths: DataFrame, keys: Sequence[str], threshold: float, step: float) -> DataFrame:
    """Of m along each path: moments, share below the threshold, penalty, crossings, longest runs, slopes. One sort a path, no self-join."""
    w = Window.partitionBy(*keys).orderBy("theta")
    low = F.col("m") < threshold
    p = paths.withColumn("low", low).withColumn("before", F.lag("low").over(w)).withColumn("slope", (F.col("m") - F.lag("m").over(w)) / step)
    p = p.withColumn("turn", F.coalesce(F.col("low") != F.col("before"), F.lit(False))).withColumn("island", F.sum(F.col("turn").cast("int")).over(w))
    runs = p.groupBy(*keys, "island").agg(F.first("low").alias("low"), F.count("*").alias("length")).groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("low"), F.col("length"))), F.lit(0)).alias("low_run"), F.coalesce(F.max(F.when(~F.col("low"), F.col("length"))), F.lit(0)).alias("high_run"))
    m = p.groupBy(*keys).agg(
        F.avg("m").alias("path_m_mean"), F.percentile("m", F.lit(0.5)).alias("path_m_median"), F.min("m").alias("path_m_min"), F.max("m").alias("path_m_max"), F.stddev_pop("m").alias("path_m_std"),
        F.avg(F.col("low").cast("double")).alias("fraction_below"), F.avg(F.greatest(F.lit(0.0), threshold - F.col("m"))).alias("integrated_penalty"),
        F.sum(F.col("turn").cast("int")).alias("ridge_crossings"), F.avg(F.abs("slope")).alias("mean_abs_dm_dtheta"), F.max(F.abs("slope")).alias("max_abs_dm_dtheta"),
    )
    return m.join(runs, [*keys]).select(*m.columns, (F.col("low_run") * step).alias("longest_low_run_deg"), (F.col("high_run") * step).alias("longest_high_run_deg"))


def basin(field: DataFrame, top: int) -> DataFrame:
    """Mean latitude and circular mean longitude of the `top` places of the greatest m."""
    t = field.orderBy(F.desc("m"), "lat", "lon").limit(top)
    return t.agg(F.avg("lat").alias("basin_lat"), F.degrees(F.atan2(F.avg(F.sin(F.radians("lon"))), F.avg(F.cos(F.radians("lon"))))).alias("basin_lon"))


def centroid(lat, lon, weight: Column | None = None) -> tuple[Column, Column]:
    """Aggregates: latitude and longitude of the (weighted) mean unit vector; plain means where it vanishes."""
    w = F.lit(1.0) if weight is None else weight
    v = tuple(F.sum(w * c) for c in geo.unit(lat, lon))
    zero = F.sqrt(geo.dot(v, v)) < 1e-12
    return F.when(zero, F.avg(lat)).otherwise(geo.latitude(v)), F.when(zero, F.avg(lon)).otherwise(geo.longitude(v))


def preference(records: DataFrame, poles: DataFrame, bulge: float = 11_000.0, sigma: float = 25.0) -> DataFrame:
    """How well each candidate pole (px, py, pz) predicts the weighted records: preference_raw, preference_norm, hit_fraction, mae_m, rmse_m, preference_0_1.

    The grid, whose size its steps set, is broadcast, in parts if it has over a million poles; places with equal z and weight are summed first.
    """
    keys = [c for c in poles.columns]
    places = records.groupBy("latitude", "longitude", "z_m", "weight").agg(F.count("*").alias("n"))
    v = geo.unit("latitude", "longitude")
    weighed = places.select(*(c.alias(f"v{i}") for i, c in enumerate(v)), "z_m", (F.col("weight") * F.col("n")).alias("w"))
    met = reduce(DataFrame.unionByName, (weighed.crossJoin(F.broadcast(p)) for p in in_parts(poles)))
    miss = F.col("z_m") - geo.predicted_elevation((F.col("v0"), F.col("v1"), F.col("v2")), (F.col("px"), F.col("py"), F.col("pz")), bulge)
    scored = met.withColumn("miss", miss)
    w, x = F.col("w"), F.col("miss")
    out = scored.groupBy(*keys).agg(
        F.sum(w * F.exp(-0.5 * (x / sigma) * (x / sigma))).alias("preference_raw"), F.sum(w).alias("_w"),
        (F.sum(F.when(F.abs(x) <= sigma, w)) / F.sum(w)).alias("hit_fraction"), (F.sum(w * F.abs(x)) / F.sum(w)).alias("mae_m"), F.sqrt(F.sum(w * x * x) / F.sum(w)).alias("rmse_m"),
    )
    out = out.withColumn("preference_norm", F.col("preference_raw") / F.col("_w")).withColumn("hit_fraction", F.coalesce("hit_fraction", F.lit(0.0))).drop("_w")
    top = out.agg(F.max("preference_norm")).scalar()
    return out.withColumn("preference_0_1", F.coalesce(F.col("preference_norm") / F.nullif(top, F.lit(0.0)), F.lit(0.0)))


def inverse(sites: DataFrame, poles: DataFrame, within: float, bulge: float = 11_000.0) -> DataFrame:
    """For each site (id, latitude, longitude, z_m) the poles (offset_deg, px, py, pz) that predict its z up to `within`, both to five digits: id, n, least_offset_deg, most_offset_deg; sites without one are left out.

    The grid, whose size its steps set, is broadcast, in parts if it has over a million poles. Sites are dealt evenly; a task holds a block of sites by poles and sends a row for each site, no pair becomes a row.
    """
    kind = dict(sites.dtypes)["id"]
    edge = float(math.floor(Decimal(str(within)) * 100_000) / Decimal(100_000) + Decimal("0.000005"))  # the least size that is over `within` when rounded
    v = geo.unit("latitude", "longitude")
    weighed = spread(sites.select("id", F.col("z_m").cast("double").alias("z_m"), *(c.alias(f"v{i}") for i, c in enumerate(v))))

    def found(part: DataFrame) -> DataFrame:
        grid = part.select(*(F.col(c).cast("double") for c in ("offset_deg", "px", "py", "pz"))).sort("offset_deg").toPandas()
        held = sites.sparkSession.sparkContext.broadcast(tuple(grid[c].to_numpy() for c in grid.columns))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            offset, px, py, pz = held.value
            size = max(1, PAIRS // max(1, len(offset)))
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    block = batch.slice(at, size)
                    z, x, y, w = (block[c].to_numpy(zero_copy_only=False)[:, None] for c in ("z_m", "v0", "v1", "v2"))
                    dot = x * px
                    dot += y * py
                    dot += w * pz
                    dot *= dot
                    np.subtract(w * w, dot, out=dot)
                    dot *= -bulge
                    np.subtract(z, dot, out=dot)
                    hit = np.abs(dot, out=dot) < edge
                    n = hit.sum(axis=1)
                    some = np.flatnonzero(n)
                    ends = (hit[some].argmax(axis=1), len(offset) - 1 - hit[some, ::-1].argmax(axis=1)) if len(some) else (some, some)
                    yield pa.RecordBatch.from_arrays([block["id"].take(pa.array(some)), pa.array(n[some].astype(np.int64)), *(pa.array(offset[e]) for e in ends)], names=["id", "n", "least", "most"])

        return weighed.mapInArrow(run, f"id {kind}, n long, least double, most double")

    met = reduce(DataFrame.unionByName, (found(p) for p in in_parts(poles)))
    return met.groupBy("id").agg(F.sum("n").alias("n"), F.min("least").alias("least_offset_deg"), F.max("most").alias("most_offset_deg"))


def correlated(grid: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n and the correlation of two fields over the cells that have both, and least, greatest, middle, mean and median of the first (a_min ...)."""
    g = grid.dropna(subset=[a, b])
    stats = {"min": F.min(a), "max": F.max(a), "mid": (F.min(a) + F.max(a)) / 2, "mean": F.avg(a), "median": F.percentile(a, F.lit(0.5))}
    return g.agg(F.count("*").alias("n"), F.corr(a, b).alias("pearson"), *(c.alias(f"{a}_{n}") for n, c in stats.items()))
