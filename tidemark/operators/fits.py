"""Least-squares fits from sums, so that one pass with map-side sums serves any number of rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.functions.placing import in_parts, kept, spread
from tidemark.operators.statistics import spearman


def line(y: str, x) -> dict[str, Column]:
    """Aggregates of the fit y = intercept + slope * x. r2 is null where x or y is constant."""
    x, y = geo.column(x), F.col(y)
    r2 = F.nullif(F.regr_sxx(y, x), F.lit(0.0)).isNotNull() & F.nullif(F.regr_syy(y, x), F.lit(0.0)).isNotNull()
    fit = F.when(r2, F.regr_r2(y, x))
    rmse = F.sqrt(F.greatest(F.lit(0.0), F.regr_syy(y, x) * (1 - fit) / F.regr_count(y, x)))
    return {"n": F.regr_count(y, x), "slope": F.regr_slope(y, x), "intercept": F.regr_intercept(y, x), "r2": fit, "rmse": rmse}


def harmonics(df: DataFrame, kmax: int, z: str = "z_m", lon: str = "longitude") -> DataFrame:
    """For k = 1..kmax the fit z = a + b cos(k lon) + c sin(k lon): k, n, r2, cos_coeff, sin_coeff, amplitude_m, phase_deg; closed form from second moments."""
    each = df.select(F.col(z).alias("z"), F.radians(lon).alias("l"), F.explode(F.sequence(F.lit(1), F.lit(kmax))).alias("k")).select("k", "z", F.cos(F.col("k") * F.col("l")).alias("c"), F.sin(F.col("k") * F.col("l")).alias("s"))
    cov = lambda a, b: F.covar_pop(a, b)
    m = each.groupBy("k").agg(F.count("*").alias("n"), cov("c", "c").alias("cc"), cov("s", "s").alias("ss"), cov("c", "s").alias("cs"), cov("c", "z").alias("cz"), cov("s", "z").alias("sz"), cov("z", "z").alias("zz"))
    c = F.col
    det = F.nullif(c("cc") * c("ss") - c("cs") * c("cs"), F.lit(0.0))
    b, a = (c("cz") * c("ss") - c("sz") * c("cs")) / det, (c("sz") * c("cc") - c("cz") * c("cs")) / det
    out = m.withColumn("cos_coeff", b).withColumn("sin_coeff", a)
    return out.select("k", "n", ((c("cos_coeff") * c("cz") + c("sin_coeff") * c("sz")) / F.nullif(c("zz"), F.lit(0.0))).alias("r2"), "cos_coeff", "sin_coeff", F.hypot("cos_coeff", "sin_coeff").alias("amplitude_m"), F.degrees(F.atan2(-c("sin_coeff"), c("cos_coeff"))).alias("phase_deg"))


def spherical(df: DataFrame, by: Sequence[str] = (), z: str = "z_m") -> DataFrame:
    """z = a + gradient . unit vector, for each group: n, r2, gx, gy, gz, gradient_norm, axis_lat, axis_lon.

    One aggregate of second moments and a 3 x 3 solution in closed form; nothing but sums is shuffled. Null where the system is singular.
    """
    x, y, w = geo.unit("latitude", "longitude")
    v = df.select(*by, F.col(z).alias("_z"), x.alias("_1"), y.alias("_2"), w.alias("_3"))
    return solved(v.groupBy(*by).agg(*moments()), by)


def moments() -> list[Column]:
    """Second central moments of _1, _2, _3 and _z."""
    pairs = [("1", "1"), ("1", "2"), ("1", "3"), ("2", "2"), ("2", "3"), ("3", "3"), ("1", "z"), ("2", "z"), ("3", "z"), ("z", "z")]
    return [F.count("*").alias("n"), *(F.covar_pop(f"_{a}", f"_{b}").alias(f"c{a}{b}") for a, b in pairs)]


def solved(m: DataFrame, by: Sequence[str]) -> DataFrame:
    """The fits of rows of central moments. Each step binds what the next ones use several times, so that no expression is written out more than once."""
    names = ("11", "12", "13", "22", "23", "33", "1z", "2z", "3z", "zz")
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def minors(c: Column) -> Column:
        e = {n: c[f"c{n}"] for n in names}
        i = {
            "i11": e["22"] * e["33"] - e["23"] * e["23"], "i12": e["13"] * e["23"] - e["12"] * e["33"], "i13": e["12"] * e["23"] - e["13"] * e["22"],
            "i22": e["11"] * e["33"] - e["13"] * e["13"], "i23": e["12"] * e["13"] - e["11"] * e["23"], "i33": e["11"] * e["22"] - e["12"] * e["12"],
        }
        return F.struct(*(e[n].alias(f"c{n}") for n in names), *(v.alias(k) for k, v in i.items()))

    def gradient(m: Column) -> Column:
        det = m["c11"] * m["i11"] + m["c12"] * m["i12"] + m["c13"] * m["i13"]
        d = F.when(F.abs(det) > 1e-12, det)
        rows = (("i11", "i12", "i13"), ("i12", "i22", "i23"), ("i13", "i23", "i33"))
        return let(F.struct(d.alias("d"), *((m[a] * m["c1z"] + m[b] * m["c2z"] + m[c] * m["c3z"]).alias(f"g{k}") for k, (a, b, c) in enumerate(rows)), m["c1z"].alias("c1z"), m["c2z"].alias("c2z"), m["c3z"].alias("c3z"), m["czz"].alias("czz")), divided)

    def divided(s: Column) -> Column:
        return let(F.struct(*((s[f"g{k}"] / s["d"]).alias(n) for k, n in enumerate(("gx", "gy", "gz"))), *(s[c] for c in ("c1z", "c2z", "c3z", "czz"))), fit)

    def fit(g: Column) -> Column:
        v = (g["gx"], g["gy"], g["gz"])
        r2 = (v[0] * g["c1z"] + v[1] * g["c2z"] + v[2] * g["c3z"]) / F.nullif(g["czz"], F.lit(0.0))
        return F.struct(r2.alias("r2"), *(x.alias(n) for x, n in zip(v, ("gx", "gy", "gz"))), F.sqrt(geo.dot(v, v)).alias("gradient_norm"), geo.latitude(v).alias("axis_lat"), geo.longitude(v).alias("axis_lon"))

    out = let(let(F.struct(*(f"c{n}" for n in names)), minors), gradient)
    return m.select(*by, "n", out.alias("_fit")).select(*by, "n", "_fit.*")


#: Sums over rows, which add up over groups and can be taken away again.
def sums(df: DataFrame, by: Sequence[str], z: str = "z_m") -> DataFrame:
    x, y, w = geo.unit("latitude", "longitude")
    v = {"1": x, "2": y, "3": w, "z": F.col(z)}
    pairs = [(a, b) for i, a in enumerate(v) for b in list(v)[i:]]
    return df.groupBy(*by).agg(F.count("*").cast("double").alias("n"), *(F.sum(v[a]).alias(f"s{a}") for a in v), *(F.sum(v[a] * v[b]).alias(f"s{a}{b}") for a, b in pairs))


def leave_one_out(df: DataFrame, by: str, least: int = 1, z: str = "z_m") -> DataFrame:
    """For each group of at least `least` rows the spherical fit of all other rows.

    The group's sums are taken from the sums of all; the table is read once, not once a group.
    """
    parts = sums(df, [by], z)
    names = [c for c in parts.columns if c != by]
    total = parts.agg(F.struct(*(F.sum(n).alias(n) for n in names)).alias("t")).scalar()
    rest = parts.filter(F.col("n") >= least).withColumn("t", total).select(F.col(by).alias("left_out"), F.col("n").cast("long").alias("left_out_n"), *((F.col(f"t.{n}") - F.col(n)).alias(n) for n in names))
    cov = lambda a, b: (F.col(f"s{a}{b}") / F.col("n") - F.col(f"s{a}") * F.col(f"s{b}") / (F.col("n") * F.col("n"))).alias(f"c{a}{b}")
    v = ["1", "2", "3", "z"]
    central = rest.select("left_out", "left_out_n", "n", *(cov(a, b) for i, a in enumerate(v) for b in v[i:]))
    return solved(central, ["left_out", "left_out_n"]).withColumn("n", F.col("n").cast("long"))


def by_place(df: DataFrame, z: str = "z_m") -> DataFrame:
    """A row for each place: latitude, longitude, n, sz, szz. Grid searches run over places, of which there are fewer than rows."""
    return df.groupBy("latitude", "longitude").agg(F.count("*").alias("n"), F.sum(z).alias("sz"), F.sum(F.col(z) * F.col(z)).alias("szz"))


def pole_grid(spark, step: float, last_lat: float = 88.0) -> DataFrame:
    """lat from -88 to 88, lon from -180 below 180: a table whose size the step alone sets."""
    lats, lons = int(round(2 * last_lat / step)) + 1, int(round(360 / step))
    return spark.range(1).select(F.explode(geo.steps(-last_lat, lats, step)).alias("pole_lat")).select("pole_lat", F.explode(geo.steps(-180.0, lons, step)).alias("pole_lon"))


def plane_rescan(df: DataFrame, step: float = 4.0, z: str = "z_m") -> DataFrame:
    """For each pole of the grid the fit of z on the distance from its great circle: pole_lat, pole_lon, n, r2, slope.

    The grid (4 050 poles at 4 degrees) is broadcast to the places, in parts if it has over a million poles; each task keeps one row of sums a pole.
    """
    x, y, w = geo.unit("latitude", "longitude")
    places = by_place(df, z).select("n", "sz", "szz", x.alias("x"), y.alias("y"), w.alias("w"))
    p, q, r = geo.unit("pole_lat", "pole_lon")
    grid = pole_grid(df.sparkSession, step).select("pole_lat", "pole_lon", p.alias("p"), q.alias("q"), r.alias("r"))
    parts = in_parts(grid, (int(round(176 / step)) + 1) * int(round(360 / step)))
    places = places if len(parts) == 1 else kept(places)  # each part of the grid reads them
    met = reduce(DataFrame.unionByName, (places.crossJoin(F.broadcast(g)) for g in parts))  # a pair costs a dot product and an arc sine
    d = geo.plane_distance((F.col("x"), F.col("y"), F.col("w")), (F.col("p"), F.col("q"), F.col("r")))
    scanned = met.select("pole_lat", "pole_lon", "n", "sz", "szz", d.alias("d"))
    n, w = F.sum("n"), F.col("n") * F.col("d")
    s = scanned.groupBy("pole_lat", "pole_lon").agg(n.alias("n"), F.sum(w).alias("sx"), F.sum(w * F.col("d")).alias("sxx"), F.sum(F.col("d") * F.col("sz")).alias("sxz"), F.sum("sz").alias("sz"), F.sum("szz").alias("szz"))
    c = F.col
    xx, xz, zz = c("sxx") - c("sx") * c("sx") / c("n"), c("sxz") - c("sx") * c("sz") / c("n"), c("szz") - c("sz") * c("sz") / c("n")
    return s.select("pole_lat", "pole_lon", "n", (xz * xz / F.nullif(xx * zz, F.lit(0.0))).alias("r2"), (xz / F.nullif(xx, F.lit(0.0))).alias("slope"))


def best(df: DataFrame, score: str = "r2", ties: Sequence[str] = ("pole_lat", "pole_lon"), digits: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """The row of the greatest score, of each group of `by`, of equal ones (after rounding) the first in the order of `ties`: an aggregate, no sort."""
    key = F.struct(-F.round(score, digits), *ties)
    return df.filter(F.col(score).isNotNull()).groupBy(*by).agg(F.min_by(F.struct(*df.columns), key).alias("b")).select("b.*")


def harmonic_terms(lmax: int) -> dict[str, Column]:
    """Real spherical harmonics of degree 1 to lmax (3 at most) as polynomials of the unit vector: 3, 8 or 15 columns."""
    x, y, z = geo.unit("latitude", "longitude")
    terms = {"x": x, "y": y, "z": z}
    if lmax >= 2:
        terms |= {"xy": x * y, "yz": y * z, "z2": 3 * z * z - 1, "xz": x * z, "x2y2": x * x - y * y}
    if lmax >= 3:
        terms |= {"y3": y * (3 * x * x - y * y), "xyz": x * y * z, "yz2": y * (5 * z * z - 1), "z3": z * (5 * z * z - 3), "xz2": x * (5 * z * z - 1), "zx2y2": z * (x * x - y * y), "x3": x * (x * x - 3 * y * y)}
    return terms


def gram(df: DataFrame, terms: dict[str, Column], z: str = "z_m") -> np.ndarray:
    """The matrix of sums of products of 1, the terms and z: one row of sums comes to the driver, whatever the table's size."""
    cols = {"1": F.lit(1.0), **terms, "target": F.col(z)}
    names = list(cols)
    v = df.select(*(cols[k].alias(f"v{i}") for i, k in enumerate(names)))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = v.agg(*(F.coalesce(F.sum(F.col(f"v{i}") * F.col(f"v{j}")), F.lit(0.0)) for i, j in pairs)).first()
    m = np.zeros((len(names), len(names)))
    for (i, j), s in zip(pairs, row):
        m[i, j] = m[j, i] = s
    return m


def solve_gram(m: np.ndarray, terms: int, ridge: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(coefficients, r2) of z on 1 and the first `terms` terms; least norm where the columns depend on each other, or with ridge penalties (none on 1)."""
    k = terms + 1
    a, b, n, sz, szz = m[:k, :k], m[:k, -1], m[0, 0], m[0, -1], m[-1, -1]
    beta = np.linalg.pinv(a, rcond=1e-12) @ b if ridge is None else np.linalg.solve(a + np.diag(np.concatenate([[0.0], ridge])), b)
    total = szz - sz * sz / n if n else 0.0
    left = szz - 2 * beta @ b + beta @ a @ beta
    return beta, float(1 - left / total) if total > 0 else float("nan")


def grouped_fits(df: DataFrame, by: Sequence[str], terms: dict[str, Column], z: str = "z_m") -> DataFrame:
    """For each group of `by` the fit of z on 1 and `terms`, of least norm where they depend on each other: by, n, rank, r2, rmse, coefficients (the constant first).

    A group is one row of sums of products, summed on the map side; batches of groups are solved stacked. Rows without z or a term go. r2 is null where z does not vary.
    """
    cols = {"_1": F.lit(1.0), **{f"_t{i}": c for i, c in enumerate(terms.values())}, "_z": F.col(z).cast("double")}
    names = list(cols)
    rows = df.select(*by, *(c.alias(n) for n, c in cols.items())).dropna(subset=names)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = rows.groupBy(*by).agg(F.array(*(F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs)).alias("_sums"))
    at, size = tuple(np.array(pairs).T), len(names)
    schema = sums.select(*by).withColumns({c: F.lit(None).cast(t) for c, t in (("n", "long"), ("rank", "int"), ("r2", "double"), ("rmse", "double"), ("coefficients", "array<double>"))}).schema

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.zeros((batch.num_rows, size, size))
            m[:, at[0], at[1]] = m[:, at[1], at[0]] = batch["_sums"].flatten().to_numpy().reshape(batch.num_rows, -1)
            a, b, szz, n = m[:, :-1, :-1], m[:, :-1, -1], m[:, -1, -1], m[:, 0, 0]
            inverse = np.linalg.pinv(a, rcond=1e-12, hermitian=True)
            beta = (inverse @ b[..., None])[..., 0]
            rank = np.linalg.matrix_rank(a, tol=1e-12 * np.abs(np.linalg.eigvalsh(a)).max(axis=1), hermitian=True)
            left = np.maximum(szz - (beta * b).sum(axis=1), 0)
            total = szz - m[:, 0, -1] ** 2 / n
            with np.errstate(invalid="ignore", divide="ignore"):
                r2 = np.where(total > 1e-12 * np.maximum(szz, 1e-300), 1 - left / total, np.nan)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(beta) + 1, dtype=np.int32) * (size - 1)), pa.array(beta.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in by), pa.array(n.astype(np.int64)), pa.array(rank.astype(np.int32)), pa.array(r2, from_pandas=True), pa.array(np.sqrt(left / n)), flat], names=[*by, "n", "rank", "r2", "rmse", "coefficients"])

    return sums.mapInArrow(run, schema)


def spectral(df: DataFrame, lmax: int = 3, z: str = "z_m") -> DataFrame:
    """For degree 1..lmax: n, r2, gain over the degree before, and the norm of the degree's coefficients. One aggregate serves all degrees."""
    m = gram(df, harmonic_terms(lmax), z)
    rows, before, start = [], 0.0, 1
    for degree in range(1, lmax + 1):
        beta, r2 = solve_gram(m, (degree + 1) ** 2 - 1)
        rows.append((degree, int(m[0, 0]), r2, r2 - before, float(np.linalg.norm(beta[start:]))))
        before, start = r2, len(beta)
    return df.sparkSession.createDataFrame(pd.DataFrame(rows, columns=["degree", "n", "r2", "gain", "degree_norm"]))


def residual_fit(df: DataFrame, z: str = "z_m") -> DataFrame:
    """One row: r2 of degree 1 alone, of degrees 1 and 2 together, of degree 2 on what degree 1 leaves (its share of the left sum of squares), and of both steps after another."""
    m = gram(df, harmonic_terms(2), z)
    (beta, first), (_, both) = solve_gram(m, 3), solve_gram(m, 8)
    t = np.eye(10)
    t[9, :4] = -beta  # the target becomes the residual of degree 1
    left = t @ m @ t.T
    keep = [0, *range(4, 9), 9]
    _, second = solve_gram(left[np.ix_(keep, keep)], 5)
    return df.sparkSession.createDataFrame([(int(m[0, 0]), first, both, second, first + (1 - first) * second)], "n long, r2_l1 double, r2_l1_l2 double, r2_residual_l2 double, r2_two_steps double")


def quadrupole(df: DataFrame, z: str = "z_m") -> DataFrame:
    """The degree-2 part of the fit as a trace-free tensor: its eigenvalues, greatest first, and their axes, turned to the northern half."""
    beta, _ = solve_gram(gram(df, harmonic_terms(2), z), 8)
    xy, yz, z2, xz, x2y2 = beta[4:9]
    q = np.array([[x2y2 - z2, xy / 2, xz / 2], [xy / 2, -x2y2 - z2, yz / 2], [xz / 2, yz / 2, 2 * z2]])
    values, axes = np.linalg.eigh(q)
    rows = []
    for k in np.argsort(-values):
        v = axes[:, k] * (1 if axes[2, k] >= 0 else -1)
        rows.append((float(values[k]), float(np.degrees(np.arcsin(np.clip(v[2], -1, 1)))), float((np.degrees(np.arctan2(v[1], v[0])) + 180) % 360 - 180)))
    return df.sparkSession.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "rank int, eigenvalue double, axis_lat double, axis_lon double")


#: What names a rotation candidate, and what a fit of it gives.
CANDIDATE = ("axis_lat", "axis_lon", "angle_deg", "lambda_q")
ROTATION_FIT = ("n", "r2", "rmse", "intercept", "rotation_coeff", "quadrupole_norm", *(f"q_{k}" for k in ("xy", "yz", "z2", "xz", "x2y2")))
#: Candidates that a task fits, and that `rotation_scores` takes at most.
SCAN_ROWS, MOST_SCORED = 20_000, 10_000
#: Pairs of rows and candidates that `rotation_scores` ranks at most.
MOST_PAIRS = 1 << 36


def _turned_pole() -> tuple[Column, Column, Column]:
    return geo.rotate((F.lit(0.0), F.lit(0.0), F.lit(1.0)), geo.unit("axis_lat", "axis_lon"), F.col("angle_deg"))


def rotation_scan(df: DataFrame, axes: Sequence[tuple[float, float]], angles: Sequence[float], penalties: Sequence[float], z: str = "z_m") -> DataFrame:
    """Ridge fits of z on the potential's anomaly for turns of the pole, beside the quadrupole: axis_lat, axis_lon, angle_deg, lambda_q, n, r2, rmse and the coefficients, that of the anomaly for its scaled form.

    The anomaly is a quadratic form of the unit vector, so every candidate is fitted from the same 9 x 9 sums; a task solves
    its candidates' stacked matrices, and the rows of the table are read once.
    """
    spark = df.sparkSession
    x, y, w = geo.unit("latitude", "longitude")
    m = gram(df, {"xx": x * x, "yy": y * y, "zz": w * w, **{k: v for k, v in harmonic_terms(2).items() if k in ("xy", "yz", "xz")}}, z)
    held = spark.sparkContext.broadcast(m)
    cands = spark.createDataFrame([(float(a), float(o)) for a, o in axes], "axis_lat double, axis_lon double")
    cands = cands.withColumn("angle_deg", F.explode(F.array(*(F.lit(float(a)) for a in angles)))).withColumn("lambda_q", F.explode(F.array(*(F.lit(float(p)) for p in penalties))))
    tasks = -(-len(axes) * len(angles) * len(penalties) // SCAN_ROWS)
    cands = cands.select("*", *(p.alias(f"p{i}") for i, p in enumerate(_turned_pole()))).repartition(max(1, tasks))
    quad = np.zeros((8, 8))  # 1, the anomaly (set below), xy, yz, 3zz - 1, xz, xx - yy, z of 1, xx, yy, zz, xy, yz, xz, z
    quad[0, 0] = quad[2, 4] = quad[3, 5] = quad[5, 6] = quad[6, 1] = quad[7, 7] = 1.0
    quad[4, 0], quad[4, 3], quad[6, 2] = -1.0, 3.0, -1.0

    def fit(batches):
        g = held.value
        for pdf in batches:
            a, b, c = (pdf[f"p{i}"].to_numpy() for i in range(3))
            t = np.repeat(quad[None], len(pdf), axis=0)
            t[:, 1, :7] = np.column_stack([0 * a, a * a, b * b, c * c - 1, 2 * a * b, 2 * b * c, 2 * a * c])  # (r.p)^2 - z^2
            s = t @ g @ t.transpose(0, 2, 1)
            n = np.maximum(s[:, 0, 0], 1)
            scale = np.sqrt(np.maximum(s[:, 1, 1] / n - (s[:, 0, 1] / n) ** 2, 1e-12))
            s[:, 1] /= scale[:, None]
            s[:, :, 1] /= scale[:, None]
            plain, rhs = s[:, :7, :7], s[:, :7, 7]
            ridge = np.zeros_like(plain)
            ridge[:, 0, 0], ridge[:, 1, 1] = s[:, 0, 0] == 0, 1e-9
            for k in range(2, 7):
                ridge[:, k, k] = pdf["lambda_q"]
            beta = np.linalg.solve(plain + ridge, rhs[..., None])[..., 0]
            left = s[:, 7, 7] - 2 * (beta * rhs).sum(axis=1) + np.einsum("ni,nij,nj->n", beta, plain, beta)
            total = s[:, 7, 7] - s[:, 0, 7] ** 2 / n
            with np.errstate(invalid="ignore", divide="ignore"):
                fitted = [s[:, 0, 0].astype(np.int64), np.where(total > 0, 1 - left / total, np.nan), np.sqrt(np.maximum(left, 0) / n), beta[:, 0], beta[:, 1], np.sqrt((beta[:, 2:] ** 2).sum(axis=1)), *beta[:, 2:].T]
            yield pdf[list(CANDIDATE)].assign(**dict(zip(ROTATION_FIT, fitted)))

    return cands.mapInPandas(fit, ", ".join([*(f"{c} double" for c in CANDIDATE), "n long", *(f"{c} double" for c in ROTATION_FIT[1:])]))


def rotation_scores(df: DataFrame, fitted: DataFrame, z: str = "z_m") -> DataFrame:
    """The candidates `fitted` (rows of `rotation_scan`, MOST_SCORED at most) with what needs residuals: rotated_pole_lat, rotated_pole_lon, mae, spearman of prediction and z, rotation_spearman of the anomaly alone and z.

    The candidates are broadcast to the rows, once for their scale and once for the residuals; ranks are dealt by candidate and range.
    """
    candidates, rows_ = fitted.count(), df.count()
    if candidates > MOST_SCORED or candidates * rows_ > MOST_PAIRS:
        raise ValueError("too many candidates to score for so many rows; take the best of them")
    pole = _turned_pole()
    c = fitted.withColumns({f"p{i}": p for i, p in enumerate(pole)} | {"rotated_pole_lat": geo.latitude(pole), "rotated_pole_lon": geo.longitude(pole)})
    v = geo.unit("latitude", "longitude")
    terms = {k: t for k, t in harmonic_terms(2).items() if k not in ("x", "y", "z")}
    rows = kept(spread(df.select("latitude", "longitude", F.col(z).alias("obs"))).select(*(x.alias(f"v{i}") for i, x in enumerate(v)), *(t.alias(f"t_{k}") for k, t in terms.items()), "obs"))
    dot = sum(F.col(f"v{i}") * F.col(f"p{i}") for i in range(3))
    anomaly = dot * dot - F.col("v2") * F.col("v2")
    scales = rows.crossJoin(F.broadcast(c.select(*CANDIDATE, "p0", "p1", "p2"))).groupBy(*CANDIDATE).agg(F.greatest(F.stddev_pop(anomaly), F.lit(1e-6)).alias("scale"))
    met = rows.crossJoin(F.broadcast(c.join(scales, [*CANDIDATE]))).withColumn("rot", anomaly / F.col("scale"))
    met = met.withColumn("pred", F.col("intercept") + F.col("rotation_coeff") * F.col("rot") + sum(F.col(f"q_{k}") * F.col(f"t_{k}") for k in terms))
    errors = met.groupBy(*CANDIDATE).agg(F.avg(F.abs(F.col("obs") - F.col("pred"))).alias("mae"))
    digits = met.select(*CANDIDATE, "obs", F.round("pred", 9).alias("pred"), F.round("rot", 12).alias("rot"))
    ranks = spearman(digits, "pred", "obs", CANDIDATE).select(*CANDIDATE, "spearman")
    alone = spearman(digits, "rot", "obs", CANDIDATE).select(*CANDIDATE, F.col("spearman").alias("rotation_spearman"))
    out = c.drop("p0", "p1", "p2").join(errors, [*CANDIDATE]).join(ranks, [*CANDIDATE], "left").join(alone, [*CANDIDATE], "left")
    return out.select(*CANDIDATE, "rotated_pole_lat", "rotated_pole_lon", *ROTATION_FIT, "mae", "spearman", "rotation_spearman")


def influence(df: DataFrame, top: int = 25, z: str = "z_m", key: str = "id") -> DataFrame:
    """The `top` rows by a proxy of Cook's distance in the spherical fit: key, leverage, residual, influence, greatest first. A report of fixed length."""
    m = gram(df, harmonic_terms(1), z)
    beta, _ = solve_gram(m, 3)
    inverse = np.linalg.pinv(m[:4, :4])
    n, p = m[0, 0], 4
    row = [F.lit(1.0), *geo.unit("latitude", "longitude")]
    lever = sum(row[i] * row[j] * float(inverse[i, j]) for i in range(4) for j in range(4))
    residual = F.col(z) - sum(r * float(b) for r, b in zip(row, beta))
    left = m[-1, -1] - 2 * beta @ m[:4, -1] + beta @ m[:4, :4] @ beta
    s2 = float(left / max(n - p, 1))
    out = df.select(key, lever.alias("leverage"), residual.alias("residual"))
    cook = F.col("residual") ** 2 / (p * s2) * F.col("leverage") / (1 - F.col("leverage")) ** 2
    return out.withColumn("influence", cook).orderBy(F.desc("influence"), key).limit(top)
