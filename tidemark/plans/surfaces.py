"""Queries: scattered fields, and fits of many replicates at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.operators import fits, replicates, scattered, statistics
from tidemark.plans.analysis import W, rounded
from tidemark.plans.least_squares import RECURSIVE, TERMS_SQL, least_squares_sql
from tidemark.plans.registry import query
from tidemark.plans.resampling import REPS, _axes, _drawn_sql, md5_sql, uniform_sql
from tidemark.sources.sites import sites, usable_sites

def _places(df):
    return df.groupBy(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).agg(F.min("z_m").alias("m"))


@query("scattered_interp")
def scattered_interp(spark, d):
    """Every site's value in the field that the usable sites span; linear between them, the nearest one's beyond their hull."""
    points = sites(spark, d).select("id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return rounded(scattered.interpolated(points, _places(usable_sites(spark, d))), 6)


@query("scattered_paths")
def scattered_paths(spark, d):
    """Path metrics of the suppliers' great circles through the field of the usable sites."""
    return rounded(scattered.along_paths(_axes(spark, d), _places(usable_sites(spark, d)), ["axis_id"], -200.0), 6)


def _permuted_sql(cell: str, seed: str) -> str:
    return f"""e AS (SELECT rep, u.*, {cell} AS cell FROM u, (SELECT unnest(range(1, {REPS + 1})) AS rep)), a AS (
        SELECT rep, cell, latitude, longitude, x, y, z, row_number() OVER (PARTITION BY rep, cell ORDER BY {md5_sql(chr(39) + seed + chr(39), 'rep', 'id')}, id) AS k FROM e), b AS (
        SELECT rep, cell, z_m, row_number() OVER (PARTITION BY rep, cell ORDER BY id) AS k FROM e), dr AS (SELECT CAST(a.rep AS INTEGER) AS rep, latitude, longitude, x, y, z, z_m FROM a JOIN b ON a.rep = b.rep AND a.cell = b.cell AND a.k = b.k)"""


def _one_per_cell_sql(seed: str) -> str:
    return f"""e AS (SELECT CAST(rep AS INTEGER) AS rep, u.*, floor((latitude + 90) / 10) AS la, floor((longitude + 180) / 20) AS lo FROM u, (SELECT unnest(range(1, {REPS + 1})) AS rep)),
        dr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rep, la, lo ORDER BY {md5_sql(chr(39) + seed + chr(39), 'rep', 'id')}, id) AS k FROM e) WHERE k = 1)"""


def _ordinary_sql(seed: str) -> str:
    return f"""i AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM u), sl AS (SELECT CAST(rep AS INTEGER) AS rep, CAST(floor({uniform_sql(md5_sql(chr(39) + seed + chr(39), 'rep', 'i'))} * n) AS BIGINT) AS i FROM i, (SELECT unnest(range(1, {REPS + 1})) AS rep)),
        dr AS (SELECT rep, i.* FROM sl JOIN i USING (i))"""


_BEST_PLANES_SQL = """la AS (SELECT -88.0::DOUBLE + 4 * unnest(range(0, 45)) AS pole_lat), lon AS (SELECT -180.0::DOUBLE + 4 * unnest(range(0, 90)) AS pole_lon), p AS (
    SELECT pole_lat, pole_lon, cos(radians(pole_lat)) * cos(radians(pole_lon)) AS nx, cos(radians(pole_lat)) * sin(radians(pole_lon)) AS ny, sin(radians(pole_lat)) AS nz FROM la, lon), pl AS (
    SELECT rep, x, y, z, count(*) AS n, sum(z_m) AS sz, sum(z_m * z_m) AS szz FROM dr GROUP BY rep, x, y, z), di AS (
    SELECT rep, pole_lat, pole_lon, n, sz, szz, degrees(asin(greatest(-1, least(1, x * nx + y * ny + z * nz)))) AS d FROM pl, p), su AS (
    SELECT rep, pole_lat, pole_lon, CAST(sum(n) AS BIGINT) AS n, sum(n * d) AS sx, sum(n * d * d) AS sxx, sum(d * sz) AS sxz, sum(sz) AS sz, sum(szz) AS szz FROM di GROUP BY rep, pole_lat, pole_lon), r AS (
    SELECT rep, pole_lat, pole_lon, n, pow(sxz - sx * sz / n, 2) / ((sxx - sx * sx / n) * (szz - sz * sz / n)) AS r2 FROM su)
    SELECT rep, pole_lat, pole_lon, n, round(r2, 8) AS r2 FROM r QUALIFY row_number() OVER (PARTITION BY rep ORDER BY round(r2, 10) DESC, pole_lat, pole_lon) = 1"""


def _best_planes(draws):
    b = replicates.best_planes(replicates.by_place(draws), REPS)
    return b.select("rep", "pole_lat", "pole_lon", "n", F.round("r2", 8).alias("r2"))


@query("null_planes", f"{W}, {_permuted_sql('0', 'np')}, {_BEST_PLANES_SQL}")
def null_planes(spark, d):
    """The best plane of each permutation of the values over all places."""
    return _best_planes(statistics.permuted(usable_sites(spark, d), "z_m", "id", REPS, "np"))


@query("null_planes_cells", f"{W}, {_permuted_sql('floor((latitude + 90) / 45)', 'nc')}, {_BEST_PLANES_SQL}")
def null_planes_cells(spark, d):
    """The best plane of each permutation within latitude bands."""
    s = usable_sites(spark, d).withColumn("cell", F.floor((F.col("latitude") + 90) / 45))
    return _best_planes(statistics.permuted(s, "z_m", "id", REPS, "nc", ["cell"]))


@query("bootstrap_planes", f"{W}, {_one_per_cell_sql('bp')}, {_BEST_PLANES_SQL}")
def bootstrap_planes(spark, d):
    """The best plane of each draw of one row for each cell."""
    s = usable_sites(spark, d).withColumn("cell", geo.cell_key("latitude", "longitude"))
    return _best_planes(statistics.one_per_group(s, ["cell"], "id", REPS, "bp"))


@query("bootstrap_planes_ordinary", f"{W}, {_ordinary_sql('bo')}, {_BEST_PLANES_SQL}")
def bootstrap_planes_ordinary(spark, d):
    """The best plane of each draw of all rows with replacement."""
    return _best_planes(statistics.bootstrap_rows(usable_sites(spark, d), "id", REPS, "bo"))


def _spectra_sql() -> str:
    harmonics = " UNION ALL ".join(f"SELECT rep, {k} AS k, 1.0::DOUBLE AS one, cos({k} * radians(longitude)) AS c, sin({k} * radians(longitude)) AS s, z_m, resid FROM rd" for k in range(1, replicates.KMAX + 1))
    return f"""{least_squares_sql('dr', ['rep'], TERMS_SQL, (4, 9, 16))}, rd AS (SELECT dr.*, z_m - (beta[1] + beta[2] * x + beta[3] * y + beta[4] * z) AS resid FROM dr JOIN ls USING (rep) WHERE d = 4), ha AS ({harmonics}),
    {least_squares_sql('ha', ['rep', 'k'], ('one', 'c', 's'), (3,), 'z_m', 'hr')}, {least_squares_sql('ha', ['rep', 'k'], ('one', 'c', 's'), (3,), 'resid', 'he')},
    raw AS (SELECT rep, k, r2 FROM hr QUALIFY row_number() OVER (PARTITION BY rep ORDER BY round(r2, 10) DESC, k) = 1), res AS (SELECT rep, k, r2 FROM he QUALIFY row_number() OVER (PARTITION BY rep ORDER BY round(r2, 10) DESC, k) = 1)
    SELECT l1.rep, l1.n, round(l1.r2, 7) AS l1_r2, round(l2.r2, 7) AS l2_r2, round(l3.r2, 7) AS l3_r2, round(degrees(atan2(l1.beta[4], sqrt(l1.beta[2] * l1.beta[2] + l1.beta[3] * l1.beta[3]))), 5) AS axis_lat,
        round(degrees(atan2(l1.beta[3], l1.beta[2])), 5) AS axis_lon, CAST(raw.k AS INTEGER) AS raw_k, round(raw.r2, 7) AS raw_r2, CAST(res.k AS INTEGER) AS residual_k, round(res.r2, 7) AS residual_r2
    FROM ls l1 JOIN ls l2 USING (rep) JOIN ls l3 USING (rep) JOIN raw USING (rep) JOIN res USING (rep) WHERE l1.d = 4 AND l2.d = 9 AND l3.d = 16"""


def _spectra(draws):
    s = replicates.spectra(replicates.by_place(draws), REPS)
    seven = [F.round(c, 7).alias(c) for c in ("l1_r2", "l2_r2", "l3_r2", "raw_r2", "residual_r2")]
    return s.select("rep", "n", *seven, F.round("axis_lat", 5).alias("axis_lat"), F.round("axis_lon", 5).alias("axis_lon"), "raw_k", "residual_k")


@query("null_spectra", f"{RECURSIVE}, {_permuted_sql('0', 'ns')}, {_spectra_sql()}")
def null_spectra(spark, d):
    """Spherical degrees and longitude harmonics of each permutation of the values."""
    return _spectra(statistics.permuted(usable_sites(spark, d), "z_m", "id", REPS, "ns"))


@query("bootstrap_spectra", f"{RECURSIVE}, {_ordinary_sql('bs')}, {_spectra_sql()}")
def bootstrap_spectra(spark, d):
    """Spherical degrees and longitude harmonics of each draw of all rows with replacement."""
    return _spectra(statistics.bootstrap_rows(usable_sites(spark, d), "id", REPS, "bs"))


@query("bootstrap_evaluated")
def bootstrap_evaluated(spark, d):
    """All fits of the draws of one row for each cell, as a summary over the draws."""
    s = usable_sites(spark, d).withColumn("cell", geo.cell_key("latitude", "longitude"))
    e = replicates.evaluated(statistics.one_per_group(s, ["cell"], "id", REPS, "be"), REPS)
    return rounded(statistics.summary(e, ["n", "spherical_r2", "best_plane_r2", "l2_gain", "l3_gain", "raw_r2", "residual_r2"]), 7)


_SCHEMES = ("ordinary", "one_per_cell", "one_per_source", "cell_then_source")
_CELL_SQL = "concat_ws('_', CAST(CAST(floor((latitude + 90) / 10) AS BIGINT) AS VARCHAR), CAST(CAST(floor((longitude + 180) / 20) AS BIGINT) AS VARCHAR))"
_ALL_SQL = "id, latitude, longitude, x, y, z, z_m, source_id, cell"


@query("bootstrap_scheme_fits", f"""{RECURSIVE}, e AS (SELECT rep, u.*, {_CELL_SQL} AS cell FROM u, (SELECT unnest(range(1, {REPS + 1})) AS rep)), i AS (SELECT *, {_CELL_SQL} AS cell, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM u),
    sl AS (SELECT rep, CAST(floor({uniform_sql(md5_sql(chr(39) + 'f' + chr(39), 'rep', 'i'))} * n) AS BIGINT) AS i FROM i, (SELECT unnest(range(1, {REPS + 1})) AS rep)),
    {_drawn_sql('pc', 'cell', 'f-cell', 'e')}, {_drawn_sql('ps', 'source_id', 'f-source', 'e')}, {_drawn_sql('pb', 'source_id', 'f-both', f'(SELECT rep, {_ALL_SQL} FROM pc)')},
    al AS (SELECT rep, {_ALL_SQL} FROM sl JOIN i USING (i) UNION ALL SELECT rep + {REPS}, {_ALL_SQL} FROM pc UNION ALL SELECT rep + {2 * REPS}, {_ALL_SQL} FROM ps UNION ALL SELECT rep + {3 * REPS}, {_ALL_SQL} FROM pb),
    dr AS (SELECT * FROM al QUALIFY count(*) OVER (PARTITION BY rep) >= 20), {least_squares_sql('dr', ['rep'], TERMS_SQL[:4], (4,))}, st AS (SELECT rep, min(z_m) AS z_min, max(z_m) AS z_max, quantile_cont(z_m, 0.5) AS z_median FROM dr GROUP BY rep),
    pn AS (WITH {_BEST_PLANES_SQL}) SELECT ['{"', '".join(_SCHEMES)}'][CAST((ls.rep - 1) // {REPS} AS INTEGER) + 1] AS scheme, CAST((ls.rep - 1) % {REPS} + 1 AS INTEGER) AS rep, ls.n, round(z_min, 6) AS z_min, round(z_max, 6) AS z_max, round(z_median, 6) AS z_median, round(ls.r2, 7) AS spherical_r2,
        round(sqrt((szz - sz * sz / ls.n) * (1 - ls.r2) / ls.n), 6) AS spherical_rmse, pole_lat, pole_lon, pn.r2 AS best_plane_r2 FROM ls JOIN st ON ls.rep = st.rep JOIN pn ON ls.rep = pn.rep""")
def bootstrap_scheme_fits(spark, d):
    """The fits of every draw of the four schemes, draws of fewer than 20 rows left out; all draws are replicates of one pass."""
    s = usable_sites(spark, d).withColumn("cell", geo.cell_key("latitude", "longitude")).select("id", "latitude", "longitude", "z_m", "source_id", "cell")
    number = F.coalesce(*(F.when(F.col("scheme") == n, F.lit(i)) for i, n in enumerate(_SCHEMES)))
    draws = statistics.schemes(s, "cell", "source_id", "id", REPS, "f", 20).withColumn("rep", number * REPS + F.col("rep"))
    e = replicates.evaluated(draws, len(_SCHEMES) * REPS)
    scheme = F.element_at(F.array(*(F.lit(n) for n in _SCHEMES)), (F.floor((F.col("rep") - 1) / REPS) + 1).cast("int"))
    return e.select(scheme.alias("scheme"), ((F.col("rep") - 1) % REPS + 1).alias("rep"), "n", *(F.round(c, 6).alias(c) for c in ("z_min", "z_max", "z_median")), F.round("spherical_r2", 7).alias("spherical_r2"), F.round("spherical_rmse", 6).alias("spherical_rmse"), "pole_lat", "pole_lon", F.round("best_plane_r2", 8).alias("best_plane_r2"))


@query("grouped_gradients", f"""{RECURSIVE}, g AS (SELECT source_id, CASE WHEN z_m < -200 THEN 'deepwater' ELSE 'shelf' END AS regime, x, y, z, z_m, count(*) OVER (PARTITION BY source_id, z_m < -200) AS n FROM u), h AS (SELECT * FROM g WHERE n >= 12),
    {least_squares_sql('h', ['source_id', 'regime'], ('1', 'x', 'y', 'z'), (4,))} SELECT source_id, regime, n, round(r2, 7) AS r2, round(beta[1], 5) AS intercept, round(beta[2], 5) AS gx, round(beta[3], 5) AS gy, round(beta[4], 5) AS gz FROM ls""")
def grouped_gradients(spark, d):
    """Gradients by source and depth regime, of groups of 12 rows or more."""
    s = usable_sites(spark, d).withColumn("regime", F.when(F.col("z_m") < -200, "deepwater").otherwise("shelf"))
    g = fits.grouped_fits(s, ["source_id", "regime"], fits.harmonic_terms(1)).filter("n >= 12")
    return g.select("source_id", "regime", "n", F.round("r2", 7).alias("r2"), *(F.round(F.col("coefficients")[i], 5).alias(c) for i, c in enumerate(("intercept", "gx", "gy", "gz"))))


@query("grouped_least_norm")
def grouped_least_norm(spark, d):
    """Fits of degree 3 for every source and record class, most of which have fewer rows than terms: least norm, with rank."""
    g = fits.grouped_fits(usable_sites(spark, d), ["source_id", "record_class"], fits.harmonic_terms(3))
    return g.select("source_id", "record_class", "n", "rank", F.round("r2", 6).alias("r2"), F.round("rmse", 6).alias("rmse"))
