"""Queries on the `sites` fixture: selection, geometry and fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.operators import fits, records
from tidemark.plans.least_squares import RECURSIVE, TERMS_SQL, least_squares_sql
from tidemark.plans.registry import query
from tidemark.sources.sites import SITES_SQL, sites, usable_sites

W = "WITH " + SITES_SQL
REGIMES = records.parse_regimes("shallow:-200,50;deep:-1000,-150;high:0,200;full:-1000,200")
EDGES = [-250.0, -200.0, -100.0, 0.0, 50.0, 100.0, 200.0]
BINS_SQL = "CASE WHEN z_m = -250 THEN 0 " + " ".join(f"WHEN z_m > {a} AND z_m <= {b} THEN {i}" for i, (a, b) in enumerate(zip(EDGES, EDGES[1:]))) + " END"


def rounded(df, digits: int = 7):
    """Doubles rounded, so that both engines show the same digits; -0 becomes 0."""
    return df.select(*((F.round(F.col(f"`{n}`"), digits) + 0.0).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes))


@query("usable_sites", f"{W} SELECT id, latitude, longitude, round(z_m, 7) AS z_m, source_id, record_class FROM u")
def usable_query(spark, d):
    return rounded(usable_sites(spark, d).select("id", "latitude", "longitude", "z_m", "source_id", "record_class"))


@query("regime_counts", f"{W} SELECT CASE WHEN z_m < -200 THEN 'deepwater' ELSE 'shelf' END AS depth_regime, -200.0::DOUBLE AS depth_regime_threshold_m, count(*) AS n FROM u GROUP BY ALL")
def regime_counts(spark, d):
    return usable_sites(spark, d).groupBy(records.depth_regime(F.col("z_m")).alias("depth_regime"), F.lit(-200.0).alias("depth_regime_threshold_m")).agg(F.count("*").alias("n"))


@query(
    "z_select",
    f"""{W}, r AS (SELECT *, CASE WHEN id % 4 = 0 THEN 'n/a' WHEN id % 4 = 1 THEN CAST(id % 50 AS VARCHAR) END AS elevation_m FROM s), k AS (
        SELECT id, lower(trim(coalesce(depth_source, ''))) = 'reported' AS known, TRY_CAST(elevation_m AS DOUBLE) AS e,
            CASE WHEN id % 4 = 2 THEN CAST(id % 30 AS DOUBLE) END AS re, CASE WHEN id % 4 = 3 AND id % 3 > 0 THEN CAST(id % 70 AS DOUBLE) END AS rd FROM r)
    SELECT id, CASE WHEN known THEN coalesce(e, re, -rd) END AS z_m,
        CASE WHEN NOT known THEN '' WHEN e IS NOT NULL THEN 'elevation_m' WHEN re IS NOT NULL THEN 'reported_elevation_m' WHEN rd IS NOT NULL THEN '-reported_depth_m' ELSE '' END AS z_source FROM k""",
)
def z_select(spark, d):
    k = F.col("id")
    s = sites(spark, d).withColumn("elevation_m", F.when(k % 4 == 0, "n/a").when(k % 4 == 1, (k % 50).cast("string")))
    seen = F.struct(F.when(k % 4 == 2, (k % 30).cast("double")).alias("reported_elevation_m"), F.when((k % 4 == 3) & (k % 3 > 0), (k % 70).cast("double")).alias("reported_depth_m"))
    s = s.withColumn("reported_observations", F.when(k % 11 == 0, F.concat(F.to_json(seen), F.lit(" "))).otherwise(F.to_json(seen)))
    return records.choose_z(s, precomputed=None).select("id", (F.col("z_m") + 0.0).alias("z_m"), "z_source")


@query(
    "named_regimes",
    f"{W}, g(regime, lo, hi) AS (VALUES ('shallow', -200, 50), ('deep', -1000, -150), ('high', 0, 200), ('full', -1000, 200)) SELECT regime, count(*) AS n, round(min(z_m), 7) AS z_min, round(max(z_m), 7) AS z_max FROM u JOIN g ON z_m BETWEEN lo AND hi GROUP BY regime HAVING count(*) >= 3",
)
def named_regimes(spark, d):
    out = records.with_named_regimes(usable_sites(spark, d), REGIMES).groupBy("regime").agg(F.count("*").alias("n"), F.min("z_m").alias("z_min"), F.max("z_m").alias("z_max"))
    return rounded(out.filter("n >= 3"))


@query(
    "depth_bins",
    f"""{W}, b AS (SELECT *, {BINS_SQL} AS z_bin FROM u), w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY z_bin) AS raw FROM b WHERE z_bin IS NOT NULL), n AS (SELECT *, raw / avg(raw) OVER () AS weight FROM w)
    SELECT z_bin, count(*) AS n_records, round(sum(weight), 7) AS weight_sum, round(min(z_m), 7) AS z_min, round(max(z_m), 7) AS z_max, round(avg(z_m), 7) AS z_mean, round(quantile_cont(z_m, 0.5), 7) AS z_median FROM n GROUP BY z_bin""",
)
def depth_bins(spark, d):
    binned = usable_sites(spark, d).withColumn("z_bin", records.right_closed_bin(F.col("z_m"), EDGES))
    return rounded(records.bin_summary(records.balanced_weights(binned)))


@query("unit_vectors", f"{W} SELECT id, round(x, 9) + 0.0 AS x, round(y, 9) + 0.0 AS y, round(z, 9) + 0.0 AS z FROM u")
def unit_vectors(spark, d):
    x, y, z = geo.unit("latitude", "longitude")
    return rounded(usable_sites(spark, d).select("id", x.alias("x"), y.alias("y"), z.alias("z")), 9)


@query(
    "angular_distance",
    f"""{W}, a AS (SELECT *, degrees(acos(greatest(-1, least(1, x * cos(radians(40)) * cos(radians(-175)) + y * cos(radians(40)) * sin(radians(-175)) + z * sin(radians(40)))))) AS d FROM u)
    SELECT id, round(d, 6) AS angular_deg, round(least(d, 180 - d), 6) AS axial_deg, round(degrees(asin(greatest(-1, least(1, x * cos(radians(40)) * cos(radians(-175)) + y * cos(radians(40)) * sin(radians(-175)) + z * sin(radians(40)))))), 6) + 0.0 AS plane_deg FROM a""",
)
def angular_distance(spark, d):
    v, p = geo.unit("latitude", "longitude"), geo.unit(40, -175)
    return rounded(usable_sites(spark, d).select("id", geo.angular_distance(v, p).alias("angular_deg"), geo.axial_distance(v, p).alias("axial_deg"), geo.plane_distance(v, p).alias("plane_deg")), 6)


_ROTATED = """k AS (SELECT cos(radians(40)) * cos(radians(-175)) AS kx, cos(radians(40)) * sin(radians(-175)) AS ky, sin(radians(40)) AS kz, radians(21) AS t), v AS (
    SELECT id, x * cos(t) + (ky * z - kz * y) * sin(t) + kx * (kx * x + ky * y + kz * z) * (1 - cos(t)) AS rx,
        y * cos(t) + (kz * x - kx * z) * sin(t) + ky * (kx * x + ky * y + kz * z) * (1 - cos(t)) AS ry,
        z * cos(t) + (kx * y - ky * x) * sin(t) + kz * (kx * x + ky * y + kz * z) * (1 - cos(t)) AS rz FROM u, k)"""


@query("rotated_sites", f"{W}, {_ROTATED} SELECT id, round(degrees(asin(greatest(-1, least(1, rz / sqrt(rx * rx + ry * ry + rz * rz))))), 6) + 0.0 AS lat, round(degrees(atan2(ry, rx)), 6) + 0.0 AS lon FROM v")
def rotated_sites(spark, d):
    v = geo.rotate(geo.unit("latitude", "longitude"), geo.unit(40, -175), 21)
    return rounded(usable_sites(spark, d).select("id", geo.latitude(v).alias("lat"), geo.longitude(v).alias("lon")), 6)


@query(
    "potential_anomaly",
    f"""{W}, p AS (SELECT sin(radians(23.1)) * cos(radians(109)) AS px, sin(radians(23.1)) * sin(radians(109)) AS py, cos(radians(23.1)) AS pz), a AS (
        SELECT id, 0.5 * 7.2921159e-5 * 7.2921159e-5 * 6371000.0 * 6371000.0 * ((x * px + y * py + z * pz) * (x * px + y * py + z * pz) - z * z) AS anomaly,
            -11000.0 * (z * z - (x * px + y * py + z * pz) * (x * px + y * py + z * pz)) AS predicted FROM u, p)
    SELECT id, round((anomaly - avg(anomaly) OVER ()) / stddev_pop(anomaly) OVER (), 6) + 0.0 AS anomaly_z, round(predicted, 5) + 0.0 AS predicted_m FROM a""",
)
def potential_anomaly(spark, d):
    v, p = geo.unit("latitude", "longitude"), geo.displaced_pole(23.1, 109)
    a = usable_sites(spark, d).select("id", geo.potential_anomaly(v, (F.lit(0.0), F.lit(0.0), F.lit(1.0)), p).alias("a"), geo.predicted_elevation(v, p, 11000).alias("predicted_m"))
    s = a.agg(F.struct(F.avg("a").alias("m"), F.stddev_pop("a").alias("s"))).scalar()
    out = a.withColumn("t", s).select("id", F.coalesce((F.col("a") - F.col("t.m")) / F.nullif(F.col("t.s"), F.lit(0.0)), F.lit(0.0)).alias("anomaly_z"), "predicted_m")
    return out.select("id", (F.round("anomaly_z", 6) + 0.0).alias("anomaly_z"), (F.round("predicted_m", 5) + 0.0).alias("predicted_m"))


@query("spatial_cells", f"{W} SELECT concat_ws('_', CAST(CAST(floor((latitude + 90) / 10) AS BIGINT) AS VARCHAR), CAST(CAST(floor((longitude + 180) / 20) AS BIGINT) AS VARCHAR)) AS spatial_cell, count(*) AS n, round(avg(z_m), 7) AS z_mean FROM u GROUP BY ALL")
def spatial_cells(spark, d):
    return rounded(usable_sites(spark, d).groupBy(geo.cell_key("latitude", "longitude").alias("spatial_cell")).agg(F.count("*").alias("n"), F.avg("z_m").alias("z_mean")))


@query("wrapped_longitudes", "SELECT c_custkey AS id, ((c_custkey * 7 % 1081 - 540) + 180) - 360.0::DOUBLE * floor(((c_custkey * 7 % 1081 - 540) + 180) / 360.0::DOUBLE) - 180 AS lon FROM customer")
def wrapped_longitudes(spark, d):
    return sites(spark, d).select("id", geo.wrap_longitude((F.col("id") * 7 % 1081 - 540).cast("double")).alias("lon"))


@query("displaced_pole_grid", f"""{W}, a AS (SELECT 0.5 + 2.5 * unnest(range(0, 18)) AS a), p AS (SELECT 5.0 * unnest(range(0, 72)) AS p), g AS (SELECT CAST(a AS DOUBLE) AS offset_deg, CAST(p AS DOUBLE) AS azimuth_deg, sin(radians(a)) * cos(radians(p)) AS px, sin(radians(a)) * sin(radians(p)) AS py, cos(radians(a)) AS pz FROM a, p),
    m AS (SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z FROM u) SELECT offset_deg, azimuth_deg, round(px, 9) + 0.0 AS px, round(py, 9) + 0.0 AS py, round(pz, 9) + 0.0 AS pz, round(degrees(acos(greatest(-1, least(1, (px * x + py * y + pz * z) / sqrt(x * x + y * y + z * z))))), 5) AS from_sites_deg FROM g, m""")
def displaced_pole_grid(spark, d):
    """The grid of displaced poles and each one's distance from the middle of the usable sites."""
    x, y, z = geo.unit("latitude", "longitude")
    middle = usable_sites(spark, d).agg(F.struct(F.avg(x).alias("x"), F.avg(y).alias("y"), F.avg(z).alias("z"))).scalar()
    g = spark.range(1).select(F.explode(geo.steps(0.5, 18, 2.5)).alias("offset_deg")).select("offset_deg", F.explode(geo.steps(0.0, 72, 5.0)).alias("azimuth_deg")).withColumn("m", middle)
    p, m = geo.displaced_pole("offset_deg", "azimuth_deg"), (F.col("m.x"), F.col("m.y"), F.col("m.z"))
    d_ = geo.angular_distance(p, tuple(c / F.sqrt(geo.dot(m, m)) for c in m))
    return rounded(g.select("offset_deg", "azimuth_deg", *(c.alias(n) for c, n in zip(p, ("px", "py", "pz"))), F.round(d_, 5).alias("from_sites_deg")), 9)


@query("lat_lon_slopes", f"{W}, l AS (SELECT 'lat' AS axis, latitude AS v, z_m FROM u UNION ALL SELECT 'lon', longitude, z_m FROM u UNION ALL SELECT 'abs_lat', abs(latitude), z_m FROM u) SELECT axis, regr_count(z_m, v) AS n, round(regr_slope(z_m, v), 7) AS slope, round(regr_intercept(z_m, v), 7) AS intercept, round(regr_r2(z_m, v), 9) AS r2, round(sqrt(regr_syy(z_m, v) * (1 - regr_r2(z_m, v)) / regr_count(z_m, v)), 7) AS rmse FROM l GROUP BY axis")
def lat_lon_slopes(spark, d):
    s = usable_sites(spark, d).select("z_m", F.explode(F.create_map(F.lit("lat"), F.col("latitude"), F.lit("lon"), F.col("longitude"), F.lit("abs_lat"), F.abs("latitude"))).alias("axis", "v"))
    f = s.groupBy("axis").agg(*(c.alias(n) for n, c in fits.line("z_m", "v").items()))
    return f.select("axis", "n", *(F.round(c, 9 if c == "r2" else 7).alias(c) for c in ("slope", "intercept", "r2", "rmse")))


_HARMONICS = """h AS (SELECT k, z_m, cos(k * radians(longitude)) AS c, sin(k * radians(longitude)) AS s FROM u, (SELECT unnest(range(1, 13)) AS k)), m AS (
    SELECT k, count(*) AS n, covar_pop(c, c) AS cc, covar_pop(s, s) AS ss, covar_pop(c, s) AS cs, covar_pop(c, z_m) AS cz, covar_pop(s, z_m) AS sz, var_pop(z_m) AS zz FROM h GROUP BY k), f AS (
    SELECT k, n, zz, cz, sz, (cz * ss - sz * cs) / (cc * ss - cs * cs) AS b, (sz * cc - cz * cs) / (cc * ss - cs * cs) AS a FROM m), g AS (
    SELECT CAST(k AS INTEGER) AS k, n, round((b * cz + a * sz) / zz, 8) AS r2, round(b, 6) + 0.0 AS cos_coeff, round(a, 6) + 0.0 AS sin_coeff, round(sqrt(a * a + b * b), 6) AS amplitude_m, round(degrees(atan2(-a, b)), 5) AS phase_deg FROM f)"""


def _harmonics(spark, d):
    h = fits.harmonics(usable_sites(spark, d), 12)
    return h.select("k", "n", *((F.round(c, p) + 0.0).alias(c) for c, p in (("r2", 8), ("cos_coeff", 6), ("sin_coeff", 6), ("amplitude_m", 6), ("phase_deg", 5))))


query("harmonic_scan", f"{W}, {_HARMONICS} SELECT * FROM g")(_harmonics)


@query("best_harmonic", f"{W}, {_HARMONICS} SELECT k, r2 FROM g ORDER BY r2 DESC, k LIMIT 1")
def best_harmonic(spark, d):
    return fits.best(_harmonics(spark, d), ties=["k"]).select("k", "r2")


def _spherical_sql(group: str, source: str = "u", where: str = "") -> str:
    by = f"{group}, " if group else ""
    return f"""m AS (SELECT {by}count(*) AS n, covar_pop(x,x) AS a, covar_pop(x,y) AS b, covar_pop(x,z) AS c, covar_pop(y,y) AS d, covar_pop(y,z) AS e, covar_pop(z,z) AS f,
        covar_pop(x,z_m) AS p, covar_pop(y,z_m) AS q, covar_pop(z,z_m) AS r, var_pop(z_m) AS t FROM {source} {where} {f"GROUP BY {group}" if group else ""}), i AS (
        SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM m), g AS (
        SELECT *, (p * (d * f - e * e) - b * (q * f - e * r) + c * (q * e - d * r)) / det AS gx, (a * (q * f - r * e) - p * (b * f - c * e) + c * (b * r - c * q)) / det AS gy,
            (a * (d * r - e * q) - b * (b * r - c * q) + p * (b * e - c * d)) / det AS gz FROM i WHERE abs(det) > 1e-12)"""


_FIT = "round((gx * p + gy * q + gz * r) / t, 8) AS r2, round(sqrt(gx * gx + gy * gy + gz * gz), 5) AS gradient_norm, round(degrees(asin(gz / sqrt(gx * gx + gy * gy + gz * gz))), 5) AS axis_lat, round(degrees(atan2(gy, gx)), 5) AS axis_lon"


def _fit_columns(df, *keys):
    return df.filter("r2 IS NOT NULL").select(*keys, "n", F.round("r2", 8).alias("r2"), F.round("gradient_norm", 5).alias("gradient_norm"), F.round("axis_lat", 5).alias("axis_lat"), F.round("axis_lon", 5).alias("axis_lon"))


@query("spherical_fit", f"{W}, {_spherical_sql('')} SELECT n, {_FIT} FROM g")
def spherical_fit(spark, d):
    return _fit_columns(fits.spherical(usable_sites(spark, d)))


@query("group_fits", f"{W}, l AS (SELECT 'record_class' AS kind, record_class AS grp, * FROM u UNION ALL SELECT 'source_id', CAST(source_id AS VARCHAR), * FROM u UNION ALL SELECT 'depth_regime', CASE WHEN z_m < -200 THEN 'deepwater' ELSE 'shelf' END, * FROM u), {_spherical_sql('kind, grp', 'l', 'WHERE grp IS NOT NULL')} SELECT kind, grp AS \"group\", n, {_FIT} FROM g WHERE n >= 12")
def group_fits(spark, d):
    keys = F.create_map(F.lit("record_class"), F.col("record_class"), F.lit("source_id"), F.col("source_id").cast("string"), F.lit("depth_regime"), records.depth_regime(F.col("z_m")))
    s = usable_sites(spark, d).select("*", F.explode(keys).alias("kind", "group")).filter("`group` IS NOT NULL")
    return _fit_columns(fits.spherical(s, ["kind", "group"]).filter("n >= 12"), "kind", "group")


_OUT = """k AS (SELECT {key} AS left_out, count(*) AS left_out_n FROM u GROUP BY 1 HAVING count(*) >= {least}), l AS (SELECT left_out, left_out_n, u.* FROM k JOIN u ON {key} <> left_out)"""


@query("leave_one_source_out", f"{W}, {_OUT.format(key='source_id', least=12)}, {_spherical_sql('left_out, left_out_n', 'l')} SELECT left_out, left_out_n, n, {_FIT} FROM g")
def leave_one_source_out(spark, d):
    return _fit_columns(fits.leave_one_out(usable_sites(spark, d), "source_id", 12), "left_out", "left_out_n")


_CELL = "concat_ws('_', CAST(CAST(floor((latitude + 90) / 10) AS BIGINT) AS VARCHAR), CAST(CAST(floor((longitude + 180) / 20) AS BIGINT) AS VARCHAR))"


@query("leave_one_cell_out", f"{W}, {_OUT.format(key=_CELL, least=2)}, {_spherical_sql('left_out, left_out_n', 'l')} SELECT left_out, left_out_n, n, {_FIT} FROM g")
def leave_one_cell_out(spark, d):
    return _fit_columns(fits.leave_one_out(usable_sites(spark, d).withColumn("spatial_cell", geo.cell_key("latitude", "longitude")), "spatial_cell", 2), "left_out", "left_out_n")


#: Candidate axes by name.
AXES = (("equator_0", 0.0, 0.0), ("equator_90e", 0.0, 90.0), ("north", 90.0, 0.0), ("rotation_best", 40.0, -175.0), ("plane_best", -32.0, -74.0), ("deepwater_plane", 38.0, 64.0))
_AXES_SQL = "axes(name, axis_lat, axis_lon) AS (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {o}::DOUBLE)" for n, a, o in AXES) + ")"
_DOT = "x * cos(radians(axis_lat)) * cos(radians(axis_lon)) + y * cos(radians(axis_lat)) * sin(radians(axis_lon)) + z * sin(radians(axis_lat))"


@query("axis_scores", f"{W}, {_AXES_SQL}, p AS (SELECT name, axis_lat, axis_lon, z_m, {_DOT} AS v FROM u, axes) SELECT name, axis_lat, axis_lon, regr_count(z_m, v) AS n, round(regr_slope(z_m, v), 6) AS slope, round(regr_r2(z_m, v), 8) AS r2 FROM p GROUP BY ALL")
def axis_scores(spark, d):
    axes = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(a).alias("axis_lat"), F.lit(o).alias("axis_lon")) for n, a, o in AXES))
    s = usable_sites(spark, d).select("latitude", "longitude", "z_m", F.explode(axes).alias("a")).select("*", "a.*")
    s = s.withColumn("v", geo.dot(geo.unit("latitude", "longitude"), geo.unit("axis_lat", "axis_lon")))
    f = fits.line("z_m", "v")
    return s.groupBy("name", "axis_lat", "axis_lon").agg(f["n"].alias("n"), F.round(f["slope"], 6).alias("slope"), F.round(f["r2"], 8).alias("r2"))


_SCAN = f"""{W}, la AS (SELECT -88.0::DOUBLE + 4 * unnest(range(0, 45)) AS pole_lat), lo AS (SELECT -180.0::DOUBLE + 4 * unnest(range(0, 90)) AS pole_lon), p AS (
    SELECT pole_lat, pole_lon, cos(radians(pole_lat)) * cos(radians(pole_lon)) AS nx, cos(radians(pole_lat)) * sin(radians(pole_lon)) AS ny, sin(radians(pole_lat)) AS nz FROM la, lo), r AS (
    SELECT pole_lat, pole_lon, count(*) AS n, regr_r2(z_m, degrees(asin(greatest(-1, least(1, x * nx + y * ny + z * nz))))) AS r2, regr_slope(z_m, degrees(asin(greatest(-1, least(1, x * nx + y * ny + z * nz))))) AS slope FROM u, p GROUP BY pole_lat, pole_lon)"""


@query("plane_rescan", f"{_SCAN} SELECT pole_lat, pole_lon, n, round(r2, 8) AS r2, round(slope, 7) + 0.0 AS slope FROM r")
def plane_rescan(spark, d):
    r = fits.plane_rescan(usable_sites(spark, d))
    return r.select("pole_lat", "pole_lon", "n", F.round("r2", 8).alias("r2"), (F.round("slope", 7) + 0.0).alias("slope"))


@query("best_plane", f"{_SCAN} SELECT pole_lat, pole_lon, n, round(r2, 8) AS r2 FROM r ORDER BY round(r2, 10) DESC, pole_lat, pole_lon LIMIT 1")
def best_plane(spark, d):
    b = fits.best(fits.plane_rescan(usable_sites(spark, d)))
    return b.select("pole_lat", "pole_lon", "n", F.round("r2", 8).alias("r2"))


@query("r2_grid_surface", f"{_SCAN} PIVOT_PLACEHOLDER".replace("PIVOT_PLACEHOLDER", "SELECT pole_lat, " + ", ".join(f"round(max(CASE WHEN pole_lon = {lon} THEN r2 END), 8) AS \"lon_{lon}\"" for lon in range(-180, 180, 60)) + " FROM r GROUP BY pole_lat"))
def r2_grid_surface(spark, d):
    lons = list(range(-180, 180, 60))
    r = fits.plane_rescan(usable_sites(spark, d)).filter(F.col("pole_lon").isin(*map(float, lons))).withColumn("lon", F.col("pole_lon").cast("int"))
    p = r.groupBy("pole_lat").pivot("lon", lons).agg(F.round(F.max("r2"), 8))
    return p.select("pole_lat", *(F.col(f"`{x}`").alias(f"lon_{x}") for x in lons))


_ONE = "one AS (SELECT 1 AS g, u.* FROM u)"


@query("spectral_table", f"""{RECURSIVE}, {_ONE}, {least_squares_sql('one', ['g'], TERMS_SQL, (4, 9, 16))}, l AS (SELECT CAST(sqrt(d) AS BIGINT) - 1 AS degree, * FROM ls)
    SELECT degree, n, round(r2, 8) AS r2, round(r2 - coalesce(lag(r2) OVER (ORDER BY degree), 0), 8) AS gain, round(sqrt(list_sum(list_transform(beta[degree * degree + 1 : d], lambda b: b * b))), 6) AS degree_norm FROM l""")
def spectral_table(spark, d):
    s = fits.spectral(usable_sites(spark, d), 3)
    return s.select("degree", "n", F.round("r2", 8).alias("r2"), F.round("gain", 8).alias("gain"), F.round("degree_norm", 6).alias("degree_norm"))


@query("quadrupole_eigen", f"""{RECURSIVE}, {_ONE}, {least_squares_sql('one', ['g'], TERMS_SQL, (9,))}, c AS (SELECT beta[9] - beta[7] AS a, -beta[9] - beta[7] AS b, 2 * beta[7] AS c, beta[5] / 2 AS d, beta[8] / 2 AS e, beta[6] / 2 AS f FROM ls),
    t AS (SELECT *, sqrt((a * a + b * b + c * c + 2 * (d * d + e * e + f * f)) / 6) AS p FROM c), h AS (SELECT *, acos(greatest(-1, least(1, (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / (2 * p * p * p)))) / 3 AS phi FROM t),
    v AS (SELECT *, unnest([2 * p * cos(phi), 2 * p * cos(phi - 2 * pi() / 3), 2 * p * cos(phi + 2 * pi() / 3)]) AS value FROM h),
    w AS (SELECT value, unnest([[d * f - e * (b - value), e * d - (a - value) * f, (a - value) * (b - value) - d * d], [d * (c - value) - e * f, e * e - (a - value) * (c - value), (a - value) * f - e * d], [(b - value) * (c - value) - f * f, f * e - d * (c - value), d * f - (b - value) * e]]) AS x FROM v),
    k AS (SELECT value, arg_max(x, list_inner_product(x, x)) AS x FROM w GROUP BY value), o AS (SELECT value, CASE WHEN x[3] < 0 THEN list_transform(x, lambda y: -y) ELSE x END AS x FROM k)
    SELECT CAST(row_number() OVER (ORDER BY value DESC) AS INTEGER) AS rank, round(value, 6) AS eigenvalue, round(degrees(atan2(x[3], sqrt(x[1] * x[1] + x[2] * x[2]))), 4) AS axis_lat, round(degrees(atan2(x[2], x[1])), 4) AS axis_lon FROM o""")
def quadrupole_eigen(spark, d):
    return fits.quadrupole(usable_sites(spark, d)).select("rank", F.round("eigenvalue", 6).alias("eigenvalue"), F.round("axis_lat", 4).alias("axis_lat"), F.round("axis_lon", 4).alias("axis_lon"))


# The scan's axes (every 5 degrees), angles (every 2) and penalties.
SCAN_AXES = [(lat, lon) for lat in range(-60, 61, 5) for lon in range(-180, 180, 5)]
SCAN_ANGLES = range(1, 121, 2)
SCAN_PENALTIES = (0.1, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1000.0, 3000.0, 10_000.0, 30_000.0, 100_000.0)


def ridge_scan(spark, d):
    return fits.rotation_scan(usable_sites(spark, d), SCAN_AXES, SCAN_ANGLES, SCAN_PENALTIES)


@query("rotation_ridge_scan")
def rotation_ridge_scan(spark, d):
    """The 250 best of all 1 296 000 candidates, a report of fixed length."""
    return ridge_scan(spark, d).withColumn("_r", F.round("r2", 9)).orderBy(F.desc("_r"), "axis_lat", "axis_lon", "angle_deg", "lambda_q").limit(250).drop("_r")


@query("conservative_rotation")
def conservative_rotation(spark, d):
    """The best candidate with a penalty of 100 or more, else the best of all; of equal ones the first axis, angle and penalty."""
    scan = ridge_scan(spark, d)
    key = F.struct(F.col("lambda_q") < 100, -F.round("r2", 9), *fits.CANDIDATE)
    return scan.agg(F.min_by(F.struct(*scan.columns), key).alias("b")).select("b.*")


_RANK = "rank() OVER (PARTITION BY cid ORDER BY {0}) + (count(*) OVER (PARTITION BY cid, {0}) - 1) / 2.0::DOUBLE"
_QUADRUPOLE = ("x * y", "y * z", "3 * z * z - 1", "x * z", "x * x - y * y")


@query("rotation_scores", f"""{RECURSIVE}, ax(axis_lat, axis_lon) AS (VALUES (40.0::DOUBLE, -175.0::DOUBLE), (0.0, 30.0), (32.0, -74.0)), cd AS (SELECT row_number() OVER () AS cid, *, cos(radians(axis_lat)) * cos(radians(axis_lon)) AS a0, cos(radians(axis_lat)) * sin(radians(axis_lon)) AS a1, sin(radians(axis_lat)) AS a2
        FROM ax, (SELECT unnest([21.0::DOUBLE, 43.0]) AS angle_deg), (SELECT unnest([0.1::DOUBLE, 10.0, 1000.0]) AS lambda_q)),
    po AS (SELECT *, a1 * sin(radians(angle_deg)) + a0 * a2 * (1 - cos(radians(angle_deg))) AS p0, -a0 * sin(radians(angle_deg)) + a1 * a2 * (1 - cos(radians(angle_deg))) AS p1, cos(radians(angle_deg)) + a2 * a2 * (1 - cos(radians(angle_deg))) AS p2 FROM cd),
    an AS (SELECT po.*, x, y, z, z_m, pow(x * p0 + y * p1 + z * p2, 2) - z * z AS anomaly FROM u, po), sc AS (SELECT *, anomaly / greatest(stddev_pop(anomaly) OVER (PARTITION BY cid), 1e-6) AS rot FROM an),
    {least_squares_sql('sc', ['cid', 'lambda_q'], ('1', 'rot', *_QUADRUPOLE), (7,), ridge='CASE WHEN i = 1 THEN 0 WHEN i = 2 THEN 1e-9 ELSE lambda_q END')},
    pr AS (SELECT sc.*, beta, n, list_inner_product(beta, [1.0::DOUBLE, rot, {', '.join(_QUADRUPOLE)}]) AS pred FROM sc JOIN ls USING (cid)),
    rk AS (SELECT *, {_RANK.format('z_m')} AS rz, {_RANK.format('round(pred, 9)')} AS rp, {_RANK.format('round(rot, 12)')} AS rr FROM pr)
    SELECT axis_lat, axis_lon, angle_deg, lambda_q, round(degrees(asin(greatest(-1, least(1, any_value(p2))))), 6) AS rotated_pole_lat, round(degrees(atan2(any_value(p1), any_value(p0))), 6) AS rotated_pole_lon, count(*) AS n,
        round(1 - sum(pow(z_m - pred, 2)) / (count(*) * var_pop(z_m)), 7) AS r2, round(sqrt(avg(pow(z_m - pred, 2))), 6) AS rmse, round(any_value(beta)[1], 5) AS intercept, round(any_value(beta)[2], 5) AS rotation_coeff,
        round(sqrt(list_sum(list_transform(any_value(beta)[3:7], lambda b: b * b))), 5) AS quadrupole_norm, {', '.join(f'round(any_value(beta)[{i}], 5) AS q_{k}' for i, k in enumerate(('xy', 'yz', 'z2', 'xz', 'x2y2'), 3))},
        round(avg(abs(z_m - pred)), 6) AS mae, round(corr(rp, rz), 7) AS spearman, round(corr(rr, rz), 7) AS rotation_spearman FROM rk GROUP BY cid, axis_lat, axis_lon, angle_deg, lambda_q""")
def rotation_scores(spark, d):
    """The fixed reference turns in full: fit, pole, coefficients, errors and rank correlations, for each penalty."""
    s = usable_sites(spark, d)
    out = fits.rotation_scores(s, fits.rotation_scan(s, [(40, -175), (0, 30), (32, -74)], (21, 43), (0.1, 10.0, 1000.0)))
    digits = {"rotated_pole_lat": 6, "rotated_pole_lon": 6, "rmse": 6, "mae": 6, "r2": 7, "spearman": 7, "rotation_spearman": 7, "n": None, **dict.fromkeys(fits.CANDIDATE)}
    return out.select(*(F.col(c) if digits.get(c, 5) is None else F.round(c, digits.get(c, 5)).alias(c) for c in out.columns))


@query("residual_fit", f"""{RECURSIVE}, {_ONE}, {least_squares_sql('one', ['g'], TERMS_SQL, (4, 9))}, rd AS (SELECT one.*, z_m - (beta[1] + beta[2] * x + beta[3] * y + beta[4] * z) AS resid FROM one JOIN ls USING (g) WHERE d = 4), {least_squares_sql('rd', ['g'], ('1', *_QUADRUPOLE), (6,), 'resid', 'l2')}
    SELECT a.n, round(a.r2, 8) AS r2_l1, round(b.r2, 8) AS r2_l1_l2, round(l2.r2, 8) AS r2_residual_l2, round(a.r2 + (1 - a.r2) * l2.r2, 8) AS r2_two_steps FROM ls a, ls b, l2 WHERE a.d = 4 AND b.d = 9""")
def residual_fit(spark, d):
    return rounded(fits.residual_fit(usable_sites(spark, d)), 8)


@query("influence_top25", f"""{RECURSIVE}, {_ONE}, {least_squares_sql('one', ['g'], TERMS_SQL[:4], (4,))}, v AS (SELECT id, z_m, [1.0::DOUBLE, x, y, z] AS f, beta, inverse, n FROM one JOIN ls USING (g)),
    l AS (SELECT id, n, list_inner_product(f, list_transform(inverse, lambda r: list_inner_product(r, f))) AS h, z_m - list_inner_product(f, beta) AS e FROM v), k AS (SELECT *, sum(e * e) OVER () / greatest(n - 4, 1) AS s2 FROM l), c AS (SELECT id, h, e, e * e / (4 * s2) * h / ((1 - h) * (1 - h)) AS cook FROM k)
    SELECT id, round(h, 8) AS leverage, round(e, 7) + 0.0 AS residual, round(cook, 8) AS influence FROM c ORDER BY cook DESC, id LIMIT 25""")
def influence_top25(spark, d):
    i = fits.influence(usable_sites(spark, d))
    return i.select("id", F.round("leverage", 8).alias("leverage"), (F.round("residual", 7) + 0.0).alias("residual"), F.round("influence", 8).alias("influence"))
