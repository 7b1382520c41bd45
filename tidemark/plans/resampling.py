"""Queries: ranks, quantiles, resampling, fields, paths and preference grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.functions.placing import numbered
from tidemark.operators import fields, fits, records, statistics
from tidemark.plans.analysis import EDGES, BINS_SQL, W, rounded
from tidemark.plans.least_squares import RECURSIVE, TERMS_SQL, least_squares_sql
from tidemark.plans.registry import query, table
from tidemark.sources.sites import usable_sites


def md5_sql(*parts: str) -> str:
    return "md5(concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "))"


def uniform_sql(digest: str) -> str:
    return f"(CAST(('0x' || substr({digest}, 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)"


@query("trimmed", f"{W}, q AS (SELECT quantile_cont(z_m, 0.02) AS a, quantile_cont(z_m, 0.98) AS b FROM u) SELECT id, round(z_m, 7) AS z_m FROM u, q WHERE z_m BETWEEN a AND b")
def trimmed(spark, d):
    return rounded(statistics.trim(usable_sites(spark, d)).select("id", "z_m"))


@query("distribution_summary", f"{W}, l AS (SELECT record_class, 'z_m' AS metric, z_m AS v FROM u UNION ALL SELECT record_class, 'latitude', latitude FROM u) SELECT record_class, metric, count(*) AS n, round(avg(v), 7) AS mean, round(quantile_cont(v, 0.5), 7) AS median, round(quantile_cont(v, 0.05), 7) AS p05, round(quantile_cont(v, 0.25), 7) AS p25, round(quantile_cont(v, 0.75), 7) AS p75, round(quantile_cont(v, 0.95), 7) AS p95 FROM l GROUP BY record_class, metric")
def distribution_summary(spark, d):
    return rounded(statistics.summary(usable_sites(spark, d), ["z_m", "latitude"], ["record_class"]))


_RANKS = """r AS (SELECT *, rank() OVER (PARTITION BY record_class ORDER BY round(z_m)) + (count(*) OVER (PARTITION BY record_class, round(z_m)) - 1) / 2.0::DOUBLE AS rz,
    rank() OVER (PARTITION BY record_class ORDER BY latitude) + (count(*) OVER (PARTITION BY record_class, latitude) - 1) / 2.0::DOUBLE AS rl FROM u)"""


@query("average_ranks", f"{W}, {_RANKS} SELECT id, record_class, rz AS z_rank FROM r")
def average_ranks(spark, d):
    s = usable_sites(spark, d).withColumn("zr", F.round("z_m"))
    return statistics.average_rank(s, "zr", "z_rank", ["record_class"]).select("id", "record_class", "z_rank")


@query("spearman", f"{W}, {_RANKS} SELECT record_class, count(*) AS n, round(corr(rz, rl), 9) AS spearman FROM r GROUP BY record_class")
def spearman(spark, d):
    return rounded(statistics.spearman(usable_sites(spark, d).withColumn("z_m", F.round("z_m")), "z_m", "latitude", ["record_class"]), 9)


@query("gamma", f"{W}, v AS (SELECT round(z_m / 10) AS x, floor(latitude / 5) AS y FROM u), p AS (SELECT sign(a.y - b.y) AS s FROM v a JOIN v b ON a.x > b.x) SELECT CAST(sum(CASE WHEN s > 0 THEN 1 ELSE 0 END) AS BIGINT) AS concordant, CAST(sum(CASE WHEN s < 0 THEN 1 ELSE 0 END) AS BIGINT) AS discordant, round(sum(s) / CAST(sum(abs(s)) AS DOUBLE), 9) AS gamma FROM p")
def gamma(spark, d):
    s = usable_sites(spark, d).select(F.round(F.col("z_m") / 10).alias("x"), F.floor(F.col("latitude") / 5).alias("y"))
    return rounded(statistics.gamma(s, "x", "y"), 9)


REPS = 20


def _permute_sql(within: str = "") -> str:
    by = f"rep{within}"
    return f"""e AS (SELECT rep, u.*, {'_CELL_' if within else "''"} AS cell FROM u, (SELECT unnest(range(1, {REPS + 1})) AS rep)), a AS (
        SELECT rep, cell, x, y, z, row_number() OVER (PARTITION BY {by} ORDER BY {md5_sql("'p'", 'rep', 'id')}, id) AS k FROM e), b AS (
        SELECT rep, cell, z_m, row_number() OVER (PARTITION BY {by} ORDER BY id) AS k FROM e), j AS (SELECT a.*, z_m FROM a JOIN b ON a.rep = b.rep AND a.cell = b.cell AND a.k = b.k)"""


def _null_fits(perm):
    s = perm.withColumn("v", geo.dot(geo.unit("latitude", "longitude"), geo.unit(40, -175)))
    return s.groupBy("rep").agg(F.regr_r2("z_m", "v").alias("r2"))


_DOT = "(x * cos(radians(40)) * cos(radians(-175)) + y * cos(radians(40)) * sin(radians(-175)) + z * sin(radians(40)))"


@query("permute_global", f"{W}, {_permute_sql()} SELECT CAST(rep AS INTEGER) AS rep, round(regr_r2(z_m, {_DOT}), 9) AS r2 FROM j GROUP BY rep")
def permute_global(spark, d):
    return rounded(_null_fits(statistics.permuted(usable_sites(spark, d), "z_m", "id", REPS, "p")), 9)


@query("permute_cells", f"{W}, {_permute_sql(', cell').replace('_CELL_', 'CAST(CAST(floor((latitude + 90) / 45) AS BIGINT) AS VARCHAR)')} SELECT CAST(rep AS INTEGER) AS rep, round(regr_r2(z_m, {_DOT}), 9) AS r2 FROM j GROUP BY rep")
def permute_cells(spark, d):
    s = usable_sites(spark, d).withColumn("cell", F.floor((F.col("latitude") + 90) / 45))
    return rounded(_null_fits(statistics.permuted(s, "z_m", "id", REPS, "p", ["cell"])), 9)


@query("p_values", f"{W}, {_permute_sql()}, n AS (SELECT rep, regr_r2(z_m, {_DOT}) AS r2 FROM j GROUP BY rep), o AS (SELECT regr_r2(z_m, {_DOT}) AS obs FROM u) SELECT round(max(obs), 9) AS observed, round((sum(CASE WHEN r2 >= obs THEN 1 ELSE 0 END) + 1) / CAST(count(*) + 1 AS DOUBLE), 9) AS p, round(quantile_cont(r2, 0.5), 9) AS null_median, round(quantile_cont(r2, 0.95), 9) AS null_p95 FROM n, o")
def p_values(spark, d):
    s = usable_sites(spark, d)
    observed = s.agg(F.regr_r2("z_m", geo.dot(geo.unit("latitude", "longitude"), geo.unit(40, -175)))).scalar()
    nulls = _null_fits(statistics.permuted(s, "z_m", "id", REPS, "p")).withColumn("obs", observed)
    return rounded(nulls.agg(F.max("obs").alias("observed"), statistics.p_greater(F.col("r2"), F.col("obs")).alias("p"), F.percentile("r2", F.lit(0.5)).alias("null_median"), F.percentile("r2", F.lit(0.95)).alias("null_p95")), 9)


@query("bootstrap_rows", f"{W}, i AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM u), dr AS (SELECT rep, CAST(floor({uniform_sql(md5_sql(chr(39) + 'b' + chr(39), 'rep', 'i'))} * n) AS BIGINT) AS i FROM i, (SELECT unnest(range(1, {REPS + 1})) AS rep)) SELECT CAST(rep AS INTEGER) AS rep, count(*) AS n, round(avg(z_m), 7) AS z_mean, round(regr_r2(z_m, latitude), 9) AS r2 FROM dr JOIN i USING (i) GROUP BY rep")
def bootstrap_rows(spark, d):
    b = statistics.bootstrap_rows(usable_sites(spark, d), "id", REPS, "b")
    return b.groupBy("rep").agg(F.count("*").alias("n"), F.round(F.avg("z_m"), 7).alias("z_mean"), F.round(F.regr_r2("z_m", "latitude"), 9).alias("r2"))


@query("bootstrap_source_block", f"{W}, g AS (SELECT source_id, row_number() OVER (ORDER BY source_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT source_id FROM u)), dr AS (SELECT rep, CAST(floor({uniform_sql(md5_sql(chr(39) + 'g' + chr(39), 'rep', 'i'))} * n) AS BIGINT) AS i FROM g, (SELECT unnest(range(1, {REPS + 1})) AS rep)) SELECT CAST(rep AS INTEGER) AS rep, count(*) AS n, count(DISTINCT source_id) AS n_sources, round(avg(z_m), 7) AS z_mean FROM dr JOIN g USING (i) JOIN u USING (source_id) GROUP BY rep")
def bootstrap_source_block(spark, d):
    b = statistics.bootstrap_groups(usable_sites(spark, d), "source_id", REPS, "g")
    return b.groupBy("rep").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("n_sources"), F.round(F.avg("z_m"), 7).alias("z_mean"))


@query("bootstrap_one_per_cell", f"{W}, c AS (SELECT rep, u.*, floor((latitude + 90) / 10) AS a, floor((longitude + 180) / 20) AS b FROM u, (SELECT unnest(range(1, {REPS + 1})) AS rep)), r AS (SELECT *, row_number() OVER (PARTITION BY rep, a, b ORDER BY {md5_sql(chr(39) + 'c' + chr(39), 'rep', 'id')}, id) AS k FROM c), t AS (SELECT *, row_number() OVER (PARTITION BY rep, source_id ORDER BY {md5_sql(chr(39) + 's' + chr(39), 'rep', 'id')}, id) AS k2 FROM r WHERE k = 1) SELECT CAST(rep AS INTEGER) AS rep, count(*) AS n_cells, round(avg(z_m), 7) AS z_mean, sum(CASE WHEN k2 = 1 THEN 1 ELSE 0 END)::BIGINT AS n_sources, round(avg(CASE WHEN k2 = 1 THEN z_m END), 7) AS z_mean_sources FROM t GROUP BY rep")
def bootstrap_one_per_cell(spark, d):
    """One row per cell, then of those one per source."""
    s = usable_sites(spark, d).withColumn("cell", geo.cell_key("latitude", "longitude"))
    cells = statistics.one_per_group(s, ["cell"], "id", REPS, "c")
    least = F.min_by("z_m", F.struct(statistics.draw("s", F.col("rep"), F.col("id")), F.col("id")))
    per_source = cells.groupBy("rep", "source_id").agg(least.alias("z_m")).groupBy("rep").agg(F.count("*").alias("n_sources"), F.round(F.avg("z_m"), 7).alias("z_mean_sources"))
    return cells.groupBy("rep").agg(F.count("*").alias("n_cells"), F.round(F.avg("z_m"), 7).alias("z_mean")).join(per_source, "rep")


@query("bootstrap_summary", f"{W}, i AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM u), dr AS (SELECT rep, CAST(floor({uniform_sql(md5_sql(chr(39) + 'b' + chr(39), 'rep', 'i'))} * n) AS BIGINT) AS i FROM i, (SELECT unnest(range(1, {REPS + 1})) AS rep)), b AS (SELECT rep, round(avg(z_m), 7) AS z_mean, round(regr_r2(z_m, latitude), 7) AS r2 FROM dr JOIN i USING (i) GROUP BY rep), l AS (SELECT 'z_mean' AS metric, z_mean AS v FROM b UNION ALL SELECT 'r2', r2 FROM b) SELECT metric, count(*) AS n, round(avg(v), 9) AS mean, round(quantile_cont(v, 0.5), 9) AS median, round(quantile_cont(v, 0.05), 9) AS p05, round(quantile_cont(v, 0.25), 9) AS p25, round(quantile_cont(v, 0.75), 9) AS p75, round(quantile_cont(v, 0.95), 9) AS p95 FROM l GROUP BY metric")
def bootstrap_summary(spark, d):
    """Of values with 7 digits, whose means and quantiles over 20 draws end within 9, so that none lies between two results of rounding."""
    b = statistics.bootstrap_rows(usable_sites(spark, d), "id", REPS, "b").groupBy("rep").agg(F.round(F.avg("z_m"), 7).alias("z_mean"), F.round(F.regr_r2("z_m", "latitude"), 7).alias("r2"))
    return rounded(statistics.summary(b, ["z_mean", "r2"]), 9)


#: Intercept and gradient of the smooth field.
FIELD = (19.4268163, -0.49025260, -2.33584766, -1.45900941)
_FIELD_SQL = """la AS (SELECT -60.0::DOUBLE + 5 * unnest(range(0, 25)) AS lat), lo AS (SELECT -180.0::DOUBLE + 5 * unnest(range(0, 72)) AS lon), f AS (
    SELECT lat, lon, 19.4268163::DOUBLE - 0.49025260::DOUBLE * cos(radians(lat)) * cos(radians(lon)) - 2.33584766::DOUBLE * cos(radians(lat)) * sin(radians(lon)) - 1.45900941::DOUBLE * sin(radians(lat)) AS m FROM la, lo)"""


def field(spark):
    g = spark.range(1).select(F.explode(geo.steps(-60.0, 25, 5.0)).alias("lat")).select("lat", F.explode(geo.steps(-180.0, 72, 5.0)).alias("lon"))
    x, y, z = geo.unit("lat", "lon")
    return g.withColumn("m", FIELD[0] + FIELD[1] * x + FIELD[2] * y + FIELD[3] * z)


_SITE_FIELD_SQL = "f AS (SELECT latitude AS lat, longitude AS lon, min(z_m) AS m FROM u GROUP BY latitude, longitude)"


def site_field(spark, d):
    """The usable sites' places with their least z, as a field."""
    return usable_sites(spark, d).groupBy(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).agg(F.min("z_m").alias("m"))


@query("field_summary", f"{W}, {_SITE_FIELD_SQL} SELECT count(*) AS n, round(min(m), 6) AS m_min, round(max(m), 6) AS m_max, round((min(m) + max(m)) / 2, 6) AS m_mid, round(avg(m), 6) AS m_mean, round(quantile_cont(m, 0.5), 6) AS m_median FROM f")
def field_summary(spark, d):
    return site_field(spark, d).agg(F.count("*").alias("n"), *(F.round(c, 6).alias(n) for n, c in (("m_min", F.min("m")), ("m_max", F.max("m")), ("m_mid", (F.min("m") + F.max("m")) / 2), ("m_mean", F.avg("m")), ("m_median", F.percentile("m", F.lit(0.5))))))


@query("field_correlation", f"""{RECURSIVE}, one AS (SELECT 1 AS g, u.* FROM u), {least_squares_sql('one', ['g'], TERMS_SQL[:4], (4,))}, c AS (SELECT floor((latitude + 90) / 10) * 10 - 85 AS lat, floor((longitude + 180) / 20) * 20 - 170 AS lon, avg(z_m) AS m FROM u GROUP BY 1, 2),
    p AS (SELECT m, beta[1] + beta[2] * cos(radians(lat)) * cos(radians(lon)) + beta[3] * cos(radians(lat)) * sin(radians(lon)) + beta[4] * sin(radians(lat)) AS e FROM c, ls)
    SELECT count(*) AS n, round(corr(e, m), 7) AS pearson, round(min(e), 5) AS e_min, round(max(e), 5) AS e_max, round((min(e) + max(e)) / 2, 5) AS e_mid, round(avg(e), 5) AS e_mean, round(quantile_cont(e, 0.5), 5) AS e_median FROM p""")
def field_correlation(spark, d):
    """Two fields on one grid: the spherical fit's values at the centers of 10 by 20 degree cells, and the mean z of the sites in them."""
    s = usable_sites(spark, d)
    beta = fits.grouped_fits(s.withColumn("g", F.lit(1)), ["g"], fits.harmonic_terms(1)).select("coefficients").scalar()
    lat, lon = F.floor((F.col("latitude") + 90) / 10) * 10 - 85, F.floor((F.col("longitude") + 180) / 20) * 20 - 170
    cells = s.groupBy(lat.cast("double").alias("lat"), lon.cast("double").alias("lon")).agg(F.avg("z_m").alias("m"))
    return fields.correlated(cells.withColumn("b", beta).withColumn("e", F.col("b")[0] + geo.dot(geo.unit("lat", "lon"), tuple(F.col("b")[i] for i in (1, 2, 3)))), "e", "m").select("n", F.round("pearson", 7).alias("pearson"), *(F.round(f"e_{x}", 5).alias(f"e_{x}") for x in ("min", "max", "mid", "mean", "median")))


@query("field_geometry", f"{W}, {_SITE_FIELD_SQL}, q AS (SELECT quantile_cont(m, 0.9) AS a, quantile_cont(m, 0.1) AS b FROM f), p AS (SELECT 'top' AS part, lat, lon, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM f, q WHERE m >= a UNION ALL SELECT 'bottom', lat, lon, cos(radians(lat)) * cos(radians(lon)), cos(radians(lat)) * sin(radians(lon)), sin(radians(lat)) FROM f, q WHERE m <= b), c AS (SELECT part, count(*) AS n, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM p GROUP BY part) SELECT part, n, round(degrees(asin(z / sqrt(x * x + y * y + z * z))), 5) AS lat, round(degrees(atan2(y, x)), 5) AS lon FROM c")
def field_geometry(spark, d):
    f = site_field(spark, d)
    q = f.agg(F.struct(F.percentile("m", F.lit(0.9)).alias("a"), F.percentile("m", F.lit(0.1)).alias("b"))).scalar()
    part = F.when(F.col("m") >= F.col("q.a"), "top").when(F.col("m") <= F.col("q.b"), "bottom")
    lat, lon = fields.centroid("lat", "lon")
    return f.withColumn("q", q).withColumn("part", part).filter("part IS NOT NULL").groupBy("part").agg(F.count("*").alias("n"), F.round(lat, 5).alias("lat"), F.round(lon, 5).alias("lon"))


@query("basin", f"{W}, {_SITE_FIELD_SQL}, t AS (SELECT * FROM f ORDER BY m DESC, lat, lon LIMIT 25) SELECT round(avg(lat), 6) AS basin_lat, round(degrees(atan2(avg(sin(radians(lon))), avg(cos(radians(lon))))), 6) AS basin_lon FROM t")
def basin(spark, d):
    return rounded(fields.basin(site_field(spark, d), 25), 6)


_PATH_SQL = f"""WITH {_FIELD_SQL}, ax AS (SELECT (s_suppkey * 37 % 121 - 60)::DOUBLE AS axis_lat, (s_suppkey * 53 % 360 - 180)::DOUBLE AS axis_lon, s_suppkey AS axis_id FROM supplier), a AS (
    SELECT *, cos(radians(axis_lat)) * cos(radians(axis_lon)) AS ax, cos(radians(axis_lat)) * sin(radians(axis_lon)) AS ay, sin(radians(axis_lat)) AS az FROM ax), r AS (
    SELECT *, CASE WHEN abs(az) < 0.9 THEN 0.0::DOUBLE ELSE 1.0 END AS rx, CASE WHEN abs(az) < 0.9 THEN 1.0::DOUBLE ELSE 0.0 END AS rz FROM a), e AS (
    SELECT *, -rz * ay AS e0, rz * ax - rx * az AS e1, rx * ay AS e2 FROM r), n AS (
    SELECT axis_id, ax, ay, az, e0 / sqrt(e0*e0+e1*e1+e2*e2) AS e0, e1 / sqrt(e0*e0+e1*e1+e2*e2) AS e1, e2 / sqrt(e0*e0+e1*e1+e2*e2) AS e2 FROM e), v AS (
    SELECT axis_id, theta, e0 * cos(radians(theta)) + (ay * e2 - az * e1) * sin(radians(theta)) AS vx, e1 * cos(radians(theta)) + (az * e0 - ax * e2) * sin(radians(theta)) AS vy, e2 * cos(radians(theta)) + (ax * e1 - ay * e0) * sin(radians(theta)) AS vz FROM n, (SELECT 2.0::DOUBLE * unnest(range(0, 181)) AS theta)), m AS (
    SELECT axis_id, theta, round(19.4268163::DOUBLE - 0.49025260::DOUBLE * vx - 2.33584766::DOUBLE * vy - 1.45900941::DOUBLE * vz, 9) AS m FROM v), l AS (
    SELECT *, m < 19.0 AS low, lag(m < 19.0) OVER w AS before, (m - lag(m) OVER w) / 2.0::DOUBLE AS slope FROM m WINDOW w AS (PARTITION BY axis_id ORDER BY theta)), i AS (
    SELECT *, coalesce(low <> before, false) AS turn, sum(CASE WHEN low <> before THEN 1 ELSE 0 END) OVER (PARTITION BY axis_id ORDER BY theta) AS island FROM l), runs AS (
    SELECT axis_id, island, bool_or(low) AS low, count(*) AS n FROM i GROUP BY axis_id, island), longest AS (
    SELECT axis_id, coalesce(max(CASE WHEN low THEN n END), 0) * 2.0::DOUBLE AS longest_low_run_deg, coalesce(max(CASE WHEN NOT low THEN n END), 0) * 2.0::DOUBLE AS longest_high_run_deg FROM runs GROUP BY axis_id), metrics AS (
    SELECT axis_id, round(avg(m), 6) AS path_m_mean, round(quantile_cont(m, 0.5), 6) AS path_m_median, round(min(m), 6) AS path_m_min, round(max(m), 6) AS path_m_max, round(stddev_pop(m), 6) AS path_m_std,
        round(avg(CASE WHEN low THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS fraction_below, round(avg(greatest(0.0, 19.0 - m)), 6) AS integrated_penalty, CAST(sum(CASE WHEN turn THEN 1 ELSE 0 END) AS BIGINT) AS ridge_crossings,
        round(avg(abs(slope)), 6) AS mean_abs_dm_dtheta, round(max(abs(slope)), 6) AS max_abs_dm_dtheta FROM i GROUP BY axis_id), pm AS (SELECT * FROM metrics JOIN longest USING (axis_id))"""


def _axes(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("axis_id"), (k * 37 % 121 - 60).cast("double").alias("axis_lat"), (k * 53 % 360 - 180).cast("double").alias("axis_lon"))


def _path_metrics(spark, d):
    p = fields.sweep(_axes(spark, d))
    x, y, z = geo.unit("lat", "lon")
    p = p.withColumn("m", F.round(FIELD[0] + FIELD[1] * x + FIELD[2] * y + FIELD[3] * z, 9))
    return rounded(fields.path_metrics(p, ["axis_id"], 19.0, 2.0), 6)


query("path_metrics", f"{_PATH_SQL} SELECT * FROM pm")(_path_metrics)


@query("observed_vs_random", f"{_PATH_SQL}, ov AS (SELECT axis_id % 5 = 0 AS obs, 'path_m_mean' AS metric, path_m_mean AS v FROM pm UNION ALL SELECT axis_id % 5 = 0, 'integrated_penalty', integrated_penalty FROM pm), o AS (SELECT metric, quantile_cont(v, 0.5) AS observed_median FROM ov WHERE obs GROUP BY metric) SELECT metric, round(max(observed_median), 6) AS observed_median, round(quantile_cont(v, 0.5), 6) AS random_median, round(quantile_cont(v, 0.1), 6) AS random_p10, round(quantile_cont(v, 0.9), 6) AS random_p90, round((sum(CASE WHEN v >= observed_median THEN 1 ELSE 0 END) + 1) / CAST(count(*) + 1 AS DOUBLE), 6) AS p_high, round((sum(CASE WHEN v <= observed_median THEN 1 ELSE 0 END) + 1) / CAST(count(*) + 1 AS DOUBLE), 6) AS p_low FROM ov JOIN o USING (metric) WHERE NOT obs GROUP BY metric")
def observed_vs_random(spark, d):
    long = _path_metrics(spark, d).select((F.col("axis_id") % 5 == 0).alias("obs"), "path_m_mean", "integrated_penalty").unpivot(["obs"], ["path_m_mean", "integrated_penalty"], "metric", "v")
    o = long.filter("obs").groupBy("metric").agg(F.percentile("v", F.lit(0.5)).alias("observed_median"))
    r = long.filter("NOT obs").join(o, "metric")
    v, m = F.col("v"), F.col("observed_median")
    return rounded(r.groupBy("metric").agg(F.max(m).alias("observed_median"), F.percentile("v", F.lit(0.5)).alias("random_median"), F.percentile("v", F.lit(0.1)).alias("random_p10"), F.percentile("v", F.lit(0.9)).alias("random_p90"), statistics.p_greater(v, m).alias("p_high"), statistics.p_greater(-v, -m).alias("p_low")), 6)


@query("random_axes", f"SELECT c_custkey AS k, round(degrees(asin(2 * {uniform_sql(md5_sql(chr(39) + 'lat' + chr(39), 'c_custkey'))} - 1)), 7) AS axis_lat, round(360.0::DOUBLE * {uniform_sql(md5_sql(chr(39) + 'lon' + chr(39), 'c_custkey'))} - 180, 7) AS axis_lon FROM customer")
def random_axes(spark, d):
    """A random axis for every customer."""
    k = F.col("c_custkey")
    return rounded(table(spark, d, "customer").select(k.alias("k"), F.degrees(F.asin(2 * statistics.uniform(statistics.draw("lat", k)) - 1)).alias("axis_lat"), (360 * statistics.uniform(statistics.draw("lon", k)) - 180).alias("axis_lon")))


_MATCHED = "k * 200 + j"


@query("matched_random_axes", f"WITH c AS (SELECT c_custkey AS k, CAST(c_custkey % 60 + 1 AS DOUBLE) AS angle_deg FROM customer), e AS (SELECT k, angle_deg, unnest(range(0, 200)) AS j FROM c) SELECT k, angle_deg, j, round(degrees(asin(2 * {uniform_sql(md5_sql(chr(39) + 'mlat' + chr(39), _MATCHED))} - 1)), 7) AS axis_lat, round(360.0::DOUBLE * {uniform_sql(md5_sql(chr(39) + 'mlon' + chr(39), _MATCHED))} - 180, 7) AS axis_lon FROM e")
def matched_random_axes(spark, d):
    """For every customer as a candidate 200 random axes with its angle."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 60 + 1).cast("double").alias("angle_deg"))
    return rounded(statistics.matched_axes(c, "k", 200, "m"))


def _drawn_sql(name: str, by: str, seed: str, source: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rep, {by} ORDER BY {md5_sql(chr(39) + seed + chr(39), 'rep', 'id')}, id) AS k FROM {source}) WHERE k = 1)"


@query("bootstrap_schemes", f"""{W}, e AS (SELECT rep, id, z_m, latitude, source_id, concat_ws('_', CAST(CAST(floor((latitude + 90) / 10) AS BIGINT) AS VARCHAR), CAST(CAST(floor((longitude + 180) / 20) AS BIGINT) AS VARCHAR)) AS cell FROM u, (SELECT unnest(range(1, {REPS + 1})) AS rep)),
    i AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM u), dr AS (SELECT rep, CAST(floor({uniform_sql(md5_sql(chr(39) + 's' + chr(39), 'rep', 'i'))} * n) AS BIGINT) AS i FROM i, (SELECT unnest(range(1, {REPS + 1})) AS rep)),
    {_drawn_sql('pc', 'cell', 's-cell', 'e')}, {_drawn_sql('ps', 'source_id', 's-source', 'e')}, {_drawn_sql('pb', 'source_id', 's-both', '(SELECT rep, id, z_m, latitude, source_id, cell FROM pc)')},
    a AS (SELECT 'ordinary' AS scheme, rep, z_m, latitude FROM dr JOIN i USING (i) UNION ALL SELECT 'one_per_cell', rep, z_m, latitude FROM pc UNION ALL SELECT 'one_per_source', rep, z_m, latitude FROM ps UNION ALL SELECT 'cell_then_source', rep, z_m, latitude FROM pb)
    SELECT scheme, CAST(rep AS INTEGER) AS rep, count(*) AS n, round(sum(z_m), 6) AS z_sum, round(regr_r2(z_m, latitude), 9) AS r2 FROM a GROUP BY scheme, rep HAVING count(*) >= 20""")
def bootstrap_schemes(spark, d):
    """Every scheme's draws, those of fewer than 20 rows left out."""
    s = usable_sites(spark, d).withColumn("cell", geo.cell_key("latitude", "longitude")).select("id", "z_m", "latitude", "source_id", "cell")
    b = statistics.schemes(s, "cell", "source_id", "id", REPS, "s", 20)
    return b.groupBy("scheme", "rep").agg(F.count("*").alias("n"), F.round(F.sum("z_m"), 6).alias("z_sum"), F.round(F.regr_r2("z_m", "latitude"), 9).alias("r2"))


@query("field_interp", f"{W}, {_FIELD_SQL}, k AS (SELECT id, latitude AS lat, longitude AS lon, floor(latitude / 5) + i AS a, floor(longitude / 5) + j AS o FROM u, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)), c AS (SELECT id, k.lat, k.lon, (1 - abs(k.lat / 5 - a)) * (1 - abs(k.lon / 5 - o)) AS w, m FROM k LEFT JOIN f ON f.lat = 5 * a AND f.lon = 5 * o) SELECT id, lat, lon, round(sum(w * m) / nullif(sum(CASE WHEN m IS NOT NULL THEN w END), 0), 7) AS m FROM c WHERE w > 0 GROUP BY id, lat, lon")
def field_interp(spark, d):
    points = usable_sites(spark, d).select("id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return rounded(fields.bilinear(points, field(spark), 5.0), 7)


_POLES = "pg AS (SELECT 2.5::DOUBLE * a AS offset_deg, 10.0::DOUBLE * p AS azimuth_deg, sin(radians(2.5 * a)) * cos(radians(10 * p)) AS px, sin(radians(2.5 * a)) * sin(radians(10 * p)) AS py, cos(radians(2.5 * a)) AS pz FROM (SELECT unnest(range(1, 19)) AS a), (SELECT unnest(range(0, 36)) AS p))"
_PREFERENCE = f"""{W}, {_POLES}, b AS (SELECT *, {BINS_SQL} AS z_bin FROM u), w0 AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY z_bin) AS raw FROM b WHERE z_bin IS NOT NULL), w AS (SELECT *, raw / avg(raw) OVER () AS weight FROM w0), c AS (
    SELECT offset_deg, azimuth_deg, weight, z_m + 11000.0::DOUBLE * (z * z - (x * px + y * py + z * pz) * (x * px + y * py + z * pz)) AS miss FROM w, pg), g0 AS (
    SELECT offset_deg, azimuth_deg, sum(weight * exp(-0.5 * (miss / 25) * (miss / 25))) / sum(weight) AS pref, coalesce(sum(CASE WHEN abs(miss) <= 25 THEN weight END), 0) / sum(weight) AS hit, sum(weight * abs(miss)) / sum(weight) AS mae, sqrt(sum(weight * miss * miss) / sum(weight)) AS rmse FROM c GROUP BY offset_deg, azimuth_deg), pref AS (
    SELECT offset_deg, azimuth_deg, round(pref, 8) AS preference_norm, round(hit, 8) AS hit_fraction, round(mae, 5) AS mae_m, round(rmse, 5) AS rmse_m, round(pref / max(pref) OVER (), 7) AS preference_0_1 FROM g0)"""


def _preference(spark, d):
    s = records.balanced_weights(usable_sites(spark, d).withColumn("z_bin", records.right_closed_bin(F.col("z_m"), EDGES)))
    g = spark.range(1).select(F.explode(geo.steps(2.5, 18, 2.5)).alias("offset_deg")).select("offset_deg", F.explode(geo.steps(0.0, 36, 10.0)).alias("azimuth_deg"))
    poles = g.select("*", *(c.alias(n) for c, n in zip(geo.displaced_pole("offset_deg", "azimuth_deg"), ("px", "py", "pz"))))
    p = fields.preference(s, poles)
    return p.select("offset_deg", "azimuth_deg", F.round("preference_norm", 8).alias("preference_norm"), F.round("hit_fraction", 8).alias("hit_fraction"), F.round("mae_m", 5).alias("mae_m"), F.round("rmse_m", 5).alias("rmse_m"), F.round("preference_0_1", 7).alias("preference_0_1"))


query("preference_grid", f"{_PREFERENCE} SELECT * FROM pref")(_preference)


@query("preference_top", f"{_PREFERENCE} SELECT offset_deg, azimuth_deg, preference_norm FROM pref ORDER BY preference_norm DESC, offset_deg, azimuth_deg LIMIT 20")
def preference_top(spark, d):
    return _preference(spark, d).select("offset_deg", "azimuth_deg", "preference_norm").orderBy(F.desc("preference_norm"), "offset_deg", "azimuth_deg").limit(20)


@query("weighted_centroids", f"{_PREFERENCE}, t AS (SELECT 0.9::DOUBLE AS q UNION ALL SELECT 0.95 UNION ALL SELECT 0.99), c2 AS (SELECT q, quantile_cont(preference_norm, 0.9) AS c90, quantile_cont(preference_norm, 0.95) AS c95, quantile_cont(preference_norm, 0.99) AS c99 FROM pref, t GROUP BY q), k AS (SELECT q, CASE q WHEN 0.9 THEN c90 WHEN 0.95 THEN c95 ELSE c99 END AS least FROM c2), v AS (SELECT q, preference_norm AS w, sin(radians(offset_deg)) * cos(radians(azimuth_deg)) AS x, sin(radians(offset_deg)) * sin(radians(azimuth_deg)) AS y, cos(radians(offset_deg)) AS z FROM pref JOIN k ON preference_norm >= least), e AS (SELECT q, count(*) AS n, sum(w * x) AS x, sum(w * y) AS y, sum(w * z) AS z FROM v GROUP BY q) SELECT q AS quantile, n, round(degrees(asin(z / sqrt(x * x + y * y + z * z))), 4) AS lat, round(degrees(atan2(y, x)), 4) AS lon FROM e")
def weighted_centroids(spark, d):
    p = _preference(spark, d)
    cuts = p.agg(F.array(*(F.struct(F.lit(q).alias("quantile"), F.percentile("preference_norm", F.lit(q)).alias("least")) for q in (0.9, 0.95, 0.99)))).scalar()
    each = p.withColumn("c", F.explode(cuts)).filter(F.col("preference_norm") >= F.col("c.least")).select("*", "c.quantile")
    each = each.withColumn("lat", 90 - F.col("offset_deg")).withColumn("lon", geo.wrap_longitude("azimuth_deg"))
    lat, lon = fields.centroid("lat", "lon", F.col("preference_norm"))
    return each.groupBy("quantile").agg(F.count("*").alias("n"), F.round(lat, 4).alias("lat"), F.round(lon, 4).alias("lon"))


@query("regime_pairs", f"{W}, g(regime, lo, hi) AS (VALUES ('shallow', -200, 50), ('deep', -1000, -150), ('high', 0, 200), ('full', -1000, 200)), c AS (SELECT regime, sum(x) AS x, sum(y) AS y, sum(z) AS z, avg(z_m) AS zm FROM u JOIN g ON z_m BETWEEN lo AND hi GROUP BY regime), n AS (SELECT regime, zm, x / sqrt(x*x+y*y+z*z) AS x, y / sqrt(x*x+y*y+z*z) AS y, z / sqrt(x*x+y*y+z*z) AS z FROM c) SELECT a.regime AS regime_a, b.regime AS regime_b, round(degrees(acos(greatest(-1, least(1, a.x * b.x + a.y * b.y + a.z * b.z)))), 4) AS separation_deg, round(abs(a.zm - b.zm), 6) AS z_difference FROM n a JOIN n b ON a.regime < b.regime")
def regime_pairs(spark, d):
    from tidemark.plans.analysis import REGIMES

    lat, lon = fields.centroid("latitude", "longitude")
    c = records.with_named_regimes(usable_sites(spark, d), REGIMES).groupBy("regime").agg(lat.alias("lat"), lon.alias("lon"), F.avg("z_m").alias("z"))
    a, b = (c.select(*(F.col(n).alias(f"{n}_{s}") for n in c.columns)) for s in "ab")
    j = a.join(b, F.col("regime_a") < F.col("regime_b"))
    return j.select("regime_a", "regime_b", F.round(geo.angular_distance(geo.unit("lat_a", "lon_a"), geo.unit("lat_b", "lon_b")), 4).alias("separation_deg"), F.round(F.abs(F.col("z_a") - F.col("z_b")), 6).alias("z_difference"))


@query("single_site_inverse", f"""{W}, g AS (SELECT 0.5::DOUBLE * a AS offset_deg, 2.5::DOUBLE * p AS azimuth_deg FROM (SELECT unnest(range(1, 91)) AS a), (SELECT unnest(range(0, 144)) AS p)), h AS (SELECT *, sin(radians(offset_deg)) * cos(radians(azimuth_deg)) AS px, sin(radians(offset_deg)) * sin(radians(azimuth_deg)) AS py, cos(radians(offset_deg)) AS pz FROM g),
    r AS (SELECT id, offset_deg, azimuth_deg, round(z_m + 11000.0::DOUBLE * (z * z - pow(x * px + y * py + z * pz, 2)), 5) AS residual FROM u, h)
    SELECT id, count(*) AS n, min(offset_deg) AS least_offset_deg, max(offset_deg) AS most_offset_deg FROM r WHERE abs(residual) <= 25 GROUP BY id""")
def single_site_inverse(spark, d):
    """For every usable site the displaced poles of the grid that predict its z within 25 m: how many, and how far they are from north."""
    g = spark.range(1).select(F.explode(geo.steps(0.5, 90, 0.5)).alias("offset_deg")).select("offset_deg", F.explode(geo.steps(0.0, 144, 2.5)).alias("azimuth_deg"))
    poles = g.select("*", *(c.alias(n) for c, n in zip(geo.displaced_pole("offset_deg", "azimuth_deg"), ("px", "py", "pz"))))
    return fields.inverse(usable_sites(spark, d).select("id", "latitude", "longitude", "z_m"), poles, 25.0)


@query("top_fraction", f"{W}, r AS (SELECT id, z_m, row_number() OVER (ORDER BY z_m DESC, id) AS k, count(*) OVER () AS n FROM u) SELECT id, round(z_m, 7) AS z_m FROM r WHERE k <= greatest(1, ceil(n * 0.1))")
def top_fraction(spark, d):
    """The tenth of the greatest values: rows are numbered by ranges of (-z_m, id), and no task sees all of them."""
    s = usable_sites(spark, d).select("id", "z_m")
    most = s.agg(F.greatest(F.lit(1), F.ceil(F.count("*") * 0.1))).scalar()
    placed = numbered(s.withColumn("_o", F.struct((-F.col("z_m")).alias("a"), F.col("id").alias("b"))), "_o", "_i")
    return rounded(placed.filter(F.col("_i") < most).select("id", "z_m"))


@query("class_zscore", f"{W} SELECT id, round((z_m - avg(z_m) OVER w) / nullif(stddev_pop(z_m) OVER w, 0), 7) + 0.0 AS z_score FROM u WINDOW w AS (PARTITION BY record_class)")
def zscore(spark, d):
    s = usable_sites(spark, d)
    m = s.groupBy("record_class").agg(F.avg("z_m").alias("m"), F.stddev_pop("z_m").alias("sd"))
    return rounded(s.join(m, "record_class").select("id", ((F.col("z_m") - F.col("m")) / F.nullif(F.col("sd"), F.lit(0.0))).alias("z_score")))
