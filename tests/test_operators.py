"""Operators against numpy or plain Python, and sources, sinks and streams on small files."""

from __future__ import annotations

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.functions import text as tx
from tidemark.functions.placing import numbered
from tidemark.operators import fields, fits, merge, records, statistics
from tidemark.sources import files
from tidemark.streaming import status


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 1, 300))), rng.uniform(-180, 180, 300)
    v = unit(lat, lon)
    z = 3 + v @ [1.0, -2.0, 0.5] + 4 * v[:, 0] * v[:, 1] + rng.normal(0, 0.3, 300)
    return lat, lon, z, spark.createDataFrame([(i, float(a), float(o), float(h)) for i, (a, o, h) in enumerate(zip(lat, lon, z))], "id long, latitude double, longitude double, z_m double")


def unit(lat, lon):
    a, o = np.radians(lat), np.radians(lon)
    return np.column_stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)])


def r2_of(x, z):
    x = np.column_stack([np.ones(len(z)), x])
    beta = np.linalg.lstsq(x, z, rcond=None)[0]
    return beta, 1 - ((z - x @ beta) ** 2).sum() / ((z - z.mean()) ** 2).sum()


def test_longitudes_and_vectors(spark):
    for lon, want in ((180, -180), (-180, -180), (190, -170), (-190, 170), (540, -180), (0, 0)):
        assert one(spark, geo.wrap_longitude(lon)) == want
    assert one(spark, geo.latitude((F.lit(0.0), F.lit(0.0), F.lit(0.0)))) is None
    turned = geo.rotate(geo.unit(0, 0), geo.unit(90, 0), 90)
    assert abs(one(spark, geo.longitude(turned)) - 90) < 1e-9


def test_spherical_fit_and_leave_one_out(points):
    lat, lon, z, df = points
    beta, r2 = r2_of(unit(lat, lon), z)
    got = fits.spherical(df).first()
    assert np.allclose([got["gx"], got["gy"], got["gz"]], beta[1:]) and abs(got["r2"] - r2) < 1e-9
    df = df.withColumn("g", F.col("id") % 7)
    for r in fits.leave_one_out(df, "g").collect():
        keep = np.arange(300) % 7 != r["left_out"]
        assert abs(r["r2"] - r2_of(unit(lat[keep], lon[keep]), z[keep])[1]) < 1e-9 and r["n"] == keep.sum()


def test_spectral_ridge_and_influence(points):
    lat, lon, z, df = points
    v = unit(lat, lon)
    x, y, w = v.T
    full = np.column_stack([x, y, w, x * y, y * w, 3 * w * w - 1, x * w, x * x - y * y])
    table = {r["degree"]: r for r in fits.spectral(df, 3).collect()}
    assert abs(table[1]["r2"] - r2_of(v, z)[1]) < 1e-9 and abs(table[2]["r2"] - r2_of(full, z)[1]) < 1e-9 and table[3]["r2"] >= table[2]["r2"]
    scan = fits.rotation_scan(df, [(40, -175), (0, 30)], [21, 40], [1e-9, 1e5]).collect()
    best = r2_of(full[:, 3:], z)[1]  # the anomaly lies in the span of the quadrupole
    assert all(abs(r["r2"] - best) < 1e-6 for r in scan if r["lambda_q"] < 1) and all(r["r2"] < best + 1e-9 for r in scan)
    d = np.column_stack([np.ones(300), v])
    hat = np.einsum("ij,jk,ik->i", d, np.linalg.inv(d.T @ d), d)
    top = fits.influence(df, 25).collect()
    assert len(top) == 25 and all(abs(r["leverage"] - hat[r["id"]]) < 1e-9 for r in top)
    q = fits.quadrupole(df).collect()
    assert abs(sum(r["eigenvalue"] for r in q)) < 1e-9 and all(r["axis_lat"] >= 0 for r in q)


def test_rank_statistics(spark):
    rng = random.Random(1)
    data = [(float(rng.randrange(12)), float(rng.randrange(9))) for _ in range(150)]
    df = spark.createDataFrame(data, "x double, y double")
    c = sum((a - p) * (b - q) > 0 for a, b in data for p, q in data) // 2
    d = sum((a - p) * (b - q) < 0 for a, b in data for p, q in data) // 2
    got = statistics.gamma(df, "x", "y").first()
    assert (got["concordant"], got["discordant"]) == (c, d) and abs(got["gamma"] - (c - d) / (c + d)) < 1e-12
    same = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert statistics.spearman(same, "x", "y").first()["spearman"] is None and statistics.gamma(same, "x", "y").first()["gamma"] is None


def test_permutations_keep_groups_and_values(points):
    df = points[3].withColumn("g", F.col("id") % 5)
    got = statistics.permuted(df, "z_m", "id", 3, "s", ["g"]).toPandas()
    truth = points[3].toPandas().z_m
    for rep in (1, 2, 3):
        p = got[got.rep == rep]
        assert sorted(p.id) == list(range(300))
        for g in range(5):
            assert sorted(p[p.g == g].z_m) == sorted(truth[np.arange(300) % 5 == g])


def test_numbered(spark):
    got = numbered(spark.range(1000).repartition(9).withColumnRenamed("id", "k"), "k", "i").collect()
    assert all(r["k"] == r["i"] for r in got) and len(got) == 1000


def test_field_columns_and_interpolation(spark):
    df = spark.createDataFrame([("10", "190", "1"), ("10", "-170", "2"), ("x", "0", "3")], "Latitude string, Long string, MACH string")
    assert [tuple(r) for r in fields.load_field(df).collect()] == [(10.0, -170.0, 1.0)]
    grid = spark.createDataFrame([(float(a), float(o), 2.0 * a - o) for a in range(0, 11, 5) for o in range(0, 11, 5)], "lat double, lon double, m double")
    got = fields.bilinear(spark.createDataFrame([(1, 2.5, 7.0), (2, 5.0, 5.0), (3, 70.0, 70.0)], "id int, lat double, lon double"), grid, 5.0)
    assert {r["id"]: r["m"] and round(r["m"], 9) for r in got.collect()} == {1: -2.0, 2: 5.0, 3: None}


def test_paths_close_and_runs(spark):
    axes = spark.createDataFrame([(90.0, 0.0)], "axis_lat double, axis_lon double")
    p = fields.sweep(axes, 2.0)
    assert p.count() == 181 and p.filter("abs(lat) > 1e-9").count() == 0
    p = p.withColumn("m", F.when(F.col("theta").between(90, 180), 0.0).otherwise(1.0))
    m = fields.path_metrics(p, ["axis_lat"], 0.5, 2.0).first()
    assert m["ridge_crossings"] == 2 and m["longest_low_run_deg"] == 92.0 and m["longest_high_run_deg"] == 180.0


def present(v):
    return v is not None and not (isinstance(v, str) and v.strip().lower() in ("", "null", "none"))


def fold(rows, names, top, others):
    held = dict(rows[0])
    for new in map(dict, rows[1:]):
        def rank(r, cols):
            return any(present(r[c]) for c in cols)

        old_first = False
        if rank(held, [top]) != rank(new, [top]):
            old_first = rank(held, [top])
        elif rank(held, [top, *others]) != rank(new, [top, *others]):
            old_first = rank(held, [top, *others])
        else:
            old_first = sum(present(held[c]) for c in names) > sum(present(new[c]) for c in names)
        a, b = (held, new) if old_first else (new, held)
        held = {c: b[c] if not present(a[c]) and present(b[c]) else a[c] for c in names}
    return held


def test_fold_of_duplicates(spark):
    rng = random.Random(4)
    names = ["elevation_m", "derived", "notes", "method"]
    data = [(f"k{rng.randrange(60)}", i, rng.choice([None, 1.5, 2.5]), rng.choice([None, 7.0]), rng.choice([None, "null", " ", "x", "y"]), rng.choice(["a", None])) for i in range(200)]
    df = spark.createDataFrame(data, "id string, seq int, elevation_m double, derived double, notes string, method string")
    got = {r["id"]: {c: r[c] for c in names} for r in merge.fold_duplicates(df, any_elevation=["derived"]).collect()}
    groups: dict = {}
    for k, s, *v in data:
        groups.setdefault(k, {})[tuple(v)] = s
    for k, g in groups.items():
        rows = [dict(zip(names, v)) for v, _ in sorted(g.items(), key=lambda x: x[1])]
        assert got[k] == fold(rows, names, "elevation_m", ["derived"])


def test_lookup_forms(spark):
    assert one(spark, tx.key_variants(F.lit("K-7098"))) == ["k7098"]
    assert one(spark, tx.key_variants(F.lit("01"))) == ["01", "1"]
    assert one(spark, tx.key_variants(F.lit(" "))) == []
    r = spark.createDataFrame([(1, "K 7098"), (2, "1"), (3, None)], "id int, name string")
    t = spark.createDataFrame([(1, "01", "a"), (2, "k7098", "b"), (3, "1", "c")], "seq int, key string, v string")
    assert {x["id"]: x["v"] for x in merge.lookup(r, t, ["name"], ["key"], "seq").collect()} == {1: "b", 2: "a"}


def test_texts(spark):
    t = "Raised beach. 45 degrees 30 minutes South Latitude and 20 degrees 15 minutes West of the Longitude. Guyot with summit depth of 1,250 m; 10 fathoms. 12,500 years B.P."
    assert one(spark, tx.coordinates(F.lit(t))).asDict() == {"lat": -45.5, "lon": -20.25, "source": "reported_dms"}
    assert one(spark, tx.depth_m(F.lit(t))) == 1250.0 and one(spark, tx.depth_m(F.lit("10 fathoms deep"))) == 18.3 and one(spark, tx.depth_m(F.lit(""))) is None
    assert one(spark, tx.ages_ka(F.lit(t))) == [12.5]
    assert one(spark, tx.table_rows(F.lit("<table><tr><th>A</th><td> b <i>c</i></td></tr><tr><td></td></tr></table>"))) == [["A", "b c"]]
    assert one(spark, tx.quality(F.lit(""))) == 0.0
    assert one(spark, records.plain_number(F.lit(100.0))) == "100" and one(spark, records.plain_number(F.lit(0.5))) == "0.5"
    got = one(spark, records.union_value(F.lit("[1, null, 3]")))
    assert got["items"] == [1.0, None, 3.0] and one(spark, records.union_value(F.lit('"LGM"')))["label"] == "LGM" and one(spark, records.union_value(F.lit("null")))["label"] is None


def test_bins_and_regimes(spark):
    df = spark.createDataFrame([(x,) for x in (-250.0, -200.0, -199.0, 0.0, 200.0, 201.0)], "z_m double")
    bins = [r["b"] for r in df.select(records.right_closed_bin(F.col("z_m"), [-250, -200, 0, 200]).alias("b")).collect()]
    assert bins == [0, 0, 1, 1, 2, None]
    assert one(spark, records.depth_regime(F.lit(-200.0))) == "shelf"
    assert records.parse_regimes("a:-1,2; b:0,3;") == [("a", -1.0, 2.0), ("b", 0.0, 3.0)]


def test_record_files(spark, tmp_path):
    rows = [("r1", 1.5, -2.5, "1", '{"reported_elevation_m":3.0}'), ("r2", None, None, '"LGM"', None)]
    df = spark.createDataFrame(rows, "id string, latitude double, longitude double, elevation_m string, reported_observations string")
    df = df.withColumn("elevation_m", records.union_value(F.col("elevation_m"))).withColumn("reported_observations", F.from_json("reported_observations", files.REPORTED))
    path = str(tmp_path / "out")
    files.write_records(df, path)
    back = {r["id"]: r for r in files.read_records(spark, path).collect()}
    assert back["r1"]["elevation_m"]["num"] == 1.0 and back["r1"]["reported_observations"]["reported_elevation_m"] == 3.0 and back["r1"]["elevation_min"] == "1"
    assert back["r2"]["latitude"] is None and back["r2"]["elevation_m"]["label"] == "LGM"
    imported = {r["id"]: r for r in files.import_records(spark, path).collect()}
    assert imported["r1"]["elevation_m"] == "1.0" and imported["r1"]["indicative_range_m"] is None
    feature = [json.loads(r["value"]) for r in files.features(df.select("id", "latitude", "longitude")).collect()]
    assert feature[0]["geometry"] == {"type": "Point", "coordinates": [-2.5, 1.5]} and feature[1]["geometry"] is None
    with pytest.raises(ValueError):
        (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
        files.import_records(spark, str(tmp_path / "bad.csv"))


def test_folders_and_documents(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "My File.TXT").write_text("\n Title here \nbody\fpage two")
    (d / "b.csv").write_text("a;b\n1;2\n")
    (d / "c.xyz").write_text("?")
    got = {r["source_id"]: r["kind"] for r in files.incoming(spark, str(d)).collect()}
    assert got == {"my_file": "text", "b": "csv", "c": "unsupported"}
    assert files.incoming(spark, str(d), ["My File"]).count() == 1
    doc = files.read_texts(spark, str(d / "My File.TXT"))
    assert doc.first()["title"] == "Title here" and [r["page"] for r in files.pages(doc).collect()] == [1, 2]
    assert one(spark, files.metadata(F.lit("Title: a: b\nPages: 3\nTitle: c"))) == {"Pages": "3", "Title": "c"}
    assert files.read_delimited(spark, str(d / "b.csv")).first().asDict() == {"a": "1", "b": "2"}
    items = spark.createDataFrame([("s", [("table", 0, "<tr><td>x</td><td>y</td></tr>", ["cap"], [], ""), ("text", 1, "", [], [], "no")])], "source_id string, items array<struct<type: string, page_idx: int, table_body: string, captions: array<string>, footnotes: array<string>, text: string>>")
    assert [tuple(r) for r in files.page_blocks(items).collect()] == [("s", 1, "table", "cap\nx | y", "cap\nx | y")]


def test_geocodes_and_rasters(spark, tmp_path):
    f = lambda kind, c, **p: {"type": "Feature", "geometry": {"type": kind, "coordinates": c}, "properties": p}
    (tmp_path / "g.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [f("Point", [10, 20], k="1"), f("MultiPoint", [[1, 2]], k="2"), f("MultiPoint", [[1, 2], [3, 4]], k="3"), f("Point", [10, 95], k="4")]}))
    got = {r["properties"]["k"]: (r["lat"], r["lon"]) for r in files.read_geocodes(spark, str(tmp_path / "g.geojson")).collect()}
    assert got == {"1": (20.0, 10.0), "2": (2.0, 1.0)}
    cells = spark.createDataFrame([(r, c, float(10 * r + c) if (r, c) != (1, 1) else -99.0) for r in range(3) for c in range(3)], "row int, col int, value double")
    p = spark.createDataFrame([(1, 89.5, -179.5), (2, 88.2, -178.9), (3, 0.0, 0.0), (4, None, 0.0), (5, 87.5, -177.1)], "id int, latitude double, longitude double")
    got = {r["id"]: r["sampled_m"] for r in files.sample_raster(p, cells, (-180.0, 90.0), (1.0, 1.0), (3, 3), -99.0).collect()}
    assert got == {1: 0.0, 2: None, 3: None, 4: None, 5: 22.0}


def wait(query):
    query.processAllAvailable()
    query.stop()


def test_streams(spark, tmp_path):
    d, ck = tmp_path / "files", tmp_path / "ck"
    d.mkdir()
    (d / "a one.txt").write_text("x")
    (d / "b.txt").write_text("y")
    q = status.discovered(spark, str(d)).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(ck)).start()
    q.processAllAvailable()
    (d / "b.md").write_text("again")
    wait(q)
    assert sorted(r["source_id"] for r in spark.sql("SELECT source_id FROM seen").collect()) == ["a_one", "b"]

    events = [(1, "2024-01-01 00:00:00", "a", "queued", 1), (2, "2024-01-01 00:00:10", "a", "running", 1), (3, "2024-01-01 00:00:20", "a", "queued", 1), (4, "2024-01-01 00:02:00", "a", "completed", 2), (5, "2024-01-01 00:02:10", "a", "running", 1), (5, "2024-01-01 00:02:10", "a", "running", 1), (6, "2024-01-02 00:00:00", "z", "queued", 1)]
    src = tmp_path / "ev"
    spark.createDataFrame(events, "event_id long, ts string, source_id string, status string, count long").selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS ts", "source_id", "status", "count").coalesce(1).write.parquet(str(src))
    stream = lambda: spark.readStream.schema(status.EVENT).parquet(str(src))

    def run(df, name, mode):
        wait(df.writeStream.format("memory").queryName(name).outputMode(mode).start())
        return spark.sql(f"SELECT * FROM {name}").collect()

    states = {r["source_id"]: r for r in run(status.source_states(stream()), "states", "update")}
    assert states["a"]["status"] == "completed" and states["a"]["changes"] == 3
    first = min(run(status.leases(stream()), "leases", "append"), key=lambda r: r["first"])
    assert first["beats"] == 3
    assert {(r["status"], r["n"]) for r in run(status.counts_by_window(stream()), "windows", "append") if str(r["start"]).startswith("2024-01-01")} == {("queued", 2), ("running", 3), ("completed", 1)}
    assert len(run(status.once(stream()), "once", "append")) == 6


def test_single_writer_merge(spark, tmp_path):
    path = str(tmp_path / "merged")
    write = status.merge_into(path)
    write(spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int"), 0)
    write(spark.createDataFrame([("b", 2), ("c", 2)], "id string, v int"), 1)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("id", "v").collect()) == [("a", 1), ("b", 1), ("c", 2)]


def test_dispatch_limit(spark):
    df = spark.createDataFrame([(50.0, 0.5, 100.0), (85.0, 0.5, 100.0), (85.0, 1.5, 100.0), (95.0, 0.1, 100.0), (10.0, 0.1, 5.0), (10.0, 0.1, 1.0)], "memory_percent double, load_per_cpu double, disk_free_gb double")
    assert [r["limit"] for r in status.dispatch_limit(df, 9).collect()] == [9, 4, 3, 0, 4, 0]


def test_entry_without_training_data(spark, sf, tmp_path):
    """The entry module works where corpus_pipeline.py and the llm folders are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'best_plane' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def test_extraction(spark):
    from tidemark.operators import extraction as ex

    s = one(spark, ex.depth_summary(F.lit("at a depth of 20 m, a terrace 30–40 m bmsl and the 212 m isobath; at 1, 2 and ~3")))
    assert (s["mid"], s["low"], s["high"]) == (20.5, -40.0, -1.0)
    assert one(spark, ex.depth_summary(F.lit("nothing"))) is None and one(spark, ex.depth_summary(F.lit("guyot summit depth of 1,250 m")))["low"] == -1250.0
    a = one(spark, ex.age_from_text(F.lit("12-14,000 years")))
    assert (a["num"], a["low"], a["high"]) == (None, 12.0, 14.0) and one(spark, ex.age_from_text(F.lit("9,500 BP")))["num"] == 9.5
    assert one(spark, ex.beach_name(F.lit("Lower beach (west)."))) == "Lower beach" and one(spark, ex.beach_depth(F.lit("10–12 fathoms"))) == 20.12
    assert one(spark, ex.salvage_json(F.lit('ok {"a": {"b": 1}} end'))) == '{"a": {"b": 1}}' and one(spark, ex.salvage_json(F.lit("{bad"))) is None
    assert one(spark, ex.strip_controls(F.lit("\x1b[31mred\x1b[0m"))) == "red" and one(spark, ex.number_list(F.lit("0.1, 1,x,"))) == [0.1, 1.0, None]
    assert one(spark, ex.elapsed(F.lit(59))) == "00:59" and one(spark, ex.elapsed(F.lit(3725))) == "1:02:05"
    assert one(spark, ex.author_list(F.array(*map(F.lit, "abcd")))) == "a et al." and one(spark, ex.author_list(F.array(F.lit("a"), F.lit("b")))) == "a; b"
    assert spark.createDataFrame([('{"a": ["x", {"b": "y"}], "c": 1}',), ("{",), (None,)], "t string").select(ex.json_strings("t").alias("s")).collect() == [(["x", "y"],), ([],), ([],)]


def test_tables_sections_and_answers(spark):
    from tidemark.operators import extraction as ex

    html = "<table><tr><th>Group</th><th>Age (yrs B.P.)</th></tr><tr><td>A</td><td>100</td></tr><tr><td> </td><td>200</td><td>extra</td></tr></table>"
    t = ex.table_records(spark.createDataFrame([(1, html), (2, "none")], "page_id int, html string"), "page_id")
    assert [(r["row"], r["cells"]) for r in t.orderBy("row").collect()] == [(1, {"group": "A", "age yrs bp": "100"}), (2, {"group": "", "age yrs bp": "200"})]
    flat = t.select("page_id", "row", F.col("cells")["group"].alias("g"))
    assert [r["g"] for r in ex.carried(flat, "page_id", "row", ["g"]).orderBy("row").collect()] == ["A", "A"]
    d = spark.createDataFrame([(1, "intro\nmore\n\n# Head #\nbody one\n\nbody  two"), (2, ""), (3, None)], "doc_id int, text string")
    got = [tuple(r) for r in ex.sectioned_paragraphs(d, "doc_id").orderBy("n").collect()]
    assert got == [(1, 1, None, "intro more"), (1, 2, "Head", "body one"), (1, 3, "Head", "body two")]
    answers = {"intro": 'noise {"candidate_records": [{"site_name": "s", "latitude": 95}, {"site_name": "t", "latitude": 5.5, "coordinate_source": "guess"}]} noise'}
    ask = lambda text: answers.get((text or "").split("\n")[0])
    got = ex.interpreted(d, "doc_id", "text", ask).collect()
    assert [(r["doc_id"], r["site_name"], r["latitude"], r["coordinate_source"]) for r in got] == [(1, "t", 5.5, "inferred_text")]
    refs = spark.createDataFrame([(1, "doi: 10.1000/abc. text 10.1000/zzz\nReferences\n" + "10.1000/zzz " * 3)], "doc_id int, text string")
    assert ex.ranked_dois(refs, "doc_id").first()["doi"] == "10.1000/abc"


def test_interpretation(spark):
    from tidemark.operators import interpret as it

    docs = spark.createDataFrame([("a", "Raised beach near Port Elin", "An ancient beach at 30 feet.\n\nThe submerged forest lies at a depth of 12 m.\n\nNothing else."), ("b", "Plain", "A guyot at 10.50, 20.25 with summit depth of 900 m and a marine terrace"), ("c", None, None)], "source_id string, title string, text string")
    places = spark.createDataFrame([("Port Elin", 1.0, 2.0)], "query string, lat double, lon double")
    got = {(r["source_id"], r["indicator_type"]): r for r in it.document_records(docs, places).collect()}
    assert set(got) == {("a", "raised_beach"), ("b", "marine_terrace"), ("b", "guyot_or_drowned_platform")}
    assert got["a", "raised_beach"]["coordinate_source"] == "inferred_text" and got["b", "marine_terrace"]["latitude"] == 10.5
    c = {(r["source_id"], r["kind"]): r["elevation_m"] for r in it.clusters(docs).collect()}
    assert c[("a", "raised_beach")] == 9.14 and c[("a", "submerged_forest")] == -12.0 and c[("b", "guyot")] == -900.0
    assert one(spark, it.labelled_lines(F.lit("a\nDepth: 3\nx depth"), ["depth"])) == ["Depth: 3", "x depth"]
    f = spark.createDataFrame([("s", "Reef A\ntext one\n\nother\n\nReef B. two")], "source_id string, text string")
    assert [r["name"] for r in it.feature_paragraphs(f, ["Reef A", "Reef B"]).collect()] == ["Reef A", "Reef B"]
    r = spark.createDataFrame([(1, 5.0, 6.0, "reported"), (2, 7.0, 8.0, "reported")], "id int, latitude double, longitude double, coordinate_source string")
    m = spark.createDataFrame([(1, 50.0, 60.0)], "id int, lat double, lon double")
    g = {x["id"]: x for x in it.with_geocodes(r, m, True).collect()}
    assert (g[1]["latitude"], g[1]["coordinate_source"]) == (50.0, "inferred_map") and g[2]["latitude"] is None and g[2]["longitude"] is None
    assert it.with_geocodes(r, m, False).filter("latitude IS NULL").count() == 0
    x = spark.createDataFrame([(1, 0.0, 0.0, 5.0), (2, 0.0, 0.0, 5.0), (3, 1.0, 0.0, 5.0)], "seq int, axis_lat double, axis_lon double, angle_deg double")
    u = it.candidate_union([("x", x), ("no", r), ("y", x.drop("angle_deg"))], 2)
    assert sorted((q["file"], q["axis_lat"]) for q in u.collect()) == [("x", 0.0), ("y", 0.0)]
    e = it.evidence_union([spark.createDataFrame([("k", 1)], "id string, v int"), spark.createDataFrame([("k", 2, "z")], "id string, v int, w string")])
    assert [tuple(q) for q in e.select("id", "v", "w").collect()] == [("k", 2, "z")]


def test_entry_needs_no_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert 'best_plane' in e.queries() and e.oracle_sql()"], cwd=root, check=True)


@pytest.mark.parametrize("blocks", [1, 3, 40])
def test_gamma_by_ranges(spark, blocks):
    """A value that a third of the rows have, and many ties, however many ranges there are."""
    rng = random.Random(blocks)
    data = [(float(rng.choice([5, rng.randrange(40), rng.randrange(40)])), float(rng.choice([7, rng.randrange(30), rng.randrange(30)]))) for _ in range(220)]
    c = sum((a - p) * (b - q) > 0 for a, b in data for p, q in data) // 2
    d = sum((a - p) * (b - q) < 0 for a, b in data for p, q in data) // 2
    got = statistics.gamma(spark.createDataFrame([*data, (None, 1.0)], "x double, y double"), "x", "y", blocks).first()
    assert (got["concordant"], got["discordant"]) == (c, d) and abs(got["gamma"] - (c - d) / (c + d)) < 1e-12


def test_quantiles_by_ranges(spark):
    rng = random.Random(2)
    data = [("a", round(rng.gauss(0, 3), 1)) for _ in range(300)] + [("b", 4.0)] * 40 + [(None, float(k)) for k in range(7)] + [("c", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(3)
    shares = {"p05": 0.05, "median": 0.5, "p95": 0.95}
    got = {r["g"]: r for r in statistics.quantiles(df, "v", shares, ["g"]).collect()}
    assert set(got) == {"a", "b", None}
    for g, r in got.items():
        v = [x for k, x in data if k == g and x is not None]
        assert r["n"] == len(v) and all(abs(r[n] - np.quantile(v, p)) < 1e-9 for n, p in shares.items())
    whole = statistics.quantiles(df, "v", shares).first()
    assert abs(whole["median"] - np.median([x for _, x in data if x is not None])) < 1e-9
    assert statistics.quantiles(df.limit(0), "v", shares, ["g"]).collect() == [] and statistics.quantiles(df.limit(0), "v", shares).first()["n"] is None
    assert statistics.trim(df.filter("g = 'a'"), "v").count() == sum(np.quantile([x for k, x in data if k == "a"], 0.02) <= x <= np.quantile([x for k, x in data if k == "a"], 0.98) for k, x in data if k == "a")


def test_rotation_scores_and_residual_fit(points):
    lat, lon, z, df = points
    v = unit(lat, lon)
    x, y, w = v.T
    quad = np.column_stack([x * y, y * w, 3 * w * w - 1, x * w, x * x - y * y])
    r = fits.rotation_scores(df, fits.rotation_scan(df, [(40, -175)], [21], [10.0])).first()
    pole = unit(np.array([r["rotated_pole_lat"]]), np.array([r["rotated_pole_lon"]]))[0]
    rot = (v @ pole) ** 2 - w**2
    rot /= rot.std()
    d = np.column_stack([np.ones(len(z)), rot, quad])
    beta = np.linalg.solve(d.T @ d + np.diag([0, 1e-9, *[10.0] * 5]), d.T @ z)
    left = z - d @ beta
    rank = lambda a: np.argsort(np.argsort(a))
    assert np.allclose([r["intercept"], r["rotation_coeff"], r["quadrupole_norm"]], [beta[0], beta[1], np.linalg.norm(beta[2:])])
    assert np.allclose([r["rmse"], r["mae"], r["spearman"]], [np.sqrt((left**2).mean()), np.abs(left).mean(), np.corrcoef(rank(d @ beta), rank(z))[0, 1]])
    f = fits.residual_fit(df).first()
    b1, l1 = r2_of(v, z)
    both = r2_of(np.column_stack([v, quad]), z)[1]
    rest = z - np.column_stack([np.ones(len(z)), v]) @ b1
    assert np.allclose([f["r2_l1"], f["r2_l1_l2"], f["r2_residual_l2"]], [l1, both, r2_of(quad, rest)[1]]) and f["r2_two_steps"] <= both + 1e-9
    with pytest.raises(ValueError):
        fits.rotation_scores(df, df.sparkSession.range(fits.MOST_SCORED + 1))


def test_tables_of_no_kind_and_odd_rows(spark):
    from tidemark.operators import tables

    html = ["<table><tr><td>a</td></tr></table>", "", None, "<table><tr><td>Beach name</td><td>Age</td></tr><tr><td></td><td></td></tr><tr><td>x</td></tr><tr><td>5 fathom beach</td><td>none</td></tr></table>"]
    items = spark.createDataFrame([(f"s{i}", i, None, h) for i, h in enumerate(html)], "source_id string, table_no int, caption string, html string")
    docs = spark.createDataFrame([("s3", None, None)], "source_id string, title string, text string")
    got = tables.mined(items, docs).collect()
    assert [(r["source_id"], r["row"], r["elevation_m"], r["group_name"], r["age"]["num"], r["dating_method"]) for r in got] == [("s3", 2, -9.14, "x", None, "other")]
    assert tables.mined(items.limit(0), docs).collect() == []


def test_large_grids_are_broadcast_in_parts(points, monkeypatch):
    from tidemark.functions import placing

    df = points[3]
    want = sorted(tuple(r) for r in fits.plane_rescan(df, 22.0).collect())
    monkeypatch.setattr(placing, "MOST_BROADCAST", 40)
    got = sorted(tuple(r) for r in fits.plane_rescan(df, 22.0).collect())
    assert len(got) == len(want) == 9 * 16 and np.allclose(np.array(got, dtype=float), np.array(want, dtype=float), equal_nan=True)


def test_all_clusters_of_a_document_are_kept(spark):
    """Forty paragraphs are forty clusters, also those whose first 200 characters are alike; a text that comes twice is one."""
    from tidemark.operators import interpret as it

    same = "The terrace was surveyed in detail " * 8
    paragraphs = [f"{same}and has a water depth of {10 + i} m." for i in range(40)]
    docs = spark.createDataFrame([("a", "\n\n".join([*paragraphs, paragraphs[3]])), ("b", paragraphs[3])], "source_id string, text string")
    got = it.clusters(docs).collect()
    assert sorted((r["source_id"], r["n"], r["elevation_m"]) for r in got) == [("a", i + 1, -10.0 - i) for i in range(40)] + [("b", 1, -13.0)]
