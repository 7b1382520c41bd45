"""Queries: files written and read back, listings, grids, text helpers, model answers and streams in batch form."""

from __future__ import annotations

import json

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import functions as F

from tidemark.functions.placing import new_folder
from tidemark.operators import extraction as ex
from tidemark.operators import fields, interpret
from tidemark.plans.evidence import _RECORD_SQL, raw_records
from tidemark.plans.registry import query, table
from tidemark.sources import files, rasters
from tidemark.sources.sites import SITES_SQL, usable_sites
from tidemark.streaming import lease, machine, status


def _file_rows(spark, d):
    """`raw_records` as rows of a record file."""
    age = F.struct(F.col("age_ka").alias("num"), F.lit(None).cast("array<double>").alias("items"), F.lit(None).cast("string").alias("label"))
    r = raw_records(spark, d).withColumn("age_ka", age).withColumn("source_locator", F.struct(F.col("provenance").alias("page"), F.col("quote").alias("quote_or_paraphrase")))
    return r.withColumn("id", F.col("id").cast("string")).withColumn("indicative_range_m", F.when(F.col("indicative_range_m").isNotNull(), F.array("indicative_range_m", F.lit(2.5))))


@query("record_files", f"WITH {_RECORD_SQL} SELECT CAST(id AS VARCHAR) AS id, latitude, longitude, elevation_m, age_ka, record_class, coordinate_source, quote, provenance AS page, CASE WHEN indicative_range_m IS NOT NULL THEN 2.5::DOUBLE END AS range_top, confidence_score FROM r")
def record_files(spark, d):
    """All records written as record files, a part of them appended, and read back with numbers and nested columns parsed."""
    path, rows = new_folder(spark, "records"), _file_rows(spark, d)
    files.write_records(rows.filter("CAST(id AS BIGINT) % 3 > 0"), path)
    files.write_records(rows.filter("CAST(id AS BIGINT) % 3 = 0"), path, "append")
    r = files.read_records(spark, path)
    return r.select("id", "latitude", "longitude", F.col("elevation_m.num").alias("elevation_m"), F.col("age_ka.num").alias("age_ka"), "record_class", "coordinate_source", F.col("source_locator.quote_or_paraphrase").alias("quote"), F.col("source_locator.page").alias("page"), F.get("indicative_range_m", 1).alias("range_top"), "confidence_score")


@query("record_import", f"WITH {_RECORD_SQL} SELECT CAST(id AS VARCHAR) AS id, latitude, CAST(elevation_m AS DOUBLE) AS elevation_m, quote, 31::BIGINT AS n_columns FROM r")
def record_import(spark, d):
    """Record files taken as they are."""
    path = new_folder(spark, "records")
    files.write_records(_file_rows(spark, d), path)
    r = files.import_records(spark, path)
    return r.select("id", "latitude", F.col("elevation_m").try_cast("double").alias("elevation_m"), F.col("source_locator.quote_or_paraphrase").alias("quote"), F.lit(len(r.columns)).cast("long").alias("n_columns"))


def _reports(spark, d) -> str:
    """A folder with a text file for each nation, a file of another kind and a hidden one; 27 small files, which the driver writes."""
    folder = new_folder(spark, "reports")
    fs, at = pafs.FileSystem.from_uri(folder) if ":" in folder else (pafs.LocalFileSystem(), folder)
    fs.create_dir(f"{at}/deep", recursive=True)
    for r in table(spark, d, "nation").collect():
        text = f"\n  Report of {r['n_name']}\nPages: {r['n_nationkey']}\nAuthor: A: B\nPages: {r['n_nationkey'] + 1}\n\fSecond page of {r['n_name']}\n"
        with fs.open_output_stream(f"{at}/{'deep/' if r['n_nationkey'] % 2 else ''}Report {r['n_name']}.v1.txt") as f:
            f.write(text.encode())
    for name in ("Scan.JPG", ".hidden.txt"):
        with fs.open_output_stream(f"{at}/{name}") as f:
            f.write(b"x")
    return folder


_REPORT_ID = "'report_' || replace(lower(n_name), ' ', '_') || '.v1'"


@query("incoming_files", f"SELECT {_REPORT_ID} AS source_id, 'text' AS kind, CAST(60 + 2 * length(n_name) + length(CAST(n_nationkey AS VARCHAR)) + length(CAST(n_nationkey + 1 AS VARCHAR)) AS BIGINT) AS length FROM nation UNION ALL SELECT 'scan', 'unsupported', 1")
def incoming_files(spark, d):
    """A listing of a folder and its subfolders: source ids, kinds and lengths, hidden files left out."""
    return files.incoming(spark, _reports(spark, d)).select("source_id", "kind", "length")


@query("wanted_files", f"SELECT {_REPORT_ID} AS source_id FROM nation WHERE n_name IN ('NATION_3', 'NATION_17')")
def wanted_files(spark, d):
    """The files of a selection of sources."""
    return files.incoming(spark, _reports(spark, d), ["Report NATION_3.v1", "report nation_17.v1", "none"]).select("source_id")


@query("report_pages", f"SELECT {_REPORT_ID} AS source_id, 'Report of ' || n_name AS title, 1 AS page, CAST(NULL AS VARCHAR) AS text FROM nation UNION ALL SELECT {_REPORT_ID}, 'Report of ' || n_name, 2, 'Second page of ' || n_name FROM nation")
def report_pages(spark, d):
    """Whole text files with their titles, split at form feeds."""
    folder = _reports(spark, d)
    t = files.read_texts(spark, f"{folder}/deep").unionByName(files.read_texts(spark, f"{folder}/Report*"))
    return files.pages(t).select("source_id", "title", "page", F.when(F.col("page") == 2, F.trim(F.replace("text", F.lit("\n"), F.lit("")))).alias("text"))


@query("report_metadata", f"SELECT {_REPORT_ID} AS source_id, CAST(n_nationkey + 1 AS VARCHAR) AS pages, 'A: B' AS author FROM nation")
def report_metadata(spark, d):
    """`Key: value` lines: of equal keys the last, divided at the first colon."""
    folder = _reports(spark, d)
    t = files.read_texts(spark, f"{folder}/Report*").unionByName(files.read_texts(spark, f"{folder}/deep")).withColumn("m", files.metadata(F.col("text")))
    return t.select("source_id", F.col("m.Pages").alias("pages"), F.col("m.Author").alias("author"))


@query("delimited_files", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CAST(p_size AS VARCHAR) AS p_size FROM part")
def delimited_files(spark, d):
    """A table written with semicolons and read by the separator that its first line tells."""
    path = new_folder(spark, "delimited")
    table(spark, d, "part").select("p_partkey", "p_name", "p_size").write.option("header", True).option("sep", ";").csv(path)
    return files.read_delimited(spark, path)


def _listing(spark, d):
    """Orders as a listing of files: three to a customer's folder, some empty."""
    k = F.col("o_orderkey")
    path = F.concat(F.lit("file:/data/src"), (F.col("o_custkey") % 50).cast("string"), F.lit("/part"), k.cast("string"), F.lit(".csv"))
    return table(spark, d, "orders").select(path.alias("path"), F.when(k % 4 > 0, k).otherwise(0).alias("length"), F.col("o_orderdate").alias("modified"))


_LISTING_SQL = "f AS (SELECT 'src' || CAST(o_custkey % 50 AS VARCHAR) AS source, 'file:/data/src' || CAST(o_custkey % 50 AS VARCHAR) || '/part' || CAST(o_orderkey AS VARCHAR) || '.csv' AS path, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey ELSE 0 END AS length, o_orderdate AS modified FROM orders)"


@query("newest_file", f"WITH {_LISTING_SQL} SELECT path, length FROM f ORDER BY modified DESC, path DESC LIMIT 1")
def newest_file(spark, d):
    return files.newest(_listing(spark, d)).select("path", "length")


@query("stale_files", f"WITH {_LISTING_SQL}, r AS (SELECT max(modified) AS made FROM f WHERE path LIKE '%/part1.csv') SELECT path FROM f, r WHERE path NOT LIKE '%/part1.csv' AND modified > made")
def stale_files(spark, d):
    """Inputs that are newer than what was made of them."""
    return files.stale_inputs(_listing(spark, d), "/part1.csv").select("path")


@query("complete_sources", f"WITH {_LISTING_SQL} SELECT source, count(*) FILTER (length > 0) AS n FROM f GROUP BY source HAVING count(*) FILTER (length > 0) >= 20")
def complete_sources(spark, d):
    return files.complete_sources(_listing(spark, d), 20)


@query("geojson_lines", f"WITH {SITES_SQL} SELECT id, CASE WHEN id % 7 > 0 THEN longitude END AS lon, CASE WHEN id % 7 > 0 THEN latitude END AS lat, source_id FROM u")
def geojson_lines(spark, d):
    """Sites written as a feature a line and read back; without coordinates there is no geometry."""
    path = new_folder(spark, "features")
    s = usable_sites(spark, d).select("id", F.when(F.col("id") % 7 > 0, F.col("latitude")).alias("latitude"), "longitude", "source_id")
    files.write_geojson_lines(s, path)
    f = spark.read.schema("type string, geometry struct<type: string, coordinates: array<double>>, properties struct<id: long, source_id: int>").json(path)
    return f.select("properties.id", F.get("geometry.coordinates", 0).alias("lon"), F.get("geometry.coordinates", 1).alias("lat"), "properties.source_id")


@query("geocode_file", "SELECT CAST(n_nationkey * 3 - 30 AS DOUBLE) AS lat, CAST(n_nationkey * 7 - 80 AS DOUBLE) AS lon, n_name AS name FROM nation WHERE n_nationkey % 5 < 3")
def geocode_file(spark, d):
    """A feature collection of points, multi-points of one and of two points, and points out of range."""
    k = F.col("n_nationkey")
    at = F.concat(F.lit("["), (k * 7 - 80).cast("string"), F.lit(","), (k * 3 - 30).cast("string"), F.lit("]"))
    geometry = F.when(k % 5 < 2, F.concat(F.lit('{"type":"Point","coordinates":'), at, F.lit("}"))).when(k % 5 == 2, F.concat(F.lit('{"type":"MultiPoint","coordinates":['), at, F.lit("]}")))
    geometry = geometry.when(k % 5 == 3, F.concat(F.lit('{"type":"MultiPoint","coordinates":['), at, F.lit(",[0,0]]}"))).otherwise('{"type":"Point","coordinates":[200,5]}')
    each = table(spark, d, "nation").select(F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":{"name":"'), F.col("n_name"), F.lit('"}}')).alias("f"))
    path = new_folder(spark, "geocodes")
    each.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("value")).write.text(path)  # a nation a feature
    return files.read_geocodes(spark, path).select("lat", "lon", F.col("properties")["name"].alias("name"))


@query("raster_samples", f"WITH {SITES_SQL}, c AS (SELECT id, latitude, longitude, CAST(trunc((longitude + 180) / 7) AS BIGINT) AS c, CAST(trunc((90 - latitude) / 5) AS BIGINT) AS r FROM s) SELECT id, CASE WHEN c BETWEEN 0 AND 49 AND r BETWEEN 0 AND 35 AND (r * 50 + c) % 11 > 0 THEN CAST(r * 50 + c AS DOUBLE) END AS sampled_m FROM c")
def raster_samples(spark, d):
    """Sites sampled from a grid of cells, some without data, which ends before the eastmost sites."""
    from tidemark.sources.sites import sites

    cells = spark.range(36 * 50).select(F.floor(F.col("id") / 50).cast("int").alias("row"), (F.col("id") % 50).cast("int").alias("col"), F.when(F.col("id") % 11 > 0, F.col("id").cast("double")).otherwise(-9999.0).alias("value"))
    return files.sample_raster(sites(spark, d), cells, (-180.0, 90.0), (7.0, 5.0), (36, 50), -9999.0).select("id", "sampled_m")


@query("raster_file", f"WITH {SITES_SQL}, c AS (SELECT CAST(trunc(longitude + 180) AS BIGINT) AS c, CAST(trunc(90 - latitude) AS BIGINT) AS r, min(id) AS least FROM s GROUP BY 1, 2) SELECT id, CASE WHEN c BETWEEN 0 AND 349 AND least % 11 > 0 THEN CAST(least AS DOUBLE) END AS sampled_m FROM s JOIN c ON c.c = trunc(longitude + 180) AND c.r = trunc(90 - latitude)")
def raster_file(spark, d):
    """Sites sampled from a raster file of one-degree cells, written from the sites' least ids; some cells have no data, and the file ends before the eastmost sites."""
    from tidemark.sources.sites import sites

    s = sites(spark, d)
    cells = s.groupBy((F.col("longitude") + 180).cast("int").alias("c"), (90 - F.col("latitude")).cast("int").alias("r")).agg(F.min("id").alias("v")).filter("c < 350").collect()  # no more than 180 x 350 cells
    grid = np.full((180, 350), -9999.0)
    for x in cells:
        grid[x["r"], x["c"]] = x["v"] if x["v"] % 11 else -9999.0
    path = f"{new_folder(spark, 'raster')}.tif"
    rasters.write_raster(path, grid, (-180.0, 90.0), (1.0, 1.0), -9999.0, 64, rasters.DEFLATE, 3)
    return rasters.sample_file(s.select("id", "longitude", "latitude"), path).select("id", "sampled_m")


@query("run_report", f"WITH {_RECORD_SQL}, c AS (SELECT record_class, count(*) AS n FROM r GROUP BY record_class) SELECT '# Run' || chr(10) || chr(10) || 'Records: ' || CAST((SELECT count(*) FROM r) AS VARCHAR) || chr(10) || 'Unresolved: ' || CAST((SELECT count(*) FROM r WHERE latitude IS NULL) AS VARCHAR) || chr(10) || chr(10) || (SELECT string_agg('- ' || record_class || ': ' || CAST(n AS VARCHAR), chr(10) ORDER BY '- ' || record_class || ': ' || CAST(n AS VARCHAR)) FROM c) AS value")
def run_report(spark, d):
    r = raw_records(spark, d)
    return files.report(r, r.filter("latitude IS NULL"))


@query("block_items", "SELECT 's' || CAST(p_partkey % 10 AS VARCHAR) AS source_id, CAST(p_size + 1 AS BIGINT) AS page, CASE p_partkey % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'table' ELSE 'chart' END AS source, CASE WHEN p_partkey % 4 = 1 THEN p_name || chr(10) || 'a | b ' || p_type ELSE p_name END AS text FROM part WHERE p_partkey % 4 < 3")
def block_items(spark, d):
    """Image, table and chart items of content lists as blocks of text."""
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, "image").when(k % 4 == 1, "table").when(k % 4 == 2, "chart").otherwise("text")
    body = F.when(k % 4 == 1, F.concat(F.lit("<tr><td>a</td> <td>b</td></tr><p>"), F.col("p_type"), F.lit("</p>")))
    item = F.struct(kind.alias("type"), F.col("p_size").cast("long").alias("page_idx"), body.alias("table_body"), F.array("p_name").alias("captions"), F.array().cast("array<string>").alias("footnotes"), F.lit(None).cast("string").alias("text"))
    return files.page_blocks(table(spark, d, "part").select(F.concat(F.lit("s"), (k % 10).cast("string")).alias("source_id"), F.array(item).alias("items"))).select("source_id", "page", "source", "text")


@query("staged_texts", """WITH d AS (SELECT doc_id AS k, coalesce(text, '') AS t FROM documents) SELECT 's' || CAST(k AS VARCHAR) AS source_id, CASE WHEN k % 4 = 0 THEN length(t) ELSE length(t) + 2 + length(CAST(k AS VARCHAR)) + 1 END AS n_chars,
    CASE k % 3 WHEN 0 THEN 'Title ' || CAST(k AS VARCHAR) ELSE CASE WHEN k % 4 = 0 THEN coalesce(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], 's' || CAST(k AS VARCHAR)) ELSE CAST(k AS VARCHAR) END END AS title, CASE WHEN k % 3 = 0 THEN CAST(k % 7 + 1 AS INTEGER) END AS page_count FROM d""")
def staged_texts(spark, d):
    """Documents whose text comes from images where there is no other, with the titles and pages of their content items."""
    k = F.col("doc_id")
    own = F.concat(F.lit("# "), k.cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")))
    item = lambda kind, text, level, page: F.struct(F.lit(kind).alias("type"), text.alias("text"), F.lit(level).alias("text_level"), page.cast("int").alias("page_idx"))
    items = F.when(k % 3 == 0, F.array(item("text", F.lit(" "), 1, k * 0), item("text", F.concat(F.lit(" Title  "), k.cast("string")), 1, k % 7), item("image", F.lit("x"), 1, k * 0)))
    docs = table(spark, d, "documents").select(F.concat(F.lit("s"), k.cast("string")).alias("source_id"), F.when(k % 4 > 0, own).alias("native_text"), F.when(k % 4 != 1, F.when(k % 4 == 0, F.coalesce("text", F.lit(""))).otherwise(own)).alias("ocr_text"), items.alias("items"))
    return files.staged(files.better_text(docs)).select("source_id", F.length("text").alias("n_chars"), "title", "page_count")


@query("csv_documents", "SELECT lower('file_' || CAST(n_nationkey AS VARCHAR)) AS source_id, n_name AS title, n_name || ',a, \"b\",' || CAST(n_regionkey AS VARCHAR) || chr(10) || 'x,,z' AS text FROM nation")
def csv_documents(spark, d):
    """CSV files as documents, quoted cells without their quotes."""
    folder = new_folder(spark, "csv")
    fs, at = pafs.FileSystem.from_uri(folder) if ":" in folder else (pafs.LocalFileSystem(), folder)
    fs.create_dir(at, recursive=True)
    for r in table(spark, d, "nation").collect():  # 25 rows
        with fs.open_output_stream(f"{at}/File {r['n_nationkey']}.csv") as f:
            f.write(f'{r["n_name"]},"a, ""b""",{r["n_regionkey"]}\nx,,z\n'.encode())
    return files.csv_documents(spark, folder).select("source_id", "title", "text")


@query("json_sink", "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS balance, CASE WHEN c_custkey % 3 > 0 THEN '{\"balance\":' ELSE '{\"balance\":null,' END AS head FROM customer")
def json_sink(spark, d):
    """Rows written as JSON objects with sorted keys, read back as text and as columns."""
    path, k = new_folder(spark, "json"), F.col("c_custkey")
    files.write_json(table(spark, d, "customer").select(k.alias("id"), F.col("c_name").alias("name"), F.when(k % 3 > 0, F.col("c_acctbal")).alias("balance")), path)
    lines = spark.read.text(path)
    r = F.from_json("value", "id long, name string, balance double")
    return lines.select(r.alias("r"), "value").select("r.id", "r.name", "r.balance", F.when(F.col("value").startswith('{"balance":null,'), '{"balance":null,').otherwise(F.substring("value", 1, 11)).alias("head"))


@query("log_sink", "SELECT CAST(run AS INTEGER) AS run, CAST(c_custkey AS VARCHAR) AS value FROM customer, (SELECT unnest([0, 1]) AS run)")
def log_sink(spark, d):
    """A log that two runs append to, after a summary that it replaced."""
    path, lines = new_folder(spark, "log"), table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("value"))
    files.write_lines(lines.select(F.concat(F.lit("old "), "value").alias("value")), path)
    files.write_lines(lines.select(F.concat(F.lit("0 "), "value").alias("value")), path)
    files.write_lines(lines.select(F.concat(F.lit("1 "), "value").alias("value")), path, append=True)
    return spark.read.text(path).select(F.substring_index("value", " ", 1).cast("int").alias("run"), F.substring_index("value", " ", -1).alias("value"))


@query("discovery_sink", "SELECT 'Work \"' || p_name || '\", part ' || CAST(p_partkey AS VARCHAR) AS title, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS authors, CAST(p_size + 1970 AS VARCHAR) AS year, '10.1000/' || CAST(p_partkey AS VARCHAR) AS doi, '' AS url, p_type AS search_keywords_matched, '2024-05-01' AS search_date FROM part")
def discovery_sink(spark, d):
    """Found works written as CSV with the date of the search, and read back."""
    path, k = new_folder(spark, "found"), F.col("p_partkey")
    works = table(spark, d, "part").select(F.concat(F.lit('Work "'), "p_name", F.lit('", part '), k.cast("string")).alias("title"), F.when(k % 2 == 0, F.col("p_brand")).alias("authors"), (F.col("p_size") + 1970).alias("year"), F.concat(F.lit("10.1000/"), k.cast("string")).alias("doi"), F.col("p_type").alias("search_keywords_matched"))
    files.write_discovery(works, path, "2024-05-01")
    r = spark.read.option("escape", '"').csv(path, header=True)
    return r.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in r.columns))


@query("field_columns", "WITH f AS (SELECT CAST(l_linenumber * 10 AS DOUBLE) AS lat, CAST(l_quantity * 13 AS DOUBLE) AS lon, l_tax AS m FROM lineitem WHERE l_returnflag <> 'R'), w AS (SELECT lat, lon + 180 - 360 * floor((lon + 180) / 360) - 180 AS lon, m FROM f) SELECT lat, lon, min(m) AS m FROM w GROUP BY lat, lon")
def field_columns(spark, d):
    """A scalar field from columns of other names, as text, some of it no number."""
    f = table(spark, d, "lineitem").select((F.col("l_linenumber") * 10).cast("string").alias("Latitude"), (F.col("l_quantity") * 13).cast("string").alias("LONG"), F.when(F.col("l_returnflag") != "R", F.col("l_tax").cast("string")).otherwise("n/a").alias("Mach"))
    return fields.load_field(f)


@query("candidate_files", "WITH a AS (SELECT o_orderkey AS seq, CAST(o_custkey % 60 AS DOUBLE) AS axis_lat, CAST(o_custkey % 90 AS DOUBLE) AS axis_lon, 21.0::DOUBLE AS angle_deg FROM orders ORDER BY 1 LIMIT 300), b AS (SELECT CAST(s_suppkey AS DOUBLE) AS axis_lat, 0.0::DOUBLE AS axis_lon FROM supplier) SELECT DISTINCT 'a' AS file, axis_lat, axis_lon, angle_deg FROM a UNION ALL SELECT 'b', axis_lat, axis_lon, NULL FROM (SELECT DISTINCT * FROM b ORDER BY axis_lat LIMIT 300)")
def candidate_files(spark, d):
    """The first 300 candidates of each table, which is the operator's limit; a table without axes is left out."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 60).cast("double").alias("axis_lat"), (F.col("o_custkey") % 90).cast("double").alias("axis_lon"), F.lit(21.0).alias("angle_deg"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_suppkey").cast("double").alias("axis_lat"), F.lit(0.0).alias("axis_lon"))
    return interpret.candidate_union([("a", o), ("b", s), ("c", table(spark, d, "region"))], 300).select("file", "axis_lat", "axis_lon", "angle_deg")


@query("manual_geocodes", f"WITH {_RECORD_SQL}, m AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_suppkey % 80 AS DOUBLE) END AS lat FROM supplier) SELECT r.id, lat AS latitude, CASE WHEN lat IS NOT NULL THEN lat + 1 END AS longitude, CASE WHEN lat IS NOT NULL THEN 'inferred_map' ELSE coordinate_source END AS coordinate_source FROM r LEFT JOIN m ON r.id = m.id")
def manual_geocodes(spark, d):
    """Manual geocodes before all other coordinates; a record that the table lacks has none."""
    k = F.col("s_suppkey")
    lat = F.when(k % 3 > 0, (k % 80).cast("double"))
    return interpret.with_geocodes(raw_records(spark, d), table(spark, d, "supplier").select(k.alias("id"), lat.alias("lat"), (lat + 1).alias("lon")), True).select("id", "latitude", "longitude", "coordinate_source")


@query("evidence_stages", "SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 'both' WHEN c_custkey % 3 = 0 THEN 'three' ELSE 'two' END AS kind, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS quote FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def evidence_stages(spark, d):
    """The records of two stages; of equal ids the later one's."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    two = c.filter(k % 2 == 0).select(k.alias("id"), F.lit("two").alias("kind"))
    three = c.filter(k % 3 == 0).select(k.alias("id"), F.when(k % 2 == 0, "both").otherwise("three").alias("kind"), F.col("c_name").alias("quote"))
    return interpret.evidence_union([two, three]).select("id", "kind", "quote")


@query("text_helpers", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN '{\"a\": ' || CAST(c_custkey AS VARCHAR) || '}' END AS salvaged, 'ok ' || c_mktsegment AS plain, CASE WHEN c_custkey % 4 = 3 THEN 'a0 et al.' ELSE array_to_string([CASE WHEN i < c_custkey % 4 + 1 THEN 'a' || CAST(i AS VARCHAR) END FOR i IN range(0, 3) IF i < c_custkey % 4 + 1], '; ') END AS authors, c_custkey + 0.5::DOUBLE AS total, 'Depth: ' || CAST(c_custkey AS VARCHAR) AS line FROM customer")
def text_helpers(spark, d):
    """JSON found in an answer, terminal codes removed, author lists, number lists and labelled lines."""
    k = F.col("c_custkey")
    n = k.cast("string")
    answer = F.when(k % 2 == 0, F.concat(F.lit('Sure: {"a": '), n, F.lit("} done"))).otherwise(F.concat(F.lit("{ no "), n, F.lit(" }")))
    names = F.transform(F.sequence(F.lit(0).cast("long"), k % 4), lambda i: F.concat(F.lit("a"), i.cast("string")))
    colour = F.concat(F.lit("\x1b[31mok\x1b[0m "), F.col("c_mktsegment"))
    numbers = F.aggregate(F.transform(ex.number_list(F.concat(n, F.lit(", , 0.5 ,x"))), lambda x: F.coalesce(x, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    text = F.concat(F.lit("first\nDepth: "), n, F.lit("\nother\n"))
    return table(spark, d, "customer").select(k.alias("id"), ex.salvage_json(answer).alias("salvaged"), ex.strip_controls(colour).alias("plain"), ex.author_list(names).alias("authors"), numbers.alias("total"), F.get(interpret.labelled_lines(text, ["depth"]), 0).alias("line"))


@query("named_features", "SELECT CAST(c_custkey AS VARCHAR) AS source_id, 'Terraces' AS name, 'Terraces. At ' || CAST(c_custkey AS VARCHAR) || ' m.' AS paragraph FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'Guyots', 'Guyots on two lines' FROM customer WHERE c_custkey % 2 = 0")
def named_features(spark, d):
    """Paragraphs that begin with the name of a feature."""
    k = F.col("c_custkey")
    text = F.concat(F.lit("Intro of Terraces.\n\nTerraces. At\n  "), k.cast("string"), F.lit(" m.\n \n"), F.when(k % 2 == 0, "Guyots\non two lines").otherwise("Guyotsx"))
    return interpret.feature_paragraphs(table(spark, d, "customer").select(k.cast("string").alias("source_id"), text.alias("text")), ["Terraces", "Guyots"])


def _answer(text: str) -> str | None:
    """A stand-in for a model: answers from the number in a text, sometimes with prose around, sometimes nothing."""
    n = int(text.split()[-1])
    if n % 4 == 3:
        return None if n % 8 == 3 else "no candidates {"
    return "Here: " + json.dumps({"candidate_records": [{"site_name": f"S{n}", "latitude": n % 200 - 100, "longitude": 5, "elevation_m": -n / 2, "coordinate_source": "reported" if n % 2 else "guessed"}]}) + " end"


@query("model_answers", "SELECT c_custkey AS id, 'S' || CAST(c_custkey AS VARCHAR) AS site_name, CAST(c_custkey % 200 - 100 AS DOUBLE) AS latitude, -c_custkey / 2.0::DOUBLE AS elevation_m, CASE WHEN c_custkey % 2 = 1 THEN 'reported' ELSE 'inferred_text' END AS coordinate_source FROM customer WHERE c_custkey % 4 < 3 AND abs(c_custkey % 200 - 100) <= 90")
def model_answers(spark, d):
    """A model's answers as candidate records; no JSON and places out of range give none."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("record "), F.col("c_custkey").cast("string")).alias("text"))
    return ex.interpreted(c, "id", "text", _answer).select("id", "site_name", "latitude", "elevation_m", "coordinate_source")


@query("dispatch_limits", "WITH m AS (SELECT event_id, event_id % 100 AS mem, event_id % 23 / 10.0::DOUBLE AS load, event_id % 17 AS disk FROM events) SELECT event_id, CAST(CASE WHEN mem >= 92 OR load >= 2.0 OR disk < 2 THEN 0 WHEN mem >= 82 AND load >= 1.4 THEN 2 WHEN mem >= 82 OR load >= 1.4 OR disk < 10 THEN 3 ELSE 6 END AS INTEGER) AS \"limit\" FROM m")
def dispatch_limits(spark, d):
    """How many of six jobs may start at each state of a machine."""
    k = F.col("event_id")
    return status.dispatch_limit(table(spark, d, "events").select("event_id", (k % 100).alias("memory_percent"), (k % 23 / 10.0).alias("load_per_cpu"), (k % 17).alias("disk_free_gb")), 6).select("event_id", "limit")


@query("stream_merge", "SELECT user_id AS id, count(*) AS n FROM (SELECT DISTINCT user_id FROM events) GROUP BY user_id")
def stream_merge(spark, d):
    """A stream of events, read in several batches, merged by one writer into a table of new keys; two runs over the same files add nothing."""
    source, path = new_folder(spark, "events"), new_folder(spark, "merged")
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), "event_type")
    e.repartition(4).write.parquet(source)
    for run in range(2):
        stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(source)
        stream.writeStream.foreachBatch(status.merge_into(path)).trigger(availableNow=True).option("checkpointLocation", new_folder(spark, f"stream{run}")).start().awaitTermination()
    return spark.read.parquet(path).groupBy("id").agg(F.count("*").alias("n"))


@query("stream_discovery", f"SELECT {_REPORT_ID} AS source_id FROM nation")
def stream_discovery(spark, d):
    """Text files found by a stream, each source once although each is there twice."""
    folder, path = _reports(spark, d), new_folder(spark, "found")
    fs, at = pafs.FileSystem.from_uri(folder) if ":" in folder else (pafs.LocalFileSystem(), folder)
    fs.delete_file(f"{at}/Scan.JPG")
    fs.create_dir(f"{at}/deep/again")
    for f in fs.get_file_info(pafs.FileSelector(at)):
        if f.base_name.startswith("Report"):
            fs.copy_file(f.path, f"{at}/deep/again/{f.base_name}")
    found = status.discovered(spark, f"{folder}/*", 10).unionByName(status.discovered(spark, f"{folder}/deep/*", 10)).dropDuplicates(["source_id"])
    found.select("source_id").writeStream.format("parquet").option("path", path).trigger(availableNow=True).option("checkpointLocation", new_folder(spark, "stream")).start().awaitTermination()
    return spark.read.parquet(path)


_MACHINE_SQL = f"""WITH e AS (SELECT event_id, user_id AS source_id, ['queued', 'running', 'completed', 'failed', 'skipped', 'restarted', 'running', 'unsupported', 'cancelled', 'none'][event_id * 7 % 10 + 1] AS w FROM events),
    g AS (SELECT source_id, list_concat([struct_pack(s := '', n := 0::BIGINT)], list(struct_pack(s := w, n := 0::BIGINT) ORDER BY event_id)) AS rows FROM e GROUP BY source_id),
    f AS (SELECT source_id, len(rows) - 1 AS events, list_reduce(rows, lambda a, x: CASE WHEN x.s NOT IN ({', '.join(f"'{w}'" for w in status.STATUSES)}) OR (a.s IN ({', '.join(f"'{w}'" for w in status.TERMINAL)}) AND x.s <> 'restarted') OR (x.s = 'queued' AND a.s = 'running') THEN a
        ELSE struct_pack(s := CASE WHEN x.s = 'restarted' THEN 'queued' ELSE x.s END, n := a.n + CASE WHEN a.s = (CASE WHEN x.s = 'restarted' THEN 'queued' ELSE x.s END) THEN 0 ELSE 1 END) END) AS r FROM g)
    SELECT source_id, nullif(r.s, '') AS status, r.n AS changes, CAST(events AS BIGINT) AS events FROM f"""


def _status_events(spark, d):
    words = F.array(*(F.lit(w) for w in ("queued", "running", "completed", "failed", "skipped", "restarted", "running", "unsupported", "cancelled", "none")))
    return table(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("source_id"), F.element_at(words, (F.col("event_id") * 7 % 10 + 1).cast("int")).alias("status"))


@query("source_machine", _MACHINE_SQL)
def source_machine(spark, d):
    """Each source's status after all its events, by maps that compose."""
    return machine.final_states(_status_events(spark, d))


@query("source_machine_stream", _MACHINE_SQL)
def source_machine_stream(spark, d):
    """The same from a stream of four files, one batch each, by keyed state."""
    source, path = new_folder(spark, "events"), new_folder(spark, "states")
    e = _status_events(spark, d).withColumn("source_id", F.col("source_id").cast("string"))
    for k in range(4):
        e.filter(F.floor(F.col("event_id") * 4 / (1 + e.agg(F.max("event_id")).scalar())) == k).write.mode("append").parquet(f"{source}/part={k}")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1_000_000)
    for k in range(4):  # one run for each file, from the same checkpoint: the order of batches is that of the events
        states = status.source_states(stream.parquet(f"{source}/part={k}") if k == 0 else stream.parquet(f"{source}/part=[0-{k}]"))
        states.writeStream.outputMode("update").foreachBatch(lambda b, i, k=k: b.write.mode("append").parquet(path)).trigger(availableNow=True).option("checkpointLocation", f"{path}-at").start().awaitTermination()
    s = spark.read.parquet(path)
    return s.groupBy("source_id").agg(F.max_by(F.struct("status", "changes", "events"), "events").alias("s")).select(F.col("source_id").cast("long").alias("source_id"), "s.*")


_TTL_MS = 3_600_000
_LEASE_SQL = f"""WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS ts, CAST(user_id AS VARCHAR) AS source_id, ['claim', 'heartbeat', 'release', 'claim', 'heartbeat'][event_id % 5 + 1] AS kind, 'h' || CAST(event_id // 3 % 3 AS VARCHAR) AS holder FROM events),
    g AS (SELECT source_id, list_concat([[struct_pack(event := '', holder := '', ts := 0::BIGINT, lh := '', le := 0::BIGINT, lr := '')]], list([struct_pack(event := kind, holder := holder, ts := ts, lh := '', le := 0::BIGINT, lr := '')] ORDER BY ts, event_id)) AS rows FROM e GROUP BY source_id),
    x AS (SELECT source_id, list_reduce(rows, lambda acc, y: list_concat(acc,
        CASE WHEN acc[len(acc)].lh <> '' AND y[1].ts > acc[len(acc)].le THEN [struct_pack(event := 'expired', holder := acc[len(acc)].lh, ts := acc[len(acc)].le, lh := '', le := 0::BIGINT, lr := 'expired')] ELSE [] END,
        [CASE WHEN y[1].event = 'claim' AND (acc[len(acc)].lh = '' OR y[1].ts > acc[len(acc)].le) THEN struct_pack(event := CASE WHEN acc[len(acc)].lh <> '' OR acc[len(acc)].lr = 'expired' THEN 'reclaimed' ELSE 'granted' END, holder := y[1].holder, ts := y[1].ts, lh := y[1].holder, le := y[1].ts + {_TTL_MS}, lr := '')
            WHEN acc[len(acc)].lh <> '' AND y[1].ts > acc[len(acc)].le THEN struct_pack(event := 'lost', holder := y[1].holder, ts := y[1].ts, lh := '', le := 0::BIGINT, lr := 'expired')
            WHEN acc[len(acc)].lh <> y[1].holder THEN struct_pack(event := CASE WHEN y[1].event = 'claim' THEN 'denied' ELSE 'lost' END, holder := y[1].holder, ts := y[1].ts, lh := acc[len(acc)].lh, le := acc[len(acc)].le, lr := acc[len(acc)].lr)
            WHEN y[1].event = 'release' THEN struct_pack(event := 'released', holder := y[1].holder, ts := y[1].ts, lh := '', le := 0::BIGINT, lr := 'released')
            ELSE struct_pack(event := 'renewed', holder := y[1].holder, ts := y[1].ts, lh := y[1].holder, le := y[1].ts + {_TTL_MS}, lr := acc[len(acc)].lr) END])) AS told FROM g),
    o AS (SELECT source_id, unnest(list_concat(told[2:], CASE WHEN told[len(told)].lh <> '' THEN [struct_pack(event := 'expired', holder := told[len(told)].lh, ts := told[len(told)].le, lh := '', le := 0::BIGINT, lr := '')] ELSE [] END)) AS t FROM x)
    SELECT source_id, t.event AS event, t.holder AS holder, t.ts AS ts_ms FROM o"""


@query("lease_stream", _LEASE_SQL)
def lease_stream(spark, d):
    """What becomes of the leases that the events claim, renew and release, from a stream run to its end; a last tick moves the watermark past all of them."""
    source, path = new_folder(spark, "events"), new_folder(spark, "leases")
    kinds = F.array(*(F.lit(k) for k in ("claim", "heartbeat", "release", "claim", "heartbeat")))
    i = F.col("event_id")
    e = table(spark, d, "events").select("event_id", F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp"))).alias("ts"), F.col("user_id").cast("string").alias("source_id"), F.element_at(kinds, (i % 5 + 1).cast("int")).alias("kind"), F.concat(F.lit("h"), F.floor(i / 3 % 3).cast("string")).alias("holder"))
    tick = e.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"), F.lit("~").alias("source_id"), F.lit("tick").alias("kind"), F.lit("").alias("holder"))
    e.write.parquet(f"{source}/part=0")
    tick.write.parquet(f"{source}/part=1")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for files in ("part=0", "part=[0-1]"):
            stream = spark.readStream.schema(e.schema).parquet(f"{source}/{files}")
            lease.lease_events(stream, _TTL_MS, "1 day").writeStream.format("parquet").option("path", path).trigger(availableNow=True).option("checkpointLocation", f"{path}-at").start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(path).filter("source_id <> '~'").select("source_id", "event", "holder", "ts_ms")
