"""Queries: text extraction, atlas rows, merging, lookups, checks and status tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions import text as tx
from tidemark.functions.placing import spread
from tidemark.operators import merge, records, unique
from tidemark.plans.registry import query, table
from tidemark.sources import atlas

def micros(name: str):
    """Microseconds since 1970 of a timestamp without a zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({name} AS TIMESTAMP_NTZ))")


_NOTE_SQL = "notes AS (SELECT doc_id, coalesce(text, '') || chr(10) || 'Water depth of ' || CAST(doc_id % 90 AS VARCHAR) || '.5 m off Cape Nord, ' || CAST(doc_id % 40 + 10 AS VARCHAR) || ',250 years B.P. and ' || CAST(doc_id % 900 + 300 AS VARCHAR) || ' years B.P. at ' || CAST(doc_id % 120 - 10 AS VARCHAR) || '.125, ' || CAST(doc_id % 360 - 180 AS VARCHAR) || '.5000 near Port Elin; submerged beach doi 10.1000/AB' || CAST(doc_id % 7 AS VARCHAR) || '.' AS note FROM documents)"


def notes(spark, d):
    k = F.col("doc_id")
    n = lambda x: x.cast("string")
    parts = ["\nWater depth of ", n(k % 90), ".5 m off Cape Nord, ", n(k % 40 + 10), ",250 years B.P. and ", n(k % 900 + 300), " years B.P. at ", n(k % 120 - 10), ".125, ", n(k % 360 - 180), ".5000 near Port Elin; submerged beach doi 10.1000/AB", n(k % 7), "."]
    return spread(table(spark, d, "documents"), "doc_id").select("doc_id", F.concat(F.coalesce("text", F.lit("")), *(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("note"))


@query("depth_extract", f"WITH {_NOTE_SQL} SELECT doc_id, TRY_CAST(regexp_extract(note, '(?:Water depth|water depth|Depth|depth)(?: of| at)?\\s+(?:of\\s+)?(\\d+(?:\\.\\d+)?)\\s*m', 1) AS DOUBLE) AS depth_m FROM notes")
def depth_extract(spark, d):
    return notes(spark, d).select("doc_id", tx.depth_m(F.col("note")).alias("depth_m"))


@query("age_extract", f"WITH {_NOTE_SQL}, a AS (SELECT doc_id, unnest(regexp_extract_all(substr(note, 1, 30000), '(?i)(\\d{{1,2}},\\d{{3}}|\\d{{3,5}})\\s*(?:yrs\\s*B\\.P\\.|years\\s*B\\.P\\.|B\\.P\\.)', 1)[1:5]) AS age FROM notes) SELECT doc_id, round(sum(CAST(replace(age, ',', '') AS DOUBLE) / 1000), 6) AS total_ka, count(*) AS n FROM a GROUP BY doc_id")
def age_extract(spark, d):
    """Ages of all notes; an age counts if it stands within the first 30 000 characters, which is the operator's rule."""
    n = notes(spark, d).select("doc_id", F.explode(tx.ages_ka(F.col("note"))).alias("age"))
    return n.groupBy("doc_id").agg(F.round(F.sum("age"), 6).alias("total_ka"), F.count("*").alias("n"))


_PAIR = r"\b(-?\d{1,2}\.\d{2,6})\s*,\s*(-?\d{1,3}\.\d{2,6})\b"
_LAT, _LON = r"(?i)(\d{1,2})\D+(\d{1,2})\D+(North|South)\s+Latitude", r"(?is)(\d{1,3})\D+(\d{1,2})\D+(West|East).{0,120}?Longitude"


def _dms_sql(pattern: str) -> str:
    g = lambda k: f"regexp_extract(note, '{pattern}', {k})"
    return f"(TRY_CAST({g(1)} AS DOUBLE) + TRY_CAST({g(2)} AS DOUBLE) / 60) * CASE WHEN lower({g(3)})[1] IN ('s', 'w') THEN -1 ELSE 1 END"


#: Coordinates as the text has them: degrees and minutes, else the first pair of decimals in range within 20 000 characters.
_COORDINATES_SQL = f"""{_NOTE_SQL}, parsed AS (SELECT doc_id, note, {_dms_sql(_LAT)} AS d_lat, {_dms_sql(_LON)} AS d_lon,
        list_filter(list_zip(list_transform(regexp_extract_all(substr(note, 1, 20000), '{_PAIR}', 1), lambda x: CAST(x AS DOUBLE)), list_transform(regexp_extract_all(substr(note, 1, 20000), '{_PAIR}', 2), lambda x: CAST(x AS DOUBLE))), lambda p: abs(p[1]) <= 90 AND abs(p[2]) <= 180)[1] AS pair FROM notes),
    located AS (SELECT doc_id, note, CASE WHEN abs(d_lat) <= 90 AND abs(d_lon) <= 180 THEN d_lat ELSE pair[1] END AS lat, CASE WHEN abs(d_lat) <= 90 AND abs(d_lon) <= 180 THEN d_lon ELSE pair[2] END AS lon FROM parsed)"""


@query("coordinate_extract", f"WITH {_COORDINATES_SQL} SELECT doc_id, lat, lon FROM located")
def coordinate_extract(spark, d):
    """Coordinates of all notes, null where none are in range; decimals count within the first 20 000 characters, which is the operator's rule."""
    return notes(spark, d).select("doc_id", tx.coordinates(F.col("note")).alias("c")).select("doc_id", "c.lat", "c.lon")


@query("place_queries", f"WITH {_NOTE_SQL}, p AS (SELECT doc_id, list_concat(regexp_extract_all(note, 'near\\s+([A-Z][A-Za-z\\-]+(?:\\s+[A-Z][A-Za-z\\-]+)*)', 1), regexp_extract_all(note, 'off\\s+([A-Z][A-Za-z\\-]+(?:\\s+[A-Z][A-Za-z\\-]+)*)', 1)) AS p FROM notes) SELECT doc_id, list_distinct_ordered AS places FROM (SELECT doc_id, list_filter(p, lambda x, i: list_position(p, x) = i)[1:5] AS list_distinct_ordered FROM p)")
def place_queries(spark, d):
    """The places that every note names after `near` and `off`, five at most, which is the operator's rule."""
    return notes(spark, d).select("doc_id", tx.places(F.col("note")).alias("places"))


WORDS = ["submerged beach", "raised beach", "the", "licensed", "idiot", "%%%"]


@query("keyword_analysis", f"WITH {_NOTE_SQL}, k(word) AS (VALUES " + ", ".join(f"('{w}')" for w in WORDS) + ") SELECT word, count(*) AS n_docs FROM notes JOIN k ON contains(lower(note), word) GROUP BY word")
def keyword_analysis(spark, d):
    return notes(spark, d).select(F.explode(tx.keywords(F.col("note"), WORDS)).alias("word")).groupBy("word").agg(F.count("*").alias("n_docs"))


@query("doc_quality", r"""WITH c AS (SELECT doc_id, CAST(length(text) AS DOUBLE) AS total, length(regexp_replace(text, '\p{L}', '', 'g')) AS no_alpha, length(regexp_replace(text, '\s', '', 'g')) AS no_ws, length(regexp_replace(text, '[^\x00-\x7e°–—©]', '', 'g')) AS no_weird,
    list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:200] AS l FROM documents), m AS (
    SELECT *, list_sum(list_transform(l, lambda x: length(x))) / CAST(greatest(len(l), 1) AS DOUBLE) AS mean FROM c)
    SELECT doc_id, round_even(greatest(0, least(1, (total - no_alpha) / total * 0.45 + least((total - no_ws) / total, 0.25) * 1.2 + (1 - least((total - no_weird) / total, 0.2)) * 0.25 + CASE WHEN mean BETWEEN 25 AND 180 THEN 1.0 ELSE 0.6 END * 0.1)), 3) AS quality FROM m""")
def doc_quality(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.quality(F.col("text")).alias("quality"))


@query("title_first_line", "WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents) SELECT doc_id, l[1] AS title, CAST(len(l) AS INTEGER) AS n_lines FROM l")
def title_first_line(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", tx.title(t).alias("title"), F.size(F.filter(F.transform(F.split(t, r"\R"), lambda x: F.trim(x)), lambda x: x != "")).alias("n_lines"))


@query("kwic", f"WITH {_NOTE_SQL}, p AS (SELECT doc_id, note, strpos(lower(note), 'submerged beach') AS pos FROM notes) SELECT doc_id, trim(regexp_replace(substr(note, greatest(pos - 40, 1), least(60, pos + 19)), '\\s+', ' ', 'g')) AS quote FROM p WHERE pos > 0")
def kwic(spark, d):
    return notes(spark, d).select("doc_id", tx.in_context(F.col("note"), "submerged beach", 40, 20).alias("quote")).filter("quote IS NOT NULL")


@query("html_tables", "SELECT page_id, CAST(len(regexp_extract_all(html, '(?is)<tr\\b[^>]*>(.*?)</tr\\s*>', 1)) AS INTEGER) AS n_rows, CAST(len(regexp_extract_all(html, '(?is)<t[dh]\\b[^>]*>(.*?)</t[dh]\\s*>', 1)) AS INTEGER) AS n_cells FROM pages")
def html_tables(spark, d):
    p = table(spark, d, "pages")
    rows = F.regexp_extract_all("html", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1))
    return p.select("page_id", F.size(rows).alias("n_rows"), F.size(F.regexp_extract_all("html", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), F.lit(1))).alias("n_cells"))


@query("html_text", "WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM pages) SELECT page_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS digest FROM t")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", tx.html_text(F.col("html")).alias("t")).select("page_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


@query("doi_extract", f"WITH {_NOTE_SQL} SELECT doc_id, lower(rtrim(regexp_extract(note, '(10\\.\\d{{4,9}}/[^\\s\"<>]+)', 1), '.,;:)]')) AS doi FROM notes")
def doi_extract(spark, d):
    return notes(spark, d).select("doc_id", F.get(tx.dois(F.col("note")), 0).alias("doi"))


@query("doi_novelty", f"WITH {_NOTE_SQL}, w AS (SELECT doc_id, lower(rtrim(regexp_extract(note, '(10\\.\\d{{4,9}}/[^\\s\"<>]+)', 1), '.,;:)]')) AS doi FROM notes) SELECT min(doc_id) AS doc_id, doi FROM w WHERE doi NOT IN ('10.1000/ab0', '10.1000/ab3') GROUP BY doi")
def doi_novelty(spark, d):
    known = spark.range(1).select(F.explode(F.array(F.lit("10.1000/AB0"), F.lit("10.1000/ab3 "))).alias("doi"))
    return merge.novel(doi_extract(spark, d), known, order=("doc_id",))


@query("paragraphs", "WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents) SELECT doc_id, count(*) AS n, CAST(max(length(p)) AS INTEGER) AS longest FROM p WHERE trim(p) <> '' GROUP BY doc_id")
def paragraphs(spark, d):
    p = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("p")).filter("trim(p) <> ''")
    return p.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("p")).alias("longest"))


@query("section_carry", "WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN turn END AS head FROM conversations) SELECT conv_id, turn, last_value(head IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM c")
def section_carry(spark, d):
    """Headings carried down to the rows that follow, within one table or document."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("section"))


def atlas_rows(spark, d):
    """An atlas export derived from orders and lineitem keys."""
    k = F.col("o_orderkey")
    pick = lambda values, by: F.element_at(F.array(*(F.lit(v) for v in values)), (by % len(values)).cast("int") + 1)
    n = lambda c, test: F.when(test, c.cast("string")).otherwise("")
    return table(spark, d, "orders").select(
        F.when(k % 17 == 0, "").otherwise(k.cast("string")).alias("WALIS_ID"),
        n(k % 181 - 90, k % 13 > 0).alias("Latitude"), (k % 360 - 180).cast("string").alias("Longitude"),
        pick(["Sea Level Indicator", "Marine Limiting", "Terrestrial Limiting"], k).alias("Type of datapoint"),
        pick(["Marine Terrace", "Coral reef terrace (general definition)", "Tidal notch", "Beach deposit or beachrock", "Limiting indicator", "Other thing", "Shell bed"], F.floor(k / 3)).alias("RSL Indicator"),
        F.lit("").alias("RSL indicator description"),
        n(k % 40 - 20, k % 5 > 0).alias("Elevation (m)"), n(k % 23 - 11, k % 3 == 0).alias("Paleo RSL (m)"), n(k % 9, k % 7 == 0).alias("Paleo water depth estimate (m)"),
        n(k % 250 - 50, k % 4 > 0).alias("Distance from sample"), pick(["Mean Sea Level", "EGM2008", "Lowest Astronomical Tide", "local"], k).alias("Vertical datum"),
        pick(["U-Series", "Luminescence", "AAR", "ESR", "Stratigraphic constraint", "radiocarbon", "none"], k).alias("Dating technique"), pick(["Older than", "Younger than", "Equal to", ""], k).alias("Timing constraint"),
        n(k % 130, k % 6 == 0).alias("U-Series corrected age (speleothems, ka)"), n(k % 120, k % 6 == 1).alias("U-Series recalculated age (ka)"), n(k % 110, k % 6 == 2).alias("Reported age (ka)"),
        n(k % 100, k % 6 == 3).alias("Stratigraphy Lower Age (ka)"), n(k % 140, k % 12 == 3).alias("Stratigraphy Upper Age (ka)"), F.when(k % 6 == 4, "MIS 5e").otherwise("").alias("Marine Isotopic Stage"),
        n(k % 6, k % 8 == 0).alias("Lower limit of living range (m)"), n(k % 11, k % 8 < 2).alias("Upper limit of living range (m)"), n(k % 4, k % 8 > 3).alias("IR"), n(k % 3, k % 8 > 2).alias("RWL"),
        (k % 6).cast("string").alias("Quality of RSL information"), (k % 5).cast("string").alias("Quality of age information"), pick(["Yes", "no"], k).alias("Originally accepted?"),
    )


_ATLAS_SQL = """a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 > 0 THEN CAST(o_orderkey % 181 - 90 AS DOUBLE) END AS lat, CAST(o_orderkey % 360 - 180 AS DOUBLE) AS lon, CASE o_orderkey % 3 WHEN 0 THEN 'sea_level_indicator' WHEN 1 THEN 'marine_limiting' ELSE 'terrestrial_limiting' END AS record_class,
    CAST(floor(o_orderkey / 3) AS BIGINT) % 7 AS i, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 40 - 20 AS DOUBLE) END AS elev, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 23 - 11 AS DOUBLE) END AS paleo,
    CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey % 9 AS DOUBLE) END AS depth, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 250 - 50 AS DOUBLE) END AS dist FROM orders), r AS (
    SELECT *, CASE i WHEN 0 THEN 'marine_terrace' WHEN 1 THEN 'coral_reef' WHEN 2 THEN 'tidal_notch' WHEN 3 THEN 'beachrock' WHEN 4 THEN CASE WHEN record_class = 'marine_limiting' THEN 'subtidal_facies' ELSE 'marine_over_terrestrial_contact' END WHEN 6 THEN 'marine_shell_bed' END AS indicator_type FROM a), q AS (
    SELECT *, CASE WHEN k % 17 = 0 THEN 'missing_walis_id' WHEN lat IS NULL THEN 'missing_coordinates' WHEN indicator_type IS NULL THEN 'unmapped_indicator' END AS reason FROM r)"""


@query("atlas_texts", """WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS w, ['Marine Terrace', 'Coral reef terrace (general definition)', 'Tidal notch', 'Beach deposit or beachrock', 'Limiting indicator', 'Other thing', 'Shell bed'][CAST(floor(o_orderkey / 3) AS BIGINT) % 7 + 1] AS indicator, CASE WHEN o_orderkey % 3 > 0 THEN 'Bay ' || CAST(o_orderkey % 9 AS VARCHAR) ELSE '' END AS site, CASE WHEN o_orderkey % 4 = 0 THEN 'north' ELSE '' END AS sub FROM orders)
    SELECT k, indicator AS description, array_to_string(list_filter([site, sub, 'Region', 'Nation'], lambda x: x <> ''), ', ') AS location_name, CASE WHEN site <> '' OR sub <> '' THEN array_to_string(list_filter([site, sub], lambda x: x <> ''), ' - ') ELSE w END AS site_name FROM a""")
def atlas_texts(spark, d):
    """Descriptions, locations and sites composed of what is not blank."""
    k = F.col("k")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).withColumns({
        "WALIS_ID": F.when(k % 17 == 0, "").otherwise(k.cast("string")), "RSL Indicator": F.element_at(F.array(*(F.lit(v) for v in ("Marine Terrace", "Coral reef terrace (general definition)", "Tidal notch", "Beach deposit or beachrock", "Limiting indicator", "Other thing", "Shell bed"))), (F.floor(k / 3) % 7).cast("int") + 1),
        "RSL indicator description": F.lit(None).cast("string"), "Site": F.when(k % 3 > 0, F.concat(F.lit(" Bay  "), (k % 9).cast("string"))), "Subsite": F.when(k % 4 == 0, "north").otherwise(" "), "Region": F.lit("Region"), "Nation": F.lit("Nation"),
        "Quality of RSL information": F.lit("3"), "Quality of age information": F.lit(""), "Originally accepted?": F.lit("yes"), "Accepted by other study?": F.lit(""),
    })
    t = atlas.texts()
    return atlas.cleaned(rows).select(F.col("k").cast("long").alias("k"), *(t[n].alias(n) for n in ("description", "location_name", "site_name")))


@query("atlas_skipped", f"WITH {_ATLAS_SQL} SELECT reason, count(*) AS n FROM q WHERE reason IS NOT NULL GROUP BY reason")
def atlas_skipped(spark, d):
    return atlas.skipped(atlas_rows(spark, d))


@query("atlas_canonical", f"""WITH {_ATLAS_SQL} SELECT CAST(k AS VARCHAR) AS sample_id, record_class, indicator_type, lat AS latitude, lon AS longitude, CASE WHEN dist >= 0 THEN dist ELSE 100.0 END AS coordinate_uncertainty_m, coalesce(paleo, elev) AS elevation_m, elev AS reported_elevation_m, CASE WHEN depth > 0 THEN depth WHEN elev < 0 THEN -elev END AS reported_depth_m,
    CASE k % 4 WHEN 2 THEN 'LAT' WHEN 3 THEN 'unknown' ELSE 'MSL' END AS elevation_reference, CASE k % 7 WHEN 0 THEN 'u_series' WHEN 1 THEN 'luminescence' WHEN 2 THEN 'aar' WHEN 3 THEN 'esr' WHEN 4 THEN 'stratigraphic_context' WHEN 5 THEN 'radiocarbon' ELSE 'other' END AS dating_method,
    CASE k % 4 WHEN 0 THEN 'older_than' WHEN 1 THEN 'younger_than' WHEN 2 THEN 'equal' ELSE CASE WHEN k % 6 = 3 THEN 'range' ELSE 'unknown' END END AS age_relation,
    CASE k % 6 WHEN 0 THEN CAST(k % 130 AS DOUBLE) WHEN 1 THEN CAST(k % 120 AS DOUBLE) WHEN 2 THEN CAST(k % 110 AS DOUBLE) END AS age_num, CASE WHEN k % 6 = 3 THEN CAST(k % 100 AS DOUBLE) END AS age_lo, CASE WHEN k % 12 = 3 THEN CAST(k % 140 AS DOUBLE) END AS age_hi, CASE WHEN k % 6 = 4 THEN 'MIS 5e' END AS age_label,
    CASE WHEN k % 8 = 0 THEN CAST(k % 6 AS DOUBLE) WHEN k % 8 = 1 THEN NULL WHEN k % 8 > 3 THEN k % 3 - abs(k % 4) / 2.0::DOUBLE END AS range_lo, CASE WHEN k % 8 < 2 THEN CAST(k % 11 AS DOUBLE) WHEN k % 8 > 3 THEN k % 3 + abs(k % 4) / 2.0::DOUBLE END AS range_hi FROM q WHERE reason IS NULL""")
def atlas_canonical(spark, d):
    c = atlas.canonical(atlas_rows(spark, d))
    return c.select(*(x for x in c.columns if x not in ("age", "indicative_range_m")), F.col("age.num").alias("age_num"), F.col("age.lo").alias("age_lo"), F.col("age.hi").alias("age_hi"), F.col("age.label").alias("age_label"), F.get("indicative_range_m", 0).alias("range_lo"), F.get("indicative_range_m", 1).alias("range_hi"))


_POINTS_SQL = "p AS (SELECT o_orderkey AS seq, CAST(o_custkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS elevation_m, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus WHEN o_orderkey % 4 = 1 THEN 'null' END AS notes, o_orderpriority AS method FROM orders)"


def points(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("seq"), F.col("o_custkey").cast("string").alias("id"), F.when(k % 3 == 0, F.col("o_totalprice")).alias("elevation_m"), F.when(k % 4 == 0, F.col("o_orderstatus")).when(k % 4 == 1, "null").alias("notes"), F.col("o_orderpriority").alias("method"))


@query("keep_last", f"WITH {_POINTS_SQL} SELECT id, max(seq) AS seq, min(seq) AS place, arg_max(method, seq) AS method FROM p GROUP BY id")
def keep_last(spark, d):
    return merge.keep_last(points(spark, d)).select("id", "seq", "place", "method")


_FOLD_SQL = """r AS (SELECT id, elevation_m AS e, notes AS n, method AS m, row_number() OVER (PARTITION BY id ORDER BY seq) AS k FROM p), fold AS (
    SELECT id, k, e, n, m FROM r WHERE k = 1
    UNION ALL
    SELECT id, k, CASE WHEN t THEN coalesce(ae, be) ELSE coalesce(be, ae) END, CASE WHEN t THEN CASE WHEN coalesce(lower(trim(an)) NOT IN ('', 'null', 'none'), false) OR NOT coalesce(lower(trim(bn)) NOT IN ('', 'null', 'none'), false) THEN an ELSE bn END ELSE CASE WHEN coalesce(lower(trim(bn)) NOT IN ('', 'null', 'none'), false) OR NOT coalesce(lower(trim(an)) NOT IN ('', 'null', 'none'), false) THEN bn ELSE an END END, CASE WHEN t THEN CASE WHEN coalesce(lower(trim(am)) NOT IN ('', 'null', 'none'), false) OR NOT coalesce(lower(trim(bm)) NOT IN ('', 'null', 'none'), false) THEN am ELSE bm END ELSE CASE WHEN coalesce(lower(trim(bm)) NOT IN ('', 'null', 'none'), false) OR NOT coalesce(lower(trim(am)) NOT IN ('', 'null', 'none'), false) THEN bm ELSE am END END FROM (
        SELECT *, CASE WHEN (ae IS NOT NULL) <> (be IS NOT NULL) THEN ae IS NOT NULL ELSE ((CASE WHEN ae IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN coalesce(lower(trim(an)) NOT IN ('', 'null', 'none'), false) THEN 1 ELSE 0 END) + (CASE WHEN coalesce(lower(trim(am)) NOT IN ('', 'null', 'none'), false) THEN 1 ELSE 0 END)) > ((CASE WHEN be IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN coalesce(lower(trim(bn)) NOT IN ('', 'null', 'none'), false) THEN 1 ELSE 0 END) + (CASE WHEN coalesce(lower(trim(bm)) NOT IN ('', 'null', 'none'), false) THEN 1 ELSE 0 END)) END AS t
        FROM (SELECT f.id, r.k, f.e AS ae, f.n AS an, f.m AS am, r.e AS be, r.n AS bn, r.m AS bm FROM fold f JOIN r ON f.id = r.id AND r.k = f.k + 1) AS j) AS w)
    SELECT id, e AS elevation_m, n AS notes, m AS method FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k DESC) AS z FROM fold) AS x WHERE z = 1"""


@query("fold_duplicates", f"WITH RECURSIVE {_POINTS_SQL}, {_FOLD_SQL}")
def fold_duplicates(spark, d):
    return merge.fold_duplicates(points(spark, d))


@query("append_merge", f"WITH {_POINTS_SQL} SELECT id, seq, method FROM p WHERE seq % 5 = 0 UNION ALL SELECT id, min(seq), arg_min(method, seq) FROM p WHERE seq % 5 > 0 AND id NOT IN (SELECT id FROM p WHERE seq % 5 = 0) GROUP BY id")
def append_merge(spark, d):
    p = points(spark, d).select("id", "seq", "method")
    return merge.append_merge(p.filter("seq % 5 = 0"), p.filter("seq % 5 > 0"))


@query("key_variant_lookup", "WITH l AS (SELECT p_partkey AS id, CAST(p_partkey % 30 AS VARCHAR) AS n FROM part), t AS (SELECT s_suppkey AS seq, CASE WHEN s_suppkey % 2 = 0 THEN lpad(CAST(s_suppkey % 30 AS VARCHAR), 2, '0') ELSE 'K-' || CAST(s_suppkey AS VARCHAR) END AS key FROM supplier), m AS (SELECT id, min(seq) AS seq FROM l JOIN t ON TRY_CAST(key AS BIGINT) = CAST(n AS BIGINT) GROUP BY id) SELECT id, m.seq, key FROM m JOIN t ON m.seq = t.seq")
def key_variant_lookup(spark, d):
    l = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 30).cast("string").alias("n"))
    k = F.col("s_suppkey")
    t = table(spark, d, "supplier").select(k.alias("seq"), F.when(k % 2 == 0, F.lpad((k % 30).cast("string"), 2, "0")).otherwise(F.concat(F.lit("K-"), k.cast("string"))).alias("key"))
    return merge.lookup(l, t, ["n"], ["key"], "seq").select("id", "seq", "key")


_OBS_SQL = "o AS (SELECT l_orderkey AS k, l_linenumber AS ln, CAST(l_suppkey % 5 AS VARCHAR) AS source_id, l_returnflag AS indicator_type, CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_partkey % 40 AS VARCHAR) ELSE '' END AS sample_id, 'Site-' || CAST(l_partkey % 300 AS VARCHAR) AS site_name, CASE WHEN l_linenumber % 2 = 0 THEN round(l_quantity) END AS elevation_m, CASE WHEN l_linenumber % 4 = 1 THEN round(l_tax * 100) / 10 END AS age_ka FROM lineitem)"


@query("semantic_anti", f"WITH {_OBS_SQL}, c AS (SELECT * FROM o WHERE k % 2 = 0), e AS (SELECT * FROM o WHERE k % 2 = 1) SELECT k, ln, site_name FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.source_id = c.source_id AND e.indicator_type = c.indicator_type AND ((c.sample_id <> '' AND e.sample_id = c.sample_id) OR (e.site_name = c.site_name AND (coalesce(abs(e.elevation_m - c.elevation_m) <= 1, false) OR coalesce(abs(e.age_ka - c.age_ka) <= 0.25, false) OR (e.elevation_m IS NULL AND c.elevation_m IS NULL AND e.age_ka IS NULL AND c.age_ka IS NULL)))))")
def semantic_anti(spark, d):
    ln, p = F.col("l_linenumber"), F.col("l_partkey")
    o = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), ln.alias("ln"), (F.col("l_suppkey") % 5).cast("string").alias("source_id"), F.col("l_returnflag").alias("indicator_type"), F.when(ln % 3 == 0, (p % 40).cast("string")).otherwise("").alias("sample_id"),
        F.concat(F.lit("Site-"), (p % 300).cast("string")).alias("site_name"), F.when(ln % 2 == 0, F.round("l_quantity")).alias("elevation_m"), F.when(ln % 4 == 1, F.round(F.col("l_tax") * 100) / 10).alias("age_ka"))
    return unique.not_seen(o.filter("k % 2 = 0"), o.filter("k % 2 = 1")).select("k", "ln", "site_name")


_SAME_SQL = """(k.id = x[1].id OR (k.source_id = x[1].source_id AND k.indicator_type = x[1].indicator_type AND ((k.sample_id <> '' AND k.sample_id = x[1].sample_id) OR ((k.site_name = x[1].site_name OR k.location_name = x[1].location_name)
    AND (coalesce(abs(k.e - x[1].e) <= 1, false) OR coalesce(abs(k.a - x[1].a) <= 0.25, false) OR (k.e IS NULL AND x[1].e IS NULL AND k.a IS NULL AND x[1].a IS NULL))))))"""


@query("semantic_unique", f"""WITH o AS (SELECT o_orderkey AS id, CAST(o_custkey % 25 AS VARCHAR) AS source_id, o_orderstatus AS indicator_type, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey % 40 AS VARCHAR) ELSE '' END AS sample_id, 'site' || CAST(o_custkey % 12 AS VARCHAR) AS site_name,
        'place' || CAST(o_orderkey % 9 AS VARCHAR) AS location_name, CASE WHEN o_orderkey % 5 > 0 THEN round(o_totalprice / 400) / 2 END AS e, CASE WHEN o_orderkey % 4 = 1 THEN CAST(o_orderkey % 400 AS DOUBLE) / 8 END AS a FROM orders),
    g AS (SELECT source_id, indicator_type, list([o] ORDER BY id) AS rows FROM o GROUP BY source_id, indicator_type),
    f AS (SELECT list_reduce(rows, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {_SAME_SQL})) > 0 THEN acc ELSE list_concat(acc, x) END) AS stay FROM g), t AS (SELECT unnest(stay) AS r FROM f) SELECT r.id AS id, r.source_id AS source_id, r.site_name AS site_name FROM t""")
def semantic_unique(spark, d):
    """Orders as observations, taken in the order of their ids: of those that are probably the same the first that no earlier taken one rules out."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, d, "orders").select(
        k.alias("id"), (c % 25).cast("string").alias("source_id"), F.col("o_orderstatus").alias("indicator_type"), F.when(k % 3 == 0, (c % 40).cast("string")).otherwise("").alias("sample_id"),
        F.concat(F.lit("Site "), (c % 12).cast("string")).alias("site_name"), F.concat(F.lit("place-"), (k % 9).cast("string")).alias("location_name"),
        F.when(k % 5 > 0, F.round(F.col("o_totalprice") / 400) / 2).alias("elevation_m"), F.when(k % 4 == 1, (k % 400).cast("double") / 8).alias("age_ka"))
    return unique.semantically_unique(o, order="id").select("id", "source_id", unique.plain(F.col("site_name")).alias("site_name"))


@query("id_sha256", "SELECT c_custkey AS key, sha256(concat_ws('|', CAST(c_nationkey AS VARCHAR), lower(trim(c_name)), '', printf('%.6f', CAST(c_custkey % 90 AS DOUBLE)), printf('%.6f', CAST(c_custkey % 180 AS DOUBLE)), c_mktsegment)) AS id FROM customer")
def id_sha256(spark, d):
    k = F.col("c_custkey")
    parts = [F.col("c_nationkey"), F.lower(F.trim("c_name")), F.lit(None), F.format_string("%.6f", (k % 90).cast("double")), F.format_string("%.6f", (k % 180).cast("double")), F.col("c_mktsegment")]
    return table(spark, d, "customer").select(k.alias("key"), records.record_id(parts).alias("id"))


_RECORD_SQL = "r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 9 > 0 THEN CAST(c_custkey % 200 - 100 AS DOUBLE) END AS latitude, CASE WHEN c_custkey % 11 > 0 THEN CAST(c_custkey % 400 - 200 AS DOUBLE) END AS longitude, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS elevation_m, CASE WHEN c_custkey % 4 = 0 THEN 12.0::DOUBLE END AS age_ka, CASE c_custkey % 4 WHEN 0 THEN 'reported' WHEN 1 THEN 'inferred_text' WHEN 2 THEN 'inferred_map' ELSE 'guess' END AS coordinate_source, CASE c_custkey % 3 WHEN 0 THEN 'sea_level_indicator' WHEN 1 THEN 'marine_limiting' ELSE 'other' END AS record_class, CASE WHEN c_custkey % 2 = 0 THEN 'q' END AS quote, CASE WHEN c_custkey % 5 = 0 THEN 1.0::DOUBLE END AS indicative_range_m, CASE WHEN c_custkey % 6 > 0 THEN 'p' END AS provenance, c_custkey % 13 / 10.0::DOUBLE AS confidence_score FROM customer)"


def raw_records(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("id"), F.when(k % 9 > 0, (k % 200 - 100).cast("double")).alias("latitude"), F.when(k % 11 > 0, (k % 400 - 200).cast("double")).alias("longitude"), F.when(k % 3 > 0, F.col("c_acctbal")).alias("elevation_m"), F.when(k % 4 == 0, 12.0).alias("age_ka"),
        F.when(k % 4 == 0, "reported").when(k % 4 == 1, "inferred_text").when(k % 4 == 2, "inferred_map").otherwise("guess").alias("coordinate_source"), F.when(k % 3 == 0, "sea_level_indicator").when(k % 3 == 1, "marine_limiting").otherwise("other").alias("record_class"),
        F.when(k % 2 == 0, "q").alias("quote"), F.when(k % 5 == 0, 1.0).alias("indicative_range_m"), F.when(k % 6 > 0, "p").alias("provenance"), (k % 13 / 10.0).alias("confidence_score"))


@query("confidence", f"WITH {_RECORD_SQL}, w AS (SELECT *, latitude IS NOT NULL AND longitude IS NOT NULL AS loc FROM r), t AS (SELECT *, CASE coordinate_source WHEN 'reported' THEN 0.10::DOUBLE WHEN 'inferred_text' THEN 0.05 ELSE 0.02 END + CASE WHEN loc THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN elevation_m IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN age_ka IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN quote IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN record_class = 'sea_level_indicator' THEN 0.15::DOUBLE ELSE 0.08 END + CASE WHEN indicative_range_m IS NOT NULL THEN 0.15::DOUBLE ELSE 0.05 END AS total FROM w), c AS (SELECT *, CASE WHEN NOT loc THEN least(total, 0.55) ELSE total END AS capped FROM t) SELECT id, round(CASE WHEN elevation_m IS NULL AND age_ka IS NULL THEN least(capped, 0.45) ELSE capped END, 3) AS confidence FROM c")
def confidence(spark, d):
    return raw_records(spark, d).select("id", records.confidence().alias("confidence"))


@query("validate_errors", f"WITH {_RECORD_SQL} SELECT id, array_to_string(list_filter([CASE WHEN record_class NOT IN ('sea_level_indicator', 'marine_limiting', 'terrestrial_limiting') THEN 'unknown record_class' END, CASE WHEN coordinate_source NOT IN ('reported', 'inferred_text', 'inferred_map') THEN 'unknown coordinate_source' END, CASE WHEN abs(latitude) > 90 THEN 'latitude out of range' END, CASE WHEN abs(longitude) > 180 THEN 'longitude out of range' END, CASE WHEN confidence_score > 1 THEN 'confidence_score out of range' END, CASE WHEN provenance IS NULL THEN 'no provenance' END], lambda x: x IS NOT NULL), '; ') AS errors FROM r")
def validate_errors(spark, d):
    return raw_records(spark, d).select("id", F.concat_ws("; ", records.validation_errors()).alias("errors"))


@query("elevation_texts", "WITH v AS (SELECT c_custkey AS id, c_custkey % 50 AS a, CAST(c_custkey % 50 + c_custkey % 7 AS DOUBLE) AS b FROM customer) SELECT id, CASE id % 3 WHEN 0 THEN CAST(a AS VARCHAR) WHEN 1 THEN CAST(a AS VARCHAR) ELSE '' END AS elevation_min, CASE id % 3 WHEN 0 THEN CAST(a AS VARCHAR) WHEN 1 THEN CAST(CAST(b AS BIGINT) AS VARCHAR) ELSE '' END AS elevation_max FROM v")
def elevation_texts(spark, d):
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, (k % 50).cast("string")).when(k % 3 == 1, F.concat(F.lit("["), (k % 50).cast("string"), F.lit(", null, "), (k % 50 + k % 7).cast("string"), F.lit("]"))).otherwise('"LGM"')
    t = records.elevation_texts(F.col("v"))
    return table(spark, d, "customer").select(k.alias("id"), records.union_value(raw).alias("v")).select("id", t["elevation_min"].alias("elevation_min"), t["elevation_max"].alias("elevation_max"))


@query("age_to_ka", "SELECT o_orderkey AS id, CASE WHEN o_totalprice > 1000 OR (o_orderkey % 2 = 0 AND o_totalprice > 300) THEN round_even(o_totalprice / 1000, 3) ELSE o_totalprice END AS age_ka FROM orders")
def age_to_ka(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), records.age_to_ka(F.col("o_totalprice"), F.when(F.col("o_orderkey") % 2 == 0, "Radiocarbon 14C").otherwise("AAR")).alias("age_ka"))


@query("elevation_normalise", f"WITH {_RECORD_SQL}, v AS (SELECT id, latitude, longitude, elevation_m, CASE WHEN id % 4 = 1 THEN 7.0::DOUBLE END AS reported, CASE WHEN id % 5 > 0 THEN floor(latitude) * 10 + 0.5 END AS dem FROM r) SELECT id, coalesce(reported, elevation_m, CASE WHEN longitude IS NOT NULL THEN dem END) AS elevation_m, CASE WHEN reported IS NOT NULL THEN 'reported' WHEN elevation_m IS NOT NULL THEN 'existing' WHEN latitude IS NULL OR longitude IS NULL THEN 'no coordinates' WHEN dem IS NULL THEN 'no raster value' ELSE 'raster' END AS derivation FROM v")
def elevation_normalise(spark, d):
    r = raw_records(spark, d).select("id", "latitude", "longitude", "elevation_m", F.lit("unknown").alias("depth_source"), F.when(F.col("id") % 4 == 1, 7.0).alias("reported_elevation_m"), F.when(F.col("id") % 5 > 0, F.floor("latitude") * 10 + 0.5).alias("sampled_m"))
    return records.normalized_elevation(r).select("id", "elevation_m", "derivation")


@query("json_field", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", records.json_number(F.col("props"), "k").alias("k"))


@query("status_latest", "SELECT user_id, arg_max(event_type, event_id) AS status, max(event_id) AS event_id, count(*) AS n FROM events GROUP BY user_id")
def status_latest(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"), F.max("event_id").alias("event_id"), F.count("*").alias("n"))


@query("lease_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g) SELECT user_id, epoch_us(min(ts)) AS first_us, count(*) AS n FROM s GROUP BY user_id, session")
def lease_sessions(spark, d):
    """Heartbeats of a holder that follow each other within the time-out are one lease."""
    s = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.min("ts").alias("first"), F.count("*").alias("n"))
    return s.select("user_id", micros("first").alias("first_us"), "n")


@query("event_windows", "SELECT event_type, epoch_us(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01')) AS day_us, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    w = table(spark, d, "events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return w.select("event_type", micros("w.start").alias("day_us"), "n", "total")


@query("node_registry", "WITH m AS (SELECT max(ts) AS now FROM events) SELECT user_id, epoch_us(max(ts)) AS seen_us, max(ts) >= (SELECT now FROM m) - INTERVAL 7 DAY AS healthy FROM events GROUP BY user_id")
def node_registry(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts")).scalar()
    return e.groupBy("user_id").agg(F.max("ts").alias("seen")).select("user_id", micros("seen").alias("seen_us"), (F.col("seen") >= now - F.expr("INTERVAL 7 DAYS")).alias("healthy"))


@query("label_join", "SELECT lang, count(*) AS n, sum(toxic)::BIGINT AS toxic, sum(quality)::BIGINT AS good FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def label_join(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return j.groupBy("lang").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.sum("quality").alias("good"))
