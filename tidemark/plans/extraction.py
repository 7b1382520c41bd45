"""Queries: depths, ages, tables, sections, references, queues and the processing of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import extraction as ex
from tidemark.operators import gazetteer, interpret
from tidemark.plans.evidence import _ATLAS_SQL, _COORDINATES_SQL, _NOTE_SQL, _RECORD_SQL, atlas_rows, notes, raw_records
from tidemark.plans.registry import query, table
from tidemark.sources import atlas


@query("depth_ranges", f"WITH {_NOTE_SQL} SELECT doc_id, doc_id % 90 + 0.5::DOUBLE AS mid, -(doc_id % 90 + 0.5::DOUBLE) AS low FROM notes")
def depth_ranges(spark, d):
    return notes(spark, d).select("doc_id", ex.depth_summary(F.col("note")).alias("s")).select("doc_id", "s.mid", "s.low")


@query("guyot_depths", "WITH k AS (SELECT p_partkey AS id, CAST(p_size * 100 AS DOUBLE) AS m FROM part) SELECT id, CASE id % 4 WHEN 0 THEN CASE WHEN m >= 300 THEN m END WHEN 1 THEN CASE WHEN m + 100 >= 300 THEN m + 100 END WHEN 2 THEN 1500.0::DOUBLE ELSE 45.0::DOUBLE END AS depth_m FROM k")
def guyot_depths(spark, d):
    k, m = F.col("p_partkey"), F.col("p_size") * 100
    n = lambda x: x.cast("string")
    t = F.when(k % 4 == 0, F.concat(F.lit("The guyot has a summit depth near "), n(m), F.lit(" m.")))
    t = t.when(k % 4 == 1, F.concat(F.lit("Guyot tops lie between "), n(m), F.lit("–"), n(m + 200), F.lit(" m."))).when(k % 4 == 2, "Its summits now being 1.2-1.8 km below sea level").otherwise("An atoll top falls below 45 m with respect to sea level")
    return table(spark, d, "part").select(k.alias("id"), F.get(ex.guyot_depths(t), 0).alias("depth_m"))


@query("site_names", "SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'Port-Elin' WHEN 1 THEN 'Cape Nord' WHEN 2 THEN 'Holm and Vik' WHEN 3 THEN c_mktsegment WHEN 4 THEN 'Malta' ELSE 'Narrative evidence locality' END AS site FROM customer")
def site_names(spark, d):
    k = F.col("c_custkey")
    t = F.when(k % 6 == 0, "BEACHES NEAR PORT-ELIN").when(k % 6 == 1, "A terrace off Cape Nord, drowned.").when(k % 6 == 2, "Found between Holm and Vik when dredged.").when(k % 6 == 4, "so said malta").otherwise("nothing here")
    section = F.when(k % 6 == 3, F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" the")))
    return table(spark, d, "customer").select(k.alias("id"), ex.site_name(t, section, ["Gozo", "Malta"]).alias("site"))


@query("age_texts", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 1 THEN (o_orderkey % 90 + 10) / 1000.0::DOUBLE END AS num, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 90 + 10)::DOUBLE END AS low, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 90 + 10) + 1.0::DOUBLE END AS high FROM orders")
def age_texts(spark, d):
    n = (F.col("o_orderkey") % 90 + 10).cast("string")
    t = F.when(F.col("o_orderkey") % 2 == 0, F.concat(n, F.lit(" to "), (F.col("o_orderkey") % 90 + 11).cast("string"), F.lit(",000 years"))).otherwise(F.concat(n, F.lit(" years")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), ex.age_from_text(t).alias("a")).select("id", "a.num", "a.low", "a.high")


@query("table_headers", "SELECT p_partkey AS id, trim(regexp_replace(lower(p_name || ' (' || p_type || ')'), '[^a-z0-9]+', ' ', 'g')) AS header FROM part")
def table_headers(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), ex.header(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("header"))


@query("beach_depths", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN round_even((p_size + p_size + 2) / 2.0 * 1.8288, 2) WHEN 1 THEN round_even(p_size * 1.8288, 2) ELSE p_size END::DOUBLE AS depth_m FROM part")
def beach_depths(spark, d):
    n = F.col("p_size").cast("string")
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(n, F.lit("–"), (F.col("p_size") + 2).cast("string"), F.lit(" fathom beach"))).when(F.col("p_partkey") % 3 == 1, F.concat(n, F.lit(" fathoms (upper)"))).otherwise(F.concat(F.lit("Toe at approx. "), n, F.lit(" m")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), ex.beach_depth(name).alias("depth_m"))


@query("doi_ranking", f"WITH {_NOTE_SQL} SELECT doc_id, '10.1000/ab' || CAST(doc_id % 7 AS VARCHAR) AS doi FROM notes")
def doi_ranking(spark, d):
    return ex.ranked_dois(notes(spark, d), "doc_id", "note").select("doc_id", "doi")


@query("gazetteer_pick", "WITH g AS (SELECT n_name AS query, s_name || ', ' || n_name AS display_name, CASE s_suppkey % 3 WHEN 0 THEN 'shop' ELSE 'place' END AS class, s_acctbal AS importance FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT query, arg_max(display_name, importance) AS display_name FROM g WHERE class <> 'shop' GROUP BY query")
def gazetteer_pick(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    g = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("query"), F.concat("s_name", F.lit(", "), "n_name").alias("display_name"), F.when(F.col("s_suppkey") % 3 == 0, "shop").otherwise("place").alias("class"), F.lit("town").alias("type"), F.col("s_acctbal").alias("importance"))
    return gazetteer.best_place(g).select("query", "display_name")


@query("sectioned_paragraphs", "WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), l AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t) WHERE trim(regexp_replace(l, '\\s+', ' ', 'g')) <> '' GROUP BY doc_id) SELECT doc_id, n AS n_lines FROM l")
def sectioned_paragraphs(spark, d):
    """Documents without headings and blank lines are one paragraph; its lines are counted by the words' places."""
    t = table(spark, d, "documents").select("doc_id", F.concat_ws("\n\n", F.split(F.coalesce("text", F.lit("")), "\n")).alias("text"))
    return ex.sectioned_paragraphs(t, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query("median_step", "WITH v AS (SELECT DISTINCT round(l_discount * 100) AS v FROM lineitem), s AS (SELECT v - lag(v) OVER (ORDER BY v) AS d FROM v) SELECT quantile_cont(d, 0.5) AS median_step FROM s")
def median_step(spark, d):
    return ex.median_step(table(spark, d, "lineitem").select(F.round(F.col("l_discount") * 100).alias("v")), "v")


@query("queue_order", "SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) AS place FROM orders WHERE o_orderstatus <> 'F'")
def queue_order(spark, d):
    """Pending jobs of each queue: boosted ones first, then in the order they came; numbered by ranges, so that a queue is many tasks' work."""
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    jobs = table(spark, d, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("queue"), rank.alias("rank"))
    return ex.queued(jobs, ["queue"], ["rank", "id"]).select("id", (F.col("place") + 1).alias("place"))


_STATES_SQL = "t AS (SELECT o_orderkey AS idx, ['running', 'queued', 'done', 'failed', 'cancelled', 'skipped', 'unsupported', 'odd'][o_orderkey % 8 + 1] AS status, 'File ' || o_orderpriority AS name, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 1000 AS DOUBLE) END AS elapsed, o_custkey % 4 AS unresolved FROM orders), r AS (SELECT *, CASE status WHEN 'running' THEN 0 WHEN 'queued' THEN 1 WHEN 'done' THEN 2 WHEN 'failed' THEN 3 WHEN 'cancelled' THEN 4 WHEN 'skipped' THEN 5 WHEN 'unsupported' THEN 6 ELSE 9 END AS rank FROM t)"


@query("sort_modes", f"WITH {_STATES_SQL} SELECT idx, row_number() OVER (ORDER BY rank, idx) - 1 AS by_status, row_number() OVER (ORDER BY lower(name), idx) - 1 AS by_name, row_number() OVER (ORDER BY -coalesce(elapsed, 0), idx) - 1 AS by_elapsed, row_number() OVER (ORDER BY -unresolved, rank, idx) - 1 AS by_unresolved FROM r")
def sort_modes(spark, d):
    """The place of each job in the status table under each of its orders."""
    k = F.col("o_orderkey")
    words = F.array(*(F.lit(w) for w in ("running", "queued", "done", "failed", "cancelled", "skipped", "unsupported", "odd")))
    states = table(spark, d, "orders").select(k.alias("idx"), F.element_at(words, (k % 8 + 1).cast("int")).alias("status"), F.concat(F.lit("File "), "o_orderpriority").alias("name"), F.when(k % 5 > 0, (k % 1000).cast("double")).alias("elapsed"), (F.col("o_custkey") % 4).alias("unresolved"))
    out = states.select("idx")
    for mode in ("status", "name", "elapsed", "unresolved"):
        out = out.join(ex.sorted_states(states, mode, "idx").select("idx", F.col("place").alias(f"by_{mode}")), "idx")
    return out


@query("processed_records", f"WITH {_RECORD_SQL}, v AS (SELECT record_class IN ('sea_level_indicator', 'marine_limiting', 'terrestrial_limiting') AND coordinate_source IN ('reported', 'inferred_text', 'inferred_map') AND coalesce(abs(latitude) <= 90, true) AND coalesce(abs(longitude) <= 180, true) AND provenance IS NOT NULL AS accepted, record_class FROM r) SELECT record_class, accepted, count(*) AS n FROM v GROUP BY ALL")
def processed_records(spark, d):
    return ex.processed(raw_records(spark, d)).groupBy("record_class", "accepted").agg(F.count("*").alias("n"))


@query("elapsed_texts", "SELECT event_id, CASE WHEN event_id % 9000 >= 3600 THEN CAST(CAST(floor((event_id % 9000) / 3600) AS BIGINT) AS VARCHAR) || ':' ELSE '' END || printf('%02d:%02d', CAST(floor((event_id % 9000) % 3600 / 60) AS BIGINT), (event_id % 9000) % 60) AS elapsed FROM events")
def elapsed_texts(spark, d):
    return table(spark, d, "events").select("event_id", ex.elapsed(F.col("event_id") % 9000).alias("elapsed"))


@query("json_strings", "SELECT event_id, event_type AS first_string, 2::BIGINT AS n FROM events")
def json_strings(spark, d):
    doc = F.to_json(F.struct(F.struct("event_type", "value").alias("a"), F.array("props", F.lit(None)).alias("b")))
    e = table(spark, d, "events").select("event_id", ex.json_strings(doc).alias("s"))
    return e.select("event_id", F.get("s", 0).alias("first_string"), F.size("s").cast("long").alias("n"))


_INDICATORS_SQL = "list_concat(" + ", ".join(f"CASE WHEN regexp_matches(head, '{'|'.join(phrases)}') THEN ['{name}'] ELSE [] END" for name, phrases in interpret.INDICATORS) + ")"


@query("document_records", f"""WITH {_COORDINATES_SQL}, r AS (SELECT CAST(doc_id AS VARCHAR) AS source_id, lat AS latitude, -TRY_CAST(regexp_extract(note, '(?i)(?:water depth|depth(?: of| at)?)\\s+(?:of\\s+)?(\\d+(?:\\.\\d+)?)\\s*m', 1) AS DOUBLE) AS elevation_m,
        lower(substr(note, 1, 6000)) AS head FROM located WHERE lat IS NOT NULL AND lon IS NOT NULL),
    n AS (SELECT *, {_INDICATORS_SQL} AS found FROM r)
    SELECT source_id, unnest(CASE WHEN len(found) > 0 THEN found ELSE ['{interpret.DEFAULT_INDICATOR}'] END) AS indicator_type, elevation_m, latitude FROM n""")
def document_records(spark, d):
    """A record for each indicator of each note with coordinates; indicators count within the first 6 000 characters and coordinates within 20 000, which are the operator's rules."""
    n = notes(spark, d).select(F.col("doc_id").cast("string").alias("source_id"), F.lit("Report off Cape Nord").alias("title"), F.col("note").alias("text"))
    return interpret.document_records(n).select("source_id", "indicator_type", "elevation_m", "latitude")


@query("evidence_clusters", f"WITH {_NOTE_SQL} SELECT CAST(doc_id AS VARCHAR) AS source_id, 'landform' AS kind, -(doc_id % 90 + 0.5::DOUBLE) AS elevation_m FROM notes")
def evidence_clusters(spark, d):
    n = notes(spark, d).select(F.col("doc_id").cast("string").alias("source_id"), F.col("note").alias("text"))
    return interpret.promotable(interpret.clusters(n)).select("source_id", "kind", "elevation_m")


@query("atlas_confidence", f"WITH {_ATLAS_SQL} SELECT CAST(k AS VARCHAR) AS sample_id, round_even(greatest(0, least(1, 0.6::DOUBLE * 0.75 + (k % 6 + k % 5) / 10.0::DOUBLE * 0.25 + CASE WHEN k % 2 = 0 THEN 0.08::DOUBLE ELSE 0 END - CASE WHEN record_class <> 'sea_level_indicator' THEN 0.05::DOUBLE ELSE 0 END)), 3) AS confidence FROM q WHERE reason IS NULL")
def atlas_confidence(spark, d):
    rows = atlas.cleaned(atlas_rows(spark, d)).filter(atlas.skip_reason().isNull()).withColumn("Accepted by other study?", F.lit(""))
    return rows.select(atlas.text("WALIS_ID").alias("sample_id"), atlas.confidence(F.lit(0.6)).alias("confidence"))
