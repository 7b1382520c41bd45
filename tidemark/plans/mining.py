"""Queries: records from the tables of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import tables
from tidemark.plans.registry import query, table

_ROW = lambda *cells: F.concat(F.lit("<tr>"), *(x for c in cells for x in (F.lit("<td>"), c if not isinstance(c, str) else F.lit(c), F.lit("</td>"))), F.lit("</tr>"))


def _years(n):
    """12345 as `12,345`."""
    return F.concat(F.floor(n / 1000).cast("string"), F.lit(","), F.lpad((n % 1000).cast("string"), 3, "0"))


def table_items(spark, d):
    """A table of one of six kinds for each part, and the documents that hold them."""
    k, s = F.col("p_partkey"), F.col("p_size")
    n = lambda x: x.cast("string")
    t = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    html = [
        F.concat(_ROW("Location", "Feature type", "Depth range (m)", "a", "b", "Reference"), _ROW(F.col("p_brand")), _ROW(t("Loc ", n(k)), "Terrace", t(n(s), " m"), "x", "y", "ref"), _ROW("Reef", t(n(s), "–", n(s + 10), " m"), "x", "y", "ref")),
        F.concat(_ROW("Geomorphic feature", "Facies", "Timing"), _ROW(t("Ridge offshore of Cape Agulhas, at a depth of ", n(s), " m"), "F1", "MIS 5"), _ROW("Dune without a place", "F2", "MIS 6")),
        F.concat(_ROW("Sample Number", "Material", "Locality", "Age (year)", "Altitude (m)"), _ROW("North"), _ROW(t("S-", n(k)), "Ostrea shell", t("Bay ", n(k)), t(_years(k + 12000), " ± 50"), t(n(s), ".5")), _ROW("S-x", "wood", "Bay", "none", "3")),
        F.concat(_ROW("Sample station", "Depth below sea bed (m)", "Radiocarbon age (yrs B.P.)", "Laboratory ref. number"), _ROW(t("ST-", n(k)), "0.5", t(_years(k + 8000), " ± 60"), t("LAB-", n(k)))),
        F.concat(_ROW("Group", "Beach name", "Age (years B.P.)"), _ROW("g", "10-12 fathom beach", _years(k + 9000)), _ROW(t(n(s), " fathom beach (old)"), "-"), _ROW("g", "modern sea level", "0")),
        F.concat(_ROW("No.", "Species", "Element", "ZMUC file", "Locality", "Method", "Lab no.", "14C age", "d13C", "Calibrated age"), _ROW("7", "Whale", "rib", "Z1", t("Fjord ", n(k)), "AMS", t("AAR-", n(k % 50)), t(_years(k + 7000), " ± 40"), "-20", t(_years(k + 8000), "–", _years(k + 9000)))),
    ]
    kind = k % 6
    source = F.when(kind == 5, "whales").otherwise(t("p", n(k)))
    page = F.coalesce(*(F.when(kind == i, h) for i, h in enumerate(html)))
    parts = table(spark, d, "part")
    items = parts.select(source.alias("source_id"), k.cast("int").alias("table_no"), F.lit(None).cast("string").alias("caption"), F.concat(F.lit("<table>"), page, F.lit("</table>")).alias("html"))
    docs = parts.filter(kind != 5).select(source.alias("source_id"), F.lit("Report").alias("title"), t("A beach lies at ", n(s), " to ", n(s + 10), " m waterdepth.").alias("text"))
    return items, docs


_SQL = """WITH p AS (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS s, p_partkey % 6 AS kind, 'p' || CAST(p_partkey AS VARCHAR) AS source_id FROM part), r AS (
    SELECT source_id, k, 2 AS row, 'palaeoshoreline' AS kind, 'Loc ' || CAST(k AS VARCHAR) AS site_name, 'table_' || CAST(k + 1 AS VARCHAR) || '_2' AS sample_id, 'marine_terrace' AS indicator_type, 'sea_level_indicator' AS record_class, -s AS elevation_m, -s AS low, -s AS high, NULL::DOUBLE AS age_ka, NULL::DOUBLE AS age_low, NULL::DOUBLE AS age_high, NULL::DOUBLE AS spread FROM p WHERE kind = 0
    UNION ALL SELECT source_id, k, 3, 'palaeoshoreline', 'Loc ' || CAST(k AS VARCHAR), 'table_' || CAST(k + 1 AS VARCHAR) || '_3', 'coral_reef', 'sea_level_indicator', -(s + 5), -(s + 10), -s, NULL, NULL, NULL, NULL FROM p WHERE kind = 0
    UNION ALL SELECT source_id, k, 1, 'feature', 'Cape Agulhas', 'feature_table_1', 'submerged_beach', 'sea_level_indicator', -s, -s, -s, NULL, NULL, NULL, NULL FROM p WHERE kind = 1
    UNION ALL SELECT source_id, k, 2, 'dated_altitude', 'Bay ' || CAST(k AS VARCHAR), 'S-' || CAST(k AS VARCHAR), 'marine_shell_bed', 'marine_limiting', s + 0.5, s - 4.5, s + 2.5, (k + 12000) / 1000, NULL, NULL, 0.05 FROM p WHERE kind = 2
    UNION ALL SELECT source_id, k, 1, 'radiocarbon_depth', 'ST-' || CAST(k AS VARCHAR), 'LAB-' || CAST(k AS VARCHAR), 'submerged_beach', 'sea_level_indicator', -(s + 5), -(s + 10), -s, (k + 8000) / 1000, NULL, NULL, 0.06 FROM p WHERE kind = 3
    UNION ALL SELECT source_id, k, 1, 'dated_beach_name', '10-12 fathom beach', 'beach_depth_1', 'submerged_beach', 'sea_level_indicator', -20.12, -22.62, -17.62, (k + 9000) / 1000, NULL, NULL, NULL FROM p WHERE kind = 4
    UNION ALL SELECT source_id, k, 2, 'dated_beach_name', CAST(CAST(s AS BIGINT) AS VARCHAR) || ' fathom beach', 'beach_depth_2', 'submerged_beach', 'sea_level_indicator', -round_even(s * 1.8288, 2), round_even(-round_even(s * 1.8288, 2) - 2.5, 2), round_even(-round_even(s * 1.8288, 2) + 2.5, 2), (k + 9000) / 1000, NULL, NULL, NULL FROM p WHERE kind = 4
    UNION ALL SELECT 'whales', max(k), 1, 'specimen', 'Fjord ' || CAST(max(k) AS VARCHAR), 'AAR-' || CAST(k % 50 AS VARCHAR), 'subtidal_facies', 'marine_limiting', NULL, NULL, NULL, NULL, (max(k) + 8000) / 1000, (max(k) + 9000) / 1000, 0.04 FROM p WHERE kind = 5 GROUP BY k % 50)
    SELECT source_id, k AS table_no, row, kind, site_name, sample_id, indicator_type, record_class, round(elevation_m, 6) AS elevation_m, round(low, 6) AS low, round(high, 6) AS high, round(age_ka, 6) AS age_ka, round(age_low, 6) AS age_low, round(age_high, 6) AS age_high, round(spread, 6) AS spread FROM r"""


@query("mined_tables", _SQL)
def mined_tables(spark, d):
    """Records of every part's table: palaeoshorelines, features, dated altitudes, radiocarbon depths, dated beach names and specimens."""
    items, docs = table_items(spark, d)
    r = tables.mined(items, docs, specimen_sources=["whales"])
    six = lambda c: F.round(c, 6)
    return r.select(
        "source_id", F.col("table_no").cast("long").alias("table_no"), "row", "kind", "site_name", "sample_id", "indicator_type", "record_class", six("elevation_m").alias("elevation_m"), six(F.get("indicative_range_m", 0)).alias("low"),
        six(F.get("indicative_range_m", 1)).alias("high"), six("age.num").alias("age_ka"), six("age.low").alias("age_low"), six("age.high").alias("age_high"), six("age_uncertainty_ka").alias("spread"),
    )
