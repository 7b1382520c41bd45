"""Documents to candidate records: indicators, quotes, places, clusters and the union of evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators.extraction import FATHOM_M, depth_summary, sectioned_paragraphs
from tidemark.operators.records import record_id

# Phrases that name an indicator, in order.
INDICATORS = (
    ("raised_beach", ("ancient beach", "raised beach")),
    ("submerged_beach", ("submerged beach",)),
    ("terrestrial_over_marine_contact", ("submerged forest",)),
    ("marine_terrace", ("marine terrace",)),
    ("guyot_or_drowned_platform", ("guyot", "table mount", "tablemount", "flat-topped seamount", "flat topped seamount", "drowned carbonate platform", "drowned platform", "drowned island")),
)
DEFAULT_INDICATOR = "submerged_beach"


def _named(text: Column) -> Column:
    has = lambda low, phrases: reduce(lambda a, b: a | b, (F.contains(low, F.lit(p)) for p in phrases))
    return tx.once(F.lower(text), lambda low: F.array_compact(F.array(*(F.when(has(low, p), name) for name, p in INDICATORS))))


def indicators(title: Column, text: Column, within: int | None = 6000) -> Column:
    """Indicators that the title names, else those that the first `within` characters of the text (None: all of it) name, else the default one."""
    in_title, in_text = _named(F.coalesce(title, F.lit(""))), _named(F.concat_ws(" ", title, tx.beginning(text, within)))
    said = tx.once(in_text, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(DEFAULT_INDICATOR))))
    return tx.once(in_title, lambda found: F.when(F.size(found) > 0, found).otherwise(said))


def quote(text: Column, indicator: Column) -> Column:
    """The text around the first phrase that names the indicator, else its beginning; at most 800 characters."""
    options = [F.when(indicator == name, tx.in_context(text, p)) for name, phrases in INDICATORS for p in phrases]
    return F.coalesce(*options, F.substring(tx.collapse(text), 1, 800))


def worked_out(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with `columns` as a step of its own: filters and later columns take their values, where the planner would else copy the expressions into each and search the text again."""
    return df.withColumn("_of", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))).select("*", *(F.col(f"_of.{n}").alias(n) for n in columns)).drop("_of")


def document_records(docs: DataFrame, places: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """A record for each indicator of a document (source_id, title, text) that has coordinates or, with `places` (query, lat, lon), names a known place near or off which it lies.

    With `whole`, coordinates, ages and indicators count wherever they stand in the text, else within its beginning.
    """
    within = {"within": None} if whole else {}
    d = worked_out(docs, c=tx.coordinates(F.col("text"), **within)).withColumn("query", F.get(tx.places(F.coalesce("title", F.lit(""))), 0))
    if places is not None:
        d = d.join(places.select("query", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")), "query", "left")
    else:
        d = d.withColumns({"_lat": F.lit(None).cast("double"), "_lon": F.lit(None).cast("double")})
    reported = F.col("c").isNotNull()
    d = d.withColumns({"latitude": F.coalesce("c.lat", "_lat"), "longitude": F.coalesce("c.lon", "_lon"), "depth_m": tx.depth_m(F.col("text")), "ages": tx.ages_ka(F.col("text"), **within)})
    d = d.filter("latitude IS NOT NULL AND longitude IS NOT NULL").withColumn("found", indicators(F.col("title"), F.col("text"), **within))
    d = d.select("*", F.posexplode("found").alias("n", "indicator_type"))
    sample = F.concat(F.lit("feature_"), (F.col("n") + 1).cast("string"))
    out = d.select(
        "source_id", sample.alias("sample_id"), F.coalesce("query", "source_id").alias("site_name"), "latitude", "longitude", F.when(reported, "reported").otherwise("inferred_text").alias("coordinate_source"),
        F.when(reported, 100.0).otherwise(5000.0).alias("coordinate_uncertainty_m"), (-F.col("depth_m")).alias("elevation_m"), F.when(F.col("depth_m").isNotNull(), "reported").otherwise("other").alias("depth_source"),
        "indicator_type", F.get("ages", 0).alias("age_ka"), quote(F.col("text"), F.col("indicator_type")).alias("quote"),
    )
    parts = [F.col("source_id"), F.lower(F.trim("site_name")), F.col("sample_id"), F.format_string("%.6f", "latitude"), F.format_string("%.6f", "longitude"), F.col("indicator_type")]
    return out.withColumn("id", record_id(parts))


def clusters(docs: DataFrame) -> DataFrame:
    """(source_id, n, kind, elevation_m, section, paragraph): all paragraphs on raised beaches (feet), submerged forests, landforms with depths and guyots, each text of a document once."""
    p = sectioned_paragraphs(docs, "source_id").withColumn("low", F.lower("paragraph"))
    feet = tx.where_named(F.col("low"), ["feet", "ft"], tx.number(tx.first_group(F.col("paragraph"), r"(?i)(\d+(?:\.\d+)?)\s*(?:feet|ft)\b")))
    fathoms = tx.where_named(F.col("low"), ["fathoms"], tx.number(tx.first_group(F.col("paragraph"), tx.FATHOMS)) * FATHOM_M)
    p = worked_out(p, feet=feet, depth=depth_summary(F.col("paragraph"))["mid"], fathoms=fathoms)
    feet, depth, fathoms = F.col("feet"), F.col("depth"), F.col("fathoms")
    kind = (
        F.when(F.col("low").contains("raised beach") | F.col("low").contains("ancient beach"), "raised_beach")
        .when(F.col("low").contains("submerged forest"), "submerged_forest").when(F.col("paragraph").rlike(tx.GUYOT), "guyot").when(F.coalesce(depth, fathoms).isNotNull(), "landform")
    )
    elevation = F.when(F.col("kind") == "raised_beach", F.bround(feet * 0.3048, 2)).otherwise(F.bround(-F.coalesce(depth, fathoms), 2))
    found = p.withColumn("kind", kind).filter("kind IS NOT NULL").withColumn("elevation_m", elevation)
    first = found.groupBy("source_id", "paragraph").agg(F.min_by(F.struct("n", "kind", "elevation_m", "section"), "n").alias("r"))
    return first.select("source_id", "r.*", "paragraph")


def promotable(df: DataFrame) -> DataFrame:
    """Clusters with an elevation."""
    return df.filter("elevation_m IS NOT NULL")


def feature_paragraphs(docs: DataFrame, names: list[str], text: str = "text") -> DataFrame:
    """(source_id, name, paragraph): blocks between blank lines that begin with one of the names."""
    blocks = docs.select("source_id", F.explode(F.split(text, r"\n\s*\n")).alias("raw")).withColumn("paragraph", tx.collapse(F.col("raw")))
    name = F.coalesce(*(F.when(F.col("raw").startswith(n + "\n") | F.col("raw").startswith(n + ".") | (F.col("paragraph") == n), F.lit(n)) for n in names))
    return blocks.withColumn("name", name).filter("name IS NOT NULL").select("source_id", "name", "paragraph")


def labelled_lines(text: Column, labels: list[str], most: int = 20) -> Column:
    low = lambda x: reduce(lambda a, b: a | b, (F.contains(F.lower(x), F.lit(w.lower())) for w in labels))
    return F.slice(F.filter(F.split(text, r"\R"), low), 1, most)


def evidence_union(stages: list[DataFrame], key: str = "id") -> DataFrame:
    """All stages' records by name, of equal ids the last stage's."""
    numbered = [s.withColumn("stage", F.lit(i)) for i, s in enumerate(stages)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    return both.groupBy(key).agg(F.max_by(F.struct(*both.columns), "stage").alias("r")).select("r.*")


def with_geocodes(records: DataFrame, matches: DataFrame, has_table: bool, key: str = "id") -> DataFrame:
    """Manual geocodes before all else: a match (id, lat, lon) with coordinates sets them (inferred_map); where a table exists and has none for a record, its coordinates become null, with a note; without a table nothing changes."""
    if not has_table:
        return records.withColumn("geocode_note", F.lit(None).cast("string"))
    m = matches.select(F.col(key), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    found = F.col("_lat").isNotNull() & F.col("_lon").isNotNull()
    out = records.join(m, key, "left").withColumns({
        "latitude": F.col("_lat"), "longitude": F.when(found, F.col("_lon")),
        "coordinate_source": F.when(found, "inferred_map").otherwise(F.col("coordinate_source")),
        "geocode_note": F.when(found, "manual geocode").otherwise("no manual geocode"),
    })
    return out.withColumn("latitude", F.when(found, F.col("latitude"))).drop("_lat", "_lon")


def candidate_union(frames: list[tuple[str, DataFrame]], most: int, axis: tuple[str, str] = ("axis_lat", "axis_lon")) -> DataFrame:
    """The first `most` candidates of each named table in `seq` order; tables without axis columns are skipped, missing columns are null, and a place, angle and table counts once."""
    parts = []
    for name, df in frames:
        if set(axis) <= set(df.columns):
            ordered = df.orderBy("seq").limit(most) if "seq" in df.columns else df.limit(most)
            parts.append(ordered.withColumn("file", F.lit(name)))
    if not parts:
        raise ValueError("no table has the axis columns")
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.dropDuplicates([c for c in ("file", *axis, "angle_deg") if c in both.columns])
