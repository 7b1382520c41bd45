"""Documents interpreted as one plan: records of their text, blocks, tables and model answers, what stays open, contexts and a summary."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.placing import kept, numbered
from tidemark.operators import interpret, tables, unique
from tidemark.operators.links import with_source_links
from tidemark.operators.records import record_id

# Words of sea-level reports, of narratives, of older geology, of contexts, and places by the words that name them.
KEYWORDS = (
    "relative sea level", "rsl", "marine terrace", "guyot", "guyots", "tablemount", "table mount", "flat-topped seamount", "flat topped seamount", "drowned carbonate platform", "drowned island", "seamount",
    "atoll", "raised beach", "submerged beach", "submerged forest", "beachrock", "coral reef", "tidal notch", "lagoonal", "deltaic", "saltmarsh", "mangrove", "shoreline", "shore platform", "wave-cut", "intertidal",
    "marine shell", "speleothem", "paleo sea level", "sea-level", "sea level", "water depth", "radiocarbon",
)
NARRATIVE = ("chapter", "legend", "story", "myth", "biblical", "victorian", "archaeologist", "journey", "adventure", "royal", "king")
ANCIENT = ("permian", "eocene", "cretaceous", "jurassic", "triassic", "palaeontology", "paleontology", "conodont", "bryozoan", "foraminifera", "trace fossils", "stratigraphic", "submarine channel", "sedimentology", "basin floor")
RECENT = (
    "holocene", "pleistocene", "radiocarbon", "raised beach", "submerged beach", "marine terrace", "guyot", "guyots", "tablemount", "flat-topped seamount", "flat topped seamount", "drowned carbonate platform",
    "drowned platform", "drowned island", "atoll", "relative sea level", "relative sea-level", "yrs b.p", "years b.p",
)
ARTIFACTS = ("table", "fig.", "figure", "plate", "map")
CONTEXT_WORDS = ("depth", "bmsl", "shoreline", "palaeoshoreline", "reef", "barrier", "terrace", "shoal", "cliff", "map", "guyot", "tablemount", "seamount", "atoll", "drowned platform")
LOCATIONS = (("bermuda", "Bermuda"), ("wissant", "Wissant"), ("ekofisk", "Ekofisk-Norwegian Trench"), ("south australia", "Southeast South Australia"))
# What counts as a coordinate, an age and an elevation.
COORDINATE = r"[-+]?\d{1,3}(?:\.\d+)?\s*[NSEW]|[-+]?\d{1,3}\.\d+\s*,\s*[-+]?\d{1,3}\.\d+"
AGE = r"(?i)\b\d+(?:,\d{3})*(?:\.\d+)?\s*(?:ka|kyr|ky|Ma|BP|yrs B\.P\.)\b"
ELEVATION = r"(?i)\b\d+(?:,\d{3})*(?:\.\d+)?\s*(?:m|meters|metres|feet|ft|fathoms)\b"
REASONS = {
    "non_candidate_narrative_source": "No candidate RSL SamplePoints detected; source appears to be narrative/background text rather than an extractable site report.",
    "candidate_review_needed": "Potential RSL-related terms detected, but no point-level coordinates/elevations/ages were extracted into validated SamplePoints.",
    "non_candidate_unstructured_source": "No structured SamplePoint records extracted from unstructured text source.",
}
#: Contexts of a source that a model is asked about, characters of one, of its label's cue, and of the beginning by which contexts are told apart.
MOST_CONTEXTS, CONTEXT_CHARS, CUE_CHARS, SAME_CHARS = 4, 5_000, 80, 200
STAGES = ("document", "page_block", "table", "model", "narrative")
RECORD = "id string, source_id string, sample_id string, site_name string, location_name string, indicator_type string, latitude double, longitude double, coordinate_source string, elevation_m double, age_ka double, quote string, doi_or_url string"


def _any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def classification(text: Column) -> Column:
    """struct(keywords, coordinates, ages, elevations, class): what a text speaks of, and whether it may hold records, is a narrative or neither."""
    keywords = F.array_sort(tx.keywords(text, list(KEYWORDS)))
    count = lambda p: F.regexp_count(text, F.lit(p))
    found = F.struct(keywords.alias("keywords"), count(COORDINATE).alias("coordinates"), count(AGE).alias("ages"), count(ELEVATION).alias("elevations"))
    kind = lambda f: F.when((f["coordinates"] > 0) | ((f["ages"] >= 2) & (f["elevations"] >= 2)) | (F.size(f["keywords"]) >= 3), "candidate_review_needed").when(_any(F.lower(text), NARRATIVE), "non_candidate_narrative_source").otherwise("non_candidate_unstructured_source")
    return F.element_at(F.transform(F.array(found), lambda f: F.struct(f["keywords"], f["coordinates"], f["ages"], f["elevations"], kind(f).alias("class"))), 1)


def is_ancient(title: Column, text: Column) -> Column:
    """Whether title and text name two or more words of older geology and none of the recent ones."""
    both = F.lower(F.concat_ws("\n", title, text))
    return (F.size(tx.keywords(both, list(ANCIENT))) >= 2) & ~_any(both, RECENT)


def location(title: Column, text: Column, otherwise: Column) -> Column:
    both = F.lower(F.concat_ws("\n", title, text))
    return F.coalesce(*(F.when(F.contains(both, F.lit(w)), F.lit(name)) for w, name in LOCATIONS), otherwise)


def _shaped(df: DataFrame) -> DataFrame:
    """`df` with the columns of RECORD; absent ones are null, absent ids are made from source, site, sample, place and indicator."""
    cols = {c: kind for c, kind in (x.split() for x in RECORD.split(", "))}
    df = df.withColumns({c: F.lit(None).cast(kind) for c, kind in cols.items() if c not in df.columns})
    parts = [F.col("source_id"), F.lower(F.trim("site_name")), F.col("sample_id"), F.format_string("%.6f", "latitude"), F.format_string("%.6f", "longitude"), F.col("indicator_type")]
    return df.withColumn("id", F.coalesce("id", record_id(parts))).select(*(F.col(c).cast(kind).alias(c) for c, kind in cols.items()))


def block_records(blocks: DataFrame, docs: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """A record for each indicator of a page block (source_id, page, source, cue, text) that has coordinates, or names a place of `places` (query, lat, lon): the first of those that are known.

    The document (source_id, title) gives title and location; blocks without a document, blank blocks and blocks without a place give nothing.
    """
    b = blocks.filter("length(trim(text)) > 0").join(docs.select("source_id", "title"), "source_id").withColumn("_b", F.monotonically_increasing_id())
    b = kept(b.withColumn("c", tx.coordinates(F.col("text"), None)))
    if places is None:
        placed = b.withColumns({"_lat": F.lit(None).cast("double"), "_lon": F.lit(None).cast("double"), "_query": F.lit(None).cast("string")})
    else:
        named = b.filter("c IS NULL").select("_b", F.posexplode(tx.places(F.col("text"))).alias("n", "query")).join(places.select("query", "lat", "lon"), "query")
        first = named.groupBy("_b").agg(F.min_by(F.struct("query", "lat", "lon"), "n").alias("p")).select("_b", F.col("p.query").alias("_query"), F.col("p.lat").alias("_lat"), F.col("p.lon").alias("_lon"))
        placed = b.join(first, "_b", "left")
    reported = F.col("c").isNotNull()
    r = placed.withColumns({"latitude": F.coalesce("c.lat", "_lat"), "longitude": F.coalesce("c.lon", "_lon"), "depth_m": tx.depth_m(F.col("text")), "ages": tx.ages_ka(F.col("text"), within=None)}).filter("latitude IS NOT NULL AND longitude IS NOT NULL")
    r = r.withColumn("found", interpret.indicators(F.col("title"), F.col("text"), None)).select("*", F.posexplode("found").alias("n", "indicator_type"))
    site = F.coalesce("_query", location(F.col("title"), F.col("text"), F.col("source_id")))
    return _shaped(r.select(
        "source_id", F.concat(F.lit("page_"), F.col("page").cast("string"), F.lit("_feature_"), (F.col("n") + 1).cast("string")).alias("sample_id"), site.alias("site_name"), site.alias("location_name"), "indicator_type", "latitude", "longitude",
        F.when(reported, "reported").otherwise("inferred_text").alias("coordinate_source"), (-F.col("depth_m")).alias("elevation_m"), F.get("ages", 0).alias("age_ka"), F.substring(tx.collapse(F.col("text")), 1, 800).alias("quote"),
    ))


def table_records(items: DataFrame, docs: DataFrame, **options) -> DataFrame:
    """The records of all tables, as `tables.mined` reads them."""
    m = tables.mined(items, docs, **options)
    return _shaped(m.select("source_id", "sample_id", "site_name", F.col("site_name").alias("location_name"), "indicator_type", "elevation_m", F.col("age.num").alias("age_ka"), "quote"))


def contexts(blocks: DataFrame) -> DataFrame:
    """(source_id, n, label, text): the blocks that speak of depths, landforms or maps, numbered from 1 by page and text, each text once (by its beginning)."""
    relevant = blocks.filter(_any(F.lower("text"), CONTEXT_WORDS))
    label = F.concat(F.col("source"), F.lit(" page "), F.col("page").cast("string"), F.lit(": "), F.substring("cue", 1, CUE_CHARS))
    each = relevant.groupBy("source_id", F.substring("text", 1, SAME_CHARS).alias("_same")).agg(F.min(F.struct("page", label.alias("label"), F.substring("text", 1, CONTEXT_CHARS).alias("text"))).alias("c"))
    order = numbered(each.select("source_id", "c"), ["source_id", "c"], "_place")
    start = order.groupBy("source_id").agg(F.min("_place").alias("_start"))
    return order.join(start, "source_id").select("source_id", (F.col("_place") - F.col("_start") + 1).cast("int").alias("n"), "c.label", "c.text")


@dataclass
class Interpretation:
    """records (RECORD, stage), unresolved (source_id, class, reason), contexts (source_id, n, label, text), summary (a row for each document)."""

    records: DataFrame
    unresolved: DataFrame
    contexts: DataFrame
    summary: DataFrame


def interpreted(docs: DataFrame, blocks: DataFrame, items: DataFrame, answers: DataFrame | None = None, links: DataFrame | None = None, places: DataFrame | None = None, unique_narrative: bool = True, **table_options) -> Interpretation:
    """All documents (source_id, title, text; one row each) with their page blocks, tables and model answers (source_id and candidate columns).

    Records of text, blocks and tables come first. Model answers count for sources that these leave open although they may hold records or have tables or figures, unless they are about older geology. Of equal ids the
    last stage's record stays. Paragraphs with an elevation are the last resort: all of them for sources that are still open, and, with `unique_narrative`, for the others those that are no observation taken before.
    Blank links are filled from `links` (source_id, url). Sources without any record get an unresolved row with its reason. Null titles and texts count as empty; blocks, tables and answers of other sources give nothing.
    """
    told = docs.select("source_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    told = kept(told.withColumn("a", classification(F.col("text"))).withColumns({"ancient": is_ancient(F.col("title"), F.col("text")), "artifacts": _any(F.lower("text"), ARTIFACTS)}))
    own = lambda df: df.join(told.select("source_id"), "source_id", "left_semi")
    blocks, items = kept(own(blocks)), own(items)
    stages = {"document": _shaped(interpret.document_records(told, places, whole=True)), "page_block": block_records(blocks, told, places), "table": table_records(items, told, **table_options)}
    early = kept(reduce(DataFrame.unionByName, (s.withColumn("stage", F.lit(n)) for n, s in stages.items())))
    if answers is not None:
        open_ = told.filter("NOT ancient AND (a.class = 'candidate_review_needed' OR artifacts)").join(early.select("source_id"), "source_id", "left_anti").select("source_id")
        early = kept(early.unionByName(_shaped(answers.join(open_, "source_id", "left_semi")).withColumn("stage", F.lit("model"))))
    rank = F.coalesce(*(F.when(F.col("stage") == n, i) for i, n in enumerate(STAGES)))
    main = kept(early.groupBy("id").agg(F.max_by(F.struct(*early.columns), rank).alias("r")).select("r.*"))

    c = interpret.promotable(interpret.clusters(told))
    indicator = F.when(F.col("kind") == "submerged_forest", "terrestrial_over_marine_contact").when(F.col("kind") == "guyot", "guyot_or_drowned_platform").when(F.col("kind") == "raised_beach", "raised_beach").otherwise(interpret.DEFAULT_INDICATOR)
    site = F.coalesce(F.get(tx.places(F.col("paragraph")), 0), F.col("section"), F.col("source_id"))
    narrative = _shaped(c.select("source_id", F.concat(F.lit("narrative_"), F.col("n").cast("string")).alias("sample_id"), site.alias("site_name"), F.col("source_id").alias("location_name"), indicator.alias("indicator_type"), "elevation_m", F.substring("paragraph", 1, 800).alias("quote")))
    narrative = kept(narrative.withColumns({"stage": F.lit("narrative"), "place": F.split_part("sample_id", F.lit("_"), F.lit(2)).cast("int")}))
    closed = main.select("source_id").distinct()
    last = narrative.join(closed, "source_id", "left_anti").dropDuplicates(["id"]).drop("place")
    if unique_narrative:
        order = numbered(narrative.join(closed, "source_id", "left_semi"), ["source_id", "place"], "_seq").drop("place")
        last = last.unionByName(unique.semantically_unique(order, main, "_seq").drop("_seq"))
    records = main.unionByName(last)
    if links is not None:
        records = with_source_links(records, links)
    records = kept(records)

    counts = records.groupBy("source_id").agg(F.count("*").alias("n_records"), *(F.count_if(F.col("stage") == s).alias(f"n_{s}") for s in STAGES))
    seen = kept(contexts(blocks))
    per_block = blocks.groupBy("source_id").agg(F.count("*").alias("n_blocks"))
    per_context = seen.groupBy("source_id").agg(F.count("*").alias("n_contexts"))
    whole = told.join(counts, "source_id", "left").join(per_block, "source_id", "left").join(per_context, "source_id", "left").fillna(0)
    reason = F.coalesce(*(F.when(F.col("a.class") == k, F.lit(v)) for k, v in REASONS.items()))
    unresolved = whole.filter("n_records = 0").select("source_id", F.col("a.class").alias("class"), reason.alias("reason"))
    numbers = ["n_records", *(f"n_{s}" for s in STAGES), "n_blocks", "n_contexts"]
    summary = whole.select("source_id", "title", F.col("a.class").alias("class"), *(F.col(f"a.{x}").alias(x) for x in ("coordinates", "ages", "elevations", "keywords")), *numbers, "artifacts", "ancient", F.length("text").alias("text_length"), tx.quality(F.col("text")).alias("quality"), F.substring(tx.collapse(F.col("text")), 1, 300).alias("quote"))
    return Interpretation(records, unresolved, seen.filter(F.col("n") <= MOST_CONTEXTS), summary)
