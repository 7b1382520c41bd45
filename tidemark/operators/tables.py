"""Records from the tables of documents: what a table's header says decides how its rows are read."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.placing import kept
from tidemark.functions.text import GUYOT, collapse, first_group, number, table_rows
from tidemark.operators import extraction as ex

AGE = "struct<num: double, low: double, high: double, label: string>"
RANGE = "array<double>"
#: What every kind of table gives.
RECORD = {
    "source_id": "string", "table_no": "int", "row": "int", "kind": "string", "site_name": "string", "sample_id": "string", "location_name": "string", "record_class": "string", "indicator_type": "string",
    "group_name": "string", "material": "string", "elevation_m": "double", "indicative_range_m": RANGE, "age": AGE, "age_uncertainty_ka": "double", "reported_m": "double", "dating_method": "string", "quote": "string",
}
# Words of a table's header (or caption) that tell its kind, in order; the first kind of which all words are there.
SIGNATURES = (
    ("palaeoshoreline", ("feature type", "depth range")),
    ("feature", ("geomorphic feature",)),
    ("dated_altitude", ("sample", "material", "locality", "age", "altitude")),
    ("radiocarbon_depth", ("radiocarbon age", "depth below sea bed")),
    ("dated_beach_name", ("beach name", "age")),
)
FEATURE_CAPTION = "interpreted timing"
# Words that name an indicator in a table cell, in order.
INDICATORS = (
    ("coral_reef", "reef|coral"), ("wave_cut_notch_or_bench", "bench|cliff|notch"), ("marine_terrace", "terrace"), ("estuarine_sediment", "estuar|channel|valley"), ("raised_beach", "dune"),
    ("submerged_beach", "barrier|beach|shoreline|ridge|shoal"), ("subtidal_facies", "facies|sediment"),
)
# Sample material to (indicator, record class, metres below and above in the indicative range).
MATERIALS = (("coral", ("coral_reef", "sea_level_indicator", 6.0, 0.5)), ("mollusca?|ostrea|shell", ("marine_shell_bed", "marine_limiting", 5.0, 2.0)), ("wood", ("marine_over_terrestrial_contact", "marine_limiting", 4.0, 4.0)))
OTHER_MATERIAL = ("raised_beach", "sea_level_indicator", 4.0, 4.0)
# Where a text says how deep its beach lies, and phrases that name a feature's site.
BEACH_BETWEEN = (r"(?i)waterdepths?\s+between\s+(\d+(?:\.\d+)?)\s+and\s+(\d+(?:\.\d+)?)\s*m", r"(?i)at\s+(\d+(?:\.\d+)?)\s+to\s+(\d+(?:\.\d+)?)\s*m\s+waterdepth")
BEACH_BELOW = r"(?i)relative sea level[^.]{0,80}?about\s+(\d+(?:\.\d+)?)\s*m\s+below"
SITES = (
    r"offshore of ([A-Z][A-Za-z ]+?)(?:\s+extends|\s+and|,|\.|$)", r"off the ([A-Z][A-Za-z ]+?)(?:\s+River|\s+region|\s+in|,|\.|$)",
    r"vicinity of the ([A-Z][A-Za-z ]+?)(?:\s+indicates|\s+and|,|\.|$)", r"adjacent to the ([A-Z][A-Za-z ]+?)(?:\s+River|\s+and|,|\.|$)",
)
BARE_DEPTH = r"(?i)~?\s*(\d+(?:,\d{3})*(?:\.\d+)?)\s*(?:[–-]\s*~?\s*(\d+(?:,\d{3})*(?:\.\d+)?))?\s*m?"
BEACH_HALF_RANGE = 2.5


def _first(column: Column, rules: Sequence[tuple[str, object]], value, other) -> Column:
    """The value of the first rule whose pattern the column holds."""
    return reduce(lambda rest, rule: F.when(column.rlike(rule[0]), value(rule[1])).otherwise(rest), reversed(rules), other)


def indicator(text: Column) -> Column:
    """The indicator that a cell names; guyots first, a submerged beach if none is named."""
    low = F.lower(text)
    return F.when(text.rlike(GUYOT), "guyot_or_drowned_platform").otherwise(_first(low, [(p, n) for n, p in INDICATORS], F.lit, F.lit("submerged_beach")))


def record_class(kind: Column) -> Column:
    return F.when(kind == "terrestrial_over_marine_contact", "terrestrial_limiting").otherwise("sea_level_indicator")


def cell_depths(text: Column, bare: bool = False) -> Column:
    """struct(mid, low, high) as `depth_summary` gives it; with `bare`, numbers alone count where no phrase names a depth."""
    named = ex.depth_summary(text)
    if not bare:
        return named
    plain = F.replace(text, F.lit("−"), F.lit("-"))
    most = F.when(plain.rlike(GUYOT), 6000.0).otherwise(150.0)
    each = F.concat(*(F.transform(F.regexp_extract_all(plain, F.lit(BARE_DEPTH), F.lit(g)), lambda x: number(F.nullif(x, F.lit("")))) for g in (1, 2)))
    v = F.filter(each, lambda x: (x >= 0) & (x <= most))
    low, high = F.array_min(v), F.array_max(v)
    return F.coalesce(named, F.when(F.size(v) > 0, F.struct(F.bround((low + high) / 2, 2).alias("mid"), F.bround(-high, 2).alias("low"), F.bround(-low, 2).alias("high"))))


def bp_age(text: Column) -> tuple[Column, Column]:
    """An age BP and its uncertainty in ka: the first two numbers of a cell."""
    n = F.regexp_extract_all(text, F.lit(r"(\d+(?:,\d{3})*(?:\.\d+)?)"), F.lit(1))
    return tuple(F.bround(number(F.get(n, k)) / 1000, 3) for k in (0, 1))


def _age(num=None, low=None, high=None, label=None) -> Column:
    cast = lambda c, kind: (F.lit(None) if c is None else c).cast(kind)
    return F.struct(cast(num, "double").alias("num"), cast(low, "double").alias("low"), cast(high, "double").alias("high"), cast(label, "string").alias("label"))


def table_cells(items: DataFrame, specimen_sources: Sequence[str] = ()) -> DataFrame:
    """(source_id, table_no, kind, header, row, raw, cells) of items (source_id, table_no, caption, html): each row with its cells that are not blank. Rows count from 0, the header.

    Tables of `specimen_sources` are specimen tables if their first rows look like one; all others go by their header; tables of no kind go.
    """
    t = items.select("source_id", "table_no", F.lower(F.coalesce("caption", F.lit(""))).alias("caption"), table_rows(F.col("html")).alias("rows")).filter(F.size("rows") > 0)
    head = F.array_join(F.transform(F.get("rows", 0), ex.header), " ")
    low = F.array_join(F.transform(F.get("rows", 0), F.lower), " ")
    has = lambda words, where: reduce(lambda a, b: a & b, (F.contains(where, F.lit(w)) for w in words))
    kind = F.lit(None).cast("string")
    for name, words in reversed(SIGNATURES):
        test = has(words, low if name in ("palaeoshoreline", "feature") else head)
        kind = F.when(test | F.contains("caption", F.lit(FEATURE_CAPTION)) if name == "feature" else test, name).otherwise(kind)
    top = F.slice("rows", 1, 3)
    said = F.lower(F.array_join(F.transform(top, lambda r: F.array_join(r, " ")), " "))
    specimen = has(("zmuc", "locality", "calibrated age"), said) | (F.exists(top, lambda r: F.get(r, 0).rlike(r"^\d{1,2}$")) & said.rlike("aar-|k-"))
    own = F.col("source_id").isin(*specimen_sources) if specimen_sources else F.lit(False)
    t = t.withColumn("kind", F.when(own, F.when(specimen, "specimen")).otherwise(kind)).filter("kind IS NOT NULL")
    t = t.select("source_id", "table_no", "kind", F.transform(F.get("rows", 0), ex.header).alias("header"), F.posexplode("rows").alias("row", "raw"))
    return t.withColumn("cells", F.filter("raw", lambda c: c != ""))


def _window():
    return Window.partitionBy("source_id", "table_no").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)


def _grouped(rows: DataFrame) -> DataFrame:
    """Body rows with `group_name`, the last row above of one cell; these rows go."""
    return rows.filter("row > 0").withColumn("group_name", F.last(F.when(F.size("cells") == 1, F.get("cells", 0)), ignorenulls=True).over(_window())).filter(F.size("cells") > 1)


def _record(header: Column, cells: Column) -> Column:
    """Header to cell as a map; of equal headers the last cell."""
    pairs = F.arrays_zip(header.alias("h"), F.slice(cells, 1, F.size(header)).alias("c"))
    pairs = F.filter(pairs, lambda p: p["h"].isNotNull() & p["c"].isNotNull())
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["h"] == p["h"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["h"], p["c"])))


def _named(record: str, *names: str) -> Column:
    """The first of the named cells that is there and not blank."""
    return F.coalesce(*(F.nullif(F.try_element_at(F.col(record), F.lit(n)), F.lit("")) for n in names))


def _out(rows: DataFrame, **cols: Column) -> DataFrame:
    quote = F.substring(F.array_join("cells", " | "), 1, 800)
    made = {"source_id": F.col("source_id"), "table_no": F.col("table_no"), "row": F.col("row"), "kind": F.col("kind"), "quote": quote, **cols}
    return rows.select(*(made.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in RECORD.items()))


def palaeoshoreline(rows: DataFrame) -> DataFrame:
    """Location, morphology, depth range, ..., reference: a row of five cells lacks its location, which is the last one above."""
    body, w = _grouped(rows).filter(F.size("cells") >= 3), _window()
    whole = (F.size("cells") != 5) | (F.col("row") == F.first("row").over(w))
    body = body.withColumn("site", F.last(F.when(whole, F.get("cells", 0)), ignorenulls=True).over(w)).withColumn("cells", F.when(whole, F.col("cells")).otherwise(F.concat(F.array("site"), "cells")))
    body = body.withColumn("d", cell_depths(F.get("cells", 2), bare=True)).filter("d IS NOT NULL AND site <> ''")
    kind = indicator(F.concat_ws(" ", F.coalesce("group_name", F.lit("")), "site", F.get("cells", 1)))
    sample = F.concat(F.lit("table_"), (F.col("table_no") + 1).cast("string"), F.lit("_"), F.col("row").cast("string"))
    return _out(body, site_name=F.col("site"), location_name=F.col("site"), sample_id=sample, indicator_type=kind, record_class=record_class(kind), group_name=F.col("group_name"), elevation_m=-F.col("d.mid"), indicative_range_m=F.array("d.low", "d.high"), reported_m=F.col("d.mid"), dating_method=F.lit("stratigraphic_context"))


def feature(rows: DataFrame, fallback_site: str | None = None) -> DataFrame:
    """Feature, facies, timing: the feature's own words name its depth, its site and its indicator."""
    body = rows.filter("row > 0").filter(F.size("cells") >= 3).withColumn("text", F.get("cells", 0)).withColumn("d", cell_depths(F.col("text"))).filter("d IS NOT NULL")
    site, kind = F.coalesce(*(first_group(F.col("text"), p) for p in SITES), F.lit(fallback_site).cast("string")), indicator(F.col("text"))
    return _out(body, site_name=site, location_name=site, sample_id=F.concat(F.lit("feature_table_"), F.col("row").cast("string")), indicator_type=kind, record_class=record_class(kind), group_name=F.get("cells", 1), elevation_m=-F.col("d.mid"), indicative_range_m=F.array("d.low", "d.high"), reported_m=F.col("d.mid"), dating_method=F.lit("stratigraphic_context"))


def dated_altitude(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows as long as the header with a locality, an age BP and an altitude; the material, or else the group or the document's title, decides indicator, class and range."""
    body = _grouped(rows).join(docs.select("source_id", "title"), "source_id", "left").filter(F.size("cells") >= F.size("header")).withColumn("r", _record(F.col("header"), F.col("cells")))
    body = body.withColumns({"site": _named("r", "locality", "location"), "material": F.coalesce(_named("r", "material"), F.lit("")), "age_text": _named("r", "age year", "age years bp", "age"), "altitude": _named("r", "altitude m", "elevation m", "height m")})
    z, (age, spread) = number(first_group(F.col("altitude"), r"(-?\d+(?:,\d{3})*(?:\.\d+)?)")), bp_age(F.col("age_text"))
    body = body.withColumns({"z": z, "age": age, "spread": spread}).filter("site IS NOT NULL AND age IS NOT NULL AND z IS NOT NULL")
    facts = lambda m: F.struct(F.lit(m[0]).alias("indicator"), F.lit(m[1]).alias("class"), F.lit(m[2]).alias("below"), F.lit(m[3]).alias("above"))
    body = body.withColumn("m", _first(F.lower(F.concat_ws(" ", "material", "group_name", "title")), MATERIALS, facts, facts(OTHER_MATERIAL)))
    sample = F.coalesce(_named("r", "sample number", "sample no", "sample"), F.concat(F.lit("sample_"), F.col("row").cast("string")))
    reach = F.array(F.bround(F.col("z") - F.col("m.below"), 2), F.bround(F.col("z") + F.col("m.above"), 2))
    return _out(body, site_name=F.col("site"), sample_id=sample, location_name=F.concat_ws(", ", "site", "group_name"), indicator_type=F.col("m.indicator"), record_class=F.col("m.class"), group_name=F.col("group_name"), material=F.nullif(F.col("material"), F.lit("")), elevation_m=F.col("z"), indicative_range_m=reach, age=_age(F.col("age")), age_uncertainty_ka=F.col("spread"), reported_m=F.col("z"), dating_method=F.lit("radiocarbon"))


def beach_context(text: Column) -> Column:
    """struct(mid, low, high) of the depth in metres at which a text says that its beach lies; null where it doesn't."""
    pairs = [(number(first_group(text, p, 1)), number(first_group(text, p, 2))) for p in BEACH_BETWEEN]
    below = number(first_group(text, BEACH_BELOW))
    whole = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct(F.bround((a + b) / 2, 2).alias("mid"), F.least(a, b).alias("low"), F.greatest(a, b).alias("high")))
    return F.coalesce(*(whole(a, b) for a, b in pairs), whole(below, below))


def radiocarbon_depth(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows as long as the header with a radiocarbon age and a depth below the sea bed; elevation and range are those of the document's beach."""
    body = rows.filter("row > 0").filter(F.size("cells") >= F.size("header")).withColumn("r", _record(F.col("header"), F.col("cells")))
    (age, spread), below = bp_age(_named("r", "radiocarbon age yrs bp", "radiocarbon age", "age")), number(first_group(_named("r", "depth below sea bed m", "depth m"), r"(-?\d+(?:,\d{3})*(?:\.\d+)?)"))
    body = body.withColumns({"age": age, "spread": spread, "below": below, "site": F.coalesce(_named("r", "sample station", "station", "sample"), F.concat(F.lit("station_"), F.col("row").cast("string")))}).filter("age IS NOT NULL AND below IS NOT NULL")
    body = body.join(docs.select("source_id", beach_context(F.col("text")).alias("b")), "source_id", "left")
    sample = F.coalesce(_named("r", "laboratory ref number", "lab number"), F.concat(F.lit("radiocarbon_depth_"), F.col("row").cast("string")))
    reach = F.when(F.col("b").isNotNull(), F.array(-F.col("b.high"), -F.col("b.low")))
    return _out(body, site_name=F.col("site"), sample_id=sample, location_name=F.col("site"), indicator_type=F.lit("submerged_beach"), record_class=F.lit("sea_level_indicator"), material=F.lit("shell material"), elevation_m=-F.col("b.mid"), indicative_range_m=reach, age=_age(F.col("age")), age_uncertainty_ka=F.col("spread"), reported_m=F.col("below"), dating_method=F.lit("radiocarbon"))


def dated_beach_name(rows: DataFrame, location: str | None = None) -> DataFrame:
    """Beaches whose name tells their depth; a row without an age has the last one above it."""
    body = _grouped(rows).withColumn("n", F.size("cells"))
    exact, pair = F.col("n") == F.size("header"), (F.col("n") == 2) & (F.size("header") >= 3)
    body = body.withColumn("r", F.when(exact, _record(F.col("header"), F.col("cells"))))
    name = F.when(exact, _named("r", "beach name", "name")).when(pair, F.get("cells", 0)).when(F.col("n") >= 3, F.get("cells", 1))
    aged = F.when(exact, _named("r", "age years bp", "age")).when(pair, F.get("cells", 1)).when(F.col("n") >= 3, F.get("cells", 2))
    body = body.withColumn("name", F.coalesce(name, F.get("cells", F.col("n") - 2))).withColumn("aged", F.when(name.isNull(), F.get("cells", F.col("n") - 1)).otherwise(aged))
    body = body.filter(~F.contains(F.lower("name"), F.lit("modern sea level"))).withColumn("a", ex.age_from_text(F.coalesce("aged", F.lit(""))))
    known = F.col("a.num").isNotNull() | F.col("a.low").isNotNull()
    body = body.withColumn("a", F.last(F.when(known, F.col("a")), ignorenulls=True).over(_window())).withColumn("d", ex.beach_depth(F.col("name"))).filter("d IS NOT NULL")
    kind, z = F.when(F.col("d") > 0, "submerged_beach").otherwise("raised_beach"), F.bround(-F.col("d"), 2)
    reach = F.array(F.bround(z - BEACH_HALF_RANGE, 2), F.bround(z + BEACH_HALF_RANGE, 2))
    dated = F.when(F.col("a").isNotNull(), "stratigraphic_context").otherwise("other")
    return _out(body, site_name=ex.beach_name(F.col("name")), sample_id=F.concat(F.lit("beach_depth_"), F.col("row").cast("string")), location_name=F.lit(location), indicator_type=kind, record_class=F.lit("sea_level_indicator"), group_name=F.col("group_name"), elevation_m=z, indicative_range_m=reach, age=_age(F.col("a.num"), F.col("a.low"), F.col("a.high")), reported_m=F.col("d"), dating_method=dated)


def specimen(rows: DataFrame) -> DataFrame:
    """Rows of ten cells that begin with a number: species, element, file, locality, method, laboratory number, radiocarbon and calibrated age. Of equal laboratory numbers the last."""
    body = rows.filter(F.size("raw") >= 10).filter(F.get("raw", 0).rlike(r"^\d{1,2}$")).filter((F.get("raw", 4) != "") & (F.get("raw", 6) != ""))
    c = [F.get("raw", k) for k in range(10)]
    age, spread = bp_age(c[7])
    years = F.regexp_extract_all(F.replace(F.replace(c[9], F.lit(","), F.lit("")), F.lit("–"), F.lit("-")), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    cal = [F.bround(number(F.get(years, k)) / 1000, 3) for k in (0, 1)]
    modern, least = F.lower(c[7]) == "modern", c[7].startswith(">")
    own = F.when(modern, _age(F.lit(0.0))).when(least & age.isNotNull(), _age(label=F.concat(F.lit(">"), age.cast("string")))).when(age.isNotNull(), _age(age))
    value = F.when(cal[1].isNotNull(), _age(None, *cal)).when(cal[0].isNotNull(), _age(cal[0])).otherwise(own)
    spread = F.when(~modern & ~least, spread)
    out = _out(body, site_name=c[4], sample_id=c[6], location_name=c[4], indicator_type=F.lit("subtidal_facies"), record_class=F.lit("marine_limiting"), material=F.concat_ws("; ", c[1], c[2], c[3]), age=value, age_uncertainty_ka=spread, dating_method=F.when(value.isNotNull(), "radiocarbon").otherwise("other"))
    return out.groupBy("source_id", "sample_id").agg(F.max_by(F.struct(*out.columns), F.struct("table_no", "row")).alias("r")).select("r.*")


def mined(items: DataFrame, docs: DataFrame, specimen_sources: Sequence[str] = (), location: str | None = None, fallback_site: str | None = None) -> DataFrame:
    """The records of all tables (items: source_id, table_no, caption, html; docs: source_id, title, text), each read as its header's kind says.

    Pages are read once, for all kinds. Rows of one table are ordered in one task, which a table's length bounds. Null captions, pages without tables and rows too short for their kind give nothing.
    """
    rows = kept(table_cells(items, specimen_sources))
    of = lambda kind: rows.filter(F.col("kind") == kind)
    parts = [palaeoshoreline(of("palaeoshoreline")), feature(of("feature"), fallback_site), dated_altitude(of("dated_altitude"), docs), radiocarbon_depth(of("radiocarbon_depth"), docs), dated_beach_name(of("dated_beach_name"), location), specimen(of("specimen"))]
    return reduce(DataFrame.unionByName, parts)
