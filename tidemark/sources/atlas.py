"""Rows of an external atlas export as canonical records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import collapse

# Ordered rules, (words any of which must stand in the text, value).
INDICATORS = (
    (("marine terrace", "shoreline angle"), "marine_terrace"),
    (("single coral",), "coral_head"),
    (("coral", "reef", "algal reef"), "coral_reef"),
    (("tidal notch",), "tidal_notch"),
    (("beachrock",), "beachrock"),
    (("beach", "foreshore", "barrier"), "raised_beach"),
    (("lagoon",), "lagoonal_sediment"),
    (("estuar",), "estuarine_sediment"),
    (("salt marsh", "basal peat", "peat"), "saltmarsh_peat_or_mud"),
    (("mangrove",), "mangrove_peat_or_mud"),
    (("tidal flat", "intertidal"), "tidal_flat_sediment"),
    (("shore platform",), "shore_platform"),
    (("speleothem",), "speleothem_sea_level_proxy"),
    (("marine fauna", "shell"), "marine_shell_bed"),
)
METHODS = ((("u-series", "uranium"), "u_series"), (("luminescence",), "luminescence"), (("=aar",), "aar"), (("=esr",), "esr"), (("stratigraphic",), "stratigraphic_context"), (("radiocarbon", "14c"), "radiocarbon"))
CLASSES = ((("marine limiting",), "marine_limiting"), (("terrestrial limiting",), "terrestrial_limiting"))
RELATIONS = ((("older",), "older_than"), (("younger",), "younger_than"), (("equal",), "equal"))
DATUMS = ((("lowest astronomical",), "LAT"), (("mean sea level", "egm", "geoid", "datum"), "MSL"))


def cleaned(df: DataFrame) -> DataFrame:
    """All columns as texts with white space collapsed, once for the many rules that read them."""
    return df.select(*(F.coalesce(collapse(F.col(f"`{c}`").cast("string")), F.lit("")).alias(c) for c in df.columns))


def text(name: str) -> Column:
    """A column of a cleaned table; blank for null."""
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def value(name: str) -> Column:
    x = F.col(f"`{name}`").cast("string").try_cast("double")
    return F.when(~F.isnan(x), x)


def by_rules(c: Column, rules, otherwise: Column | str | None) -> Column:
    """The value of the first rule of which a word stands in c (or, with `=`, is c)."""
    out = None
    for words, v in rules:
        test = F.lit(False)
        for w in words:
            test = test | ((c == w[1:]) if w[0] == "=" else F.contains(c, F.lit(w)))
        out = F.when(test, v) if out is None else out.when(test, v)
    return out.otherwise(otherwise)


def record_class() -> Column:
    return by_rules(F.lower(text("Type of datapoint")), CLASSES, "sea_level_indicator")


def indicator_type() -> Column:
    c = F.lower(F.concat_ws(" ", text("RSL Indicator"), text("RSL indicator description")))
    limiting = F.when(F.contains(c, F.lit("limiting indicator")), F.when(record_class() == "marine_limiting", "subtidal_facies").otherwise("marine_over_terrestrial_contact"))
    return by_rules(c, INDICATORS, limiting)


def skip_reason(quality_mode: str = "all", include_limiting: bool = True) -> Column:
    out = F.when(text("WALIS_ID") == "", "missing_walis_id").when(value("Latitude").isNull() | value("Longitude").isNull(), "missing_coordinates")
    if not include_limiting:
        out = out.when(record_class() != "sea_level_indicator", "limiting_excluded")
    if quality_mode == "accepted":
        out = out.when(F.lower(text("Originally accepted?")) != "yes", "not_originally_accepted")
    if quality_mode == "positive-quality":
        positive = lambda n: F.coalesce(value(n), F.lit(0.0)) > 0
        out = out.when(~positive("Quality of RSL information") | ~positive("Quality of age information"), "non_positive_quality")
    return F.coalesce(out, F.when(indicator_type().isNull(), "unmapped_indicator"))


def best_age() -> Column:
    """struct(num, lo, hi, label, note): corrected, recalculated or reported age, else stratigraphic bounds, else the isotopic stage."""
    def one(num=None, lo=None, hi=None, label=None, note=""):
        d, s = (lambda c: (c if c is not None else F.lit(None)).cast("double")), (lambda c: (c if c is not None else F.lit(None)).cast("string"))
        return F.struct(d(num).alias("num"), d(lo).alias("lo"), d(hi).alias("hi"), s(label).alias("label"), F.lit(note).alias("note"))

    names = (("U-Series corrected age (speleothems, ka)", "corrected"), ("U-Series recalculated age (ka)", "recalculated"), ("Reported age (ka)", "reported"))
    lo, hi, stage = value("Stratigraphy Lower Age (ka)"), value("Stratigraphy Upper Age (ka)"), text("Marine Isotopic Stage")
    options = [F.when(value(n).isNotNull(), one(num=value(n), note=note)) for n, note in names]
    return F.coalesce(*options, F.when(lo.isNotNull() | hi.isNotNull(), one(lo=lo, hi=hi, note="bounds")), F.when(stage != "", one(label=stage, note="stage")), one(note="none"))


def indicative_range() -> Column:
    lo, hi, ir, rwl = (value(n) for n in ("Lower limit of living range (m)", "Upper limit of living range (m)", "IR", "RWL"))
    around = F.when(ir.isNotNull() & rwl.isNotNull(), F.array(rwl - F.abs(ir) / 2, rwl + F.abs(ir) / 2))
    return F.when(lo.isNotNull() | hi.isNotNull(), F.array(lo, hi)).otherwise(around)


def canonical(df: DataFrame, quality_mode: str = "all", include_limiting: bool = True) -> DataFrame:
    """One record for each row that is not skipped."""
    paleo, measured, depth, distance = (value(n) for n in ("Paleo RSL (m)", "Elevation (m)", "Paleo water depth estimate (m)", "Distance from sample"))
    return cleaned(df).filter(skip_reason(quality_mode, include_limiting).isNull()).select(
        text("WALIS_ID").alias("sample_id"), record_class().alias("record_class"), indicator_type().alias("indicator_type"),
        value("Latitude").alias("latitude"), value("Longitude").alias("longitude"),
        F.when(distance >= 0, distance).otherwise(100.0).alias("coordinate_uncertainty_m"),
        F.coalesce(paleo, measured).alias("elevation_m"), measured.alias("reported_elevation_m"),
        F.when(depth > 0, depth).when(measured < 0, F.abs(measured)).alias("reported_depth_m"),
        by_rules(F.lower(text("Vertical datum")), DATUMS, "unknown").alias("elevation_reference"),
        by_rules(F.lower(text("Dating technique")), METHODS, "other").alias("dating_method"),
        by_rules(F.lower(text("Timing constraint")), RELATIONS, F.when((text("Stratigraphy Upper Age (ka)") != "") | (text("Stratigraphy Lower Age (ka)") != ""), "range").otherwise("unknown")).alias("age_relation"),
        best_age().alias("age"), indicative_range().alias("indicative_range_m"),
    )


def skipped(df: DataFrame, quality_mode: str = "all", include_limiting: bool = True) -> DataFrame:
    """Rows left out, by reason, most first."""
    return cleaned(df).select(skip_reason(quality_mode, include_limiting).alias("reason")).filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def composed(separator: str, *names: str) -> Column:
    """The texts of the columns that are not blank, joined."""
    return F.concat_ws(separator, *(F.nullif(text(n), F.lit("")) for n in names))


def texts() -> dict[str, Column]:
    """Description, location, site and notes of a row."""
    blank = lambda n: F.coalesce(F.nullif(text(n), F.lit("")), F.lit("blank"))
    notes = F.format_string("RSL quality %s, age quality %s. Accepted: %s; by another study: %s.", *(blank(n) for n in ("Quality of RSL information", "Quality of age information", "Originally accepted?", "Accepted by other study?")))
    return {
        "description": composed("; ", "RSL Indicator", "RSL indicator description"),
        "location_name": composed(", ", "Site", "Subsite", "Region", "Nation"),
        "site_name": F.coalesce(F.nullif(composed(" - ", "Site", "Subsite"), F.lit("")), text("WALIS_ID")),
        "notes": notes,
    }


def confidence(base: Column) -> Column:
    """A blend of a record's completeness with the row's quality marks and acceptance, less a little for limiting points."""
    mark = lambda n: F.coalesce(F.floor(value(n)), F.lit(0))
    yes = lambda n: F.lower(text(n)) == "yes"
    # Weights of the blend.
    total = base * 0.75 + (mark("Quality of RSL information") + mark("Quality of age information")) / 10.0 * 0.25
    total = total + F.when(yes("Originally accepted?"), 0.08).otherwise(0.0) + F.when(yes("Accepted by other study?"), 0.03).otherwise(0.0) - F.when(record_class() != "sea_level_indicator", 0.05).otherwise(0.0)
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 3)
