"""Operators on point records: selection, tags, bins, weights, scores and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEEPWATER_M, HIGHEST_M = -200.0, 200.0
RECORD_CLASSES = ("sea_level_indicator", "marine_limiting", "terrestrial_limiting")
COORDINATE_SOURCES = ("reported", "inferred_text", "inferred_map")


def is_reported(source: Column) -> Column:
    """Null counts as not reported."""
    return F.coalesce(F.lower(F.trim(source)) == "reported", F.lit(False))


def usable(df: DataFrame, highest: float = HIGHEST_M) -> DataFrame:
    """Reported records with both coordinates and an elevation of at most `highest`."""
    return df.filter(is_reported(F.col("depth_source")) & F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & (F.col("z_m") <= highest))


def to_number(c: Column) -> Column:
    """What is no number, and NaN, becomes null."""
    x = c.cast("string").try_cast("double")
    return F.when(~F.isnan(x), x)


def json_number(c: Column, key: str) -> Column:
    return to_number(F.get_json_object(c, f"$.{key}"))


def choose_z(df: DataFrame, precomputed: str | None = "z_m") -> DataFrame:
    """Adds z_m and z_source for reported records: a value computed before, else elevation_m, else the reported elevation, else the negated reported depth."""
    options = [("precomputed_z_m", to_number(F.col(precomputed)))] if precomputed else []
    reported = F.col("reported_observations")
    options += [("elevation_m", to_number(F.col("elevation_m"))), ("reported_elevation_m", json_number(reported, "reported_elevation_m")), ("-reported_depth_m", -json_number(reported, "reported_depth_m"))]
    known = is_reported(F.col("depth_source"))
    name = F.coalesce(*(F.when(known & c.isNotNull(), F.lit(n)) for n, c in options), F.lit(""))
    return df.withColumns({"z_m": F.when(known, F.coalesce(*(c for _, c in options))), "z_source": name})


def depth_regime(z: Column, threshold: float = DEEPWATER_M, names: tuple[str, str] = ("deepwater", "shelf")) -> Column:
    """The name of what lies below the threshold, or of what lies on and above it."""
    return F.when(z < threshold, names[0]).when(z >= threshold, names[1])


def parse_regimes(text: str) -> list[tuple[str, float, float]]:
    """`name:low,high;name:low,high`."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(";"))):
        name, _, ends = part.partition(":")
        low, high = (float(x) for x in ends.split(","))
        out.append((name.strip(), low, high))
    return out


def with_named_regimes(df: DataFrame, regimes: Sequence[tuple[str, float, float]], z: str = "z_m") -> DataFrame:
    """A row for each regime that a record lies in; ends belong to a regime, so regimes may overlap."""
    hits = F.array_compact(F.array(*(F.when(F.col(z).between(low, high), F.lit(name)) for name, low, high in regimes)))
    return df.withColumn("regime", F.explode(hits))


def right_closed_bin(x: Column, edges: Sequence[float]) -> Column:
    """The number of the bin (a, b] that holds x; the first bin holds its low end too; null outside."""
    out = F.when(x == edges[0], 0)
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        out = out.when((x > low) & (x <= high), i)
    return out


def balanced_weights(df: DataFrame, by: str = "z_bin") -> DataFrame:
    """Adds `weight`, 1 / (rows of the bin), scaled to a mean of 1; rows without a bin go. Bins are summed map-side and joined back, so a full bin is no burden."""
    kept = df.filter(F.col(by).isNotNull())
    n = kept.groupBy(by).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n") / F.count("*")).scalar()
    return kept.join(n, by).withColumn("weight", total / F.col("_n")).drop("_n")


def bin_summary(df: DataFrame, by: str = "z_bin", z: str = "z_m", weight: str = "weight") -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n_records"), F.sum(weight).alias("weight_sum"), F.min(z).alias("z_min"), F.max(z).alias("z_max"), F.avg(z).alias("z_mean"), F.percentile(z, F.lit(0.5)).alias("z_median"))


def is_present(c: Column) -> Column:
    """Null, blank, `null` and `none` are absent."""
    return F.coalesce(~F.lower(F.trim(c.cast("string"))).isin("", "null", "none"), F.lit(False))


def validation_errors(classes: Sequence[str] = RECORD_CLASSES, categories: Sequence[str] | None = None) -> Column:
    """What is wrong with a record, as an array of texts, empty for a good one."""
    c = F.col

    def outside(name: str, low: float, high: float) -> Column:
        return F.when((c(name) < low) | (c(name) > high), f"{name} out of range")

    checks = [
        F.when(~F.coalesce(c("record_class").isin(*classes), F.lit(False)), "unknown record_class"),
        F.when(~F.coalesce(c("coordinate_source").isin(*COORDINATE_SOURCES), F.lit(False)), "unknown coordinate_source"),
        outside("latitude", -90, 90), outside("longitude", -180, 180), outside("confidence_score", 0, 1),
        F.when(~is_present(c("provenance")), "no provenance"),
    ]
    if categories:
        checks.insert(1, F.when(~F.coalesce(c("indicator_type").isin(*categories), F.lit(False)), "unknown indicator_type"))
    return F.array_compact(F.array(*checks))


def confidence() -> Column:
    """A record's completeness from 0 to 1, at most 0.55 without coordinates and 0.45 with neither elevation nor age.

    Reads latitude, longitude, elevation_m, age_ka, quote, coordinate_source, record_class and indicative_range_m.
    """
    c = F.col
    located = c("latitude").isNotNull() & c("longitude").isNotNull()
    # The weights and caps of the record model.
    weights = [
        (located, 0.15, 0.0),
        (c("elevation_m").isNotNull(), 0.15, 0.0),
        (c("age_ka").isNotNull(), 0.15, 0.0),
        (F.coalesce(F.length("quote") > 0, F.lit(False)), 0.15, 0.0),
        (F.coalesce(c("record_class") == "sea_level_indicator", F.lit(False)), 0.15, 0.08),
        (c("indicative_range_m").isNotNull(), 0.15, 0.05),
    ]
    total = F.when(c("coordinate_source") == "reported", 0.10).when(c("coordinate_source") == "inferred_text", 0.05).otherwise(0.02)
    for test, yes, no in weights:
        total = total + F.when(test, yes).otherwise(no)
    total = F.when(~located, F.least(total, F.lit(0.55))).otherwise(total)
    total = F.when(c("elevation_m").isNull() & c("age_ka").isNull(), F.least(total, F.lit(0.45))).otherwise(total)
    return F.bround(F.least(F.lit(1.0), total), 3)


def normalized_elevation(df: DataFrame, sampled: str = "sampled_m") -> DataFrame:
    """Sets elevation_m, depth_source, derived_depth_m and derivation: a reported elevation stays, an existing one stays, else the sampled value is taken, rounded to centimetres."""
    reported, existing, dem = F.col("reported_elevation_m"), F.col("elevation_m"), F.col(sampled)
    from_dem = reported.isNull() & existing.isNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & dem.isNotNull()
    note = (
        F.when(reported.isNotNull(), "reported").when(existing.isNotNull(), "existing")
        .when(F.col("latitude").isNull() | F.col("longitude").isNull(), "no coordinates").when(dem.isNull(), "no raster value").otherwise("raster")
    )
    return df.withColumns({
        "elevation_m": F.coalesce(reported, existing, F.when(from_dem, F.bround(dem, 2))),
        "depth_source": F.when(reported.isNotNull(), "reported").when(from_dem, "SRTM15+V2").otherwise(F.col("depth_source")),
        "derived_depth_m": F.when(from_dem & (dem < 0), F.bround(-dem, 2)),
        "derivation": note,
    })


def age_to_ka(age: Column, method: Column) -> Column:
    """Years become thousands of years: any age above 1000, and radiocarbon ages above 300. Others, and ages not above 0, stay."""
    years = (age > 1000) | (F.coalesce(F.lower(method).contains("radiocarbon"), F.lit(False)) & (age > 300))
    return F.when(years, F.bround(age / 1000, 3)).otherwise(age)


UNION = T.StructType([T.StructField("num", T.DoubleType()), T.StructField("items", T.ArrayType(T.DoubleType())), T.StructField("label", T.StringType())])


def union_value(text: Column) -> Column:
    """A JSON number, list of numbers or label as a struct (num, items, label)."""
    trimmed = F.trim(text)
    items = F.when(trimmed.startswith("["), F.from_json(trimmed, "array<double>"))
    num = to_number(F.regexp_replace(trimmed, '^"|"$', ""))
    label = F.when(is_present(trimmed) & items.isNull() & num.isNull(), F.regexp_replace(trimmed, '^"|"$', ""))
    return F.struct(num.alias("num"), items.alias("items"), label.alias("label"))


def plain_number(x: Column, digits: int = 6) -> Column:
    """At most six decimals without trailing zeros; empty for null."""
    text = F.format_string(f"%.{digits}f", x)
    return F.when(x.isNull(), "").otherwise(F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ""))


def elevation_texts(value: Column) -> dict[str, Column]:
    """Least, greatest and mean of a union value as texts."""
    all_ = F.coalesce(F.filter(value["items"], lambda x: x.isNotNull()), F.when(value["num"].isNotNull(), F.array(value["num"])), F.array().cast("array<double>"))
    mean = F.when(F.size(all_) > 0, F.aggregate(all_, F.lit(0.0), lambda a, x: a + x) / F.size(all_))
    return {"elevation_min": plain_number(F.array_min(all_)), "elevation_max": plain_number(F.array_max(all_)), "elevation_avg": plain_number(mean), "elevation_mean": plain_number(mean)}


def record_id(parts: Sequence[Column]) -> Column:
    """SHA-256 of the parts joined by bars; absent parts are empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)
