"""Readers and writers of record files, documents, page blocks, rasters and listings."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import collapse, quality, title
from tidemark.operators.records import elevation_texts, is_present, union_value

_STRINGS = (
    "id", "source_id", "record_class", "site_name", "sample_id", "latitude", "longitude", "coordinate_source", "coordinate_uncertainty_m", "elevation_m", "elevation_reference", "depth_source",
    "indicator_type", "indicator_subtype", "indicative_range_m", "age_ka", "dating_method", "description", "location_name", "bibliographic_reference", "doi_or_url", "confidence_score", "notes",
    "source_locator", "reported_observations", "derived_observations", "age_models", "elevation_min", "elevation_max", "elevation_avg", "elevation_mean",
)
#: The columns of a record file, in order.
RECORD_FILE = T.StructType([T.StructField(n, T.StringType()) for n in _STRINGS])
NUMBERS = ("latitude", "longitude", "coordinate_uncertainty_m", "confidence_score")
LOCATOR = "page string, figure string, table string, section string, quote_or_paraphrase string"
REPORTED = "reported_elevation_m double, reported_depth_m double, reported_datum string, reported_uncertainty_m double"
DERIVED = "raw_raster_value_m double, applied_correction_m double, derived_elevation_m double, derived_depth_m double, derivation_notes string"
AGE_MODELS = "array<struct<method: string, relation: string, age_ka: string, uncertainty_ka: double, material: string, notes: string>>"
SUFFIXES = {"csv": "csv", "txt": "text", "md": "text", "pdf": "pdf"}


def source_id(path: Column) -> Column:
    """The file's name without its last suffix, blanks as underscores, lower-cased."""
    name = F.url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B")))
    return F.lower(F.replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit(" "), F.lit("_")))


def incoming(spark: SparkSession, folder: str, wanted: list[str] | None = None) -> DataFrame:
    """(path, source_id, kind, length, modified) of the files that are not hidden; kind is csv, text, pdf or unsupported. No content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    name, suffix = F.element_at(F.split("path", "/"), -1), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = None
    for s, k in SUFFIXES.items():
        kind = F.when(suffix == s, k) if kind is None else kind.when(suffix == s, k)
    out = files.filter(~name.startswith(".")).select("path", source_id(F.col("path")).alias("source_id"), kind.otherwise("unsupported").alias("kind"), "length", "modified")
    return out if wanted is None else out.filter(F.col("source_id").isin([w.replace(" ", "_").lower() for w in wanted]))


def newest(files: DataFrame) -> DataFrame:
    """The file modified last; of several the greatest path."""
    return files.agg(F.max_by(F.struct(*files.columns), F.struct("modified", "path")).alias("f")).select("f.*")


def stale_inputs(files: DataFrame, reference: str) -> DataFrame:
    """Files modified after the file `reference` (the end of its path)."""
    at = files.filter(F.col("path").endswith(reference)).agg(F.max("modified")).scalar()
    return files.filter(~F.col("path").endswith(reference) & (F.col("modified") > at))


def complete_sources(files: DataFrame, parts: int = 3) -> DataFrame:
    """Source folders with at least `parts` files that are not empty."""
    folder = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1)
    return files.groupBy(folder.alias("source")).agg(F.count_if(F.col("length") > 0).alias("n")).filter(F.col("n") >= parts)


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(source_id, title, text) of whole text files; the title is the first line that is not blank."""
    t = spark.read.text(folder, wholetext=True).select(source_id(F.input_file_name()).alias("source_id"), F.col("value").alias("text"))
    return t.select("source_id", title(F.col("text")).alias("title"), "text")


def csv_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(source_id, title, text, quality) of CSV files as documents: cells of a row joined by commas, without their quotes, rows by line ends; the title is the first cell, else the file's name."""
    whole = spark.read.text(folder, wholetext=True).select(source_id(F.input_file_name()).alias("source_id"), F.col("value").alias("raw"))

    def parsed(raw: pd.Series) -> pd.DataFrame:
        files = [list(csv.reader(io.StringIO(x, newline=""))) for x in raw]
        return pd.DataFrame({"first": [r[0][0] if r and r[0] else None for r in files], "text": ["\n".join(",".join(c) for c in r) for r in files]})

    d = whole.select("source_id", F.pandas_udf(parsed, "first string, text string")("raw").alias("p"))
    return d.select("source_id", F.coalesce(F.nullif(F.col("p.first"), F.lit("")), F.col("source_id")).alias("title"), "p.text", quality(F.col("p.text")).alias("quality"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A JSON object for each row, with its keys in order; null fields stay."""
    df.select(*sorted(df.columns)).write.mode(mode).option("ignoreNullFields", False).json(path)


def write_lines(lines: DataFrame, path: str, append: bool = False) -> None:
    """Text lines (value): a summary that replaces the one before, or a log that grows."""
    lines.select(F.col("value").cast("string").alias("value")).write.mode("append" if append else "overwrite").text(path)


# The columns of a table of found works.
DISCOVERY = ("title", "authors", "year", "doi", "url", "search_keywords_matched")


def write_discovery(works: DataFrame, path: str, search_date: str) -> None:
    """Found works as CSV with the date of the search; absent and null columns are blank."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in works.columns else F.lit("")
    works.select(*(text(c).alias(c) for c in DISCOVERY), F.lit(search_date).alias("search_date")).write.mode("overwrite").option("escape", '"').csv(path, header=True)


def pages(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each page of a text split at form feeds, numbered from 1."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(F.split(text, "\f")).alias("page", text)).withColumn("page", F.col("page") + 1)


def metadata(text: Column) -> Column:
    """`Key: value` lines as a map; of equal keys the last; only the first colon divides."""
    lines = F.filter(F.split(text, r"\R"), lambda x: F.contains(x, F.lit(":")))
    pair = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("v"))
    pairs = F.transform(lines, pair)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def page_blocks(df: DataFrame, items: str = "items") -> DataFrame:
    """(source_id, page, source, cue, text) of the image, table and chart items of content lists: struct(type, page_idx, table_body, captions, footnotes, text)."""
    each = df.select("source_id", F.explode(items).alias("i")).filter(F.col("i.type").isin("image", "table", "chart"))
    body = collapse(F.regexp_replace(F.regexp_replace(F.coalesce("i.table_body", F.lit("")), r"(?i)</t[dh]>\s*<t[dh][^>]*>", " | "), r"<[^>]*>", " "))
    parts = F.array(F.concat_ws("\n", "i.captions"), F.concat_ws("\n", "i.footnotes"), body, F.coalesce("i.text", F.lit("")))
    text = F.array_join(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""), "\n")
    return each.select("source_id", (F.col("i.page_idx") + 1).alias("page"), F.col("i.type").alias("source"), F.substring(text, 1, 120).alias("cue"), text.alias("text")).filter("text <> ''")


# When a native text is too short or too poor to do without the one read from images.
SHORTEST_NATIVE, POOREST_NATIVE = 1500, 0.55


def better_text(df: DataFrame, native: str = "native_text", ocr: str = "ocr_text") -> DataFrame:
    """Adds text, text_quality and methods: the native text, unless it is short or poor and the one read from images is better, or as good and longer. Null texts count as empty."""
    a, b = (F.coalesce(F.col(c), F.lit("")) for c in (native, ocr))
    told = df.withColumns({"_a": a, "_b": b}).withColumns({"_qa": quality(F.col("_a")), "_qb": quality(F.col("_b"))})
    tried = (F.length("_a") < SHORTEST_NATIVE) | (F.col("_qa") < POOREST_NATIVE)
    other = tried & ((F.col("_qb") > F.col("_qa")) | ((F.col("_qb") >= F.col("_qa")) & (F.length("_b") > F.length("_a"))))
    methods = F.array_compact(F.array(F.lit("native"), F.when(tried, F.lit("ocr"))))
    return told.withColumns({"text": F.when(other, F.col("_b")).otherwise(F.col("_a")), "text_quality": F.when(other, F.col("_qb")).otherwise(F.col("_qa")), "methods": methods}).drop("_a", "_b", "_qa", "_qb")


def staged(df: DataFrame, items: str = "items", text: str = "text", stem: str = "source_id") -> DataFrame:
    """Adds title and page_count to documents with content items: struct(type, text, text_level, page_idx, ...).

    The title is the first item of level 1 that has text, else the first line without its marks, else the file's name; the pages are those up to the last item's. Null items count as none.
    """
    top = F.get(F.filter(items, lambda i: (i["type"] == "text") & (i["text_level"] == 1) & (F.length(F.trim(i["text"])) > 0)), 0)["text"]
    line = F.nullif(F.trim(F.regexp_replace(title(F.coalesce(F.col(text), F.lit(""))), "^[# ]+", "")), F.lit(""))
    pages_ = F.array_max(F.transform(items, lambda i: i["page_idx"])) + 1
    return df.withColumns({"title": F.coalesce(collapse(top), line, F.col(stem)), "page_count": pages_.cast("int")})


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Record files with numbers, union values and nested columns parsed; blank, `null` and `None` numbers are null, malformed JSON fails."""
    raw = spark.read.csv(path, header=True, schema=RECORD_FILE, multiLine=True, escape='"', mode="FAILFAST")
    number = lambda n: F.when(is_present(F.col(n)), F.col(n).cast("double")).alias(n)
    nested = {"source_locator": LOCATOR, "reported_observations": REPORTED, "derived_observations": DERIVED}
    cols = []
    for n in RECORD_FILE.names:
        if n in NUMBERS:
            cols.append(number(n))
        elif n in ("elevation_m", "age_ka"):
            cols.append(union_value(F.col(n)).alias(n))
        elif n == "indicative_range_m":
            cols.append(F.from_json(n, "array<double>").alias(n))
        elif n in nested:
            cols.append(F.from_json(n, nested[n], {"mode": "FAILFAST"}).alias(n))
        elif n == "age_models":
            cols.append(F.from_json(n, AGE_MODELS).alias(n))
        else:
            cols.append(F.col(n))
    return raw.select(*cols)


def import_records(spark: SparkSession, path: str) -> DataFrame:
    """Files that have the record columns, taken as they are: elevations and ages stay text, the indicative range is dropped, bad JSON becomes null."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    missing = set(RECORD_FILE.names) - set(raw.columns)
    if missing:
        raise ValueError(f"no record file: {sorted(missing)} are missing")
    cols = {n: F.col(n).try_cast("double") for n in NUMBERS} | {"indicative_range_m": F.lit(None).cast("array<double>")}
    cols |= {"source_locator": F.from_json("source_locator", LOCATOR), "reported_observations": F.from_json("reported_observations", REPORTED), "derived_observations": F.from_json("derived_observations", DERIVED), "age_models": F.from_json("age_models", AGE_MODELS)}
    return raw.select(*(cols.get(n, F.col(n)).alias(n) for n in RECORD_FILE.names))


def _union_json(c: Column) -> Column:
    return F.when(c["num"].isNotNull(), c["num"].cast("string")).when(c["items"].isNotNull(), F.to_json(c["items"])).when(c["label"].isNotNull(), c["label"])


def to_file_row(df: DataFrame) -> DataFrame:
    """Parsed records as the text columns of a record file, with the elevation's least, greatest and mean."""
    kinds = dict(df.dtypes)
    out = {}
    for n in RECORD_FILE.names:
        if n in ("elevation_m", "age_ka") and kinds.get(n, "").startswith("struct"):
            out[n] = _union_json(F.col(n))
        elif n in kinds and kinds[n].startswith(("struct", "array", "map")):
            out[n] = F.to_json(n)
        elif n in kinds:
            out[n] = F.col(n).cast("string")
        else:
            out[n] = F.lit("")
    if kinds.get("elevation_m", "").startswith("struct"):
        out |= elevation_texts(F.col("elevation_m"))
    return df.select(*(F.coalesce(out[n], F.lit("")).alias(n) for n in RECORD_FILE.names))


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of record files; the committer makes them visible at once."""
    to_file_row(df).write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def features(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """One GeoJSON feature a row, as text; the geometry is null without coordinates."""
    point = F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*df.columns).alias("properties")), {"ignoreNullFields": "false"}).alias("value"))


def write_geojson_lines(df: DataFrame, path: str) -> None:
    """A folder of newline-delimited features, which any number of tasks write; no document is gathered in one place."""
    features(df).write.mode("overwrite").text(path)


def read_geocodes(spark: SparkSession, path: str) -> DataFrame:
    """Points of a GeoJSON feature collection: lat, lon and the properties as a map; multi-points count if they have one point, others and those out of range go."""
    schema = "features array<struct<geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f")).select("f.*")
    flat = F.from_json(F.col("geometry.coordinates"), "array<double>")
    multi = F.from_json(F.col("geometry.coordinates"), "array<array<double>>")
    at = F.when(F.col("geometry.type") == "Point", flat).when((F.col("geometry.type") == "MultiPoint") & (F.size(multi) == 1), F.get(multi, 0))
    out = f.select(F.get(at, 1).alias("lat"), F.get(at, 0).alias("lon"), "properties")
    return out.filter(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))


def sample_raster(points: DataFrame, cells: DataFrame, origin: tuple[float, float], size: tuple[float, float], shape: tuple[int, int], nodata: float | None = None) -> DataFrame:
    """Adds `sampled_m` from a raster as (row, col, value): the cell a point lies in, truncated towards zero; null outside, for nodata and for NaN. An equi-join on the cell."""
    col = ((F.col("longitude") - origin[0]) / size[0]).cast("int")
    row = ((F.lit(origin[1]) - F.col("latitude")) / size[1]).cast("int")
    keyed = points.withColumn("_row", row).withColumn("_col", col)
    inside = F.col("_row").between(0, shape[0] - 1) & F.col("_col").between(0, shape[1] - 1)
    v = F.col("value").cast("double")
    good = cells.select(F.col("row").alias("_row"), F.col("col").alias("_col"), F.when(~F.isnan(v) & (F.lit(nodata is None) | (v != F.lit(nodata if nodata is not None else 0.0))), v).alias("_v"))
    return keyed.join(good, ["_row", "_col"], "left").select(*points.columns, F.when(inside, F.col("_v")).alias("sampled_m"))


def sniff_separator(header: str) -> str:
    """The separator that occurs most in a header line; a comma if none does."""
    return max(",\t;|", key=lambda s: (header.count(s), s == ","))


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file whose separator its first line tells; all columns are text."""
    first = spark.read.text(path).limit(1).collect()
    return spark.read.csv(path, header=True, sep=sniff_separator(first[0][0] if first else ""))


def report(records: DataFrame, unresolved: DataFrame) -> DataFrame:
    """One row of text: the counts of a run by class, as Markdown."""
    by = records.groupBy("record_class").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.format_string("- %s: %d", F.coalesce("record_class", F.lit("none")), "n"))).alias("lines"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    open_ = unresolved.agg(F.count("*")).scalar()
    return by.select(F.concat_ws("\n", F.format_string("# Run\n\nRecords: %d\nUnresolved: %d\n", "n", open_), F.array_join("lines", "\n")).alias("value"))
