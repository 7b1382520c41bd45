"""Evidence from paragraphs, tables, references and model answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.placing import numbered
from tidemark.functions.text import GUYOT, collapse, first_group, number, once, quality, table_rows, where_named  # noqa: F401
from tidemark.operators import records

FATHOM_M = 1.8288
# Patterns of depths; each group is a depth in metres.
DEPTHS = (
    r"(?i)(?:water\s+)?depth(?:s| range)?[^.;:]{0,80}?(\d+(?:\.\d+)?)\s*(?:[–-]\s*(\d+(?:\.\d+)?))?\s*m",
    r"(?i)(\d+(?:\.\d+)?)\s*(?:[–-]\s*(\d+(?:\.\d+)?))?\s*m\s*bmsl",
    r"(?i)(\d+(?:\.\d+)?)\s*(?:[–-]\s*(\d+(?:\.\d+)?))?\s*m\s+below",
    r"(?i)(?:summit|plateau|platform|top|break)\s+depths?(?:\s*\([^)]*\))?[^.;:]{0,80}?(\d+(?:,\d{3})*(?:\.\d+)?)\s*(?:[–-]\s*(\d+(?:,\d{3})*(?:\.\d+)?))?\s*m",
    r"(?i)at\s+(\d+(?:\.\d+)?)\s*,\s*(\d+(?:\.\d+)?)\s+and\s+~?\s*(\d+(?:\.\d+)?)",
    r"(?i)at\s+(?:a\s+)?depth\s+of\s+(\d+(?:\.\d+)?)\s*m",
)
#: Words without one of which a pattern of DEPTHS can't be found.
DEPTH_WORDS = (("depth",), ("bmsl",), ("below",), ("summit", "plateau", "platform", "top", "break"), ("at",), ("depth",))
ISOBATH = r"(?i)(\d+(?:\.\d+)?)\s*m\s+isobath"


def depth_values(text: Column, isobath_offset: float = 200.0) -> Column:
    """All depths named in a text that are plausible (up to 150 m, 6 000 m where guyots are named). Isobath values of `isobath_offset` and more lose it, a repair of one data set; 0 turns it off."""
    none = F.array().cast("array<string>")

    def told(t: Column) -> Column:
        plain, low = t["plain"], t["low"]
        all_of = lambda p, g, words: F.coalesce(where_named(low, words, F.regexp_extract_all(plain, F.lit(p), F.lit(g))), F.when(plain.isNotNull(), none))
        found = [all_of(p, g, words) for p, words in zip(DEPTHS, DEPTH_WORDS) for g in range(1, p.count("(\\d") + 1)]
        values = F.transform(F.flatten(F.array(*found)), lambda x: number(F.nullif(x, F.lit(""))))
        lines = F.transform(all_of(ISOBATH, 1, ["isobath"]), number)
        if isobath_offset:
            lines = F.transform(lines, lambda x: F.when(x >= isobath_offset, x - isobath_offset).otherwise(x))
        guyot = F.coalesce(where_named(low, ["guyot", "mount", "platform", "island"], plain.rlike(GUYOT)), F.lit(False))
        return once(F.struct(F.concat(values, lines).alias("v"), F.when(guyot, 6000.0).otherwise(150.0).alias("most")), lambda s: F.filter(s["v"], lambda x: (x >= 0) & (x <= s["most"])))

    plain = F.replace(text, F.lit("−"), F.lit("-"))
    return once(F.struct(plain.alias("plain"), F.lower(plain).alias("low")), told)


def depth_summary(text: Column) -> Column:
    """struct(mid, low, high): the middle of the depths and their range as elevations; null where there are none."""
    ends = once(depth_values(text), lambda v: F.struct(F.array_min(v).alias("low"), F.array_max(v).alias("high")))
    return once(ends, lambda e: F.when(e["low"].isNotNull(), F.struct(F.bround((e["low"] + e["high"]) / 2, 2).alias("mid"), F.bround(-e["high"], 2).alias("low"), F.bround(-e["low"], 2).alias("high"))))


# Where guyots and atolls say how deep they lie; one or two numbers each, in metres, or in kilometres where km follows.
GUYOT_DEPTHS = (
    r"summit\s+depths?\s+of\s+about\s+(\d+(?:,\d{3})*(?:\.\d+)?)\b.{0,180}?\bm\b",
    r"(?:summit|plateau|platform|top|break)\s+depths?(?:\s*\([^)]*\))?[^.;:]{0,100}?(\d+(?:,\d{3})*(?:\.\d+)?)\s*(?:-|to|and)?\s*(\d+(?:,\d{3})*(?:\.\d+)?)?\s*m",
    r"(?:summit|plateau|platform|top|break)[^.]{0,80}?water\s+depths?[^.;:]{0,80}?(\d+(?:,\d{3})*(?:\.\d+)?)\s*(?:-|to|and)?\s*(\d+(?:,\d{3})*(?:\.\d+)?)?\s*m",
    r"tops?\s+(?:lie|fall|are|deepen)[^.]{0,80}?(\d+(?:,\d{3})*(?:\.\d+)?)\s*(?:-|to|and)?\s*(\d+(?:,\d{3})*(?:\.\d+)?)?\s*m",
    r"depths?\s+of\s+(?:about\s+|approximately\s+|~\s*)?(\d+(?:,\d{3})*(?:\.\d+)?)\s*(?:-|to|and)?\s*(\d+(?:,\d{3})*(?:\.\d+)?)?\s*m[^.]{0,80}?(?:guyot|seamount|tablemount|platform)",
    r"(?:guyot|seamount|tablemount|platform)[^.]{0,100}?depths?\s+of\s+(?:about\s+|approximately\s+|~\s*)?(\d+(?:,\d{3})*(?:\.\d+)?)\s*(?:-|to|and)?\s*(\d+(?:,\d{3})*(?:\.\d+)?)?\s*m",
    r"(?:summits?|tops?)\s+(?:now\s+)?(?:being\s+)?(\d+(?:\.\d+)?)\s*(?:-|to)\s*(\d+(?:\.\d+)?)\s*km\s+below\s+sea\s+level",
    r"(?:summits?|tops?)[^.]{0,80}?(\d+(?:\.\d+)?)\s*km\s+below\s+sea\s+level",
    r"atoll\s+(?:top|surface)\s+falls\s+below\s+(\d+(?:\.\d+)?)\s*m\s+with\s+respect\s+to\s+sea\s+level",
)
# Phrases that name a place, in order; the second group, if any, is a second place.
PLACE_PHRASES = (
    r"offshore of ([A-Z][A-Za-z' -]+?)(?:,|\.|\sand|\sin|\sstretches|\sextends|\sis|\shas|\sranges)", r"off ([A-Z][A-Za-z' -]+?)(?:,|\.|\sand|\sin|\sstretches|\sextends|\sis|\shas|\sranges)",
    r"between ([A-Z][A-Za-z' -]+?) and ([A-Z][A-Za-z' -]+?)(?:,|\.|\swhen|\swhere)", r"vicinity of ([A-Z][A-Za-z' -]+?)(?:,|\.|\sand|\sin)",
    r"neighbourhood of ([A-Z][A-Za-z' -]+?)(?:,|\.|\sand|\sin)", r"near ([A-Z][A-Za-z' -]+?)(?:,|\.|\sand|\sin)",
)
SHOUTED_PLACE = r"\bNEAR\s+([A-Z][A-Z-]+(?:-[A-Z]+)*)"
NO_SITE = "Narrative evidence locality"


def guyot_depths(text: Column) -> Column:
    """Depths of guyots in metres, each once, in the order of the patterns: the middle of two numbers, kilometres as metres; 300 to 6 000 m, or up to 100 m where an atoll is named."""
    plain = F.replace(F.replace(text, F.lit("−"), F.lit("-")), F.lit("–"), F.lit("-"))
    parts = []
    for p in GUYOT_DEPTHS:
        groups = [F.regexp_extract_all(plain, F.lit("(?i)" + p), F.lit(g)) for g in range(1 + p.count("(\\d"))]
        zipped = F.arrays_zip(*(x.alias(n) for x, n in zip(groups, "tab")))
        unit = lambda x: F.when(F.contains(F.lower(x["t"]), F.lit("km")), 1000.0).otherwise(1.0)
        value = lambda x, g: number(F.nullif(x[g], F.lit(""))) * unit(x)
        both = (lambda x: F.coalesce(F.bround((value(x, "a") + value(x, "b")) / 2, 2), value(x, "a"))) if len(groups) == 3 else (lambda x: value(x, "a"))
        parts.append(F.transform(zipped, both))
    atoll = F.contains(F.lower(plain), F.lit("atoll"))
    return F.array_distinct(F.transform(F.filter(F.concat(*parts), lambda v: v.between(300, 6000) | ((v > 0) & (v <= 100) & atoll)), lambda v: F.bround(v, 2)))


def site_name(text: Column, section: Column | None = None, known: Sequence[str] = ()) -> Column:
    """The place a paragraph speaks of: one in capitals after NEAR, one named by a phrase, the section it stands in, the first of the `known` names in it, else a default."""
    def clean(x: Column) -> Column:
        plain = F.regexp_replace(collapse(x), r"^[ ,.;:]+|[ ,.;:]+$", "")
        return F.nullif(F.substring(F.trim(F.regexp_replace(plain, r"(?i)\b(the|former|latter)\b$", "")), 1, 120), F.lit(""))

    strip = lambda x: F.nullif(F.regexp_replace(x, "^[ -]+|[ -]+$", ""), F.lit(""))
    named = []
    for p in PLACE_PHRASES:
        places = [strip(F.regexp_extract(text, p, g)) for g in range(1, 1 + p.count("([A-Z]"))]
        named.append(F.nullif(F.concat_ws(" and ", *places), F.lit("")))
    low = F.lower(text)
    listed = [F.when(F.contains(low, F.lit(n.lower())), F.lit(n)) for n in known]
    shouted = F.array_join(F.transform(F.split(F.lower(first_group(text, SHOUTED_PLACE)), "-"), F.initcap), "-")
    ladder = [shouted, F.coalesce(*named), *([section] if section is not None else []), *listed]
    return F.coalesce(*(clean(x) for x in ladder), F.lit(NO_SITE))


def age_from_text(text: Column) -> Column:
    """struct(num, low, high) in ka: a range of years (`12-14,000` means 12 000), or the first number."""
    plain = F.replace(text, F.lit(","), F.lit(""))
    numbers = F.transform(F.regexp_extract_all(plain, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))
    a, b = F.get(numbers, 0), F.get(numbers, 1)
    digits = lambda x: F.length(F.floor(x).cast("string"))
    first = F.when((a < 1000) & (b >= 1000), a * F.pow(F.lit(10.0), F.greatest(digits(b) - digits(a), F.lit(0)))).otherwise(a)
    ranged = (F.size(numbers) >= 2) & plain.rlike(r"\d+\s*(?:-|–|to)\s*\d+")
    return F.struct(F.when(~ranged, F.bround(a / 1000, 3)).alias("num"), F.when(ranged, F.bround(first / 1000, 3)).alias("low"), F.when(ranged, F.bround(b / 1000, 3)).alias("high"))


def header(text: Column) -> Column:
    """A table header as lower-case words and digits."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))
    return F.replace(F.replace(plain, F.lit("yrs b p"), F.lit("yrs bp")), F.lit("years b p"), F.lit("years bp"))


# Depths that a beach's name tells, in fathoms (two numbers or one) or metres.
BEACH_FATHOMS_BETWEEN = r"(?i)(\d+(?:\.\d+)?)\s*(?:-|to)\s*(\d+(?:\.\d+)?)\s*fathoms?"
BEACH_FATHOMS = r"(?i)(\d+(?:\.\d+)?)\s*fathoms?"
BEACH_TOE = r"(?i)toes?\s+at\s+(?:approx\.\s*)?(\d+(?:\.\d+)?)\s*m"


def beach_depth(name: Column) -> Column:
    """Metres from a name such as `10-12 fathom beach` or `toe at 35 m`."""
    plain = F.replace(F.replace(name, F.lit("−"), F.lit("-")), F.lit("–"), F.lit("-"))
    both = F.bround((number(first_group(plain, BEACH_FATHOMS_BETWEEN, 1)) + number(first_group(plain, BEACH_FATHOMS_BETWEEN, 2))) / 2 * FATHOM_M, 2)
    return F.coalesce(both, F.bround(number(first_group(plain, BEACH_FATHOMS)) * FATHOM_M, 2), number(first_group(plain, BEACH_TOE)))


def beach_name(name: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(name, r"\s*\([^)]*\)", ""), r"^[ .;]+|[ .;]+$", "")
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit("Submerged beach"))


def table_records(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, row, cells): the tables of a page as maps from the first row's normalized headers to the cells, of equal headers the last cell; cells beyond the header go. Row numbers count from 1."""
    rows = pages.select(key, table_rows(F.col(html)).alias("rows")).filter(F.size("rows") > 1)
    each = rows.select(key, F.transform(F.get("rows", 0), header).alias("h"), F.posexplode(F.slice("rows", 2, F.size("rows"))).alias("row", "cells"))
    pairs = F.filter(F.arrays_zip(F.col("h"), F.slice("cells", 1, F.size("h"))), lambda p: p["h"].isNotNull() & p["1"].isNotNull())
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["h"] == p["h"]))
    return each.select(key, (F.col("row") + 1).alias("row"), F.map_from_entries(F.transform(last, lambda p: F.struct(p["h"], p["1"]))).alias("cells"))


def carried(df: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """Blank cells filled from the last row above that has one, within each table."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(F.nullif(F.trim(c), F.lit("")), ignorenulls=True).over(w) for c in columns})


def sectioned_paragraphs(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, n, section, paragraph): blocks of lines between blank lines; lines that begin with # name the section of what follows. Each row is a document of its own, whatever its key; its length bounds what one task orders."""
    lines = df.select(key, text, F.monotonically_increasing_id().alias("_doc")).select(key, "_doc", F.posexplode(F.split(text, r"\R")).alias("i", "raw")).withColumn("line", collapse(F.col("raw")))
    head = F.col("line").startswith("#")
    w = Window.partitionBy("_doc").orderBy("i")
    lines = lines.withColumn("section", F.last(F.when(head, F.nullif(F.regexp_replace("line", "^[# ]+|[# ]+$", ""), F.lit(""))), ignorenulls=True).over(w))
    lines = lines.withColumn("block", F.sum(F.when(head | (F.col("line") == ""), 1).otherwise(0)).over(w)).filter((F.col("line") != "") & ~head)
    out = lines.groupBy("_doc", "block").agg(F.first(key).alias(key), F.first("section").alias("section"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), " ").alias("paragraph"))
    return out.select(key, F.row_number().over(Window.partitionBy("_doc").orderBy("block")).alias("n"), "section", "paragraph")


def ranked_dois(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, doi, score, n): of each document's DOIs the best: near the start, after `doi`, not among references, found often; ties go to the first."""
    body, low = F.col(text), F.lower(F.col(text))
    refs = F.instr(low, "\nreferences")
    each = df.select(key, body.alias("t"), refs.alias("refs"), F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit(r"(10\.\d{4,9}/[^\s\"<>]+)"), F.lit(1)))).alias("raw"))
    doi = F.lower(F.regexp_replace("raw", r"[.,;:)\]]+$", ""))
    at = F.expr("instr(t, raw)")
    score = F.when(at <= 3000, 30).when(at <= 20_000, 10).otherwise(0) + F.when(F.expr("substr(t, greatest(instr(t, raw) - 20, 1), 20)").rlike("(?i)doi"), 15).otherwise(0) - F.when((F.col("refs") > 0) & (at > F.col("refs")), 40).otherwise(0)
    each = each.select(key, doi.alias("doi"), at.alias("at"), score.alias("s"))
    best = each.groupBy(key, "doi").agg(F.max("s").alias("s"), F.min("at").alias("at"), F.count("*").alias("n")).withColumn("score", F.col("s") + 5 * F.least("n", F.lit(5)))
    return best.groupBy(key).agg(F.max_by(F.struct("doi", "score", "n"), F.struct("score", -F.col("at"))).alias("b")).select(key, "b.*")


def queued(jobs: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`jobs` with `place`, 0, 1, 2 ... within each queue of `by` in the order of `order`, by ranges of rows."""
    rows = numbered(jobs, [*by, *order], "_k")
    if not by:
        return rows.withColumnRenamed("_k", "place")
    start = rows.groupBy(*by).agg(F.min("_k").alias("_start")).withColumnsRenamed({c: f"_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return rows.join(start, same).withColumn("place", F.col("_k") - F.col("_start")).drop("_k", "_start", *(f"_{c}" for c in by))


# The order of statuses in the table of jobs.
STATUS_ORDER = ("running", "queued", "done", "failed", "cancelled", "skipped", "unsupported")


def sorted_states(states: DataFrame, mode: str, index: str = "index") -> DataFrame:
    """`states` with `place`, their order by `mode`: status, name, elapsed (longest first), unresolved (most first, then status) or any other for the index alone, which also ends the others."""
    rank = F.coalesce(*(F.when(F.col("status") == s, F.lit(i)) for i, s in enumerate(STATUS_ORDER)), F.lit(9))
    keys = {"status": [rank], "name": [F.lower("name")], "elapsed": [-F.coalesce("elapsed", F.lit(0.0))], "unresolved": [-F.col("unresolved"), rank]}.get(mode, [])
    names = [f"_by{i}" for i in range(len(keys))]
    return queued(states.withColumns(dict(zip(names, keys))) if keys else states, [], [*names, index]).drop(*names)


def median_step(df: DataFrame, value: str) -> DataFrame:
    """The median of the differences between neighbouring distinct values: values are numbered by ranges and meet the one after them; no task orders all of them."""
    rows = numbered(df.select(F.col(value).alias("_v")).filter("_v IS NOT NULL").distinct(), "_v", "_i")
    steps = rows.join(rows.select((F.col("_i") + 1).alias("_i"), F.col("_v").alias("_before")), "_i").select((F.col("_v") - F.col("_before")).alias("d"))
    return steps.agg(F.percentile("d", F.lit(0.5)).alias("median_step"))


def salvage_json(text: Column) -> Column:
    """The text from the first { to the last } if that is JSON, else null."""
    cut = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(cut).isNotNull(), cut)


def strip_controls(text: Column) -> Column:
    """Without terminal control sequences."""
    return F.regexp_replace(text, r"\x1b\[[0-9;?]*[ -/]*[@-~]", "")


def elapsed(seconds: Column) -> Column:
    """mm:ss, or h:mm:ss from an hour on."""
    s = F.floor(seconds).cast("long")
    minutes = F.format_string("%02d:%02d", F.floor(s % 3600 / 60).cast("long"), s % 60)
    return F.when(s >= 3600, F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), minutes)).otherwise(minutes)


def number_list(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).try_cast("double"))


def author_list(names: Column, most: int = 3) -> Column:
    return F.when(F.size(names) > most, F.concat(F.get(names, 0), F.lit(" et al."))).otherwise(F.array_join(names, "; "))


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_strings(text: pd.Series) -> pd.Series:
    """All strings in a JSON document, in order, at any depth; none if it is malformed."""
    import json

    def walk(v):
        if isinstance(v, str):
            yield v
        elif isinstance(v, (dict, list)):
            for x in v.values() if isinstance(v, dict) else v:
                yield from walk(x)

    def strings(t):
        try:
            return list(walk(json.loads(t)))
        except (TypeError, ValueError, RecursionError):
            return []

    return text.map(strings)


def interpreted(df: DataFrame, key: str, text: str, ask: Callable[[str], str | None]) -> DataFrame:
    """(key, candidate columns): a model's answers as candidate records. `ask` gets a text and gives JSON or null; what is no JSON, and candidates out of range, go."""
    schema = "candidate_records array<struct<site_name: string, latitude: double, longitude: double, elevation_m: double, age_ka: double, indicator_type: string, coordinate_source: string>>"
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "answer": [ask(t) for t in b["t"]]})

    answers = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, answer string")
    each = answers.select(F.col("k").alias(key), F.explode(F.from_json(salvage_json(F.col("answer")), schema)["candidate_records"]).alias("c")).select(key, "c.*")
    source = F.when(F.col("coordinate_source").isin(*records.COORDINATE_SOURCES), F.col("coordinate_source")).otherwise("inferred_text")
    ok = (F.col("latitude").isNull() | F.col("latitude").between(-90, 90)) & (F.col("longitude").isNull() | F.col("longitude").between(-180, 180))
    return each.filter(ok).withColumn("coordinate_source", source)


def processed(df: DataFrame) -> DataFrame:
    """Records with their confidence, their errors and whether they are accepted: scored, checked and told apart in one pass."""
    scored = df.withColumn("confidence_score", records.confidence())
    return scored.withColumn("errors", records.validation_errors()).withColumn("accepted", F.size("errors") == 0)
