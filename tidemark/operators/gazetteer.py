"""Spellings under which a place is looked up, and the choice among what a gazetteer returns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import collapse

# Places by the words that name them, in the order in which their spellings are tried.
KNOWN_PLACES = (
    ("wilderness", ("Wilderness, Western Cape, South Africa",)),
    ("seaward barrier", ("Wilderness, Western Cape, South Africa",)),
    ("landward barrier", ("Wilderness, Western Cape, South Africa",)),
    ("mossel bay", ("Mossel Bay, South Africa",)),
    ("cape st blaize", ("Cape St Blaize, Mossel Bay, South Africa",)),
    ("cape saint blaize", ("Cape St Blaize, Mossel Bay, South Africa",)),
    ("groot brak", ("Groot Brak River, Western Cape, South Africa",)),
    ("nw malta", ("northwest Malta, Malta",)),
    ("nw gozo", ("northwest Gozo, Malta",)),
    ("sikka il-bajda", ("Sikka il-Bajda, Malta",)),
    ("malta", ("Malta",)),
    ("gozo", ("Gozo, Malta",)),
    ("robe", ("Robe, South Australia",)),
    ("beachport", ("Beachport, South Australia",)),
    ("southeast south australia", ("Southeast South Australia, Australia",)),
    ("rottnest", ("Rottnest Island, Western Australia", "Rottnest Shelf, Western Australia")),
    ("recherche", ("Esperance, Western Australia", "Recherche Archipelago, Western Australia")),
    ("lacepede", ("Lacepede Bay, South Australia",)),
    ("gippsland", ("Gippsland, Victoria, Australia",)),
    ("southeast australian shelf", ("Newcastle, New South Wales", "Coffs Harbour, New South Wales", "New South Wales, Australia")),
    ("eastern tasmanian shelf", ("Freycinet National Park, Tasmania", "Freycinet Peninsula, Tasmania")),
    ("great barrier reef", ("Great Barrier Reef, Queensland, Australia",)),
    ("torres strait", ("Torres Strait, Queensland, Australia",)),
    ("lord howe", ("Lord Howe Island, New South Wales", "Ball's Pyramid, Lord Howe Island")),
    ("balls pyramid", ("Ball's Pyramid, Lord Howe Island",)),
    ("bonaparte", ("Joseph Bonaparte Gulf, Australia",)),
    ("carnarvon", ("Carnarvon, Western Australia",)),
    ("esperance", ("Esperance, Western Australia",)),
    ("shihniuchiao", ("Hengchun, Taiwan",)),
    ("haikou", ("Haikou, Hengchun, Taiwan",)),
    ("akungtien", ("Gangshan, Kaohsiung, Taiwan",)),
    ("tainan", ("Tainan, Taiwan",)),
)
# What is no place, abbreviations with their words, countries that are added, and where texts name places.
NO_PLACES = ("site", "regional setting", "figure", "table", "map", "plate", "pretorius2016")
NO_PLACE_PATTERNS = (r"(?:boring|core|station|sample)\s*\d+[a-z-]*", r"[a-z]?\d{2,}(?:-\d+)?")
ABBREVIATIONS = ((" SW ", " southwest "), (" SE ", " southeast "), (" NW ", " northwest "), (" NE ", " northeast "), (" WA", " Western Australia"), (" NSW", " New South Wales"), (" GBR", " Great Barrier Reef"))
COUNTRIES = ("Australia", "South Africa", "Malta", "Taiwan")
CUES = (
    r"offshore of ([A-Z][A-Za-z ]+?)(?:,|\.|\s+and|\s+near|\s+on\s+the|$)",
    r"near ([A-Z][A-Za-z ]+?)(?:,|\.|\s+on\s+the|$)",
    r"of ([A-Z][A-Za-z ]+?,\s*(?:South Africa|Australia|Western Australia|Queensland|New South Wales|Tasmania))",
    r"([A-Z][A-Za-z ]+ Bay),\s*(South Africa|Australia)",
)
# Classes, types and address types that are no places, and what a context asks of a place's name.
BLOCKED_CLASSES = ("amenity", "shop", "building", "office", "tourism", "leisure", "highway")
BLOCKED_TYPES = ("kindergarten", "school", "office", "hotel", "restaurant", "residential", "road", "service")
BLOCKED_ADDRESS_TYPES = ("amenity", "road", "building", "office", "tourism", "shop", "house_number")
CONTEXTS = (
    (("south africa",), ("south africa",)),
    (("malta",), ("malta",)),
    (("taiwan",), ("taiwan",)),
    (("bermuda",), ("bermuda",)),
    (("north sea",), ("north sea", "norway", "norge", "united kingdom", "scotland", "denmark")),
    (("australia", "western australia", "south australia", "new south wales", "tasmania", "queensland"), ("australia",)),
)
NOT_MALTA = ("united states", "new york", "saratoga county")
#: Characters of a dictionary that is broadcast at most, of a text that is searched for places and countries, and of one that gives a result its context; spellings of a record.
MOST_CHARS, TEXT_CHARS, CONTEXT_CHARS, MOST_QUERIES = 32 << 20, 2_000, 3_000, 8


def stripped(c: Column) -> Column:
    return F.regexp_replace(collapse(c), r"^[ ,.;:]+|[ ,.;:]+$", "")


def named(df: DataFrame, text: str, entries: Sequence[tuple[str, Sequence[str]]] = KNOWN_PLACES, out: str = "known") -> DataFrame:
    """`df` with `out`: the values of all entries (phrase, values) whose phrase stands in `text`, whatever its case, in the order of the entries.

    One automaton finds all phrases in one pass over a text; it is broadcast, and dictionaries of more than MOST_CHARS are an error. Null texts name nothing.
    """
    if sum(len(p) + sum(map(len, v)) for p, v in entries) > MOST_CHARS:
        raise ValueError("the dictionary is too large to broadcast")
    held = df.sparkSession.sparkContext.broadcast(tuple(entries))
    schema = df.withColumn(out, F.lit(None).cast("array<string>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[str, list[int]] = {}
        for i, (phrase, _) in enumerate(held.value):
            at.setdefault(phrase.lower(), []).append(i)
        automaton = ahocorasick.Automaton()
        for phrase, places in at.items():
            automaton.add_word(phrase, places)
        automaton.make_automaton()
        for batch in batches:
            found = [sorted({i for _, places in automaton.iter((t.as_py() or "").lower()) for i in places}) if at else [] for t in batch[text]]
            values = [[v for i in hits for v in held.value[i][1]] for hits in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.list_(pa.string()))], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def no_place(query: Column) -> Column:
    """Whether a query names no place: words of a page, numbers of samples, bare numbers."""
    low = F.lower(stripped(query))
    shapes = reduce(lambda a, b: a | b, (low.rlike(f"^(?:{p})$") for p in NO_PLACE_PATTERNS))
    return (low == "") | low.isin(*NO_PLACES) | shapes | (F.contains(low, F.lit("submerged palaeolandscape")) & ~F.contains(low, F.lit("malta")))


def cues(text: Column) -> Column:
    """Places that a text names, by pattern and then in order."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in CUES[:3]]
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(CUES[3]), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(CUES[3]), F.lit(2)).alias("b"))
    return F.concat(*(F.transform(f, lambda x: F.trim(x)) for f in found), F.transform(pairs, lambda p: F.concat_ws(", ", F.trim(p["a"]), F.trim(p["b"]))))


def _spellings(query: Column, known: Column) -> Column:
    """A cleaned query's spellings: known places, itself, without shelf and offshore, abbreviations written out, its last parts."""
    without = [stripped(F.regexp_replace(query, rf"(?i)\b{w}\b", "")) for w in ("continental shelf", "shelf", "offshore")]
    expanded = reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), ABBREVIATIONS, F.concat(F.lit(" "), query, F.lit(" ")))
    expanded = collapse(expanded)
    parts = F.filter(F.transform(F.split(query, ","), lambda x: F.trim(x)), lambda x: x != "")
    several = F.size(parts) > 1
    ends = F.array(F.when(several, F.concat_ws(", ", F.slice(parts, -2, 2))), F.when(several, F.element_at(parts, -1)))
    return F.array_compact(F.concat(known, F.array(query, *without, F.when(expanded != query, expanded)), ends))


def query_variants(df: DataFrame, key: str = "id", queries: str = "queries", title: str = "title", text: str = "text", most: int | None = MOST_QUERIES, entries: Sequence[tuple[str, Sequence[str]]] = KNOWN_PLACES) -> DataFrame:
    """(key, variants): the spellings under which each record's places are looked up, in order, each once, `most` at most (a rule of the look-up; None for all).

    First those of its queries, then the places that its title and the beginning of its text name, then the queries with the countries that these name. Null queries, titles and texts count as empty;
    keys are unique.
    """
    told = df.select(key, F.coalesce(queries, F.array().cast("array<string>")).alias("queries"), F.coalesce(title, F.lit("")).alias("title"), F.substring(F.coalesce(text, F.lit("")), 1, TEXT_CHARS).alias("text"))
    each = told.select(key, F.posexplode("queries").alias("place", "query")).withColumn("query", stripped(F.replace(F.coalesce("query", F.lit("")), F.lit("–"), F.lit("-"))))
    each = named(each.filter(~no_place(F.col("query"))), "query", entries)
    own = each.select(key, "place", _spellings(F.col("query"), F.col("known")).alias("v")).groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda x: x["v"])).alias("own"))
    met = told.join(own.withColumnRenamed(key, "_key"), F.col(key) == F.col("_key"), "left")
    context = F.lower(F.concat_ws(" ", "title", "text"))

    def with_country(country: str) -> Column:
        other = F.filter("queries", lambda q: (q != "") & ~F.contains(F.lower(q), F.lit(country.lower())))
        return F.when(F.contains(context, F.lit(country.lower())), F.transform(other, lambda q: F.concat(q, F.lit(f", {country}"))))

    none = F.array().cast("array<string>")
    all_ = F.concat(F.coalesce("own", none), cues(F.col("title")), cues(F.col("text")), *(F.coalesce(with_country(c), none) for c in COUNTRIES))
    tidy = F.filter(F.transform(all_, stripped), lambda x: x != "")
    once = lambda v: F.filter(v, lambda x, i: F.array_position(F.transform(v, lambda y: F.lower(y)), F.lower(x)) == i + 1)
    out = met.select(key, tidy.alias("v")).select(key, once(F.col("v")).alias("variants"))
    return out if most is None else out.withColumn("variants", F.slice("variants", 1, most))


def fits_context(display: Column, context: Column) -> Column:
    """Whether a place's name (lower case) has what the document's context (lower case) asks for."""
    any_of = lambda c, words: reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words))
    rules = [~any_of(context, asked) | any_of(display, given) for asked, given in CONTEXTS]
    return reduce(lambda a, b: a & b, rules) & ~(any_of(context, ("malta",)) & any_of(display, NOT_MALTA))


def best_place(results: DataFrame, key: str = "query") -> DataFrame:
    """Of gazetteer results (query, display_name, class, type, importance, lat, lon) the most important one that is a place, whose name holds the query's first word and fits the context.

    addresstype, title and text (the context) and seq count where there are such columns; equally important results go by seq, else by name.
    """
    col = lambda c: F.coalesce(F.lower(c), F.lit("")) if c in results.columns else F.lit("")
    token = F.get(F.filter(F.split(F.replace(F.lower(key), F.lit(","), F.lit(" ")), r"\s+"), lambda x: F.length(x) > 2), 0)
    ok = ~col("class").isin(*BLOCKED_CLASSES) & ~col("type").isin(*BLOCKED_TYPES) & ~col("addresstype").isin(*BLOCKED_ADDRESS_TYPES)
    context = F.concat_ws(" ", col("title"), F.substring(col("text"), 1, CONTEXT_CHARS))
    good = results.filter(ok & (token.isNull() | F.contains(col("display_name"), token)) & fits_context(col("display_name"), context))
    last = -F.col("seq") if "seq" in results.columns else F.col("display_name")
    return good.groupBy(key).agg(F.max_by(F.struct(*(c for c in results.columns if c != key)), F.struct(F.coalesce("importance", F.lit(0.0)), last)).alias("b")).select(key, "b.*")
