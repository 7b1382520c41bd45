"""Text functions as Spark columns: depths, ages, coordinates, keywords, quality, titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of the evidence vocabulary.
DECIMAL_PAIR = r"\b(-?\d{1,2}\.\d{2,6})\s*,\s*(-?\d{1,3}\.\d{2,6})\b"
LATITUDE = r"(?i)(\d{1,2})\D+(\d{1,2})\D+(North|South)\s+Latitude"
LONGITUDE = r"(?is)(\d{1,3})\D+(\d{1,2})\D+(West|East).{0,120}?Longitude"
METRES = r"(?i)(?:water depth|depth(?: of| at)?|located at a water depth of|minimum depth of)\s+(?:of\s+)?(\d+(?:\.\d+)?)\s*m"
FATHOMS = r"(?i)(\d{1,3}(?:,\d{3})*(?:\.\d+)?)\s*fathoms"
GUYOT = r"(?i)guyots?|table\s*mounts?|flat[- ]topped\s+seamounts?|drowned\s+(?:carbonate\s+)?platforms?|drowned\s+islands?"
GUYOT_DEPTH = r"(?i)(?:summit|plateau|platform|top|break)\s+depths?(?:\s*\([^)]*\))?\s*(?:of|averaging|about|around|at)?\s*(?:~|approximately|approx\.)?\s*(\d+(?:,\d{3})*(?:\.\d+)?)\s*m"
AGE_BP = r"(?i)(\d{1,2},\d{3}|\d{3,5})\s*(?:yrs\s*B\.P\.|years\s*B\.P\.|B\.P\.)"
NEAR = r"near\s+([A-Z][A-Za-z\-]+(?:\s+[A-Z][A-Za-z\-]+)*)"
OFF = r"off\s+([A-Z][A-Za-z\-]+(?:\s+[A-Z][A-Za-z\-]+)*)"


def once(value: Column, use) -> Column:
    """`use(value)`, with `value` worked out once however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def where_named(low: Column, words, found: Column) -> Column:
    """`found` where the lower-case text `low` holds one of the words without which it can't be there, else null: a search for a word costs far less than a pattern."""
    test = F.contains(low, F.lit(words[0]))
    for w in words[1:]:
        test = test | F.contains(low, F.lit(w))
    return F.when(test, found)


def number(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("double")


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """Null where the pattern is not found."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def depth_m(text: Column) -> Column:
    """Metres: a depth in metres, else a summit depth where guyots are named, else fathoms."""
    low = F.lower(text)
    guyot = where_named(low, ["depth"], F.when(text.rlike(GUYOT), number(first_group(text, GUYOT_DEPTH))))
    return F.coalesce(where_named(low, ["depth"], number(first_group(text, METRES))), guyot, where_named(low, ["fathoms"], F.bround(number(first_group(text, FATHOMS)) * 1.8288, 1)))


def beginning(text: Column, within: int | None) -> Column:
    """The first `within` characters, or the whole text."""
    return text if within is None else F.substring(text, 1, within)


def ages_ka(text: Column, most: int = 5, within: int | None = 30_000) -> Column:
    """The first ages BP, at most `most`, in thousands of years."""
    found = F.regexp_extract_all(beginning(text, within), F.lit(AGE_BP), F.lit(1))
    return F.slice(F.transform(found, lambda x: F.bround(number(x) / 1000, 3)), 1, most)


def coordinates(text: Column, within: int | None = 20_000) -> Column:
    """struct(lat, lon, source): degrees and minutes named as latitude and longitude, else the first pair of decimals in range that stands within so many characters (None: anywhere)."""
    def dms(pattern: str) -> Column:
        value = number(first_group(text, pattern, 1)) + number(first_group(text, pattern, 2)) / 60
        return value * F.when(F.lower(F.substring(F.regexp_extract(text, pattern, 3), 1, 1)).isin("s", "w"), -1).otherwise(1)

    degrees = where_named(F.lower(text), ["latitude"], F.struct(dms(LATITUDE).alias("lat"), dms(LONGITUDE).alias("lon"), F.lit("reported_dms").alias("source")))
    pairs = once(beginning(text, within), lambda head: F.arrays_zip(F.regexp_extract_all(head, F.lit(DECIMAL_PAIR), F.lit(1)).alias("a"), F.regexp_extract_all(head, F.lit(DECIMAL_PAIR), F.lit(2)).alias("b")))
    pairs = F.transform(pairs, lambda p: F.struct(p["a"].cast("double").alias("lat"), p["b"].cast("double").alias("lon"), F.lit("reported_decimal").alias("source")))
    good = F.filter(pairs, lambda p: p["lat"].between(-90, 90) & p["lon"].between(-180, 180))
    return once(degrees, lambda d: F.coalesce(F.when(d["lat"].between(-90, 90) & d["lon"].between(-180, 180), d), F.get(good, 0)))


def places(text: Column, most: int = 5) -> Column:
    """Places named after `near` and `off`, each once."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (NEAR, OFF)))
    return F.slice(F.filter(F.array_distinct(F.transform(found, collapse)), lambda x: x != ""), 1, most)


# The weights and limits of a text's quality, and the shape of a DOI.
LETTER_WEIGHT, MOST_SPACE, SPACE_WEIGHT, MOST_ODD, ODD_WEIGHT, LINE_WEIGHT = 0.45, 0.25, 1.2, 0.2, 0.25, 0.1
LINE_LENGTHS, OTHER_LINES, LINES = (25, 180), 0.6, 200
DOI = r"(10\.\d{4,9}/[^\s\"<>]+)"


def quality(text: Column) -> Column:
    """From 0 to 1: shares of letters, white space and characters that are neither, and the mean length of the first 200 lines."""
    total = F.nullif(F.length(text), F.lit(0)).cast("double")
    share = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / total
    lines = F.slice(F.filter(F.transform(F.split(text, r"\R"), lambda x: F.trim(x)), lambda x: x != ""), 1, LINES)
    mean = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x)) / F.greatest(F.size(lines), F.lit(1))
    line_score = F.when(mean.between(*LINE_LENGTHS), 1.0).otherwise(OTHER_LINES)
    score = share(r"\p{L}") * LETTER_WEIGHT + F.least(share(r"\s"), F.lit(MOST_SPACE)) * SPACE_WEIGHT + (1 - F.least(share("[^\\x00-\\x7e°–—©]"), F.lit(MOST_ODD))) * ODD_WEIGHT + line_score * LINE_WEIGHT
    return F.when(total > 0, F.bround(F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))), 3)).otherwise(0.0)


def keywords(text: Column, words: list[str]) -> Column:
    return once(F.lower(text), lambda low: F.array_compact(F.array(*(F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in words))))


def in_context(text: Column, phrase: str, before: int = 150, after: int = 450, most: int = 800) -> Column:
    """The text around the first place where the phrase stands, white space collapsed; null where it doesn't."""
    at = F.instr(F.lower(text), phrase.lower())
    cut = F.substr(text, F.greatest(at - before, F.lit(1)), F.lit(before + after) + F.least(at - before - 1, F.lit(0)))
    return F.when(at > 0, F.substring(collapse(cut), 1, most))


def title(text: Column) -> Column:
    """The first line that is not blank."""
    return F.get(F.filter(F.transform(F.split(text, r"\R"), lambda x: F.trim(x)), lambda x: x != ""), 0)


# Words of titles, a line that looks like one, and one title that is known by its words.
TITLE_WORDS = r"(?i)submerged beach|ancient beach|submerged forest|marine terrace|raised beach|guyots?|table\s*mounts?|flat[- ]topped\s+seamounts?|drowned\s+(?:carbonate\s+)?platforms?"
TITLE_LINE = r"(?m)^([A-Z][A-Za-z0-9.,;:'\"()\-–— ]{20,})$"
KNOWN_TITLE = r"(?is)(Late Pleistocene and Holocene whale remains.*?trace element concentrations)"


def clean_title(title: Column, text: Column, stem: Column) -> Column:
    """The title, unless it is blank, an identifier, the file's name or terms of use; then the first that there is of: a known title, one of the first 20 lines with a title's words and over 20 characters,
    the text around such words, a line that looks like a title, the file's name."""
    raw = F.trim(F.coalesce(title, F.lit("")))
    none = (raw == "") | raw.startswith("PII:") | (raw == stem) | (F.lower(raw) == "terms of use")
    lines = F.slice(F.filter(F.transform(F.split(text, r"\R"), collapse), lambda x: x != ""), 1, 20)
    line = F.get(F.filter(lines, lambda x: x.rlike(TITLE_WORDS) & (F.length(x) > 20)), 0)
    at = F.regexp_instr(text, F.lit(f"(?s){TITLE_WORDS}"))
    word = F.regexp_substr(text, F.lit(TITLE_WORDS))
    start = F.greatest(at - 10, F.lit(1))
    around = F.when(at > 0, F.substring(collapse(F.substr(text, start, at - start + F.length(word) + 110)), 1, 160))
    known = F.substring(collapse(first_group(text, KNOWN_TITLE)), 1, 180)
    ladder = F.coalesce(known, F.substring(line, 1, 160), around, F.substring(collapse(first_group(text, TITLE_LINE)), 1, 160), stem)
    return F.when(none, ladder).otherwise(collapse(raw))


def html_text(html: Column) -> Column:
    """Tags and what stands in script and style elements removed, white space collapsed."""
    return collapse(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " "))


def table_rows(html: Column) -> Column:
    """Rows of cells of all tables in a page, white space collapsed, rows without any text left out."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), F.lit(1)), lambda c: collapse(F.regexp_replace(c, r"(?s)<[^>]*>", " "))))
    return F.filter(cells, lambda r: F.exists(r, lambda c: c != ""))


def dois(text: Column) -> Column:
    """DOIs, lower-cased, without closing punctuation, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(DOI), F.lit(1)), lambda d: F.lower(F.regexp_replace(d, r"[.,;:)\]]+$", ""))))


def key_variants(value: Column) -> Column:
    """Forms under which a key is looked up: letters and digits lower-cased; numbers also without leading zeros and with two digits."""
    plain = F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]", "")
    n = F.when(plain.rlike(r"^\d+$"), plain.try_cast("long"))
    return F.array_distinct(F.array_compact(F.array(F.nullif(plain, F.lit("")), n.cast("string"), F.when(n.isNotNull(), F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), F.lit(2)), F.lit("0"))))))
