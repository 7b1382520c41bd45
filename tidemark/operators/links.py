"""Links from documents to their publications: DOIs read out of broken lines, scored, and filled into records."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How identifiers look, where references begin, what stands near a document's own DOI, and the scores.
DOI_PREFIX = re.compile(r"10\.\d{4,9}\s*/\s*", re.IGNORECASE)
DOI = re.compile(r"10\.\d{4,9}/[-._;()/:+A-Z0-9]+", re.IGNORECASE)
PII = r"(?i)\bPII:\s*(S?\d{4}-\d{4}\(\d{2}\)\d{5}-[A-Z0-9])\b"
REFERENCES = ("# references", "\nreferences", "\nbibliography", "\nliterature cited")
OWN_CONTEXT = ("this article", "published online", "citation", "cite this article", "supplementary data associated with this article")
BY_POSITION = ((5_000, 90), (20_000, 70), (40_000, 45))
LATER, NEAR_WORD, OWN, IN_REFERENCES, EACH_FIND, MOST_FINDS = 5, 20, 50, -80, 5, 5
AROUND = 180
#: Scores that a document's parts begin with.
BASE = {"pdf_metadata": 115, "title": 80, "metadata": 90, "text": 0, "artifact": 20}
PII_SCORE, PII_PREFIX = 105, "10.1016/"
REPAIRS = (("‐", "-"), ("‑", "-"), ("‒", "-"), ("–", "-"), ("—", "-"), ("\\_", "_"), ("doi. org", "doi.org"))

_PART = r"[\w\-.;()/:+]"
#: An identifier, with the white space that line breaks left in it: after /, - or _ always, after a full stop where the next word has a digit, a stop or a slash.
READ = re.compile(rf"(?:{_PART}(?:(?<=[/\-_])\s+(?={_PART})|(?<=\.)\s+(?={_PART}*?[./\d]))?)*")


def repaired(text: str) -> str:
    for wrong, right in REPAIRS:
        text = text.replace(wrong, right)
    return text


def valid(doi: str) -> bool:
    if not DOI.fullmatch(doi):
        return False
    suffix = doi.split("/", 1)[1].lower()
    return len(suffix) >= 4 and suffix != "text" and not suffix.endswith(("/j", "/text"))


def found_dois(text: str | None, base: int) -> list[tuple[str, int, int]]:
    """(doi, score, position) of every DOI of a text, in order."""
    text = repaired(text or "")
    low, out = text.lower(), []
    references = min((at for w in REFERENCES if (at := low.find(w)) >= 0), default=len(low))
    for m in DOI_PREFIX.finditer(text):
        doi = re.sub(r"\s+", "", READ.match(text, m.start())[0]).rstrip(".,;:)]}")
        if not valid(doi):
            continue
        context = low[max(0, m.start() - AROUND) : m.end() + AROUND]
        own = any(w in context for w in OWN_CONTEXT)
        score = base + next((s for most, s in BY_POSITION if m.start() < most), LATER) + NEAR_WORD * ("doi" in context) + OWN * own
        out.append((doi, score + (IN_REFERENCES if m.start() > references and not own else 0), m.start()))
    return out


def _found(text: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([[{"doi": d, "score": s, "position": p} for d, s, p in found_dois(t, int(b))] for t, b in zip(text, base)])


def source_links(parts: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, doi, url, source, score, finds): the best DOI of each document, from its parts (key, seq, source, text) in the order of seq.

    `source` is one of BASE. A DOI's score is its best find's, and 5 for each find up to five; of equal ones the one that stands first in its part, then the one of the first part. Publisher item
    identifiers in metadata of PDFs count as DOIs. Documents without a DOI have no row; null texts have none.
    """
    base = F.coalesce(*(F.when(F.col("source") == s, F.lit(b)) for s, b in BASE.items()), F.lit(0))
    dois = F.pandas_udf(_found, "array<struct<doi string, score int, position int>>")
    read = parts.select(key, "seq", "source", F.posexplode(dois("text", base)).alias("place", "c")).select(key, "seq", "source", "place", "c.*")
    pii = parts.filter("source = 'pdf_metadata'").select(key, "seq", F.posexplode(F.regexp_extract_all("text", F.lit(PII), F.lit(1))).alias("place", "p"))
    pii = pii.select(key, "seq", F.lit("pdf_metadata_pii").alias("source"), (F.col("place") + (1 << 30)).alias("place"), F.concat(F.lit(PII_PREFIX), F.upper("p")).alias("doi"), F.lit(PII_SCORE).alias("score"), F.lit(0).alias("position"))
    order = F.struct("score", -F.col("position"), -F.col("seq"), -F.col("place"))
    each = read.unionByName(pii).groupBy(key, "doi").agg(F.max(order).alias("best"), F.max_by("source", order).alias("source"), F.count("*").alias("finds"))
    each = each.withColumn("score", F.col("best.score") + EACH_FIND * F.least("finds", F.lit(MOST_FINDS)))
    rest = [F.col("best").getField(f"col{i}") for i in (2, 3, 4)]
    top = each.groupBy(key).agg(F.max_by(F.struct("doi", F.concat(F.lit("https://doi.org/"), F.col("doi")).alias("url"), "source", "score", "finds"), F.struct("score", *rest)).alias("l"))
    return top.select(key, "l.*")


def with_source_links(records: DataFrame, links: DataFrame, key: str = "source_id", column: str = "doi_or_url") -> DataFrame:
    """Records whose `column` is blank get the URL of their source, where it has one."""
    if column not in records.columns:
        records = records.withColumn(column, F.lit(None).cast("string"))
    told = links.select(F.col(key).alias("_key"), F.col("url").alias("_url"))
    blank = F.trim(F.coalesce(F.col(column), F.lit(""))) == ""
    return records.join(told, F.col(key) == F.col("_key"), "left").withColumn(column, F.when(blank, F.coalesce("_url", column)).otherwise(F.col(column))).drop("_key", "_url")
