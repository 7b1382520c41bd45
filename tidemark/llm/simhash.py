"""Near-duplicate documents by SimHash fingerprints and ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, documents, fresh, release
from tidemark.llm.graph import components

SHINGLE = 3
SEED = 42
#: Fingerprints link at this many differing bits or fewer.
RADIUS = 2
#: Shingles whose bits are counted at once, and fingerprints whose variants a task sends.
BLOCK, SENT_ROWS = 1 << 16, 4_096


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text: A-Z lower-cased, words between white space (bytes 9 to 13 and 32), shingles with
    repeats; a bit is 1 if set in over half the shingles' XXH64. Fewer words than a shingle are one shingle; no word gives 0."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    hashed = xxhash.xxh64_intdigest
    joined = b" ".join
    n = len(words) - shingle + 1
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : min(at + BLOCK, n) + shingle - 1]
        h = np.fromiter((hashed(joined(x), seed) for x in zip(*(part[k:] for k in range(shingle)))), dtype=np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(key, fp), fp the fingerprint as a signed long. A null text has no word."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            out = [fingerprint((t.as_py() or "").encode(), shingle, seed) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(np.array(out, dtype=np.uint64).view(np.int64))], names=["key", "fp"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fp long")


def ball(fp, radius: int):
    """All fingerprints within `radius` (0, 1 or 2) bits of `fp`, itself first, as an array column."""
    masks = [0]
    for k in range(radius):
        masks += sorted({m ^ (1 << b) for m in masks for b in range(64)} - set(masks))
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.transform(F.array(*(F.lit(m).cast("long") for m in signed)), lambda m: fp.bitwiseXOR(m))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of fingerprints that join all that differ in `radius` bits or fewer (an even number).

    Meet in the middle: two such fingerprints share a variant within half the radius of either. Every fingerprint
    goes to all its variants; a variant gets at most as many fingerprints as its own ball has points (65 for half
    radius 1), and any two that meet there are within the radius. Each is linked to the least at the variant: the same
    components as from all pairs. Pairs are made distinct and their distance is checked.
    """
    if radius % 2 or not 0 <= radius <= 4:
        raise ValueError("the radius must be 0, 2 or 4: both fingerprints reach half of it")
    half = radius // 2
    even = distinct.select("fp").repartition(max(1, -(-distinct.count() // SENT_ROWS)), "fp")  # few bytes, many variants: dealt by number of rows
    sent = even.select("fp", F.explode(ball(F.col("fp"), half)).alias("variant"))
    met = sent.groupBy("variant").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("at")).filter(F.size("at") > 1)
    pairs = met.select("a", F.explode("at").alias("b")).filter("a != b").distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """A row for each row of `df`: key, fingerprint (16 hexadecimal digits), component_id.

    component_id is the least key of the documents whose fingerprints can be reached by links, the document's own
    included; null keys don't count for it. Null and empty texts have fingerprint zero and link like any other; very long texts are read whole, their shingles counted in blocks.
    Equal texts meet in one fingerprint before anything is compared; repeated rows stay. An empty table gives
    an empty result. Other columns are not read.
    """
    marked = checkpointed(fingerprints(df, key, text, shingle, seed))
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("key").alias("least")))
    grouped = rooted(distinct, radius)
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    component = grouped.join(least, "root").select("fp", "component_id")
    return marked.join(component, "fp").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def rooted(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """`distinct` fingerprints with the root of their component."""
    roots = checkpointed(components(checkpointed(links(distinct, radius))))  # components reads its edges twice
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def first_rows(df: DataFrame, grouped: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `df` whose key and text are the first of their component; `grouped` has (key, id, root) for all, id the xxhash64 of the text, a null one as an empty one.

    First is the least key, then the least id; null keys come last. Rows with the same key and the same text stay or go together;
    of those without a key one stays. A row goes by its key and text, so neither takes another along that shares only one of them.
    """
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "id")).alias("first"))
    is_first = F.col("key").eqNullSafe(F.col("first.key")) & (F.col("id") == F.col("first.id"))
    text_id, gone_key, gone_id, row = fresh(df, "text_id", "gone_key", "gone_id", "row")
    gone = checkpointed(grouped.join(first, "root").filter(~is_first).select(F.col("key").alias(gone_key), F.col("id").alias(gone_id)).distinct())
    told = df.withColumn(text_id, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    named = told.filter(F.col(key).isNotNull()).join(gone.filter(F.col(gone_key).isNotNull()), (F.col(key) == F.col(gone_key)) & (F.col(text_id) == F.col(gone_id)), "left_anti")
    bare = told.filter(F.col(key).isNull()).join(gone.filter(F.col(gone_key).isNull()), F.col(text_id) == F.col(gone_id), "left_anti")
    bare = bare.groupBy(text_id).agg(F.min_by(F.struct(*df.columns), F.xxhash64(*df.columns)).alias(row)).select(f"{row}.*")
    return named.drop(text_id).unionByName(bare)


def first_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """The rows of `df` whose key and text are the first of their component, as `first_rows` says."""
    told = df.select(F.struct(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("id")).alias("row"), F.col(text).alias("text"))
    marked = checkpointed(fingerprints(told, "row", "text", shingle, seed))
    roots = rooted(checkpointed(marked.select("fp").distinct()), radius)
    return first_rows(df, marked.join(roots, "fp").select("key.key", "key.id", "root"), key, text)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    return near_duplicates(documents(spark, sf_dir))
