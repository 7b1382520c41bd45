"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, documents, words

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: All sources together take this share of their words, and none more than CAP times its own.
SHARE, CAP = 1.5, 2.0
#: Inclusion probabilities within a source grow as a document's size to this power.
GAMMA = 0.5
SEED = "mix-1"
#: Documents that a bucket of ranks should hold, and the most buckets of a source.
BUCKET_ROWS, MOST_BUCKETS = 128, 65_536
#: Rows of one item that a task draws at once.
SENT_COPIES = 4_096


def ordered_sources(per_source: DataFrame) -> DataFrame:
    """`per_source` with `i`, the place of its source in code-point order, null last.

    Sources are dealt by range; a place is the row's place in its range plus the rows of the ranges before, of
    which there are as many as shuffle partitions. No task sees all sources.
    """
    by = F.col("source").asc_nulls_last()
    spark = per_source.sparkSession
    dealt = checkpointed(per_source.repartitionByRange(by).sortWithinPartitions(by).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = sorted((r["part"], r["n"]) for r in dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts = np.cumsum([0, *(n for _, n in sizes)])[:-1].tolist()
    offsets = spark.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts)], "part long, start long")
    return dealt.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("i", F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "at", "start")


def with_targets(per_source: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """`per_source` (source, source_size, ...) with `target`: `share` of all words dealt by weight, at most `cap` times a source's size, what is above that dealt again by weight.

    The level, words per unit of weight, rises until no further source reaches its cap; each round is one aggregate of one row.
    """
    held = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("i") % len(weights)).cast("int") + 1)
    dealt = checkpointed(ordered_sources(per_source).withColumn("weight", held))
    most = cap * F.col("source_size")
    total, open_weight = dealt.agg(F.sum("source_size"), F.sum("weight")).first()
    words_in_all = share * (total or 0)
    level, capped = words_in_all / (open_weight or 1.0), -1
    while True:
        full = most < level * F.col("weight")
        n, filled, rest = dealt.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, most)), F.lit(0.0)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped or not rest:
            break
        capped, level = n, (words_in_all - filled) / rest
    return dealt.withColumn("target", F.least(most, level * F.col("weight"))).drop("i", "weight")


def uniform(key: Column, size: Column, copy: Column, seed: str) -> Column:
    """A number above 0 and below 1, the same in every run."""
    text = F.concat_ws("|", F.lit(seed), F.coalesce(key.cast("string"), F.lit("")), size.cast("string"), copy.cast("string"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _fill(table: pa.Table) -> pa.Table:
    """`extra` for the rows of one source's last bucket: in rank order each that still fits, then one more if that comes nearer."""
    table = table.sort_by([("rank", "ascending"), ("tie", "ascending"), ("copy", "ascending")])
    gap = table["rest"][0].as_py() - table["before"][0].as_py()
    sizes = table["size"].to_numpy()
    extra = np.zeros(len(sizes), dtype=np.int32)
    for k, size in enumerate(sizes):
        if 0 < size <= gap:
            gap -= size
            extra[k] = 1
    left = np.flatnonzero((extra == 0) & (sizes > 0))
    if len(left) and (best := left[np.argmin(sizes[left])]) is not None and sizes[best] < 2 * gap:
        extra[best] = 1
    return table.drop_columns(["extra"]).append_column("extra", pa.array(extra)).select(table.schema.names)


def levels(items: DataFrame, aims: DataFrame, gamma: float) -> DataFrame:
    """(of, level): for each source the number that makes inclusion probabilities min(1, level * size ** gamma) take `rest` words on average.

    From the greatest size down sizes become certain until the level leaves the next one below 1. The running sums are over a source's
    distinct sizes, of which there are no more than the words of its longest document.
    """
    by_size = items.filter("size > 0").groupBy("source", "size").agg(F.sum(F.col("size") * F.col("rows")).alias("w"), F.sum(F.col("rows") * F.pow("size", F.lit(1 + gamma))).alias("s"))
    upto = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = by_size.select("source", "size", F.sum("w").over(upto).alias("w"), F.sum("s").over(upto).alias("s"))
    at = run.join(aims.select("of", "rest", "source_size"), F.col("source").eqNullSafe(F.col("of")))
    at = at.withColumn("level", (F.col("rest") - (F.col("source_size") - F.col("w"))) / F.col("s"))
    return at.filter(F.col("level") * F.pow("size", F.lit(gamma)) < 1).groupBy("of").agg(F.max_by("level", "size").alias("level"))


def numbered_within(df: DataFrame, by: Sequence[str], out: str) -> DataFrame:
    """`df` with `out`, 0, 1, 2 ... within each group of `by` (nulls are a group), in the order in which the rows lie.

    A group is numbered part by part: only the numbers of its rows in each part are put in order together, so that a large group is many tasks' work.
    """
    placed = checkpointed(df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    upto = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*by, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    counts = counts.select(*(F.col(c).alias(f"_of{i}") for i, c in enumerate(by)), F.col("_part").alias("_of_part"), "_before")
    on = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_of{i}")) for i, c in enumerate(by)), F.col("_part") == F.col("_of_part"))
    within = F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_at")) - 1
    return placed.withColumn("_within", within).join(counts, on).withColumn(out, F.col("_before") + F.col("_within")).select(*df.columns, out)


def singly(items: DataFrame, sent: int = SENT_COPIES) -> DataFrame:
    """A row for each row of an item, numbered by `copy`: items of many rows are first dealt in parts of `sent`."""
    one = items.filter("rows = 1").withColumn("copy", F.lit(0).cast("long"))
    many = items.filter("rows > 1").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / sent))))
    many = many.repartition(F.col("key"), F.col("_part")).withColumn("copy", F.explode(F.sequence(F.col("_part") * sent, F.least(F.col("rows"), (F.col("_part") + 1) * sent) - 1)))
    return one.unionByName(many.drop("_part"))


def copies(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, gamma: float = GAMMA, seed: str = SEED) -> DataFrame:
    """For (key, source, size) rows the items key, source, size, rows, source_size, target, inclusion, whole, extra.

    Rows that agree in all three are one item: each of its `rows` rows is drawn on its own, and as nothing tells them apart here, `extra` says how many of them are drawn.
    A source that is to take f of its words takes each document `whole` = floor(f) times for certain and draws the rest with inclusion probabilities p = min(1, level * size ** gamma), solved so that
    the drawn words are the rest on average (`inclusion`). Documents are ranked by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)) (Pareto order
    sampling), and are taken in rank order until the words of the rest are reached: a sample of fixed size in words. Equal ranks go by key. The document that would
    pass the rest stays out and those after it in order that still fit come in, then one more if that comes nearer, so a source ends within the size of a document of its target. The place where the rest is reached
    comes from sums over buckets of ranks; only the documents of one bucket of a source are looked at one by one. Documents without words are never drawn.
    """
    items = checkpointed(sized.groupBy("key", "source", "size").agg(F.count("*").alias("rows")))
    per_source = items.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.coalesce(F.sum(F.when(F.col("size") > 0, F.col("rows"))), F.lit(0)).alias("n"))
    aims = with_targets(per_source, weights, share, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    buckets = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1.0), F.least(F.lit(float(MOST_BUCKETS)), F.col("n") / BUCKET_ROWS)))))
    aims = aims.withColumn("whole", F.floor(ratio)).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))).withColumn("buckets", buckets)
    aims = checkpointed(aims.withColumnRenamed("source", "of"))
    level = levels(items, aims, gamma).withColumnRenamed("of", "_of")
    aims = checkpointed(aims.join(level, F.col("of").eqNullSafe(F.col("_of")), "left").drop("_of"))
    same = F.col("source").eqNullSafe(F.col("of"))

    u = uniform(F.col("key"), F.col("size"), F.col("copy"), seed)
    p = F.least(F.lit(1.0), F.coalesce("level", F.lit(0.0)) * F.pow("size", F.lit(gamma)))
    q = (u / (1 - u)) * ((1 - F.col("inclusion")) / F.col("inclusion"))
    ranked = singly(items).join(aims, same).withColumn("inclusion", p).withColumn("rank", F.when((F.col("size") > 0) & (F.col("inclusion") > 0), q / (1 + q)).otherwise(F.lit(1.0)))
    ranked = ranked.withColumn("bucket", F.floor(F.col("rank") * F.col("buckets")))
    ranked = checkpointed(ranked.select("key", "source", "size", "rows", "copy", "source_size", "target", "inclusion", "whole", "rest", "rank", "bucket"))

    sums = ranked.groupBy("source", "rest", "bucket").agg(F.sum("size").alias("w"))
    run = sums.selectExpr("*", "sum(w) OVER (PARTITION BY source, rest ORDER BY bucket) AS upto")
    last = run.groupBy(F.col("source").alias("of")).agg(F.min(F.when(F.col("upto") > F.col("rest"), F.col("bucket"))).alias("last"), F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))), F.lit(0)).alias("before"))
    placed = ranked.join(last, same).drop("of").withColumn("tie", F.coalesce(F.col("key").cast("string"), F.lit("")))
    placed = placed.withColumn("extra", F.when((F.col("size") > 0) & (F.col("last").isNull() | (F.col("bucket") < F.col("last"))), 1).otherwise(0))
    at_last = F.coalesce(F.col("bucket") == F.col("last"), F.lit(False))
    filled = placed.filter(at_last).groupBy("source").applyInArrow(_fill, placed.schema)
    drawn = placed.filter(~at_last).unionByName(filled).select("key", "source", "size", "rows", "source_size", "target", "inclusion", F.col("whole").cast("long").alias("whole"), F.col("extra").cast("long").alias("extra"))
    alike = [c for c in drawn.columns if c != "extra"]
    return drawn.filter("rows = 1").unionByName(drawn.filter("rows > 1").groupBy(*alike).agg(F.sum("extra").alias("extra")))


def taken_rows(df: DataFrame, drawn: DataFrame, key: str, source: str, size: str) -> DataFrame:
    """`df`, each row with the columns of its item and `_times`, how often it is taken: of an item's rows, `extra` are taken once more than the others."""
    on = F.col(key).eqNullSafe(F.col("_key")) & F.col(source).eqNullSafe(F.col("_source")) & (F.col(size) == F.col("_size"))
    drawn = checkpointed(drawn.withColumnsRenamed({c: f"_{c}" for c in drawn.columns}))
    many = drawn.filter("_rows > 1")
    alone = df.join(drawn.filter("_rows = 1"), on).withColumn("_times", F.col("_whole") + F.col("_extra"))
    if many.isEmpty():
        return alone
    number = F.when(F.col("_number") < F.col("_extra"), 1).otherwise(0)
    return alone.unionByName(numbered_within(df.join(many, on), ["_key", "_source", "_size"], "_number").withColumn("_times", F.col("_whole") + number).drop("_number"))


def sizes(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("long").alias("size"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """A row for each row of `df`: key, size, source_size, target, taken.

    Null and empty texts have size 0 and take 0. Very long texts count as they are; one longer than its source's rest may keep that source's words below the target.
    Rows of a null source are one source, last in the order. Rows that share key, source and size (repeated rows, rows without a key) are drawn one by one; which of them are taken
    is open, as they give equal rows here. Equal ranks go by key. An empty table gives an empty result. Other columns are not read. Reruns give the same rows.
    """
    sized = checkpointed(sizes(df, key, text, source))
    drawn = taken_rows(sized, copies(sized, **options), "key", "source", "size")
    return drawn.select(F.col("key").alias(key), "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("size") * F.col("_times")).alias("taken"))


def repeat_rows(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of `df`, each as often as it is taken.

    Documents without words are taken as often as their source's whole copies say, not at all where no text of the source has a word. Rows that share a key are told apart
    by a hash of their text; those that share both and the source are drawn one by one, and reruns over rows in the same order take the same ones. Columns of any name stay as they are.
    """
    packed = df.select(F.struct(*df.columns).alias("row"), F.concat_ws("|", F.col(key).cast("string"), F.xxhash64(F.coalesce(F.col(text), F.lit("")))).alias("key"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("long").alias("size"))
    drawn = taken_rows(packed, copies(packed.select("key", "source", "size"), **options).filter("whole + extra > 0"), "key", "source", "size")
    return drawn.filter("_times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's target and the words that the mix takes of it."""
    return mix(documents(spark, sf_dir)).withColumn("target", F.round("target", 6))


SQL = r"""
WITH RECURSIVE docs AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), items AS (
    SELECT doc_id, source, size, row_number() OVER (PARTITION BY doc_id, source, size) - 1 AS j FROM docs
), src AS (
    SELECT source, CAST(sum(size) AS DOUBLE) AS s, sum(CASE WHEN size > 0 THEN 1 ELSE 0 END) AS n FROM items GROUP BY source
), weighed AS (
    SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w FROM src
), filled AS (
    SELECT *, 2.0 * s AS cap, row_number() OVER o AS j, 1.5 * sum(s) OVER () AS total,
        coalesce(sum(2.0 * s) OVER (ORDER BY 2.0 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken_before,
        sum(w) OVER (ORDER BY 2.0 * s / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
    FROM weighed WINDOW o AS (ORDER BY 2.0 * s / w, source NULLS LAST)
), level AS (
    SELECT arg_min((total - taken_before) / open_weight, j) AS level FROM filled WHERE (total - taken_before) / open_weight * w <= cap
), aims AS (
    SELECT source, s, n, least(cap, level * w) AS target FROM filled, level
), parts AS (
    SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS whole, pow(2, ceil(log2(greatest(1.0::DOUBLE, least(65536.0::DOUBLE, n / 128.0::DOUBLE))))) AS buckets FROM aims
), by_size AS (
    SELECT source, size, sum(size) AS w, sum(pow(size, 1.5)) AS s15 FROM items WHERE size > 0 GROUP BY source, size
), upto AS (
    SELECT source, size, sum(w) OVER o AS w, sum(s15) OVER o AS s15 FROM by_size WINDOW o AS (PARTITION BY source ORDER BY size ROWS UNBOUNDED PRECEDING)
), trials AS (
    SELECT u.source, size, (greatest(0, p.target - p.whole * p.s) - (p.s - w)) / s15 AS c FROM upto u JOIN parts p ON u.source IS NOT DISTINCT FROM p.source
), levels AS (
    SELECT source, arg_max(c, size) AS c FROM trials WHERE c * pow(size, 0.5) < 1 GROUP BY source
), draws AS (
    SELECT i.*, p.s, p.target, p.whole, p.buckets, greatest(0, p.target - p.whole * p.s) AS rest, i.size AS words,
        (CAST(('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(size AS VARCHAR) || '|' || CAST(j AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE AS u,
        least(1.0::DOUBLE, coalesce(l.c, 0) * pow(size, 0.5)) AS p
    FROM items i JOIN parts p ON i.source IS NOT DISTINCT FROM p.source LEFT JOIN levels l ON i.source IS NOT DISTINCT FROM l.source
), odds AS (
    SELECT *, CASE WHEN size > 0 AND p > 0 THEN (u / (1 - u)) * ((1 - p) / p) END AS q FROM draws
), ranked AS (
    SELECT *, CASE WHEN q IS NOT NULL THEN q / (1 + q) ELSE 1.0 END AS rnk FROM odds
), bucketed AS (
    SELECT *, floor(rnk * buckets) AS bucket FROM ranked
), sums AS (
    SELECT source, rest, bucket, sum(sum(words)) OVER (PARTITION BY source, rest ORDER BY bucket) AS upto FROM bucketed GROUP BY source, rest, bucket
), edge AS (
    SELECT source, min(CASE WHEN upto > rest THEN bucket END) AS last, coalesce(max(CASE WHEN upto <= rest THEN upto END), 0) AS before FROM sums GROUP BY source
), placed AS (
    SELECT b.*, e.last, e.before, row_number() OVER (PARTITION BY b.source, b.bucket ORDER BY b.rnk, coalesce(CAST(b.doc_id AS VARCHAR), ''), b.j) AS k FROM bucketed b JOIN edge e ON b.source IS NOT DISTINCT FROM e.source
), fill AS (
    SELECT source, k, words, rest - before - CASE WHEN words > 0 AND words <= rest - before THEN words ELSE 0 END AS gap, words > 0 AND words <= rest - before AS extra FROM placed WHERE bucket = last AND k = 1
    UNION ALL
    SELECT p.source, p.k, p.words, f.gap - CASE WHEN p.words > 0 AND p.words <= f.gap THEN p.words ELSE 0 END, p.words > 0 AND p.words <= f.gap
    FROM fill f JOIN placed p ON f.source IS NOT DISTINCT FROM p.source AND p.bucket = p.last AND p.k = f.k + 1
), ends AS (
    SELECT source, min(gap) AS gap FROM fill GROUP BY source
), nearer AS (
    SELECT f.source, arg_min(k, words * 1000000000 + k) AS k FROM fill f JOIN ends e ON f.source IS NOT DISTINCT FROM e.source WHERE NOT extra AND words > 0 GROUP BY f.source, e.gap HAVING min(words) < 2 * e.gap
), decided AS (
    SELECT p.*, CASE WHEN p.size = 0 THEN 0 WHEN p.last IS NULL OR p.bucket < p.last THEN 1 WHEN p.bucket > p.last THEN 0 WHEN f.extra OR n.k IS NOT NULL THEN 1 ELSE 0 END AS extra
    FROM placed p LEFT JOIN fill f ON p.source IS NOT DISTINCT FROM f.source AND p.bucket = p.last AND p.k = f.k LEFT JOIN nearer n ON p.source IS NOT DISTINCT FROM n.source AND p.bucket = p.last AND p.k = n.k
)
SELECT doc_id, size, CAST(s AS BIGINT) AS source_size, round(target, 6) AS target, CAST(size * (whole + extra) AS BIGINT) AS taken FROM decided"""
