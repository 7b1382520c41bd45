"""Observations that are taken in order, each only if no earlier one that was taken is probably the same."""

from __future__ import annotations

import gc
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.placing import MOST_BROADCAST, kept, new_folder

#: Numbers are compared in millionths of their tolerance.
UNIT = 1_000_000
#: How near elevations (m) and ages (ka) of one observation are.
ELEVATION_M, AGE_KA = 1.0, 0.25
#: Width, in tolerances, of the ranges in which neighbouring values of one key are compared.
RANGE = 64
#: Tables of taken rows that are kept apart before they are put together.
MOST_ROUNDS = 32
#: Candidates that go through rounds together, about, and how many make it worth to sweep up after a round.
TOGETHER, MANY = 1 << 22, 100_000


def plain(c: Column) -> Column:
    """Lower case, letters and digits only; null as empty."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")


def facets(columns: Sequence[str], elevation_m: float = ELEVATION_M, age_ka: float = AGE_KA) -> Column:
    """An array of (key, v): two observations are probably the same if they share a key and their v differ by UNIT at most. Keys are two 64-bit hashes of what they are made of, far shorter than the texts.

    Equal ids; or the same source and indicator, and the same sample, or the same site or location and near elevations, near ages, or neither of both in either. Numbers are taken to a millionth of the tolerance;
    those that are not finite count as absent. Ids and location names are looked at if they are among `columns`.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    number = lambda c, tolerance: F.when(F.abs(F.col(c)) < F.lit(float("inf")), F.round(F.col(c) * UNIT / tolerance).cast("long"))
    e, a = number("elevation_m", elevation_m), number("age_ka", age_ka)
    zero = F.lit(0).cast("long")
    hashed = lambda *parts: F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))
    facet = lambda kind, name, v, test, grouped=True: F.when(test, F.struct(hashed(F.lit(kind), *(text(c) if grouped else F.lit("") for c in ("source_id", "indicator_type")), name).alias("key"), v.alias("v")))
    out = [facet("sample", text("sample_id"), zero, F.length(text("sample_id")) > 0)]
    if "id" in columns:
        out.append(facet("id", text("id"), zero, F.col("id").isNotNull(), False))
    for kind in ("site", "location") if "location_name" in columns else ("site",):
        name = plain(F.col(f"{kind}_name"))
        out += [facet(f"{kind} elevation", name, e, e.isNotNull()), facet(f"{kind} age", name, a, a.isNotNull()), facet(f"{kind} bare", name, zero, e.isNull() & a.isNull())]
    return F.filter(F.array(*out), lambda f: f.isNotNull())


def _near(rows: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """(key, v, first, taken) for the facets of `rows` (order, taken, facets) and the facets `others` (key, v) of taken ones: the least order of the open rows, and whether one is taken, among the values within UNIT of v.

    Rows are summed by value on the map side first, and the values of a key are compared in ranges, so neither a value nor a key that many share is one task's work.
    """
    values = rows.select("order", "taken", F.explode("facets").alias("f")).select("order", "taken", "f.key", "f.v")
    if others is not None:
        values = values.unionByName(others.select(F.lit(None).cast("long").alias("order"), F.lit(True).alias("taken"), "key", "v"))
    values = values.groupBy("key", "v").agg(F.min(F.when(~F.col("taken"), F.col("order"))).alias("first"), F.bool_or("taken").alias("taken"))
    at = lambda v: F.floor(v / (RANGE * UNIT))
    v = F.col("v")
    dealt = values.withColumn("range", F.explode(F.array_distinct(F.array(at(v - UNIT), at(v), at(v + UNIT)))))
    around = Window.partitionBy("key", "range").orderBy("v").rangeBetween(-UNIT, UNIT)
    told = dealt.select("key", "v", (F.col("range") == at(v)).alias("own"), F.min("first").over(around).alias("first"), F.max("taken").over(around).alias("taken"))
    return told.filter("own").drop("own")


def _shared(candidates: DataFrame, existing: DataFrame | None) -> list[str]:
    return [c for c in candidates.columns if existing is None or c in existing.columns]


def not_seen(candidates: DataFrame, existing: DataFrame, elevation_m: float = ELEVATION_M, age_ka: float = AGE_KA) -> DataFrame:
    """The candidates that are none of the observations of `existing`; they are not held against each other. Repeated rows stay."""
    f = facets(_shared(candidates, existing), elevation_m, age_ka)
    numbered = kept(candidates.withColumn("_order", F.monotonically_increasing_id()))
    mine = numbered.select(F.col("_order").alias("order"), F.lit(False).alias("taken"), f.alias("facets"))
    near = _near(mine.unionByName(existing.select(F.lit(None).cast("long").alias("order"), F.lit(True).alias("taken"), f.alias("facets")))).filter("taken").select("key", "v")
    seen = mine.select("order", F.explode("facets").alias("f")).select("order", "f.key", "f.v").join(near, ["key", "v"], "left_semi").select(F.col("order").alias("_order")).distinct()
    return numbered.join(seen, "_order", "left_anti").drop("_order")


class _Tables:
    """Tables in the shared folder, compressed, that go as soon as later ones take their place."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folders: dict[int, tuple[DataFrame, str]] = {}

    def stored(self, df: DataFrame) -> DataFrame:
        folder = new_folder(self.spark, "unique")
        df.write.parquet(folder)
        out = self.spark.read.schema(df.schema).parquet(folder)
        self.folders[id(out)] = out, folder
        return out

    def drop(self, *dfs: DataFrame | None) -> None:
        for df in dfs:
            if df is not None and id(df) in self.folders:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folders.pop(id(df))[1])
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def swept(self) -> None:
        """Lets the driver forget finished plans, so that their shuffle files go."""
        gc.collect()
        self.spark._jvm.System.gc()


def _ends(candidates: DataFrame, order: str) -> list[tuple[int | None, int | None]]:
    """Ranges of `order`, as far as which (included) and after which rows are taken together, of about TOGETHER rows."""
    n = candidates.count()
    parts = -(-n // TOGETHER)
    if parts < 2:
        return [(None, None)]
    cuts = candidates.agg(F.percentile_approx(F.col(order).cast("long"), [k / parts for k in range(1, parts)], 100 * parts)).first()[0]
    cuts = sorted(set(cuts))
    return list(zip([None, *cuts], [*cuts, None]))


def semantically_unique(candidates: DataFrame, existing: DataFrame | None = None, order: str = "seq", elevation_m: float = ELEVATION_M, age_ka: float = AGE_KA) -> DataFrame:
    """The candidates that are appended when they are taken in `order` (unique whole numbers), each if it is none of the observations that are there by then: those of `existing` and the candidates taken before.

    Both have source_id, indicator_type, sample_id, site_name, elevation_m and age_ka; id and location_name count if both have them. The result is the first maximal set without two that are the same. Candidates go through
    rounds in ranges of their order, about TOGETHER at a time, each held against all that was taken in the ranges before, so that the tables of a round are no longer than a range. In each round a candidate
    goes if one like it was taken in the round before (or exists), and is taken if no open one like it comes before; what was taken earlier has already ruled out all that are like it, so it is not looked at again. Rounds end when all are decided; there are as many as the longest chain in which each decides the next.
    """
    f = facets(_shared(candidates, existing), elevation_m, age_ka)
    at, tables = F.col(order).cast("long"), _Tables(candidates.sparkSession)
    rows = candidates.select(at.alias("order"), F.lit(False).alias("taken"), f.alias("facets"))
    values = lambda df: df.select(F.explode("facets").alias("f")).select("f.key", "f.v")
    there = None if existing is None else tables.stored(values(existing.select(f.alias("facets"))).distinct())
    taken = [tables.stored(rows.limit(0))]
    for after, upto in _ends(candidates, order):
        open_ = rows if after is None else rows.filter(F.col("order") > after)
        open_ = open_ if upto is None else open_.filter(F.col("order") <= upto)
        n = TOGETHER
        last = [values(df) for df in taken] + ([] if there is None else [there])
        while n:
            near = _near(open_, reduce(DataFrame.unionByName, last))
            facet = open_.select("order", F.explode("facets").alias("f")).select("order", "f.key", "f.v")
            told = facet.join(near, ["key", "v"]).groupBy("order").agg(F.min("first").alias("first"), F.bool_or("taken").alias("gone"))
            left = told.filter("NOT gone").select("order", (F.col("first") == F.col("order")).alias("stays"))
            decided = tables.stored(open_.join(left, "order").select(*rows.columns, "stays"))
            tables.drop(open_)
            del near, facet, told, left
            if n > MANY:
                tables.swept()
            taken.append(tables.stored(decided.filter("stays").drop("stays")))
            last = [values(taken[-1])]
            open_ = tables.stored(decided.filter("NOT stays").drop("stays"))
            tables.drop(decided)
            n = open_.count()
            if len(taken) == MOST_ROUNDS:
                whole = tables.stored(reduce(DataFrame.unionByName, taken))
                tables.drop(*taken)
                taken, last = [whole], [values(whole)] if n else []
        tables.drop(open_)
    stay = tables.stored(reduce(DataFrame.unionByName, taken).select(F.col("order").alias("_order")))
    tables.drop(*taken, there)
    few = stay.count() <= MOST_BROADCAST
    return candidates.join(F.broadcast(stay) if few else stay, F.col(order) == F.col("_order")).drop("_order")
