"""Ranks, correlations, resampling and summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions.placing import kept, numbered, running, spread


def draw(seed: str, *parts) -> Column:
    """A reproducible draw: the MD5 of the parts as text. Its order is a random order, its digits are uniform."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))


def uniform(digest: Column) -> Column:
    """[0, 1) from the first 52 bits of a digest."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def _same(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """`a` with the columns of `b`, which has one row for each value of `by`; nulls are a value. Without `by`, `b` is one row."""
    if not by:
        return a.crossJoin(F.broadcast(b))
    b = b.withColumnsRenamed({c: f"_b_{c}" for c in by})
    return a.join(b, reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by))).drop(*(f"_b_{c}" for c in by))


def placed_values(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """The distinct values of each group with `_n`, their number of rows, and `_before`, how many rows of the group are less. Values are dealt by range, so neither a large group nor a single one is one task's work."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    placed = running(counts, [*by, value], "_n", "_before")
    return _same(placed, placed.groupBy(*by).agg(F.min("_before").alias("_start")), by).withColumn("_before", F.col("_before") - F.col("_start")).drop("_start") if by else placed


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """For each group `n` and exact quantiles, interpolated between neighbours; nulls are left out. Without `by` there is one row, of nulls if nothing is left."""
    placed = placed_values(df.filter(F.col(value).isNotNull()), value, by)
    each = _same(placed, placed.groupBy(*by).agg(F.sum("_n").alias("n")), by)
    place = {name: (F.col("n") - 1) * F.lit(float(p)) for name, p in shares.items()}
    at = lambda k: F.max(F.when((F.col("_before") <= k) & (k < F.col("_before") + F.col("_n")), F.col(value)))
    ends = each.groupBy(*by).agg(F.max("n").alias("n"), *(at(f(p)).alias(f"_{side}_{name}") for name, p in place.items() for side, f in (("low", F.floor), ("high", F.ceil))))
    mix = {name: (F.ceil(p) - p) * F.col(f"_low_{name}") + (p - F.floor(p)) * F.col(f"_high_{name}") for name, p in place.items()}
    return ends.select(*by, "n", *(F.when(F.floor(place[name]) == F.ceil(place[name]), F.col(f"_low_{name}")).otherwise(m).alias(name) for name, m in mix.items()))


def trim(df: DataFrame, value: str = "z_m", low: float = 0.02, high: float = 0.98, least: int = 5) -> DataFrame:
    """The rows between two exact quantiles, ends included; all rows if there are fewer than `least`."""
    ends = quantiles(df.select(value), value, {"a": low, "b": high}).agg(F.struct(F.max("a").alias("a"), F.max("b").alias("b"), F.coalesce(F.max("n"), F.lit(0)).alias("n")).alias("e")).scalar()
    return df.withColumn("_e", ends).filter((F.col("_e.n") < least) | F.col(value).between(F.col("_e.a"), F.col("_e.b"))).drop("_e")


def average_rank(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds the mean rank of equal values: from counts by value, so rows of one value are never sorted, and values are dealt by range. Rows whose group or value is null go."""
    ranks = placed_values(df.dropna(subset=[*by, value]), value, by).withColumn(out, F.col("_before") + (F.col("_n") + 1) / 2).drop("_n", "_before")
    return df.join(ranks, [*by, value])


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """For each group n and the correlation of average ranks; null where either is constant."""
    ranked = average_rank(average_rank(df.select(*by, x, y).dropna(subset=[x, y]), x, "_rx", by), y, "_ry", by)
    spread = F.nullif(F.stddev_pop("_rx") * F.stddev_pop("_ry"), F.lit(0.0))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), (F.covar_pop("_rx", "_ry") / spread).alias("spearman"))


def dominated(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> float:
    """The sum of w[i] * w[j] over all pairs with a[j] < a[i] and b[j] < b[i], by merging ever larger halves."""
    order = np.lexsort((-b, a))  # of equal a the greater b first, so that none of them counts
    w, rank = w[order].astype(np.float64), np.unique(b[order], return_inverse=True)[1].astype(np.int64)
    place, most, total, size = np.arange(len(w)), len(w) + 1, 0.0, 1
    while size < len(w):
        block, right = place // (2 * size), (place // size) % 2 == 1
        key = block * most + rank
        left = np.flatnonzero(~right)
        left = left[np.argsort(key[left], kind="stable")]
        upto = np.concatenate([[0.0], np.cumsum(w[left])])
        less = upto[np.searchsorted(key[left], key[right])] - upto[np.searchsorted(key[left], block[right] * most)]
        total += float((w[right] * less).sum())
        size *= 2
    return total


def gamma(df: DataFrame, x: str, y: str, blocks: int | None = None) -> DataFrame:
    """Goodman and Kruskal's gamma, (C - D) / (C + D): ties leave the denominator.

    Rows are summed by (x, y); both axes are cut into about `blocks` (by default the cube root of the number of cells, from 64 to 2 048) ranges of equally many rows, a value that fills a range being one of its own. Pairs whose ranges differ on both
    axes are counted in the table of ranges (at most 4 * blocks ** 2 cells, one task), the others within a range of x or of y, a task for each, by sorting; no pair is made. Discordant pairs are the rest
    without ties.
    """
    v = kept(df.select(F.col(x).alias("x"), F.col(y).alias("y")).dropna().groupBy("x", "y").agg(F.count("*").alias("n")))
    rows, cells = v.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    blocks = blocks or min(2_048, max(64, round(cells ** (1 / 3))))

    def ranges(c: str, out: str) -> DataFrame:
        placed = running(v.groupBy(c).agg(F.sum("n").alias("_n")), [c], "_n", "_b")
        return placed.select(c, (2 * F.floor(F.col("_b") * blocks / F.lit(max(rows, 1))) + (F.col("_n") * blocks > rows).cast("long")).alias(out))

    cells = kept(v.join(ranges("x", "bx"), "x").join(ranges("y", "by"), "y"))

    def counted(table: pa.Table, a: str, b: str) -> pa.Table:
        return pa.table({"c": [dominated(table[a].to_numpy(), table[b].to_numpy(), table["n"].to_numpy())]})

    coarse = cells.groupBy("bx", "by").agg(F.sum("n").alias("n")).withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(lambda t: counted(t, "bx", "by"), "c double")
    in_x = cells.filter("bx % 2 = 0").groupBy("bx").applyInArrow(lambda t: counted(t, "x", "y"), "c double")
    in_y = cells.filter("by % 2 = 0").groupBy("by").applyInArrow(lambda t: counted(t, "bx", "y"), "c double")
    c = coarse.unionByName(in_x).unionByName(in_y).agg(F.coalesce(F.sum("c"), F.lit(0.0)).alias("c"))
    square = lambda d: d.agg(F.coalesce(F.sum(F.col("n").cast("double") * F.col("n")), F.lit(0.0)).alias("q"))
    tied = [square(d).withColumnRenamed("q", f"q{i}") for i, d in enumerate((v, v.groupBy("x").agg(F.sum("n").alias("n")), v.groupBy("y").agg(F.sum("n").alias("n"))))]
    one = c.crossJoin(tied[0]).crossJoin(tied[1]).crossJoin(tied[2])  # single rows
    d = (F.lit(float(rows) ** 2) - F.col("q1") - F.col("q2") + F.col("q0")) / 2 - F.col("c")
    return one.select(F.col("c").cast("long").alias("concordant"), d.cast("long").alias("discordant"), ((F.col("c") - d) / F.nullif(F.col("c") + d, F.lit(0.0))).alias("gamma"))


def permuted(df: DataFrame, value: str, key: str, reps: int, seed: str, within: Sequence[str] = ()) -> DataFrame:
    """`df` for rep 1..reps with `value` reshuffled among its rows, or among the rows of each group of `within`.

    Within a repetition the k-th value in key order goes to the k-th row in random order. Both orders are numbered by ranges of rows, so that neither
    a repetition nor a large group is one task's work. `key` tells rows apart; rows whose group is null go.
    """
    df = df.dropna(subset=[*within]) if within else df
    each = df.drop(value).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("_d", draw(seed, F.col("rep"), F.col(key)))

    def placed(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
        rows = numbered(rows, [*by, *order], "_k")
        return _same(rows, rows.groupBy(*by).agg(F.min("_k").alias("_start")), by).withColumn("_k", F.col("_k") - F.col("_start")).drop("_start") if by else rows

    values = placed(df.select(*within, value, key), within, [key]).drop(key)
    return placed(each, ["rep", *within], ["_d", key]).join(values, [*within, "_k"]).drop("_k", "_d")


def p_greater(null: Column, observed: Column) -> Column:
    """(nulls as great as the observed one + 1) / (nulls + 1)."""
    return (F.count_if(null >= observed) + 1) / (F.count(null) + 1)


def one_per_group(df: DataFrame, by: Sequence[str], key: str, reps: int, seed: str) -> DataFrame:
    """For rep 1..reps a random row of each group: the one of the least draw. Rows are dealt evenly before they are repeated, so that a task repeats and sorts its share only."""
    each = spread(df).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    least = F.min_by(F.struct(*df.columns), F.struct(draw(seed, F.col("rep"), F.col(key)), F.col(key)))
    return each.groupBy("rep", *by).agg(least.alias("r")).select("rep", "r.*")


def bootstrap_rows(df: DataFrame, key: str, reps: int, seed: str) -> DataFrame:
    """For rep 1..reps as many rows as `df` has, drawn with replacement: row k of a draw is the row whose place is a hash of (rep, k)."""
    n = df.agg(F.count("*")).scalar()
    placed = numbered(df, key, "_i")
    slots = placed.select("_i").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("_i", F.floor(uniform(draw(seed, F.col("rep"), F.col("_i"))) * n).cast("long"))
    return slots.join(placed, "_i").drop("_i")


def bootstrap_groups(df: DataFrame, by: str, reps: int, seed: str) -> DataFrame:
    """For rep 1..reps as many groups as there are, drawn with replacement, with all their rows, each as often as its group was drawn."""
    groups = df.select(by).distinct()
    placed = numbered(groups, by, "_i")
    n = groups.agg(F.count("*")).scalar()
    slots = placed.select("_i").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("_i", F.floor(uniform(draw(seed, F.col("rep"), F.col("_i"))) * n).cast("long"))
    return slots.join(placed, "_i").select("rep", by).join(df, by)


def matched_axes(candidates: DataFrame, key: str, each: int, seed: str) -> DataFrame:
    """For every candidate `each` axes drawn evenly from the sphere, with the candidate's columns and `j`, the draw: axis_lat, axis_lon."""
    rows = spread(candidates).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(each - 1).cast("long"))))
    n = F.col(key) * each + F.col("j")
    lat = F.degrees(F.asin(2 * uniform(draw(f"{seed}lat", n)) - 1))
    return rows.withColumns({"axis_lat": lat, "axis_lon": 360 * uniform(draw(f"{seed}lon", n)) - 180})


def schemes(df: DataFrame, cell: str, source: str, key: str, reps: int, seed: str, min_n: int = 1) -> DataFrame:
    """The draws of four schemes with `scheme` and `rep`: all rows with replacement, a row for each cell, a row for each source, and of the rows for each cell one for each source. Draws of fewer than `min_n` rows are left out."""
    names = df.columns
    cells = one_per_group(df, [cell], key, reps, f"{seed}-cell")
    least = F.min_by(F.struct(*names), F.struct(draw(f"{seed}-both", F.col("rep"), F.col(key)), F.col(key)))
    draws = {
        "ordinary": bootstrap_rows(df, key, reps, seed), "one_per_cell": cells, "one_per_source": one_per_group(df, [source], key, reps, f"{seed}-source"),
        "cell_then_source": cells.groupBy("rep", source).agg(least.alias("r")).select("rep", "r.*"),
    }
    all_draws = reduce(DataFrame.unionByName, (d.select(F.lit(name).alias("scheme"), "rep", *names) for name, d in draws.items()))
    large = all_draws.groupBy("scheme", "rep").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_n).drop("_n")
    return all_draws.join(large, ["scheme", "rep"])


def summary(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """For each column n, mean, median, p05, p25, p75, p95 (exact, interpolated)."""
    long = df.select(*by, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot([*by], [*columns], "metric", "value").filter("value IS NOT NULL AND NOT isnan(value)")
    shares = {"median": 0.5, "p05": 0.05, "p25": 0.25, "p75": 0.75, "p95": 0.95}
    means = long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"))
    return _same(means, quantiles(long, "value", shares, [*by, "metric"]), [*by, "metric"]).select(*by, "metric", "n", "mean", *shares)
