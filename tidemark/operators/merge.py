"""Merging, de-duplication and lookups of point records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.placing import kept
from tidemark.functions.text import key_variants


def append_merge(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """All existing rows and those new ones whose key is not among them; of new rows with one key the first in `seq` order. Existing rows are never changed."""
    fresh = new.join(existing.select(key).distinct(), key, "left_anti")
    fresh = fresh.groupBy(key).agg(F.min_by(F.struct(*fresh.columns), "seq").alias("r")).select("r.*") if "seq" in new.columns else fresh.dropDuplicates([key])
    return existing.unionByName(fresh, allowMissingColumns=True)


def keep_last(df: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The last row of each key, in the place of its first."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), seq).alias("r"), F.min(seq).alias("place")).select("r.*", "place")


def _present(c: Column, kind: str) -> Column:
    if kind == "string":
        return F.coalesce(~F.lower(F.trim(c)).isin("", "null", "none"), F.lit(False))
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull()


def _union_before(rows: DataFrame, key: str, order: Sequence[str], bits: str, out: str) -> DataFrame:
    """`rows` with `out`, the union of `bits` over the rows of the same key before, and `_at`, which puts rows in order.

    Rows are dealt by ranges of key and order, so a key that many rows share is many tasks' work; its parts pass on one union each.
    """
    dealt = kept(rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(key, "_part").agg(F.bit_or(bits).alias("_u")).withColumn("_u", F.bit_or("_u").over(earlier(Window.partitionBy(key).orderBy("_part"))))
    parts = parts.select(F.col(key).alias("_of"), F.col("_part").alias("_of_part"), F.coalesce("_u", F.lit(0)).alias("_u"))
    within = F.coalesce(F.bit_or(bits).over(earlier(Window.partitionBy(key, "_part").orderBy("_at"))), F.lit(0))
    met = dealt.withColumn("_w", within).join(parts, F.col(key).eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_of_part")))
    return met.withColumn(out, F.col("_w").bitwiseOR(F.col("_u"))).drop("_w", "_u", "_of", "_of_part", "_part")


def fold_duplicates(df: DataFrame, key: str = "id", seq: str = "seq", elevation: str = "elevation_m", any_elevation: Sequence[str] = (), scored: Sequence[str] | None = None) -> DataFrame:
    """One row for each key: its rows are folded in `seq` order.

    Of two rows the one with an `elevation` wins, then one with any of `any_elevation`, then the one with more of the
    `scored` columns present; on a tie the later. What the winner lacks is filled from the loser, so a merged row may win by what it got.

    A merged row has the columns that any row so far had. A later row that brings no new column wins only if it has as much as the merged row, and then each column is the last such row's that has it; all other rows that bring
    nothing change nothing. So a key's rows are cut where a new column comes in, which happens once a column at most; what stands between is one aggregate, and the fold runs over no more than two rows for each column.
    Up to 62 columns; rows of equal key and seq are ordered by their values.
    """
    names = [c for c in df.columns if c not in (key, seq)]
    if len(names) > 62:
        raise ValueError("no more than 62 columns can be folded")
    kinds = dict(df.dtypes)
    scored = [*(scored or names)]

    def has(r, columns: Sequence[str]) -> Column:
        test = F.lit(False)
        for c in columns:
            test = test | _present(r[c], kinds[c])
        return test

    def score(r) -> Column:
        return sum((_present(r[c], kinds[c]).cast("int") for c in scored), F.lit(0))

    def merge(old: Column, new: Column) -> Column:
        top_old, top_new = has(old, [elevation]), has(new, [elevation])
        any_old, any_new = has(old, [elevation, *any_elevation]), has(new, [elevation, *any_elevation])
        take_old = F.when(top_old != top_new, top_old).when(any_old != any_new, any_old).otherwise(score(old) > score(new))
        fill = lambda a, b, c: F.when(_present(a[c], kinds[c]) | ~_present(b[c], kinds[c]), a[c]).otherwise(b[c])
        return F.struct(F.greatest(old["_at"], new["_at"]).alias("_at"), *(F.when(take_old, fill(old, new, c)).otherwise(fill(new, old, c)).alias(c) for c in names))

    bit = {c: 1 << i for i, c in enumerate(names)}
    mask = lambda columns: F.lit(sum(bit[c] for c in columns)).cast("long")
    told = df.withColumn("_bits", sum((F.when(_present(F.col(c), kinds[c]), F.lit(bit[c])).otherwise(F.lit(0)).cast("long") for c in names), F.lit(0).cast("long")))
    order = [seq, *(c for c in names if not kinds[c].startswith("map"))]
    rows = _union_before(told, key, order, "_bits", "_before")
    new = F.col("_bits").bitwiseAND(F.bitwise_not("_before")) != 0
    equal = lambda columns: (F.col("_bits").bitwiseAND(mask(columns)) != 0) == (F.col("_before").bitwiseAND(mask(columns)) != 0)
    ties = ~new & equal([elevation]) & equal([elevation, *any_elevation]) & (F.bit_count(F.col("_bits").bitwiseAND(mask(scored))) == F.bit_count(F.col("_before").bitwiseAND(mask(scored))))
    last = lambda c: F.coalesce(F.max_by(c, F.when(_present(F.col(c), kinds[c]), F.col("_at"))), F.max_by(c, "_at")).alias(c)
    between = rows.filter(ties).groupBy(key, "_before").agg(F.max("_at").alias("_at"), *(last(c) for c in names))
    events = rows.filter(new).select(key, "_at", *names).unionByName(between.select(key, "_at", *names))
    packed = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", *names)), lambda x, y: F.when(x["_at"] < y["_at"], -1).otherwise(1)).alias("rows"))
    folded = packed.select(key, F.aggregate(F.slice("rows", 2, F.greatest(F.size("rows"), F.lit(1))), F.get("rows", 0), merge).alias("r"))
    return folded.select(key, *(F.col(f"r.{c}").alias(c) for c in names))


def lookup(records: DataFrame, table: DataFrame, record_keys: Sequence[str], table_keys: Sequence[str], seq: str, record_id: str = "id") -> DataFrame:
    """(record_id, matched_key, row...): the first row of the table, in `seq` order, that shares a key form with a record; the longest shared form is the matched key.

    Only the first row of each form is met: a record's first row is the first of one of its forms, and of every form that both have. So a form that many records and rows share brings no more rows than there are records.
    """
    forms = lambda df, keys, keep: df.select(*keep, F.explode(F.array_distinct(F.flatten(F.array(*(F.coalesce(key_variants(F.col(k).cast("string")), F.array().cast("array<string>")) for k in keys))))).alias("_form"))
    left = forms(records, record_keys, [record_id])
    right = forms(table, table_keys, [seq]).groupBy("_form").agg(F.min(seq).alias(seq))
    met = left.join(right, "_form").groupBy(record_id, seq).agg(F.max_by("_form", F.struct(F.length("_form"), F.col("_form"))).alias("matched_key"))
    first = met.groupBy(record_id).agg(F.min_by(F.struct(seq, "matched_key"), seq).alias("m")).select(record_id, "m.*")
    return first.join(table, seq)


def novel(works: DataFrame, known: DataFrame, doi: str = "doi", order: Sequence[str] = ("seq",)) -> DataFrame:
    """Works whose DOI, lower-cased, is not known; of several with one DOI the first."""
    keyed = works.filter(F.col(doi).isNotNull()).withColumn("_k", F.lower(F.trim(doi)))
    fresh = keyed.join(known.select(F.lower(F.trim(doi)).alias("_k")).distinct(), "_k", "left_anti")
    return fresh.groupBy("_k").agg(F.min_by(F.struct(*works.columns), F.struct(*order)).alias("r")).select("r.*")
