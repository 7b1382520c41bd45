"""Tables kept in the shared folder, and row numbers without a global sort in one task."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a session of one machine gets a temporary folder, and any other an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """`df`, computed once and read back from the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt to as many tasks as a shuffle has, by `keys` if given, however few pieces its files can be read in; for work that is long for each row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _dealt(df: DataFrame, order: Sequence[str], amount) -> tuple[DataFrame, DataFrame]:
    """`df` in ranges of `order` with `_p`, the number of a row's range, and `_at`, its place in it; and `_s`, the sum of `amount` over the ranges before each `_p`. Only a sum for each range comes to the driver."""
    dealt = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_p", F.shiftright("_at", 33))
    starts, total = [], 0
    for p, n in sorted((r["_p"], r["n"]) for r in dealt.groupBy("_p").agg(F.sum(amount).cast("long").alias("n")).collect()):
        starts.append((p, total))
        total += n or 0
    return dealt, F.broadcast(df.sparkSession.createDataFrame(starts, "_p long, _s long"))


def numbered(df: DataFrame, key: str | Sequence[str], out: str) -> DataFrame:
    """Adds `out`, 0, 1, 2 ... in the order of `key`: rows are dealt by range, and only the number of rows in each range comes to the driver."""
    dealt, starts = _dealt(df, [key] if isinstance(key, str) else key, F.lit(1))
    return dealt.join(starts, "_p").withColumn(out, F.col("_s") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_p", "_s", "_at")


def running(df: DataFrame, order: Sequence[str], amount: str, out: str) -> DataFrame:
    """Adds `out`, the sum of the whole numbers `amount` over the rows before in `order`, a task for each range of rows."""
    dealt, starts = _dealt(df, order, F.col(amount))
    before = F.sum(amount).over(Window.partitionBy("_p").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    return dealt.withColumn(out, F.coalesce(before, F.lit(0))).join(starts, "_p").withColumn(out, F.col(out) + F.col("_s")).drop("_p", "_s", "_at")


#: Rows of a grid of candidates that are broadcast at once.
MOST_BROADCAST = 1 << 20


def in_parts(grid: DataFrame, rows: int | None = None) -> list[DataFrame]:
    """`grid` in parts, by a hash, of about MOST_BROADCAST rows at most, each small enough to broadcast; `rows`, if known, saves counting."""
    parts = max(1, -(-(grid.count() if rows is None else rows) // MOST_BROADCAST))
    return [grid] if parts == 1 else [grid.filter(F.pmod(F.xxhash64(*grid.columns), F.lit(parts)) == k) for k in range(parts)]
