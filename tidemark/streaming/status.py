"""Streams of files and status events: discovery, seen ids, leases, state machines and windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources.files import source_id

EVENT = "event_id long, ts timestamp, source_id string, status string, count long"
#: Once reached, only a new run leaves them.
TERMINAL = ("completed", "failed", "skipped", "unsupported", "cancelled")
#: What an event can say; other words change nothing.
STATUSES = ("queued", "running", *TERMINAL, "restarted")


def discovered(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New text files of a folder as (source_id, text, path), each source once; the checkpoint remembers which were seen."""
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return files.select(source_id(F.col("_metadata.file_path")).alias("source_id"), F.col("value").alias("text"), F.col("_metadata.file_path").alias("path")).dropDuplicates(["source_id"])


def leases(events: DataFrame, ttl: str = "45 seconds", late: str = "1 minute") -> DataFrame:
    """Heartbeats of a holder that follow each other within `ttl`: source_id, first, last (exclusive), beats."""
    w = events.withWatermark("ts", late).groupBy("source_id", F.session_window("ts", ttl).alias("w")).agg(F.count("*").alias("beats"))
    return w.select("source_id", F.col("w.start").alias("first"), F.col("w.end").alias("last"), "beats")


def counts_by_window(events: DataFrame, width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events and counts of each status by tumbling or sliding windows; rows that come later than `late` are left out."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "status").agg(F.count("*").alias("n"), F.sum("count").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "status", "n", "total")


def once(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event id once, remembered for as long as `late`."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def advance(now: str | None, new: str | None) -> str | None:
    """The status after an event: queued does not undo running, and nothing but a restart leaves a terminal status."""
    if new not in STATUSES or (now in TERMINAL and new != "restarted"):
        return now
    if new == "queued" and now == "running":
        return now
    return "queued" if new == "restarted" else new


def source_states(events: DataFrame) -> DataFrame:
    """Each source's status after every batch: queued does not undo running, and nothing but a restart leaves a terminal status.

    State is one string and two numbers a source.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, n, seen = state.get if state.exists else (None, 0, 0)
        for batch in batches:
            for new, _ in sorted(zip(batch["status"], batch["event_id"]), key=lambda x: x[1]):
                after = advance(status, new)
                n += after != status
                status, seen = after, seen + 1
        state.update((status, n, seen))
        yield pd.DataFrame({"source_id": [key[0]], "status": [status], "changes": [n], "events": [seen]})

    return events.groupBy("source_id").applyInPandasWithState(step, "source_id string, status string, changes long, events long", "status string, changes long, events long", "update", GroupStateTimeout.NoTimeout)


def healthy(nodes: DataFrame, now, ttl_seconds: int = 45) -> DataFrame:
    """Of a table of heartbeats (node, ts) each node's last one and whether it is younger than `ttl_seconds` at `now`."""
    last = nodes.groupBy("node").agg(F.max("ts").alias("seen"))
    return last.withColumn("healthy", F.col("seen") >= F.lit(now) - F.make_dt_interval(secs=F.lit(ttl_seconds)))


def dispatch_limit(metrics: DataFrame, slots: int) -> DataFrame:
    """How many jobs may start, by memory, load and disk: all, half, a third or none."""
    c = F.col
    # Thresholds of the dispatch rule.
    limit = (
        F.when((c("memory_percent") >= 92) | (c("load_per_cpu") >= 2.0) | (c("disk_free_gb") < 2), 0)
        .when((c("memory_percent") >= 82) & (c("load_per_cpu") >= 1.4), max(1, slots // 3))
        .when((c("memory_percent") >= 82) | (c("load_per_cpu") >= 1.4) | (c("disk_free_gb") < 10), max(1, slots // 2))
        .otherwise(slots)
    )
    return metrics.withColumn("limit", limit)


def merge_into(path: str, key: str = "id", buckets: int = 64):
    """A foreachBatch function, the only writer of `path`: appends rows whose key is new to the Parquet table there.

    The table lies in folders by a hash of the key, `bucket`, so a batch is held against the keys of the buckets that it touches only; give as many as make one a few files.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fresh = new
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):  # else this is the table's first batch
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # `buckets` numbers at most
            existing = spark.read.schema(new.schema).parquet(path).filter(F.col("bucket").isin(touched))
            fresh = new.join(existing.select(F.col(key).alias("_k"), F.col("bucket").alias("_b")), (F.col("bucket") == F.col("_b")) & F.col(key).eqNullSafe(F.col("_k")), "left_anti")
        fresh.select(*batch.columns, "bucket").write.mode("append").partitionBy("bucket").parquet(path)
        new.unpersist()

    return write
