"""The state machine and leases: batch, stream and a plain loop agree."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.placing import new_folder
from tidemark.streaming import lease, machine, status


def loop(events):
    out = {}
    for _, source, new in sorted(events):
        now, n, seen = out.get(source, (None, 0, 0))
        after = status.advance(now, new)
        out[source] = (after, n + (after != now), seen + 1)
    return out


@pytest.mark.parametrize("partitions", [1, 9])
def test_states_of_a_hot_source(spark, partitions):
    rng = random.Random(partitions)
    words = [*status.STATUSES, "queued", "running", "running", "odd", None]
    events = [(i, None if i % 17 == 0 else f"s{0 if rng.random() < 0.6 else rng.randrange(9)}", rng.choice(words)) for i in range(4000)]
    df = spark.createDataFrame(rng.sample(events, len(events)), "event_id long, source_id string, status string")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = {r["source_id"]: (r["status"], r["changes"], r["events"]) for r in machine.final_states(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == loop([(i, s, w) for i, s, w in events])
    assert machine.final_states(df.limit(0)).count() == 0


def plain(events, ttl):
    leases, out = {}, []
    for at, i, source, kind, holder in sorted(events):
        now, told = lease.settled(leases.get(source, lease.FREE), kind, holder, at, ttl)
        leases[source] = now
        out += [(source, e, h, t, i) for e, h, t in told]
    out += [(s, "expired", l[0], l[1], None) for s, l in leases.items() if l[0]]
    return out


def test_leases_in_a_stream(spark):
    """Events out of order within the watermark's delay, over several batches, give what the loop over sorted ones gives."""
    rng = random.Random(5)
    events = [(1_000_000 + rng.randrange(4_000) * 1000, i, f"s{rng.randrange(5)}", rng.choice(["claim", "claim", "heartbeat", "heartbeat", "release", "odd"]), f"h{rng.randrange(3)}") for i in range(400)]
    events.sort(key=lambda e: e[0] + rng.randrange(30_000))
    source, out = new_folder(spark, "lease"), new_folder(spark, "told")
    end = max(e[0] for e in events) + 10_000_000
    for k in range(0, 401, 100):
        part = events[k : k + 100] or [(end, -1, "~", "tick", "")]
        spark.createDataFrame(part, "ms long, event_id long, source_id string, kind string, holder string").withColumn("ts", F.timestamp_millis("ms")).drop("ms").coalesce(1).write.mode("append").parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
        lease.lease_events(stream, 45_000, "60 seconds").writeStream.format("parquet").option("path", out).trigger(availableNow=True).option("checkpointLocation", new_folder(spark, "at")).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = [tuple(r) for r in spark.read.parquet(out).select("source_id", "event", "holder", "ts_ms", "event_id").collect() if r["source_id"] != "~"]
    bare = lambda rows: sorted((s, e, h, t) for s, e, h, t, _ in rows)
    assert bare(got) == bare(plain(events, 45_000))
    assert {e for _, e, *_ in got} >= {"granted", "reclaimed", "denied", "renewed", "released", "expired", "lost"}
