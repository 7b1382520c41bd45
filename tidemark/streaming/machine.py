"""The state machine of sources in batches: transition rules as maps of the states onto themselves, which compose in parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.streaming.status import STATUSES, advance

#: The states of a source: none yet, then the statuses that it can be in.
STATES = (None, *(s for s in STATUSES if s != "restarted"))


def rules() -> np.ndarray:
    """(event, state): the state that each event leads to; the last row is that of unknown events, which change nothing."""
    to = {s: i for i, s in enumerate(STATES)}
    return np.array([[to[advance(state, event)] for state in STATES] for event in (*STATUSES, None)], dtype=np.int8)


def composed(maps: np.ndarray, changes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One map for each run of equal `group`: the maps of its rows one after the other, and how often each start state changes on the way. Neighbours are paired until none are left."""
    while len(group) > 1:
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        place = np.arange(len(group)) - np.repeat(start, np.diff(np.r_[start, len(group)]))
        first = np.flatnonzero(place % 2 == 0)
        paired = first[(first + 1 < len(group)) & (group[np.minimum(first + 1, len(group) - 1)] == group[first])]
        if not len(paired):
            break
        changes[paired] += np.take_along_axis(changes[paired + 1], maps[paired].astype(np.int64), axis=1)
        maps[paired] = np.take_along_axis(maps[paired + 1], maps[paired].astype(np.int64), axis=1)
        maps, changes, group = maps[first], changes[first], group[first]
    return maps, changes, group


def final_states(events: DataFrame, key: str = "source_id", order: str = "event_id") -> DataFrame:
    """(key, status, changes, events) of each source after all its events (status) in the order of `order`, unique whole numbers.

    Events are dealt by ranges of (key, order), so the events of one source are many tasks' work; a task sends one map for each source and batch, and a source's maps are composed in order.
    Unknown and null statuses count as events that change nothing; a null key is a source.
    """
    kind = dict(events.dtypes)[key]
    known = F.coalesce(*(F.when(F.col("status") == s, F.lit(i)) for i, s in enumerate(STATUSES)), F.lit(len(STATUSES))).cast("int")
    dealt = events.select(F.col(key).alias("key"), F.col(order).cast("long").alias("at"), known.alias("event")).repartitionByRange("key", "at").sortWithinPartitions("key", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rules()
        identity = np.arange(len(STATES), dtype=np.int8)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch["key"].dictionary_encode(null_encoding="encode").indices.to_numpy()
            group = np.cumsum(np.r_[0, keys[1:] != keys[:-1]])
            maps = table[batch["event"].to_numpy()]
            out, changes, of = composed(maps.copy(), (maps != identity).astype(np.int64), group)
            first = np.searchsorted(group, of)
            n = np.diff(np.r_[first, len(group)])
            yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(first)), batch["at"].take(pa.array(first)), pa.array(n), pa.array(out.tolist(), pa.list_(pa.int32())), pa.array(changes.tolist(), pa.list_(pa.int64()))], names=["key", "at", "n", "map", "changes"])

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        maps, changes = np.array(table["map"].to_pylist(), dtype=np.int8), np.array(table["changes"].to_pylist(), dtype=np.int64)
        out, moved, _ = composed(maps, changes, np.zeros(table.num_rows, dtype=np.int64))
        status = STATES[out[0, 0]]
        return pa.Table.from_arrays([table["key"].combine_chunks()[:1], pa.array([status], pa.string()), pa.array([int(moved[0, 0])]), pa.array([int(np.sum(table["n"].to_numpy()))])], names=["key", "status", "changes", "events"])

    sent = dealt.mapInArrow(run, f"key {kind}, at long, n long, map array<int>, changes array<long>")
    return sent.groupBy("key").applyInArrow(joined, f"key {kind}, status string, changes long, events long").withColumnRenamed("key", key)
