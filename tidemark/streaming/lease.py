"""Leases with holders: claims, heartbeats, releases, expiry and reclaims, in the order of event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: A lease: holder ("" if free), when it ends (milliseconds), how the last one ended.
FREE = ("", 0, "")
OUT = "source_id string, event string, holder string, ts_ms long, event_id long"


def settled(lease: tuple, kind: str, holder: str, at: int, ttl: int) -> tuple[tuple, list[tuple[str, str, int]]]:
    """(lease, outcomes) after an event at `at`: a lease that ended before it expires first.

    A claim of a free source is granted, or reclaimed if the last lease expired; the holder's claims and heartbeats renew, another's claim is denied, and heartbeats and releases of those who don't hold the lease are lost.
    """
    out = []
    if lease[0] and at > lease[1]:
        out.append(("expired", lease[0], lease[1]))
        lease = ("", 0, "expired")
    if kind == "claim" and not lease[0]:
        out.append(("reclaimed" if lease[2] == "expired" else "granted", holder, at))
        lease = (holder, at + ttl, "")
    elif lease[0] != holder or kind not in ("claim", "heartbeat", "release"):
        out.append(("denied" if kind == "claim" else "lost", holder, at))
    elif kind == "release":
        out.append(("released", holder, at))
        lease = ("", 0, "released")
    else:
        out.append(("renewed", holder, at))
        lease = (holder, at + ttl, lease[2])
    return lease, out


class _Leases(StatefulProcessor):
    """Keeps a source's lease and the events that the watermark has not passed; a timer waits for the next of these or for the lease's end."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "holder string, ends long, ended string")
        self.waiting = handle.getListState("waiting", "ts_ms long, event_id long, kind string, holder string")

    def _told(self, key: tuple, new: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        rows = sorted([*(self.waiting.get() if self.waiting.exists() else ()), *new])
        due, later = [r for r in rows if r[0] <= watermark], [tuple(r) for r in rows if r[0] > watermark]
        lease, out = tuple(self.lease.get()) if self.lease.exists() else FREE, []
        for at, event_id, kind, holder in due:
            lease, told = settled(lease, kind, holder, at, self.ttl)
            out += [(key[0], event, who, when, event_id) for event, who, when in told]
        if lease[0] and watermark > lease[1]:
            out.append((key[0], "expired", lease[0], lease[1], None))
            lease = ("", 0, "expired")
        self.lease.update(lease)
        if later:
            self.waiting.put(later)
        elif self.waiting.exists():
            self.waiting.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        next_ = min([*(r[0] for r in later[:1]), *([lease[1] + 1] if lease[0] else [])], default=None)
        if next_ is not None:
            self.handle.registerTimer(max(next_, watermark + 1))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"event_id": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(at), int(i), kind, holder) for pdf in rows for at, i, kind, holder in zip(pdf["ts_ms"], pdf["event_id"], pdf["kind"], pdf["holder"])]
        yield from self._told(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._told(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def lease_events(events: DataFrame, ttl_ms: int = 45_000, late: str = "1 minute") -> DataFrame:
    """What becomes of the leases in a stream of `events` (event_id, ts, source_id, kind, holder): source_id, event, holder, ts_ms, event_id.

    An event is settled once the watermark has passed it, in the order of (ts, event_id), so the order of arrival within `late` is all the same; later ones are dropped. A lease that ends without a
    further event expires by a timer, with a null event_id. State is one lease and the events of the last `late` for each source. Needs the RocksDB state store.
    """
    told = events.withColumn("ts_ms", F.unix_millis("ts")).withWatermark("ts", late).select("ts", "ts_ms", "event_id", "source_id", "kind", "holder")
    return told.groupBy("source_id").transformWithStateInPandas(_Leases(ttl_ms), OUT, "Append", "EventTime")
