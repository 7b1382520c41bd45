"""WARC archives: round trips, revisits and what the salvage reader makes of damage."""

from __future__ import annotations

import hashlib
import io
import random
import re
import zlib

import pytest

from tidemark.llm import warc

SCHEMA = "page_id long, url string, html string, `key` string, payload string, reason string, `_first` string"
LONG = "long page " * 20


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], SCHEMA)


ROWS = [
    (7, "http://x/7", LONG), (3, "http://x/3\r\nWARC-Type: no", LONG), (5, None, LONG), (3, "http://x/3", LONG), (8, "http://ü/%41", "short"), (9, "", "short"), (10, "u", None), (11, "u", ""),
    (None, "u", LONG), (None, "u", "no key " * 30), (None, "u", "no key " * 30), (12, "u", "é" * 49), (13, "u", "é" * 50), (14, "u", "é" * 50), (15, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 40), (16, "u", "z" * 3_000_000),
]


def want(rows):
    least = {}
    for k, _, html in rows:
        if k is not None:
            least[html or ""] = min(k, least.get(html or "", k))
    out = []
    for k, _, html in rows:
        raw = (html or "").encode()
        first = least.get(html or "") if len(raw) >= 100 else None
        again = first is not None and first != k
        out.append((k, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_archives_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2_000)
    got = warc.archived(pages(spark, ROWS).repartition(3))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == want(ROWS)
    assert warc.archived(pages(spark, [])).collect() == []
    with pytest.raises(TypeError):
        warc.archived(pages(spark, ROWS), key="html")


@pytest.mark.parametrize("compress", [True, False])
def test_payloads_come_back_whole(spark, tmp_path, compress):
    rows = [r for r in ROWS if r[0] is not None]
    warc.write_warc(pages(spark, rows).repartition(2), str(tmp_path / "w"), compress=compress)
    stored = warc.read_warc(spark, str(tmp_path / "w"), rangeBytes=700)
    assert warc.gaps(stored).count() == 0
    got = warc.with_payloads(warc.pages_of(stored))
    told = [(r["page_id"], r["url"], bytes(r["payload"]).decode()) for r in got.collect()]
    assert sorted(map(str, told)) == sorted(str((k, u, h or "")) for k, u, h in rows)


def archive(n, compress, rng):
    out = []
    for k in range(n):
        raw = warc.record(k, f"http://x/{k}", rng.randbytes(rng.randrange(400)) + b" page " * rng.randrange(60))
        out.append(zlib.compress(raw, 6, wbits=31) if compress else raw)
    return out


def salvaged(data, first=0, last=None):
    return [(a, b, f and f["warc-record-id"], x) for a, b, f, x in warc.Archive(io.BytesIO(data), len(data)).salvaged(first, len(data) if last is None else last)]


def damaged(records, hurt, rng):
    """The archive with the records `hurt` flipped, cut short or overwritten, and (start, end) of what is lost; neighbours make one gap."""
    parts, lost, at = [], [], 0
    for k, r in enumerate(records):
        kind = hurt.get(k)
        if kind == "flip":
            i = rng.randrange(len(r) // 2 if r[:1] != b"W" else r.index(b"\r\n\r\n") + 4, len(r) - 12)
            r = r[:i] + bytes([r[i] ^ 0xFF]) + r[i + 1 :]
        elif kind == "cut":
            r = r[: rng.randrange(1, len(r) - 4)]
        elif kind == "noise":
            r = bytes(rng.randrange(32) for _ in range(rng.randrange(1, 900)))
        if kind:
            lost = [*lost[:-1], (lost[-1][0], at + len(r))] if lost and lost[-1][1] == at else [*lost, (at, at + len(r))]
        parts.append(r)
        at += len(r)
    return b"".join(parts), lost


@pytest.mark.parametrize("compress", [True, False])
def test_later_records_are_recovered(monkeypatch, compress):
    for piece in (97, 2 << 20):
        monkeypatch.setattr(warc, "READ_BYTES", piece)
        for seed in range(25):
            rng = random.Random(seed)
            records = archive(12, compress, rng)
            hurt = {k: rng.choice(["flip", "cut", "noise"]) for k in range(12) if rng.random() < 0.3}
            data, lost = damaged(records, hurt, rng)
            whole = salvaged(data)
            assert [r[2] for r in whole if r[2]] == [f"<urn:page:{k}>" for k in range(12) if k not in hurt]
            assert [(r[0], r[1]) for r in whole if not r[2]] == lost
            assert sum(b - a for a, b, _, _ in whole) == len(data)  # each byte is in one record or one gap
            cuts = sorted({0, len(data), *(rng.randrange(len(data)) for _ in range(4)), *(a for a, _ in lost), *(b for _, b in lost)})
            assert [r for a, b in zip(cuts, cuts[1:]) for r in salvaged(data, a, b)] == whole


def test_damaged_archives_in_spark(spark, tmp_path):
    rng = random.Random(4)
    records = archive(60, True, rng)
    data, lost = damaged(records, {0: "flip", 20: "cut", 21: "noise", 40: "flip", 59: "cut"}, rng)
    (tmp_path / "a.warc.gz").write_bytes(data)
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    (tmp_path / "none.warc").write_bytes(b"no record at all")
    stored = warc.read_warc(spark, str(tmp_path), rangeBytes=1_000)
    assert sorted((r["archive"], r["offset"], r["offset"] + r["length"]) for r in warc.gaps(stored).collect()) == [*(("a.warc.gz", a, b) for a, b in lost), ("none.warc", 0, 16)]
    assert sorted(r["page_id"] for r in warc.pages_of(stored).collect()) == [k for k in range(60) if k not in (0, 20, 21, 40, 59)]
    assert warc.read_warc(spark, str(tmp_path / "nothing-here") if (tmp_path / "nothing-here").mkdir() is None else "").count() == 0


def test_checks_of_a_record():
    good = warc.record(1, "u", b"payload")
    for bad in (good[:-1], good.replace(b"WARC-Type", b"WARC-Kind"), good.replace(b"payload\r\n", b"PAYLOAD\r\n"), good.replace(b"WARC/1.1", b"WARC/x.1"), re.sub(rb"[0-9]+\r\n\r\nHTTP", b"20\r\n\r\nHTTP", good), good[:60]):
        assert [r[2] for r in salvaged(bad)] == [None]
    other = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <x>\r\nContent-Length: 2\r\nWARC-Block-Digest: sha1:2jmj7l5rSw0yVb/vlWAYkK/YBwk=\r\n\r\nhi\r\n\r\n"
    assert [r[2] for r in salvaged(other)] == [None]
    assert [r[2] for r in salvaged(other.replace(b"sha1:2jmj7l5rSw0yVb/vlWAYkK/YBwk=", b"sha1:" + hashlib.sha1(b"hi").hexdigest().encode()))] == ["<x>"]
    assert [r[2] for r in salvaged(other.replace(b"sha1:2jmj7l5rSw0yVb/vlWAYkK/YBwk=", b"crc9:17"))] == ["<x>"]
