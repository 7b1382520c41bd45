"""Sequential uniqueness against a plain loop."""

from __future__ import annotations

import math
import random

import pytest

from tidemark.operators import unique

SCHEMA = "seq long, id string, source_id string, indicator_type string, sample_id string, site_name string, location_name string, elevation_m double, age_ka double, first string, `key` string"


def near(a, b, tolerance):
    finite = lambda x: x is not None and math.isfinite(x)
    return finite(a) and finite(b) and abs(round(a * 1e6 / tolerance) - round(b * 1e6 / tolerance)) <= 1e6


def same(a, b):
    text = lambda x: "".join(c for c in (x or "").lower() if c.isalnum())
    if a["id"] is not None and a["id"] == b["id"]:
        return True
    if (a["source_id"] or "") != (b["source_id"] or "") or (a["indicator_type"] or "") != (b["indicator_type"] or ""):
        return False
    if a["sample_id"] and a["sample_id"] == b["sample_id"]:
        return True
    if text(a["site_name"]) != text(b["site_name"]) and text(a["location_name"]) != text(b["location_name"]):
        return False
    absent = lambda x: x is None or not math.isfinite(x)
    return near(a["elevation_m"], b["elevation_m"], 1.0) or near(a["age_ka"], b["age_ka"], 0.25) or all(absent(x[c]) for x in (a, b) for c in ("elevation_m", "age_ka"))


def observations(rng, n, start=0):
    pick = lambda *xs: rng.choice(xs)
    return [
        (
            start + i, pick(None, f"id{rng.randrange(n)}"), pick("s1", "s2", None), pick("a", "b"), pick(None, "", f"x{rng.randrange(9)}"), pick("Site A", "site-a", "B é", "C", None), pick("P", "Q ", f"r{rng.randrange(6)}"),
            pick(None, math.nan, rng.randrange(90) / 3, rng.randrange(4000) / 10), pick(None, rng.randrange(400) / 8, 12.5), "clash", "clash",
        )
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_a_loop(spark, monkeypatch, seed):
    monkeypatch.setattr(unique, "RANGE", seed)
    rng = random.Random(seed)
    old, new = observations(rng, 15, 10_000), observations(rng, 220)
    e = spark.createDataFrame(old, SCHEMA)
    c = spark.createDataFrame(rng.sample(new, len(new)), SCHEMA).repartition(3)
    names = [x.split()[0].strip("`") for x in SCHEMA.split(", ")]
    there, taken = [dict(zip(names, r)) for r in old], []
    for r in (dict(zip(names, r)) for r in new):
        if not any(same(r, x) for x in there):
            there.append(r)
            taken.append(r["seq"])
    got = unique.semantically_unique(c, e)
    assert got.columns == c.columns and sorted(r["seq"] for r in got.collect()) == taken
    fresh = [r[0] for r in new if not any(same(dict(zip(names, r)), dict(zip(names, x))) for x in old)]
    assert sorted(r["seq"] for r in unique.not_seen(c, e).collect()) == fresh


def test_chains_and_odd_tables(spark):
    row = lambda i, z: (i, f"i{i}", "s", "a", "", "x", f"l{i}", z, None, "", "")
    chain = spark.createDataFrame([row(i, i * 0.9) for i in range(12)], SCHEMA)
    assert sorted(r["seq"] for r in unique.semantically_unique(chain).collect()) == [0, 2, 4, 6, 8, 10]
    hot = spark.createDataFrame([row(i, (i % 50) / 100) for i in range(4000)], SCHEMA)
    assert [r["seq"] for r in unique.semantically_unique(hot).collect()] == [0]
    assert unique.semantically_unique(chain.limit(0), chain).count() == 0
    assert unique.not_seen(chain, chain).count() == 0 and unique.not_seen(chain, chain.limit(0)).count() == 12
    alone = chain.drop("id", "location_name")
    assert unique.not_seen(alone, chain.filter("seq = 0").drop("id")).count() == 10


def test_ranges_of_the_order_give_the_same_and_leave_no_tables(spark, monkeypatch):
    """Candidates that go through rounds a few at a time are held against all that was taken before; of the tables of the rounds only the result's stays in the shared folder."""
    import glob

    from tidemark.functions import placing

    rng = random.Random(5)
    old, new = observations(rng, 5, 10_000), observations(rng, 60)
    e, c = spark.createDataFrame(old, SCHEMA), spark.createDataFrame(rng.sample(new, len(new)), SCHEMA)
    names = [x.split()[0].strip("`") for x in SCHEMA.split(", ")]
    there, want = [dict(zip(names, r)) for r in old], []
    for r in (dict(zip(names, r)) for r in new):
        if not any(same(r, x) for x in there):
            there.append(r)
            want.append(r["seq"])
    folder = placing.shared_dir(spark).removeprefix("file:")
    before = len(glob.glob(f"{folder}/unique-*"))
    for together, rounds in ((25, 4), (1 << 22, 32)):
        monkeypatch.setattr(unique, "TOGETHER", together)
        monkeypatch.setattr(unique, "MOST_ROUNDS", rounds)
        assert sorted(r["seq"] for r in unique.semantically_unique(c, e).collect()) == want
    assert len(glob.glob(f"{folder}/unique-*")) == before + 2
