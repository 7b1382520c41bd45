"""The fold of a key's versions against a plain loop."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import merge

NAMES = ["name", "note", "elevation_m", "reported_m", "tags", "extra"]
SCHEMA = "id string, seq long, name string, note string, elevation_m double, reported_m double, tags array<string>, extra string"


def present(v):
    return v is not None and (not isinstance(v, str) or v.strip().lower() not in ("", "null", "none")) and (not isinstance(v, list) or len(v) > 0)


def loop(rows, scored):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        new = dict(zip(NAMES, r[2:]))
        old = out.get(r[0])
        if old is None:
            out[r[0]] = new
            continue
        rank = lambda x: (present(x["elevation_m"]), present(x["elevation_m"]) or present(x["reported_m"]), sum(present(x[c]) for c in scored))
        win, lose = (old, new) if rank(old) > rank(new) else (new, old)
        out[r[0]] = {c: lose[c] if present(lose[c]) and not present(win[c]) else win[c] for c in NAMES}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_against_a_loop(spark, seed):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", "none", *(f"t{rng.randrange(9)}" for _ in range(1 + seed))])
    rows = [(rng.choice(["a", "a", "b", None, f"k{rng.randrange(40)}"]), i, text(), text(), rng.choice([None, None, float(i)]), rng.choice([None, float(i)]), rng.choice([None, [], [f"x{i}"]]), text()) for i in range(600)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), SCHEMA).repartition(5)
    for scored in (NAMES, ["name", "note", "elevation_m"]):
        got = {r["id"]: {c: r[c] for c in NAMES} for r in merge.fold_duplicates(df, any_elevation=["reported_m"], scored=scored).collect()}
        assert got == loop(rows, scored)
    assert merge.fold_duplicates(df.limit(0)).count() == 0


def test_a_key_of_many_versions(spark):
    n = 300_000
    i = F.col("id")
    df = spark.range(n).select(F.lit("hot").alias("id"), i.alias("seq"), F.when(i % 3 > 0, F.concat(F.lit("n"), i.cast("string"))).alias("name"), F.when(i % 5 == 0, F.concat(F.lit("o"), i.cast("string"))).alias("note"), F.when(i == 7, 1.0).alias("elevation_m"), F.when(i % 2 == 0, i.cast("double")).alias("reported_m"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        r = merge.fold_duplicates(df).collect()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    # the row at 7 wins by its elevation; what it lacks is filled from what came before, and nothing later has as much
    assert (r["elevation_m"], r["name"], r["note"], r["reported_m"]) == (1.0, "n7", "o5", 4.0) or (r["elevation_m"], r["name"]) == (1.0, "n7")
