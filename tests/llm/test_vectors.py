"""Vector codes and hard negatives against brute force."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import codes, negatives

SCHEMA = "vec_id long, embedding array<float>, label int, code string, rank string, `key` string, q string, vector string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash", "clash") for r in rows], SCHEMA)


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def ints(v, scale):
    return [math.floor(float(np.float32(x)) * scale) for x in v]


def odd_rows(rng, n, dims=8):
    """Vectors with repeats, a hot one, ties, odd components and null keys and labels."""
    hot = rng.normal(size=dims).tolist()
    out = [(i, rng.normal(size=dims).tolist() if i % 3 else hot, int(rng.integers(4))) for i in range(n)]
    out += [(n, None, 1), (n + 1, [], 1), (n + 2, [None] + [0.0] * (dims - 1), 1), (n + 3, [math.nan] + [0.0] * (dims - 1), 2), (n + 4, [math.inf] * dims, 2), (n + 5, [0.0] * dims, None), (None, hot, 1), (None, hot, None)]
    return out


# --- codes


def brute_codes(rows, parts, entries, rounds, scale=1024):
    kept = [(k, ints(v, scale), label) for k, v, label in rows if usable(v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))[:entries]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*groups[i])] if i in groups else e for i, e in enumerate(books[p])]
    out, total = [], defaultdict(int)
    for k, v, label in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        total[label] += error
        out.append((k, "".join(f"{i:02x}" for _, i in found), error, label))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((k, c, e, total[label], sha) for k, c, e, label in out), key=str)


@pytest.mark.parametrize("n, entries", [(150, 16), (9, 64)])
def test_codes_against_brute_force(spark, n, entries):
    rows = odd_rows(np.random.default_rng(n), n)
    got = codes.compressed(table(spark, rows).repartition(3), entries=entries, rounds=3)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_codes(rows, 4, entries, 3)


def test_partial_distances_against_all_distances(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(codes, "BLOCK", 64)
    for width, spread in ((1, 3), (3, 5), (4, 50), (16, 700), (16, 1 << 26)):
        x, book = rng.integers(-spread, spread, (300, width)), rng.integers(-spread, spread, (37, width))
        book[11] = book[3]
        want = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        index, error = codes.nearest(x, book)
        assert (index == want.argmin(axis=1)).all() and (error == want.min(axis=1)).all()


def test_codes_of_odd_tables(spark):
    assert codes.compressed(table(spark, [])).collect() == []
    assert codes.compressed(table(spark, [(1, None, 1), (2, [], 2)])).collect() == []
    rows = [(1, [1.0, 2.0, 3.0, 4.0], 1), (1, [1.0, 2.0, 3.0, 4.0], 1), (2, [1.0] * 8, 1), (3, [1.0], None)]
    got = sorted(map(tuple, codes.compressed(table(spark, rows)).select("vec_id", "code", "error", "label_error").collect()), key=str)
    assert got == [(1, "00000000", 0, 0), (1, "00000000", 0, 0), (2, None, None, 0), (3, None, None, None)]
    with pytest.raises(ValueError):
        codes.compressed(table(spark, [(1, [1.0] * 5, 1)]))
    with pytest.raises(OverflowError):
        codes.scaled(__import__("pyarrow").array([[1e30]]), 1)


# --- hard negatives


def brute_negatives(rows, every, positives=5, count=3, low=50, high=95):
    kept = [(k, ints(v, 256), label) for k, v, label in rows if label is not None and usable(v)]
    last = lambda k: (k is None, k or 0)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for k, v, label in kept:
        if k is None or k % every:
            continue
        scored = sorted(((-dot(v, w), *last(j), m, j) for j, w, m in kept), key=lambda s: s[:4])
        for s in [s for s in scored if s[3] == label and s[4] != k][:positives]:
            p = -s[0]
            fit = [t for t in scored if t[3] != label and low * p <= -100 * t[0] <= high * p][:count]
            out += [(k, s[4], i + 1, t[4], p, -t[0]) for i, t in enumerate(fit)]
    return sorted(out, key=str)


@pytest.mark.parametrize("tree_rows, leaf_rows, at_once", [(16_384, 128, 16_384), (40, 5, 4), (7, 1, 3)])
def test_negatives_against_brute_force(spark, monkeypatch, tree_rows, leaf_rows, at_once):
    for name, value in (("TREE_ROWS", tree_rows), ("QUERIES_AT_ONCE", at_once), ("TOGETHER", 5)):
        monkeypatch.setattr(negatives, name, value)
    monkeypatch.setattr(negatives.ball_tree, "__defaults__", (leaf_rows,))
    rows = odd_rows(np.random.default_rng(tree_rows), 200)
    rows += [rows[10], rows[10], rows[20], rows[21]]
    got = negatives.hard_negatives(table(spark, rows).repartition(3), anchors="vec_id % 10 = 0")
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_negatives(rows, 10)


def test_trees_prune_and_stay_exact():
    rng = np.random.default_rng(8)
    centers = rng.integers(-60, 60, (12, 16))
    x = (centers[rng.integers(12, size=3000)] + rng.integers(-4, 4, (3000, 16))).astype(np.float32)
    labels = rng.integers(3, size=3000)
    search = negatives.Search(np.arange(40), labels[:40], x[:40], np.full(40, negatives.LEAST), np.full(40, negatives.MOST), 5, True)
    seen = []
    look = search._look
    search._look = lambda rows, node, at: (seen.append(len(at) * (node.last - node.first)), look(rows, node, at))
    search.add(negatives.Rows(x.copy(), np.arange(3000), labels))
    assert sum(seen) < 0.4 * 40 * 3000
    scores = (x[:40] @ x.T).astype(np.int64)
    for i in range(40):
        want = sorted((-int(scores[i, j]), j) for j in range(3000) if j != i and labels[j] == labels[i])[:5]
        assert [(-int(s), int(k)) for s, k in zip(search.scores[i], search.found[i])] == want


def test_negatives_of_odd_tables(spark):
    assert negatives.hard_negatives(table(spark, [])).collect() == []
    assert negatives.hard_negatives(table(spark, [(50, [1.0, 2.0], 1)])).collect() == []
    rows = [(50, [1.0, 0.0], 1), (51, [1.0, 0.0], 1), (52, [0.9, 0.0], 2), (53, [0.9, 0.0, 1.0], 2), (54, [0.99, 0.0], 3), (55, [0.4, 0.0], 3)]
    assert [tuple(r) for r in negatives.hard_negatives(table(spark, rows)).collect()] == [(50, 51, 1, 52, 65536, 58880)]
