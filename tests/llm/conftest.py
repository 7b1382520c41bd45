from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, `key` string, host string, words string, `_key` string, `_spans` string, `_id` string, `_row` string, `_gone` string, `_copies` string, `row` string, spans string, text_id string"


def prose(rng: random.Random, n: int, stem: str = "w") -> str:
    return " ".join(f"{stem}{rng.randrange(5000)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty and long texts, copies, repeated rows and columns whose names the operators use inside."""
    rng = random.Random(3)
    long_text = prose(rng, 30_000)
    base = [prose(rng, 120) for _ in range(6)]
    texts = [None, "", "   \n\t ", "one", "Ünï çödé", *base, base[0], base[0].upper(), "a b c " * 60, "x" * 5000, long_text, "line one here\n" * 30, "  a  b \n\n c\x0bd ", base[1] + "\n" + base[2]]
    rows = [(i, t, None if i % 7 == 0 else ("en", "fr")[i % 2], None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base[3], None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, *["clash"] * 14) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
