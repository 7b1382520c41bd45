"""Toxicity scores by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, documents, id_mod, release

#: Labelled rows that the model is fitted on at most, by label: the first by a hash of their id.
POSITIVES, NEGATIVES = 4_000, 8_000
#: Slots of the table that all terms are hashed into; terms that share a slot share its weight and factors.
TABLE = 1 << 20
#: A slot needs this many sampled documents and this chi-square (one degree of freedom) to weigh anything.
LEAST_DOCS, LEAST_CHI2 = 4, 20.0
#: Beginnings of words that are terms beside the words.
PREFIXES = (4, 5, 6)
FACTORS, EPOCHS, RATE, DECAY = 8, 12, 0.1, 1e-4
THRESHOLD = 0.3
#: Words whose terms a worker remembers.
REMEMBERED = 200_000

_find_words = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> set[str]:
    """The distinct words of a whole text: runs of letters, lower-cased."""
    return set(_find_words(text.lower()))


def terms_of(word: str) -> list[int]:
    """The slots of a word's terms: of itself and of its beginnings."""
    return [zlib.crc32(b"w" + word.encode()) % TABLE, *(zlib.crc32(b"p" + word[:n].encode()) % TABLE for n in PREFIXES if len(word) >= n)]


@dataclass
class Machine:
    """score = logistic(bias + sum of weights + sum over pairs of terms of the product of their factors)."""

    index: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logit(self, active: list[int]) -> float:
        if not active:
            return self.bias
        v = self.factors[active]
        s = v.sum(axis=0)
        return float(self.bias + self.weights[active].sum() + 0.5 * (s @ s - (v * v).sum()))


class Known(dict):
    """word -> numbers of its known slots."""

    def __init__(self, index: dict[int, int]):
        super().__init__()
        self.index = index

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(self.index[t] for t in terms_of(word) if t in self.index)
        if len(self) < REMEMBERED:
            self[word] = found
        return found

    def active(self, text: str) -> list[int]:
        return sorted({i for found in map(self.__getitem__, words_of(text)) if found for i in found})


def fit_machine(index: dict[int, int], rows: list[list[int]], y: np.ndarray, weight: np.ndarray, seed: int = 7, factors: int = FACTORS) -> Machine:
    """Weighted logistic loss, stochastic gradient descent with steps scaled by past gradients (AdaGrad). Without factors the machine is additive."""
    rng = np.random.default_rng(seed)
    n = len(index)
    rate = float((weight * y).sum() / weight.sum()) if len(y) else 0.0
    m = Machine(index, float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6))), np.zeros(n), rng.normal(0, 0.05, (n, factors)))
    gb, gw, gv = 1.0, np.full(n, 1e-2), np.full((n, factors), 1e-2)
    for _ in range(EPOCHS if 0 < rate < 1 else 0):
        for i in rng.permutation(len(rows)):
            a = rows[i]
            g = (1 / (1 + np.exp(-np.clip(m.logit(a), -30, 30))) - y[i]) * weight[i]
            gb += g * g
            m.bias -= RATE * g / np.sqrt(gb)
            if a:
                v = m.factors[a]
                dw = g + DECAY * m.weights[a]
                dv = g * (v.sum(axis=0) - v) + DECAY * v
                gw[a] += dw * dw
                gv[a] += dv * dv
                m.weights[a] -= RATE * dw / np.sqrt(gw[a])
                m.factors[a] -= RATE * dv / np.sqrt(gv[a])
    return m


def _sample(docs: DataFrame, labels: DataFrame, positives: int, negatives: int) -> tuple[DataFrame, dict[int, float]]:
    """(text, y) of the sampled labelled documents, and the weight of a row of each label, which restores the labels' shares."""
    marked = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(id_mod(F.col("doc_id"), 4) != 2).select("doc_id", (F.col("toxic") > 0).cast("int").alias("y")).distinct()
    ids, weight = [], {}
    shares = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    for y, most in ((1, positives), (0, negatives)):
        ids.append(marked.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
        weight[y] = shares.get(y, 0) / max(1, min(most, shares.get(y, 0)))
    scale = max(weight.values()) or 1.0
    chosen = ids[0].unionByName(ids[1])  # no more than `positives` + `negatives` rows
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return one.select("text", "y"), {y: w / scale for y, w in weight.items()}


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, factors: int = FACTORS) -> Machine:
    """A machine fitted on at most `positives` + `negatives` labelled rows whose crc32(doc_id) mod 4 is not 2.

    Which of the TABLE slots are known follows from their counts in the sampled documents, summed on the executors. Only the known
    slots and each sampled document's come to the driver. Labels that are null are not used; a labelled id counts once for each label it has, with the text of the least hash where
    several rows share it.
    """
    rows, weight = _sample(docs, labels, positives, negatives)
    rows = checkpointed(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                held: list[tuple[np.ndarray, int]] = []
                for text, y in zip(part["text"].to_pylist(), part["y"].to_pylist()):
                    held.append((np.unique(np.array([t for w in words_of(text) for t in terms_of(w)], dtype=np.int64)), y))
                all_terms = np.concatenate([h for h, _ in held])
                ys = np.repeat([y for _, y in held], [len(h) for h, _ in held])
                term, where = np.unique(all_terms, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(np.bincount(where, minlength=len(term))), pa.array(np.bincount(where, weights=ys, minlength=len(term)).astype(np.int64))], names=["term", "n", "pos"])

    total, pos_total = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    index: dict[int, int] = {}
    if 0 < pos_total < total:
        n, pos, neg_total = F.col("n"), F.col("pos"), total - pos_total
        det = pos * (neg_total - (n - pos)) - (n - pos) * (pos_total - pos)
        chi2 = F.lit(float(total)) * det * det / F.nullif(F.lit(float(pos_total) * neg_total) * n * (total - n), F.lit(0.0))
        counted = rows.mapInArrow(count, "term long, n long, pos long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
        best = counted.filter(n >= LEAST_DOCS).withColumn("chi2", chi2).filter(F.col("chi2") >= LEAST_CHI2)
        index = {t: i for i, t in enumerate(sorted(r["term"] for r in best.select("term").collect()))}

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        known = Known(index)
        for batch in batches:
            found = [known.active(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch["y"]], names=["active", "y"])

    data = sorted((list(r["active"]), r["y"]) for r in rows.mapInArrow(active, "active array<int>, y int").collect())
    y = np.array([v for _, v in data], dtype=np.float64)
    return fit_machine(index, [a for a, _ in data], y, np.array([weight[int(v)] for v in y]), factors=factors)


def score(df: DataFrame, machine: Machine, text: str = "text", column: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `df` (all if None) and the score of each row's whole text, between 0 and 1; null texts score as empty ones."""
    keep = keep if keep is not None else [c for c in df.columns if c != column]
    held = df.sparkSession.sparkContext.broadcast(machine)
    rows = df.select(*(F.col(c) for c in keep), F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        m = held.value
        known = Known(m.index)
        for batch in batches:
            z = np.array([m.logit(known.active(t.as_py())) for t in batch["_text"]])
            out = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(out, pa.float64())], names=[*keep, column])

    schema = rows.drop("_text").schema.add(column, "double")
    return rows.mapInArrow(run, schema)


def toxicity(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of `df`: key, held_out, score, predicted.

    The model learns from `labels` and the texts alone. Without labels of both kinds all scores are the share of
    toxic labels, or 0. Null and empty texts score as texts without terms, very long ones as a whole. A score equal to the threshold is toxic.
    Repeated rows stay; an empty table gives an empty result; other columns are not read.
    """
    docs = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    scored = score(docs, train(docs, labels), keep=["doc_id"])
    return scored.select(F.col("doc_id").alias(key), (id_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `df` (columns doc_id and text among them) that score below the threshold, all columns kept; see `toxicity`."""
    return score(df, train(df, labels), column="_score").filter(F.col("_score") < threshold).drop("_score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score."""
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
