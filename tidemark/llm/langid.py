"""Language identification by averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, documents, id_mod, release

#: Documents that the model is fitted on at most: the languages take turns, each with its first document by a hash of its id; a fifth of them calibrate it.
SAMPLE = 4_000
#: Lots in which the ranks of one language are thinned out before one task puts them in order.
LOTS = 256
#: Subwords of 3 and 4 bytes share this many buckets; bucket 0 is for none.
BUCKETS = 1 << 15
DIMENSION, EPOCHS, RATE = 16, 20, 1.0
#: `accepted` holds down to the confidence at which this share of the calibration documents is right.
PRECISION = 0.99
#: Bytes of text whose subwords are looked up at once.
BLOCK = 1 << 19
UNKNOWN = "und"

#: ASCII bytes that are no letters become blanks; lower case is made before.
_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def normal(text: str) -> bytes:
    return b" " + text.lower().encode().translate(_LETTERS) + b" "


def subwords(raw: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of the subwords at each byte, for 3 and for 4 bytes; a subword may begin or end with a blank but has none inside."""
    b = raw.astype(np.uint32)
    blank = raw == 32
    three = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
    inside = blank[1:-1]
    shift, mask = np.uint32(17), np.uint32(BUCKETS - 1)
    yield np.where(inside, 0, np.maximum((three * np.uint32(2654435761)) >> shift & mask, 1))
    four = three[:-1] | (b[3:] << np.uint32(24))
    yield np.where(inside[:-1] | inside[1:], 0, np.maximum((four * np.uint32(2246822519)) >> shift & mask, 1))


def parts(text: str) -> Iterator[bytes]:
    """A whole text, normalized, in parts of about BLOCK bytes that begin and end with a blank, so no subword is lost or made between them; only words longer than that are cut."""
    raw = normal(text)
    at = 0
    while len(raw) - at > BLOCK:
        end = raw.rfind(b" ", at + 1, at + BLOCK)
        if end < 0:
            yield b" " + raw[at : at + BLOCK].strip() + b" "
            at += BLOCK
        else:
            yield raw[at : end + 1]
            at = end
    yield b" " + raw[at:] + b"  "


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text and their shares."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for part in parts(text):
        for h in subwords(np.frombuffer(part, dtype=np.uint8)) if len(part) > 3 else ():
            counts += np.bincount(h, minlength=BUCKETS)
    counts[0] = 0
    at = np.flatnonzero(counts)
    return at.astype(np.int32), (counts[at] / max(1, counts.sum())).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    #: By bucket: a language's logit (embedding times softmax weights), or the embedding where there are more languages than dimensions; a last column counts subwords.
    table: np.ndarray
    weights: np.ndarray | None
    bias: np.ndarray
    temperature: float
    least: float

    def logits(self, texts: list[str]) -> np.ndarray:
        """For each whole text; blocks of many texts are looked up together, long texts in several blocks."""
        sums = np.zeros((len(texts), self.table.shape[1]), dtype=np.float64)
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            nonlocal held, size
            if held:
                raw = np.frombuffer(b"".join(x for _, x in held), dtype=np.uint8)
                starts = np.cumsum([0, *(len(x) for _, x in held)])[:-1]
                for h in subwords(raw):
                    per = np.add.reduceat(self.table[h], np.minimum(starts, len(h) - 1), axis=0)
                    np.add.at(sums, [i for i, _ in held], per)
            held, size = [], 0

        for i, text in enumerate(texts):
            for part in parts(text):
                held.append((i, part if len(part) > 3 else part + b"    "))
                size += len(part)
                if size >= BLOCK:
                    flush()
        flush()
        mean = sums[:, :-1] / np.maximum(sums[:, -1:], 1)
        return (mean if self.weights is None else mean @ self.weights) + self.bias

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        p = softmax(self.logits(texts) / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_model(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, languages: list[str], seed: int = 7) -> Model:
    """Stochastic gradient descent, one document a step, the rate falling to zero; a fifth of the documents set temperature and rejection."""
    rng = np.random.default_rng(seed)
    n = len(languages)
    e = rng.uniform(-1, 1, (BUCKETS, DIMENSION)).astype(np.float32) / DIMENSION
    w, b = np.zeros((DIMENSION, n), dtype=np.float32), np.zeros(n, dtype=np.float32)
    mix = rng.permutation(len(bags))
    calibrate, learn = mix[: len(bags) // 5], mix[len(bags) // 5 :]
    steps, done = EPOCHS * max(1, len(learn)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(learn):
            at, share = bags[i]
            x = share @ e[at]
            g = softmax((x @ w + b)[None])[0]
            g[y[i]] -= 1
            g *= RATE * (1 - done / steps)
            back = w @ g
            w -= np.outer(x, g)
            b -= g
            e[at] -= np.outer(share, back)
            done += 1
    e[0] = 0
    logits = np.array([share @ e[at] @ w + b for at, share in (bags[i] for i in calibrate)]).reshape(-1, n)
    truth = y[calibrate]
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.05, 10, 60), key=loss)) if len(truth) else 1.0
    least = 0.0
    if len(truth):
        p = softmax(logits / temperature)
        sure, right = p.max(axis=1), p.argmax(axis=1) == truth
        order = np.argsort(-sure)
        good = np.flatnonzero(np.cumsum(right[order]) >= PRECISION * np.arange(1, len(order) + 1))
        least = float(sure[order][good[-1]]) if len(good) else 1.0
    table = np.column_stack([e @ w if n <= DIMENSION else e, np.ones(BUCKETS)]).astype(np.float32)
    table[0] = 0
    return Model(languages, table, None if n <= DIMENSION else w, b, temperature, least)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of (doc_id, text, lang): at most `sample` rows whose lang is not null and crc32(doc_id) mod 5 is not 0.

    The sample has as many documents of each language as of any other, as far as it has them, so that rare languages are learned too; each of
    `sample` languages has one at least. An id counts once for each of its languages, with the text of the least hash where several rows share it. Whole texts are turned into bucket
    shares on the executors; only these come to the driver. Without such rows the model has no language.
    """
    usable = docs.filter("lang IS NOT NULL").filter(id_mod(F.col("doc_id"), 5) != 0).select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    turn = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id"))
    ranked = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).distinct()
    lots = ranked.withColumn("lot", F.spark_partition_id() % LOTS).withColumn("turn", turn("lang", "lot")).filter(F.col("turn") <= sample)  # `sample` ranks of a language for each task and then for each lot, so that no task ranks all
    ranked = lots.withColumn("turn", turn("lang")).filter(F.col("turn") <= sample)
    ids = ranked.orderBy("turn", "h", "lang", "doc_id").limit(sample).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))  # bounded, so broadcast
    rows = usable.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")), "left_semi")
    rows = rows.groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            bags = [bag(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["lang"], pa.array([a for a, _ in bags], pa.list_(pa.int32())), pa.array([s for _, s in bags], pa.list_(pa.float32()))], names=["doc_id", "lang", "at", "share"])

    found = checkpointed(rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang string, at array<int>, share array<float>")).toArrow()
    if not len(found):
        return Model([], np.zeros((BUCKETS, 1), dtype=np.float32), None, np.zeros(0), 1.0, 1.0)
    found = found.sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    languages = sorted(set(found["lang"].to_pylist()))
    number = {x: i for i, x in enumerate(languages)}
    bags, y = [], []
    for lang, at, share in zip(found["lang"].to_pylist(), found["at"], found["share"]):
        bags.append((at.values.to_numpy(), share.values.to_numpy()))
        y.append(number[lang])
    return fit_model(bags, np.array(y), languages)


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """A row for each row of `df`: key, held_out, lang_pred, score, accepted.

    Texts that are null or have no letter are `und` with score 0, as are all texts if nothing could be learned. `score` is the calibrated
    probability of lang_pred, and `accepted` whether it reaches the level of the calibrated rejection. Equal probabilities go to the first language by code point; very long texts
    are read whole. Repeated rows stay, an empty table gives
    an empty result, other columns are not read; `lang` is read for learning only.
    """
    docs = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    held = df.sparkSession.sparkContext.broadcast(train(docs))
    rows = docs.select("doc_id", F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model = held.value
        for batch in batches:
            texts = batch["text"].to_pylist()
            some = [i for i, t in enumerate(texts) if t is not None] if model.languages else []
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for at in range(0, len(some), 512):
                part = some[at : at + 512]
                best, p = model.predict([texts[i] for i in part])
                for i, k, q in zip(part, best, p):
                    pred[i], score[i] = model.languages[k], q
            sure = [x != UNKNOWN and s >= model.least for x, s in zip(pred, score)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(pred, pa.string()), pa.array(score), pa.array(sure, pa.bool_())], names=["doc_id", "lang_pred", "score", "accepted"])

    out = rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, accepted boolean")
    return out.select(F.col("doc_id").alias(key), (id_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "accepted")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language."""
    return identify(documents(spark, sf_dir))
