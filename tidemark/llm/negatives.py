"""Hard negatives by ball trees: rows of other labels whose score lies in a window below a positive's."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.codes import finite, scaled
from tidemark.llm.common import checkpointed, release

#: Components become floor(SCALE * x).
SCALE = 256
#: Positives of an anchor, negatives of a positive, and the window of a negative's score in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Rows of a tree and queries that are broadcast at once, about, at 64 components or fewer (more components make both smaller in proportion), and rows of a leaf.
TREE_ROWS, QUERIES_AT_ONCE, LEAF_ROWS = 16_384, 16_384, 128
#: Queries that walk a tree together.
TOGETHER = 2_048
#: A null key in the ranking: after all others.
LAST = (1 << 63) - 1
LEAST, MOST = -(1 << 62), 1 << 62


@dataclass
class Node:
    """Rows [first, last) of a tree: the ball around them and the range of their labels."""

    first: int
    last: int
    center: np.ndarray
    radius: float
    labels: tuple[int, int]
    children: tuple[Node, Node] | None = None


@dataclass
class Rows:
    """Vectors (whole numbers in floats that hold every inner product exactly), keys and labels, in the order of a tree."""

    vectors: np.ndarray
    keys: np.ndarray
    labels: np.ndarray


def exact_floats(most: int, dims: int) -> type:
    """The narrowest floats in which sums of `dims` products of numbers up to `most` are exact."""
    bound = dims * most * most
    if bound < 1 << 24:
        return np.float32
    if bound < 1 << 53:
        return np.float64
    raise OverflowError("inner products pass 53 bits")


def ball_tree(rows: Rows, leaf_rows: int = LEAF_ROWS) -> Node:
    """A tree over `rows`, which are put in its order: each node is cut in half along the line between two far points of it."""
    order = np.arange(len(rows.keys))
    x = rows.vectors.astype(np.float64)

    def grown(first: int, last: int) -> Node:
        at = order[first:last]
        center = x[at].mean(axis=0)
        gaps = np.sqrt(((x[at] - center) ** 2).sum(axis=1))
        node = Node(first, last, center, float(gaps.max()), (int(rows.labels[at].min()), int(rows.labels[at].max())))
        if last - first > leaf_rows:
            one = x[at[gaps.argmax()]]
            other = x[at[((x[at] - one) ** 2).sum(axis=1).argmax()]]
            half = (last - first) // 2
            order[first:last] = at[np.argpartition(x[at] @ (other - one), half)]
            node.children = grown(first, first + half), grown(first + half, last)
        return node

    root = grown(0, len(order))
    rows.vectors, rows.keys, rows.labels = rows.vectors[order], rows.keys[order], rows.labels[order]
    return root


class Search:
    """The best `k` rows of each query so far: higher scores first, equal ones by smaller key.

    A query takes rows of its own label, without those of its own key, or rows of other labels, whose score is from `low` to `high`.
    """

    def __init__(self, keys: np.ndarray, labels: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.keys, self.labels, self.vectors, self.low, self.high, self.k, self.same = keys, labels, vectors, low, high, k, same
        self.lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        self.scores = np.full((len(keys), k), LEAST, dtype=np.int64)
        self.found = np.full((len(keys), k), LAST, dtype=np.int64)

    def add(self, rows: Rows) -> None:
        root = ball_tree(rows)
        for at in range(0, len(self.keys), TOGETHER):
            self._visit(root, rows, np.arange(at, min(at + TOGETHER, len(self.keys))))

    def _middle(self, node: Node, at: np.ndarray) -> np.ndarray:
        return self.vectors[at].astype(np.float64) @ node.center

    def _visit(self, node: Node, rows: Rows, at: np.ndarray) -> None:
        """Looks at `node` for the queries `at`, as far as its bounds leave them: a score in the ball lies within a query's length times the radius of the center's."""
        least, most = node.labels
        at = at[(least <= self.labels[at]) & (self.labels[at] <= most)] if self.same else at[(least != most) | (self.labels[at] != least)]
        if not len(at):
            return
        middle, reach = self._middle(node, at), self.lengths[at] * (node.radius * (1 + 1e-9) + np.linalg.norm(node.center) * 1e-12) + 1e-3  # with room for rounding
        open_ = (middle + reach >= np.maximum(self.low[at], self.scores[at, -1])) & (middle - reach <= self.high[at])
        at = at[open_]
        if not len(at):
            return
        if node.children is None:
            self._look(rows, node, at)
            return
        left, right = node.children
        nearer = self._middle(left, at) >= self._middle(right, at)
        self._visit(left, rows, at[nearer])  # each query goes to its nearer child first
        self._visit(right, rows, at)
        self._visit(left, rows, at[~nearer])

    def _look(self, rows: Rows, node: Node, at: np.ndarray) -> None:
        keys, labels = rows.keys[node.first : node.last], rows.labels[node.first : node.last]
        scores = (self.vectors[at] @ rows.vectors[node.first : node.last].T).astype(np.int64)
        fits = (labels[None, :] == self.labels[at, None]) == self.same
        if self.same:
            fits &= keys[None, :] != self.keys[at, None]
        fits &= (scores >= self.low[at, None]) & (scores <= self.high[at, None])
        scores[~fits] = LEAST
        k = min(self.k, scores.shape[1])
        bound = np.maximum(np.partition(scores, -k, axis=1)[:, -k], self.scores[at, -1])
        better = (scores > self.scores[at, -1, None]) | (keys[None, :] < self.found[at, -1, None])
        q, r = np.nonzero((scores >= bound[:, None]) & better & fits)
        if not len(q):
            return
        touched = np.unique(q)
        query = np.concatenate([np.repeat(touched, self.k), q])
        score = np.concatenate([self.scores[at[touched]].reshape(-1), scores[q, r]])
        key = np.concatenate([self.found[at[touched]].reshape(-1), keys[r]])
        order = np.lexsort((key, -score, query))
        query, score, key = query[order], score[order], key[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        best = place < self.k
        self.scores[at[query[best]], place[best]], self.found[at[query[best]], place[best]] = score[best], key[best]


def at_dims(size: int, dims: int) -> int:
    """`size` at 64 components, less in proportion at more."""
    return max(1, size * 64 // max(64, dims))


def searched(rows: DataFrame, queries: DataFrame, k: int, same: bool, dims: int) -> DataFrame:
    """(q, key, score, rank): of `rows` (key, label, vector of `dims`) the best `k` for each of `queries` (q, key, label, vector, low, high), whose q are unique.

    Queries meet the rows in parts of about QUERIES_AT_ONCE, each broadcast and then let go; rows stay where they are read. A task grows a tree for every
    TREE_ROWS rows that it reads, carries each query's best from one tree to the next and sends k rows a query at most.
    """
    spark = rows.sparkSession
    parts, tree_rows = max(1, -(-queries.count() // at_dims(QUERIES_AT_ONCE, dims))), at_dims(TREE_ROWS, dims)
    found = []
    for part in range(parts):
        table = queries.filter(F.pmod(F.xxhash64("q"), F.lit(parts)) == part).toArrow()
        if not table.num_rows:
            continue
        held = spark.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            release()
            table = held.value.combine_chunks()
            q, key, label, low, high = (table[c].to_numpy() for c in ("q", "key", "label", "low", "high"))
            vectors, search = scaled(table["vector"].combine_chunks(), dims, 1), None
            waiting, n = [], 0

            def grow() -> None:
                nonlocal search, waiting, n
                x = np.concatenate([scaled(b["vector"], dims, 1) for b in waiting])
                kind = exact_floats(int(max(np.abs(x).max(), np.abs(vectors).max())), dims)
                if search is None or np.dtype(kind).itemsize > search.vectors.itemsize:
                    before, search = search, Search(key, label, vectors.astype(kind), low, high, k, same)
                    if before is not None:
                        search.scores, search.found = before.scores, before.found
                search.add(Rows(x.astype(search.vectors.dtype), *(np.concatenate([b[c].to_numpy() for b in waiting]) for c in ("key", "label"))))
                waiting, n = [], 0

            for batch in (whole.slice(at, tree_rows) for whole in batches for at in range(0, whole.num_rows, tree_rows)):
                waiting.append(batch)
                n += batch.num_rows
                if n >= tree_rows:
                    grow()
            if n:
                grow()
            if search is not None:
                at, place = np.nonzero(search.scores > LEAST)
                yield pa.RecordBatch.from_arrays([pa.array(q[at]), pa.array(search.found[at, place]), pa.array(search.scores[at, place])], names=["q", "key", "score"])

        by = Window.partitionBy("q").orderBy(F.desc("score"), "key")
        best = rows.select("key", "label", "vector").mapInArrow(run, "q long, key long, score long")
        found.append(checkpointed(best.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)))
        held.unpersist()
    if not found:
        return spark.createDataFrame([], "q long, key long, score long, rank int")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def hard_negatives(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", anchors: str = "vec_id % 50 = 0", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """For each anchor and positive a row for each hard negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null label, or a vector that is null, empty or holds null or non-finite components, take no part; nor do rows whose vectors are of another length than that of the first usable row by key.
    Keys and labels are whole numbers. A score is the inner product of vectors of floor(scale * x); higher scores come first, ties by smaller key. `anchors`, an expression over `key`, names the anchors, null keys are none.
    An anchor's positives are its best rows of the same label and of another key; a positive's negatives are the best rows of other labels with low * p <= 100 * n <= high * p, of its score p and theirs n. Rows
    without a key come last among ties and are returned with a null one. Repeated rows are rows of their own. Scores beyond 53 bits are an error. An empty table gives an empty result; other columns are not read.
    """
    kept = df.select(F.col(key).cast("long").alias(key), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector")).filter(F.col("label").isNotNull() & finite(F.col("vector")))
    first = kept.orderBy(F.col(key).asc_nulls_last(), "vector").select(F.size("vector").alias("n")).limit(1).collect()
    dims = first[0]["n"] if first else 0
    ints = F.transform("vector", lambda x: F.floor(x.cast("double") * scale).cast("int"))
    rows = checkpointed(kept.filter(F.size("vector") == dims).select(F.coalesce(F.col(key), F.lit(LAST)).alias("key"), "label", ints.alias("vector"), (F.col(key).isNotNull() & F.expr(anchors)).alias("anchor")))
    asked = checkpointed(rows.filter("anchor").select(F.monotonically_increasing_id().alias("q"), "key", "label", "vector", F.lit(LEAST).alias("low"), F.lit(MOST).alias("high")))
    best = searched(rows, asked, positives, True, dims)
    p = F.col("positive_score")
    pairs = asked.select("q", F.col("key").alias("anchor_id"), "label", "vector").join(best.select("q", F.col("key").alias("positive_id"), F.col("score").alias("positive_score")), "q")
    pairs = pairs.withColumn("low", F.ceil(F.lit(low) * p / 100).cast("long")).withColumn("high", F.floor(F.lit(high) * p / 100).cast("long"))
    pairs = checkpointed(pairs.withColumn("q", F.monotonically_increasing_id()))
    windows = pairs.filter("low <= high").select("q", F.col("anchor_id").alias("key"), "label", "vector", "low", "high")
    mined = searched(rows, windows, negatives, False, dims).withColumnsRenamed({"key": "negative_id", "score": "negative_score"})
    known = lambda c: F.nullif(F.col(c), F.lit(LAST)).alias(c)
    return pairs.select("q", "anchor_id", "positive_id", "positive_score").join(mined, "q").select("anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth embedding; every seventh one's label first becomes the next."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))


SQL = """
WITH rows AS MATERIALIZED (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v
    FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score FROM rows a, rows r WHERE a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 3"""
