"""Vectors as short codes of codebook entries, found by partial-distance search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, release

#: Components are stored as floor(SCALE * x), vectors are cut into PARTS equal parts, each with a codebook of ENTRIES entries that ROUNDS rounds move.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Parts that are held against a codebook at once, dimensions whose distances all entries get before the first complete distance is known, and components that a task unpacks at once, about.
BLOCK, LEAD, UNPACKED = 1024, 4, 1 << 20


def finite(vector) -> F.Column:
    """Whether a vector has components and none is null or not finite; null vectors give false."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & whole, F.lit(False))


def scaled(column: pa.Array, dims: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of all components of equally long vectors, a row for each vector."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if x.size and np.abs(x).max() >= 1 << 31:
        raise OverflowError("components must stay below 2**31 when scaled")
    return x.astype(np.int64).reshape(-1, dims)


def pieces(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in batches of about UNPACKED components."""
    rows = max(1, UNPACKED // max(1, dims))
    for batch in batches:
        yield from (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def _fits(bound: int) -> type:
    """The narrowest integers that hold `bound`."""
    if bound < 1 << 31:
        return np.int32
    if bound < 1 << 63:
        return np.int64
    raise OverflowError("squared distances pass 64 bits")


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of `x` the first of the nearest rows of `book` and its squared distance, exact in integers.

    Dimensions come in descending order of their variance in the codebook. After the first LEAD of them the entry that is nearest so far is
    completed; from then on an entry is dropped as soon as its sum strictly exceeds the least complete distance. Halfway the one that is nearest
    among those left is completed too, which lowers that bound.
    """
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    most = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    kind = _fits(max(1, x.shape[1]) * (2 * most + 1) ** 2)
    x, book = np.ascontiguousarray(x[:, order], dtype=kind), np.ascontiguousarray(book[:, order], dtype=kind)
    index, error = np.empty(len(x), dtype=np.int64), np.empty(len(x), dtype=np.int64)
    for at in range(0, len(x), BLOCK):
        index[at : at + BLOCK], error[at : at + BLOCK] = _nearest_of_block(x[at : at + BLOCK], book)
    return index, error


def _complete(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    gap = x - chosen
    return (gap * gap).sum(axis=1, dtype=gap.dtype)


def _nearest_of_block(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = x.shape[1]
    lead = min(LEAD, width)
    so_far = np.zeros((len(x), len(book)), dtype=x.dtype)
    for d in range(lead):
        gap = x[:, d, None] - book[None, :, d]
        so_far += gap * gap
    best = _complete(x, book[so_far.argmin(axis=1)])
    row, entry = np.nonzero(so_far <= best[:, None])
    partial = so_far[row, entry]
    for d in range(lead, width):
        if d == width // 2:
            starts = np.searchsorted(row, np.arange(len(x)))
            least = np.minimum.reduceat(partial, starts)
            first = np.flatnonzero(partial == least[row])
            first = first[np.searchsorted(row[first], np.arange(len(x)))]
            best = np.minimum(best, _complete(x, book[entry[first]]))
        gap = x[row, d] - book[entry, d]
        partial += gap * gap
        keep = partial <= best[row]
        row, entry, partial = row[keep], entry[keep], partial[keep]
    least = np.minimum.reduceat(partial, np.searchsorted(row, np.arange(len(x))))
    first = np.flatnonzero(partial == least[row])
    first = first[np.searchsorted(row[first], np.arange(len(x)))]
    return entry[first], least


def kept_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """`df` without rows whose vector is null, empty or holds null or non-finite components."""
    return df.filter(finite(F.col(vector)))


def first_entries(kept: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """(part, entry, component): the vectors of the least keys, ascending, in parts; null keys come last and equal keys by their vectors. None without rows."""
    rows = kept.orderBy(F.col("key").asc_nulls_last(), "vector").limit(entries).select(F.transform("vector", lambda x: x.cast("double")).alias("v")).collect()
    if not rows:
        return None
    dims = len(rows[0]["v"])
    if dims % parts:
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts")
    alike = [r["v"] for r in rows if len(r["v"]) == dims]
    ints = scaled(pa.array(alike, pa.list_(pa.float64())), dims)
    return ints.reshape(len(alike), parts, dims // parts).transpose(1, 0, 2)


def moved(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry becomes the floor of the mean of the parts that are nearest to it, entries that no part uses stay.

    A task adds up its parts and sends a row of sums for each entry that it used; the driver gets one row for each entry of the codebooks.
    """
    parts, entries, width = books.shape
    held = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        books = held.value
        sums, counts = np.zeros((parts, entries, width), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for batch in pieces(batches, parts * width):
            x = scaled(batch["vector"], parts * width)
            for p in range(parts):
                part = x[:, p * width : (p + 1) * width]
                index, _ = nearest(part, books[p])
                order = np.argsort(index, kind="stable")
                used, starts = np.unique(index[order], return_index=True)
                if len(used):
                    sums[p, used] += np.add.reduceat(part[order], starts, axis=0)
                    counts[p] += np.bincount(index, minlength=entries)
        p, e = np.nonzero(counts)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * width), pa.array(sums[p, e].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), flat], names=["part", "entry", "n", "sums"])

    sent = kept.select("vector").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    total = sent.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums"))
    out = books.copy()
    for r in total.collect():
        out[r["part"], r["entry"]] = [s // r["n"] for s in r["sums"]]
    held.unpersist()
    return out


def trained(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (part, entry, component) of (key, vector) rows: the first entries, moved `rounds` times over all rows. None without rows."""
    books = first_entries(kept, parts, entries)
    for _ in range(rounds if books is not None else 0):
        books = moved(kept.filter(F.size("vector") == books.shape[0] * books.shape[2]), books)
    return books


def assigned(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """`kept`, without its vectors, with `code` (two hexadecimal digits for each part) and `error`, the squared distances of all parts."""
    parts, _, width = books.shape
    rest = [c for c in kept.columns if c != "vector"]
    held = kept.sparkSession.sparkContext.broadcast(books)
    schema = kept.select(*rest).withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in pieces(batches, parts * width):
            x = scaled(batch["vector"], parts * width)
            found = [nearest(x[:, p * width : (p + 1) * width], held.value[p]) for p in range(parts)]
            digits = np.stack([i for i, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            code = [digits[at : at + 2 * parts] for at in range(0, len(digits), 2 * parts)]
            error = sum(e for _, e in found)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=[*rest, "code", "error"])

    return kept.select(*rest, "vector").mapInArrow(run, schema)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components, decimal, in the order of part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compressed(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """A row for each row of `df` with a usable vector: key, code, error, label_error, codebooks_sha256.

    Rows whose vector is null, empty or holds null or non-finite components are dropped. The first usable vector by key says how many components a vector
    has, which must be a multiple of `parts`; rows with another number keep a null code and error, and count for nothing else. Null keys come last among the first entries, equal keys
    (repeated rows) are told apart by their vectors and stay; with fewer rows than `entries` the codebooks are shorter. `label_error` sums `error` over equal labels,
    null ones together. Scaled components of 2**31 or more are an error. An empty table gives an empty result; other columns are not read.

    `df` is read once for each round and twice more; checkpoint it first if it is dear to compute. Codebooks (parts * entries entries) are broadcast.
    """
    if entries > 256:
        raise ValueError("two hexadecimal digits name 256 entries at most")
    kept = kept_rows(df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector")), "key", "vector")
    books = trained(kept, parts, entries, rounds)
    if books is None:
        coded, sha = kept.select("key", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), None
    else:
        dims = books.shape[0] * books.shape[2]
        other = kept.filter(F.size("vector") != dims).select("key", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        coded, sha = checkpointed(assigned(kept.filter(F.size("vector") == dims), books).unionByName(other)), digest(books)
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    out = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(sha).cast("string").alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding's code and error."""
    return compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL of the query: every part against every entry, the rounds written out one after the other."""
    steps = [f"""kept AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {SCALE})) AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS MATERIALIZED (
    SELECT vec_id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v FROM kept, (SELECT unnest(range({parts})) AS p)
), first AS (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries}
), book0 AS MATERIALIZED (
    SELECT p, e, v FROM cut JOIN first USING (vec_id)
)"""]  # fmt: skip
    near = "SELECT c.vec_id, c.label, c.p, min((list_inner_product(c.v, c.v) - 2 * list_inner_product(c.v, b.v) + list_inner_product(b.v, b.v)) * 256 + b.e)::BIGINT AS k FROM cut c JOIN book{0} b ON c.p = b.p GROUP BY c.vec_id, c.label, c.p"
    for n in range(rounds):
        steps.append(f"""near{n} AS MATERIALIZED ({near.format(n)}), mean{n} AS (
    SELECT p, e, list(m ORDER BY i) AS v FROM (
        SELECT p, e, i, floor(sum(v[i]) / count(*)) AS m FROM (SELECT c.p, n.k % 256 AS e, c.v, unnest(range(1, len(c.v) + 1)) AS i FROM cut c JOIN near{n} n ON c.vec_id = n.vec_id AND c.p = n.p) GROUP BY p, e, i
    ) GROUP BY p, e
), book{n + 1} AS MATERIALIZED (
    SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{n} b LEFT JOIN mean{n} m ON b.p = m.p AND b.e = m.e
)""")  # fmt: skip
    steps.append(f"last AS MATERIALIZED ({near.format(rounds)})")
    return f"""WITH {", ".join(steps)}, coded AS (
    SELECT vec_id, label, string_agg(printf('%02x', k % 256), '' ORDER BY p) AS code, CAST(sum(k // 256) AS BIGINT) AS error FROM last GROUP BY vec_id, label
), sha AS (
    SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS s FROM (SELECT p, e, unnest(v) AS x, unnest(range(len(v))) AS i FROM book{rounds})
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM coded, sha"""
