"""Best-fit packing of tokenized documents into sequences."""

from __future__ import annotations

import math
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, documents, held, release, trim

#: Tokens, documents and attention cost (sum of squared piece lengths) that a sequence holds at most.
CAPACITY = (1024, 1024, 1024**2)
#: Weights of the three in the residual norm and the dot product.
WEIGHTS = (1.0, 1.0, 1.0)
#: The id after each document.
END = 2
#: Pieces shorter than a sequence that one group packs together, about; groups are dealt by hash.
GROUP_PIECES = 16_384
#: Runs of letters or marks, and other chunks, whose ids a worker remembers.
RUNS, CHUNKS = 600_000, 100_000
#: Bytes of text that are encoded at once; a longer text is encoded alone.
BLOCK = 4 << 20

#: Where a token begins whatever stands before: at a blank or line feed before a visible character.
_CHUNKS = re.compile(r"(?=[ \n]\S)").split
#: A chunk that is a word of Latin letters, which is one token run, and the ASCII marks that follow it, another; apostrophes may begin a contraction and are left out.
_PLAIN = r"^(?P<line>\n?)(?P<word>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter of each byte in a byte-level vocabulary: visible Latin-1 characters stand for themselves, the others for the characters from 256 on."""
    seen = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b > 173]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in seen)}


class Runs(dict):
    """run of text that tokens never cross -> its ids as little-endian bytes of 32-bit numbers; a line feed before a word is a run of its own."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters = model, byte_letters()

    def __missing__(self, run: str) -> bytes:
        if run[:1] == "\n" and len(run) > 1:
            return self["\n"] + self[run[1:]]
        found = array("I", [t.id for t in self.model.tokenize(run.encode().decode("latin-1").translate(self.letters))]).tobytes() if run else b""
        if len(self) < RUNS:
            self[run] = found
        return found


class Chunks(dict):
    """chunk -> the ids of a blank and the chunk, or of the chunk alone if it begins with a line feed; None if it begins with white space, so that what stands before it matters."""

    def __init__(self, whole):
        super().__init__()
        self.whole = whole

    def __missing__(self, chunk: str) -> bytes | None:
        line = chunk[:1] == "\n"
        visible = chunk[1:] if line else chunk
        if not visible or visible[0].isspace():
            return None
        found = self.whole(chunk if line else " " + chunk)
        if len(self) < CHUNKS:
            self[chunk] = found
        return found


def gathered(ids: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs number `at` of `ids`, whose lengths are `n`, one after the other, and where each ends."""
    first, n = (np.cumsum(n) - n)[at], n[at]
    ends = np.cumsum(n)
    return ids[np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], ends


def joined(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(held), dtype="<u4"), np.fromiter(map(len, held), dtype=np.int64, count=len(held)) // 4


class ChunkEncoder:
    """Token ids of whole texts, as `tokenizers` gives them with add_special_tokens=False.

    Texts are cut where a token begins whatever stands before, the distinct chunks of a block are encoded once, and their ids are
    put in the order of the texts. Chunks and words met before come from memory. Texts with several white-space characters in a row are cut at fewer places, those
    with the string of an added token (it keeps its own id) at it too.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else lambda text: [text]
        self.runs = Runs(self.tokenizer.model)
        self.chunks = Chunks(self.whole)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def careful(self, text: str) -> bytes:
        """The ids of any text."""
        out = []
        for part in self.cut_added(text):
            if part in self.added:
                out.append(self.whole(part))
            elif part:
                first, *more = _CHUNKS(part)
                out.append(self.whole(first))
                out += [self.chunks[c[1:] if c[0] == " " else c] for c in more]
        return b"".join(out)

    def distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all `chunks` one after the other, how many each has, and which begin with white space, so that they have none here."""
        parts = pc.extract_regex(chunks, _PLAIN)
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        line, word, marks = (parts.drop_null().field(k) for k in range(3))
        words = pc.binary_join_element_wise(pc.if_else(pc.equal(line, ""), " ", "\n"), word, "").dictionary_encode()
        marks = marks.dictionary_encode()
        others = list(map(self.chunks.__getitem__, chunks.filter(pa.array(~plain)).to_pylist()))
        held = [b"", *map(self.runs.__getitem__, words.dictionary.to_pylist())]
        after_words = len(held)
        held += map(self.runs.__getitem__, marks.dictionary.to_pylist())
        after_marks = len(held)
        held += [x or b"" for x in others]
        at = np.zeros((len(chunks), 2), dtype=np.int64)
        at[plain, 0] = words.indices.to_numpy() + np.int64(1)
        at[plain, 1] = marks.indices.to_numpy() + np.int64(after_words)
        at[~plain, 0] = after_marks + np.arange(len(others))
        loose = np.zeros(len(chunks), dtype=bool)
        loose[~plain] = [x is None for x in others]
        ids, ends = gathered(*joined(held), at.ravel())
        return ids, np.diff(ends[1::2], prepend=0), loose

    def __call__(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, `end` after each if given, and how many each has."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        starts, stops = offsets[:-1], offsets[1:]
        flat = split.flatten()
        coded = flat.dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int64)
        ids, n, loose = self.distinct(coded.dictionary)
        loose = loose[at]
        loose[starts] = False  # nothing stands before a first chunk
        odd = np.logical_or.reduceat(loose, starts)
        for token in self.added:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        first = [self.careful(texts[i].as_py()) if o else self.whole(c) if c else b"" for i, (o, c) in enumerate(zip(odd.tolist(), flat.take(pa.array(starts)).to_pylist()))]
        more, n_more = joined([*first, b"" if end is None else np.array([end], dtype="<u4").tobytes(), b""])
        at[np.repeat(odd, stops - starts)] = len(n) + len(texts) + 1
        at[starts] = len(n) + np.arange(len(texts))
        at = np.insert(at, stops, len(n) + len(texts))
        out, ends = gathered(np.concatenate([ids, more]), np.concatenate([n, n_more]), at)
        return out, np.diff(ends[stops + np.arange(len(texts))], prepend=0)


def encoder(path: str) -> ChunkEncoder:
    return held(f"encoder {path}", lambda: ChunkEncoder(path))


def blocks(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """`batch` in slices whose texts in `column` have about `size` bytes; a longer text is a slice of its own."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, end - at)
        at = end


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", most: int = CAPACITY[0], path: str | None = None) -> DataFrame:
    """A row for each piece: key, piece, start, length, ids_crc32. The first piece of a document may be shorter, the others have `most` tokens. A null text is empty: its only id is END."""
    path = path or tokenizer_path()
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        encode = encoder(path)
        for batch in batches:
            for part in blocks(batch, "text", BLOCK):
                ids, n = encode(pc.fill_null(part["text"], ""), END)
                parts = -(-n // most)
                row = np.repeat(np.arange(len(n)), parts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                short = (n - (parts - 1) * most)[row]
                start = np.where(piece > 0, short + (piece - 1) * most, 0)
                length = np.where(piece > 0, most, short)
                raw, begin = memoryview(ids.tobytes()), ((np.cumsum(n) - n)[row] + start) * 4
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + length * 4).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part["key"].take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["key", "piece", "start", "length", "ids_crc32"],
                )

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: tuple[int, ...] = CAPACITY, weights: tuple[float, ...] = WEIGHTS, rule: str = "norm") -> np.ndarray:
    """For each piece the number of its bin; long pieces come first, ties in the order given.

    A piece with demand d goes to the open bin with residual r >= d in every coordinate that has the least weighted norm of r - d
    (rule "norm") or the greatest weighted dot product of r and d ("dot"), all in shares of the capacity. If none has room, it opens a bin.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    demand = np.stack([lengths, np.ones_like(lengths), lengths * lengths], axis=1) / np.asarray(capacity, dtype=np.float64)
    if (demand > 1).any():
        raise ValueError("a piece is larger than a sequence")
    bins = np.empty(len(lengths), dtype=np.int64)
    residual = [np.empty(max(16, len(lengths))) for _ in capacity]
    number = np.empty(len(residual[0]), dtype=np.int64)
    n_open, n_bins = 0, 0
    smallest = demand[order[-1]] - 1e-12 if len(order) else None
    for step, i in enumerate(order.tolist()):
        d = demand[i].tolist()
        if step % 128 == 127:  # bins that hold no more piece are closed
            keep = np.logical_and.reduce([r[:n_open] >= s for r, s in zip(residual, smallest)])
            n = int(keep.sum())
            for x in (*residual, number):
                x[:n] = x[:n_open][keep]
            n_open = n
        fits = np.flatnonzero(residual[0][:n_open] >= d[0] - 1e-12)
        for r, x in zip(residual[1:], d[1:]):
            fits = fits[r[fits] >= x - 1e-12]
        if len(fits):
            left = [r[fits] for r in residual]
            if rule == "norm":
                at = fits[np.argmin(sum(w * (r - x) ** 2 for w, r, x in zip(weights, left, d)))]
            else:
                at = fits[np.argmax(sum(w * x * r for w, r, x in zip(weights, left, d)))]
            for r, x in zip(residual, d):
                r[at] -= x
            bins[i] = number[at]
        else:
            for r, x in zip(residual, d):
                r[n_open] = 1.0 - x
            number[n_open] = bins[i] = n_bins
            n_open, n_bins = n_open + 1, n_bins + 1
    return bins


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: tuple[int, int, int] = CAPACITY, weights: tuple[float, ...] = WEIGHTS, rule: str = "norm", group_pieces: int = GROUP_PIECES, path: str | None = None) -> DataFrame:
    """A row for each piece of a document: key, piece, start, length, ids_crc32, sequence_id, offset.

    Documents are cut into pieces of as many tokens as the capacities for tokens and attention cost let one sequence hold. A piece that fills a
    sequence's tokens is a sequence of its own; the others are dealt by a hash of their row number, so evenly whatever repeats, to groups of about `group_pieces`. A group
    packs its own sequences in one task of bounded size, and at most its last sequences stay part empty; ties in length go by ids, key and piece. Null and
    empty texts are one piece of one token. Very long texts are many pieces. Repeated rows are packed each. An empty table gives an empty result.
    Other columns are not read. Pieces, without texts, are kept in the shared folder.
    """
    kind = dict(df.dtypes)[key]
    most = min(capacity[0], math.isqrt(capacity[2]))
    made = checkpointed(pieces(df, key, text, most, path).withColumn("row", F.monotonically_increasing_id()))
    names = ["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = made.filter(F.col("length") == capacity[0]).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    open_ = made.filter(F.col("length") != capacity[0])
    groups = max(1, -(-open_.count() // group_pieces))
    dealt = open_.select(*names[:5], F.pmod(F.xxhash64("row"), F.lit(groups)).cast("long").alias("pack_group"))

    def one(table: pa.Table) -> pa.Table:
        release()
        table = table.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("key", "ascending"), ("piece", "ascending")])
        lengths = table["length"].to_numpy()
        bins = best_fit(lengths, capacity, weights, rule)
        by_bin = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[by_bin])
        first = np.flatnonzero(np.diff(bins[by_bin], prepend=-1))
        offset = np.empty(len(bins), dtype=np.int64)
        offset[by_bin] = ends - lengths[by_bin] - np.repeat((ends - lengths[by_bin])[first], np.diff(np.append(first, len(bins))))
        group = table["pack_group"][0].as_py()
        return pa.table([*(table[c] for c in names[:5]), pa.array((group << 32) + bins), pa.array(offset)], names=names)

    packed = dealt.groupBy("pack_group").applyInArrow(one, f"key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return packed.unionByName(full.select(*names)).withColumnRenamed("key", key)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    return pack(documents(spark, sf_dir))
