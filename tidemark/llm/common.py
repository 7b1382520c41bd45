"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the `documents` table, which every pipeline stage but the last returns.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: White space between words: blank and the controls 9 to 13, as a Java pattern.
SPACE = r"[\x20\x09-\x0D]+"


#: What a Python worker keeps from one task to the next, such as a tokenizer and the chunks it knows.
_held: dict[str, object] = {}


def held(name: str, make):
    """What this worker keeps under `name`; made if it has none."""
    if name not in _held:
        _held[name] = make()
    return _held[name]


def release() -> None:
    """Lets go of what this worker keeps. Tasks of other operators begin with it, so that a reused worker holds the memory of one operator at a time."""
    _held.clear()
    trim()


def trim() -> None:
    """Gives memory that this worker has freed back to the system, which allocators else keep from one task to the next; large arrays go back at once from then on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a session of one machine (tests) gets a temporary one, and any other an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df`, computed once and read back from the shared folder, so that no lost executor can take it along."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def require_whole(df: DataFrame, key: str) -> None:
    """An error if the column `key` does not hold whole numbers, which some operators store as 64-bit ones."""
    if dict(df.dtypes)[key] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} must be of whole numbers")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of `df` has."""
    out = []
    for name in names:
        while name in df.columns:
            name = f"_{name}"
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once for a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text as an array, null texts as none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def id_mod(doc_id: Column, divisor: int) -> Column:
    """crc32 of the decimal form of an id, modulo `divisor`; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor
