"""Shared pieces of the text operators: words, row keys, stored intermediates, Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.storage import own_dir, shared_dir, store  # noqa: F401

#: A word is a run of anything but the six ASCII white space characters; bytes.split() cuts at the same ones.
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, opened by Spark's reader alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(text: Column) -> Column:
    """The text as bytes, null as none: Python then meets no invalid string."""
    return F.coalesce(text, F.lit("")).cast("binary")


def text_key(text: Column) -> Column:
    """128 bits of the text as 32 hexadecimal digits; null counts as empty."""
    return F.md5(utf8(text))


_KEPT: list[dict] = []


def kept_by_worker() -> dict:
    """A dictionary that outlives a task. Tasks of other operators empty it, so that a worker holds the memory of one operator only."""
    _KEPT.append({})
    return _KEPT[-1]


def fresh(keep: dict | None = None) -> None:
    """Begin a task: forget what other operators kept in this worker, and give back what its allocators still hold of earlier tasks."""
    for kept in _KEPT:
        if kept is not keep:
            kept.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's only
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str | Callable[[pa.RecordBatch], pa.Array] = "text", most: int = 4 << 20, keep: dict | None = None) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the bytes of a column (its name, or what picks it) stay near a bound; a longer single row passes whole."""
    fresh(keep)
    for batch in batches:
        values = column(batch) if callable(column) else batch.column(batch.schema.get_field_index(column))
        lengths = np.asarray(pc.fill_null(pc.binary_length(values), 0), dtype=np.int64)
        ends, first, room = np.cumsum(lengths), 0, 0
        while first < batch.num_rows:
            room = (ends[first - 1] if first else 0) + most
            last = max(first + 1, int(np.searchsorted(ends, room, "right")))
            yield batch.slice(first, last - first)
            first = last


def over_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str | Callable[[pa.RecordBatch], pa.Array] = "text") -> DataFrame:
    """Apply a function to bounded Arrow batches."""

    def run(batches):
        for part in slices(batches, column):
            out = fn(part)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


class WordHashes(dict):
    """Word (bytes) to its signed 64-bit hash; forgets all when it holds too many words, so memory stays bounded."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        self[word] = h = h - (1 << 64) if h >> 63 else h
        return h


def flat_words(texts: list[bytes], hashes: WordHashes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of many texts in one list, their hashes, and where each text begins (one more entry than texts)."""
    words: list[bytes] = []
    starts = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        words += t.split()
        starts[i + 1] = len(words)
    return words, np.fromiter(map(hashes.__getitem__, words), np.int64, len(words)).view(np.uint64), starts


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k successive values: the result has k - 1 entries less."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, m = np.zeros(n, np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for j in range(k):
        out = (out ^ h[j : j + n]) * m
        out ^= out >> np.uint64(29)
    return out
