"""Helpers that several operators share: shared folders, word splitting, hashing and dealing documents into groups.

Conventions of the whole subpackage
-----------------------------------
* A null text counts as an empty one; a null doc_id is an id of its own that sorts after all others.
* Only the columns an operator names are read, so extra columns never clash with internal ones.
* Intermediate tables go to the folder that the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomnet.plans.runtime import materialize, shared_path

__all__ = ["materialize", "shared_path"]  # used from here by the operators

#: Sorts after every other id; stands for a null doc_id.
NULL_ID = np.iinfo(np.int64).max
#: The bytes that part words: space and the five ASCII controls from tab to carriage return.
WORD_BREAKS = np.zeros(256, bool)
WORD_BREAKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: 1 for ASCII letters, 2 for ASCII punctuation.
KIND = np.zeros(256, np.uint8)
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
KIND[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 2
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let the session hand texts to Python in batches of at most ``rows`` rows, so that a task's buffers hold a few MB; a lower setting stands."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def group_count(df: DataFrame, mb: float = 4.0) -> int:
    """How many groups of about ``mb`` stored MB the input makes; grows with the input, so a group's size doesn't."""
    stored = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(math.ceil(stored / (mb * 1e6)), 2**30))


def dealt(docs: DataFrame, mb: float = 4.0) -> DataFrame:
    """(pid int, doc_id long, text string): every document in one of group_count() groups, chosen by its id and text.

    The text takes part so that many rows with one id (or none) still spread. Identical rows meet in one group."""
    bounded_batches(docs.sparkSession)
    n = group_count(docs, mb)
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.pmod(F.xxhash64("doc_id", F.substring(text, 1, 4096)), F.lit(n)).cast("int").alias("pid"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row and the offsets at which each begins (one more than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # combine_chunks of none
        column = pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def after_letters(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where ASCII punctuation follows an ASCII letter, by ``kind`` (see KIND)."""
    out = np.zeros(len(data), bool)
    out[1:] = (kind[data[:-1]] == 1) & (kind[data[1:]] == 2)
    return out


def kinds_without(specials) -> np.ndarray:
    """KIND, but punctuation that follows a letter inside one of these special tokens counts as nothing, so that they stay whole."""
    kind = KIND.copy()
    for text in specials:
        raw = text.encode()
        for a, b in zip(raw, raw[1:], strict=False):
            if KIND[a] == 1 and KIND[b] == 2:
                kind[b] = 0
    return kind


def split_words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = WORD_BREAKS, also: np.ndarray | None = None) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """All maximal runs of bytes outside ``breaks``, never across texts and cut where ``also`` says; and for each text its first word (one more than texts)."""
    inside = ~breaks[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    if also is not None:
        begins |= also
    first = offsets[:-1]
    first = first[first < len(data)]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    before = np.cumsum(inside)
    kept = data[inside]
    bounds = np.append(before[starts] - 1, len(kept)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(kept)])
    return words, np.searchsorted(starts, offsets)


def as_bytes(words: pa.LargeBinaryArray) -> list[bytes]:
    """The values of an array without nulls; several times faster than to_pylist()."""
    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    data = data.to_pybytes() if data is not None else b""
    bounds = bounds.tolist()
    return [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def hash_words(words: pa.LargeBinaryArray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; computed once for each different word."""
    if not len(words):
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    each = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in as_bytes(coded.dictionary)), np.uint64, len(coded.dictionary))
    return each[coded.indices.to_numpy(zero_copy_only=False)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread sums of products over all 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(h: np.ndarray, length: int, multiplier: np.uint64 = MULTIPLIER) -> np.ndarray:
    """For each position the hash of the ``length`` symbols from there, built by doubling: n - length + 1 values."""
    n = len(h)
    if n < length:
        return np.zeros(0, np.uint64)
    power = lambda k: np.uint64(pow(int(multiplier), k, 2**64))
    total, done, piece, size = None, 0, h, 1
    while True:
        if length & size:  # take this power of two next
            part = piece[done:]
            total = part if total is None else total[: len(part)] * power(size) + part[: len(total)]
            done += size
        if 2 * size > length:
            break
        piece = piece[: len(piece) - size] * power(size) + piece[size:]
        size *= 2
    return mix(total[: n - length + 1])


def windows_inside(first: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which of the total - length + 1 windows stay within one text; first as split_words() or text_bytes() return it."""
    ok = np.zeros(max(0, total - length + 1) + 1, np.int32)
    n = first[1:] - first[:-1] - length + 1
    has = n > 0
    np.add.at(ok, first[:-1][has], 1)
    np.add.at(ok, first[:-1][has] + n[has], -1)
    return np.cumsum(ok[:-1]).astype(bool)


def covered(hits: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which of ``total`` positions lie in a window that starts at one of ``hits``."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + length, -1)
    return np.cumsum(edge[:-1]) > 0


def ids_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """int64 ids; nulls as NULL_ID."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64) if len(column) else np.zeros(0, np.int64)


def pieces(batches, column: str, size: int = 4_000_000):
    """Slices of Arrow batches with about ``size`` bytes of the column each (at least one row), so that long texts don't add up."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        cuts = [0, *(np.flatnonzero(np.diff(total // size)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
