"""Vectorised text helpers that work on Arrow string buffers, shared by the operators.

Texts arrive as Arrow batches.  ``chunks`` cuts them so that numpy temporaries stay
bounded whatever the batch size; a single longer text forms a chunk of its own.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import cache, lru_cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
BATCH_BYTES = 8 << 20
#: Keys of so many rows are broadcast in joins; there are at most HOT_KEYS of them.
HOT_ROWS, HOT_KEYS = 1000, 1000
#: Bits of a filter of ids for each of them, and at most.
ID_BITS, MOST_BITS = 16, 1 << 27
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (length + 1) of a string array; nulls become empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    raw = texts.buffers()
    off = np.frombuffer(raw[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    if raw[2] is None:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(raw[2], np.uint8)[off[0] : off[-1]], off - off[0]


def chunks(data: np.ndarray, off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``most`` bytes."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def word_table(separators: bytes) -> np.ndarray:
    """For each byte, whether it belongs to a word."""
    t = np.ones(256, bool)
    t[list(separators)] = False
    return t


#: Words of the n-gram join: everything but ASCII white space.
SPACED = word_table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words of decontamination and toxicity: ASCII letters, digits and every non-ASCII character.
ALNUM = word_table(bytes(range(0x00, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; a word never crosses a row."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    w = table[data]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    before = np.empty_like(w)
    before[0] = False
    before[1:] = w[:-1]
    before[edge] = False
    start = np.flatnonzero(w & ~before)
    after = np.empty_like(w)
    after[-1] = False
    after[:-1] = w[1:]
    after[edge - 1] = False
    end = np.flatnonzero(w & ~after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


@lru_cache(maxsize=2)
def _powers(log_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd multiplier and of its inverse modulo 2^64."""
    out = []
    for base in (_ODD, _INV):
        p = np.full(1 << log_size, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``size`` powers of the odd multiplier and of its inverse modulo 2^64."""
    return _powers(max(21, size.bit_length()))


@cache
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> _S33)
    h = h * _M1
    h ^= h >> _S33
    h = h * _M2
    h ^= h >> _S33
    return h


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of ``data``, from prefix sums of a polynomial modulo 2^64."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_byte_values()[data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _M2)


def own_keys(names: np.ndarray, n: int, keys: int) -> list[int]:
    """Negative keys under which a task's own results go out, spread over as many as there are others."""
    first = int(names[0]) if len(names) else 0
    return [-1 - (first + i) % keys for i in range(n)]


def release() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """An Arrow function that gives free memory back at its end: Python workers serve many tasks."""

    # Spark counts the parameters, so each form keeps its own
    @wraps(run)
    def over_batches(batches):
        try:
            yield from run(batches)
        finally:
            release()

    @wraps(run)
    def over_group(key, batches):
        try:
            yield from run(key, batches)
        finally:
            release()

    return over_batches if run.__code__.co_argcount == 1 else over_group


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches bounded in bytes where the session still has Spark's own bound."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) in ("67108864b", "64m", "64MB"):
        conf.set(key, f"{BATCH_BYTES}b")
    return df


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; one of our own only where it is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        named = sc.getCheckpointDir()
    if named is None:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints_{uuid.uuid4().hex}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` (which should be checkpointed) marked for broadcast if it has ``most`` rows or fewer; a shuffle joins it otherwise."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def sift(rows: DataFrame, col: Column, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``col`` may be one of ``ids`` (one column; should be checkpointed), and the others.

    The former are all that have one of the ids (nulls, too) and about one other in ID_BITS.  The
    hashed bits are broadcast; there are at most MOST_BITS, beyond which more others pass.
    """
    n = min(max(ID_BITS * ids.count(), 1 << 16), MOST_BITS)
    slot = F.pmod(F.xxhash64(F.col(ids.columns[0])), F.lit(n))
    has, piece, bits = unused(rows, "has", "piece", "bits")
    marks = materialize(ids.groupBy(F.bitmap_bucket_number(slot).alias(piece)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias(bits)))
    own = F.pmod(F.xxhash64(col), F.lit(n))
    at = F.bitmap_bit_position(own).cast("int")
    byte = F.conv(F.hex(F.call_function("substring", F.col(bits), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    mark = F.coalesce(F.call_function("shiftright", byte, at.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    told = rows.join(F.broadcast(marks), F.bitmap_bucket_number(own) == F.col(piece), "left").withColumn(has, mark).drop(piece, bits)
    return told.where(has).drop(has), told.where(~F.col(has)).drop(has)


def join_hot(rows: DataFrame, per: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``per``, which has one row for each key and, as ``weight``, how many of all ``total`` rows have it.

    Keys of ``HOT_ROWS`` rows or more, and of a ``HOT_KEYS``th of all, are broadcast (HOT_KEYS rows
    at most), so a key that a third of all rows have isn't dealt to one task.  Both inputs are
    read twice; they should be checkpointed.
    """
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    if total < least:
        return rows.join(per, keys, how)
    names = unused(rows, "hot")
    hot = per.where(F.col(weight) >= least)
    cold = rows.join(F.broadcast(hot.select(*keys, F.lit(True).alias(names[0]))), keys, "left").where(F.col(names[0]).isNull()).drop(names[0])
    return rows.join(F.broadcast(hot), keys).unionByName(cold.join(per.where(F.col(weight) < least), keys, how))


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, columns[f.name]) for f in schema)], schema=schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n in have:
            n = f"_{n}"
        have.add(n)
        out.append(n)
    return out
