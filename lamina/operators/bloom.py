"""Bloom filters: sizing, distributed construction, probing and fill ratio.

Positions come from two 64-bit hashes by double hashing.  A filter's size follows from the
number of keys; filters of more than ``MOST_BYTES`` aren't built, because they reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES, SLICE = 64 << 20, 1 << 20


def sizing(n: int, p: float) -> tuple[int, int]:
    """(bits, hashes): at least 64 bits, whole bytes, 1 to 16 hashes."""
    bits = max(64, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    bits = -(-bits // 8) * 8
    return bits, min(16, max(1, math.ceil(bits / max(1, n) * math.log(2))))


def sizing_columns(n: Column, p: Column) -> tuple[Column, Column]:
    """The same as columns."""
    ln2 = math.log(2)
    bits = F.greatest(F.lit(64), F.ceil(-n * F.log(p) / F.lit(ln2 * ln2)))
    bits = (F.ceil(bits / 8) * 8).cast("bigint")
    return bits, F.least(F.lit(16), F.greatest(F.lit(1), F.ceil(bits / n * F.lit(ln2)))).cast("bigint")


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(1), key)


def _positions(one: np.ndarray, two: np.ndarray, bits: int, k: int) -> np.ndarray:
    one, two = one.astype(np.int64).view(np.uint64), two.astype(np.int64).view(np.uint64)
    return np.stack([(one + np.uint64(i) * two) % np.uint64(bits) for i in range(k)])


@dataclass
class Bloom:
    bits: int
    hashes: int
    data: bytes

    def serialize(self) -> bytes:
        """The filter as bytes to be stored beside its table: bits and hashes in eight bytes each, then the bit field."""
        return self.bits.to_bytes(8, "big") + self.hashes.to_bytes(8, "big") + self.data

    @classmethod
    def load(cls, stored: bytes) -> Bloom:
        """A filter from its bytes; damaged ones are an error."""
        bits, k = int.from_bytes(stored[:8], "big"), int.from_bytes(stored[8:16], "big")
        if len(stored) < 16 or not 1 <= k <= 16 or bits % 8 or len(stored) - 16 != bits // 8 or not bits:
            raise ValueError("not a stored filter")
        return cls(bits, k, bytes(stored[16:]))

    def fill_ratio(self) -> float:
        return int(np.unpackbits(np.frombuffer(self.data, np.uint8)).sum()) / self.bits

    def might_contain(self, key: Column) -> Column:
        """An Arrow-batched test of a key column."""
        bits, k, data = self.bits, self.hashes, self.data

        @F.pandas_udf("boolean")
        def test(one: pd.Series, two: pd.Series) -> pd.Series:
            held = np.frombuffer(data, np.uint8)
            at = _positions(one.to_numpy(), two.to_numpy(), bits, k)
            return pd.Series(((held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(0))

        return test(*hashes(key))


def build(keys: DataFrame, column: str, p: float = 0.01, n: int | None = None) -> Bloom:
    """The filter of a column's keys; partitions make partial filters that are united slice by slice."""
    n = keys.select(column).distinct().count() if n is None else n
    bits, k = sizing(n, p)
    if bits // 8 > MOST_BYTES:
        raise ValueError("the filter would be too large; split the keys")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = _positions(batch.column(0).to_numpy(), batch.column(1).to_numpy(), bits, k).ravel()
            np.bitwise_or.at(held, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        slices = range(-(-len(held) // SLICE))
        yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array([held[i * SLICE : (i + 1) * SLICE].tobytes() for i in slices], pa.binary())], names=["slice", "data"])

    def unite(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in parts:
            for x in batch.column("data"):
                x = np.frombuffer(x.as_py(), np.uint8)
                held = x if held is None else held | x
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([held.tobytes()], pa.binary())], names=["slice", "data"])

    one, two = hashes(F.col(column))
    parts = keys.where(F.col(column).isNotNull()).select(one.alias("one"), two.alias("two")).mapInArrow(part, "slice int, data binary")
    rows = parts.groupBy("slice").applyInArrow(unite, "slice int, data binary").collect()
    data = b"".join(r.data for r in sorted(rows, key=lambda r: r.slice))
    return Bloom(bits, k, bytes(data) or bytes(bits // 8))
