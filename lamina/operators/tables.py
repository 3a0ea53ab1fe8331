"""Sorted tables in levels: statistics, read order, compaction and garbage collection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators import versions

BASE_BYTES, MULTIPLIER, LEVEL0_TABLES, BLOCK_BYTES = 64 << 20, 10, 4, 4096


def entry_bytes():
    """Bytes of a stored entry: two lengths, key, value, sequence and flag."""
    return F.octet_length("key") + F.octet_length("value") + 17


def manifest(entries: DataFrame) -> DataFrame:
    """A row for each table (``run``): what its footer would say."""
    return entries.groupBy("run", "level").agg(
        F.count("*").alias("n_entries"), F.count_if("deleted").alias("n_deletes"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"),
        F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.sum(entry_bytes()).cast("bigint").alias("bytes"),
    )


def with_path(tables: DataFrame) -> DataFrame:
    return tables.withColumn("path", F.format_string("%d_%08d.sst", "level", "run"))


def block_index(entries: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(run, block, last_key, entries, bytes): a block closes once it holds ``block_bytes``.

    The running size restarts at each block, which no window sum expresses, so each table is
    folded once in key order, streamed from a shuffle that is sorted by run and key: memory is
    that of one Arrow batch.  Within a batch a block's end is found by bisection of running sums.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["run", "block", "last_key", "entries", "bytes"], [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        run, block, size, count, last = None, 0, 0, 0, None
        for batch in batches:
            out = []
            runs, b = batch.column("run").to_numpy(), batch.column("b").to_numpy()
            cuts = [0, *(np.flatnonzero(runs[1:] != runs[:-1]) + 1).tolist(), len(runs)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if runs[lo] != run:
                    if count:
                        out.append((run, block, last, count, size))
                    run, block, size, count = int(runs[lo]), 0, 0, 0
                sums, at = np.concatenate([[0], np.cumsum(b[lo:hi])]), 0
                while at < hi - lo:
                    # the first row at which the block is full, or the rest of the batch
                    end = int(np.searchsorted(sums, sums[at] + block_bytes - size))
                    full, end = end <= hi - lo, min(end, hi - lo)
                    size, count, last = size + int(sums[end] - sums[at]), count + end - at, batch.column("key")[lo + end - 1].as_py()
                    if full:
                        out.append((run, block, last, count, size))
                        block, size, count = block + 1, 0, 0
                    at = end
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((run, block, last, count, size), types, strict=True)], names=names)

    rows = entries.select("run", "key", entry_bytes().cast("bigint").alias("b"))
    return rows.repartition("run").sortWithinPartitions("run", "key").mapInArrow(fold, "run int, block bigint, last_key string, entries bigint, bytes bigint")


def read_order(tables: DataFrame) -> DataFrame:
    """Tables by level: level 0 newest first (then path, descending), deeper ones by first key (then path)."""
    shallow = F.col("level") == 0
    w = Window.partitionBy("level").orderBy(F.when(shallow, -F.col("max_seq")), F.when(shallow, F.col("path")).desc(), F.when(~shallow, F.col("first_key")), "path")
    return tables.withColumn("place", F.row_number().over(w).cast("bigint"))


def level_stats(tables: DataFrame, base: int = BASE_BYTES, multiplier: int = MULTIPLIER, trigger: int = LEVEL0_TABLES) -> DataFrame:
    """Tables, bytes and budget of each level, and whether the level asks for compaction."""
    budget = F.when(F.col("level") == 0, F.lit(0)).otherwise(F.lit(base) * F.pow(F.lit(multiplier), F.col("level") - 1)).cast("bigint")
    stats = tables.where("level >= 0").groupBy("level").agg(F.count("*").alias("n_tables"), F.sum("bytes").cast("bigint").alias("bytes"))
    over = F.when(F.col("level") == 0, F.col("n_tables") >= trigger).otherwise(F.col("bytes") > F.col("budget"))
    return stats.withColumn("budget", budget).withColumn("over", over)


def pick_level(tables: DataFrame, **limits: int) -> DataFrame:
    """The first level that asks for compaction (null if none does)."""
    return level_stats(tables, **limits).where("over").agg(F.min("level").alias("level"))


def overlapping(tables: DataFrame, level: int) -> DataFrame:
    """The inputs of a compaction of ``level``: all its tables if it is 0, else the one with the oldest entries; and the next level's tables whose keys overlap theirs."""
    own = tables.where(F.col("level") == level)
    if level:
        own = own.orderBy("min_seq", "run").limit(1)
    hull = own.agg(F.min("first_key").alias("from_key"), F.max("last_key").alias("to_key"))
    below = tables.where(F.col("level") == level + 1).join(F.broadcast(hull), (F.col("last_key") >= F.col("from_key")) & (F.col("first_key") <= F.col("to_key")))
    return own.unionByName(below.select(*tables.columns))


def merge(inputs: DataFrame, drop_tombstones: bool) -> DataFrame:
    """The newest version of each key of the inputs; tombstones go only where nothing lies deeper."""
    newest = versions.latest(inputs, -F.col("source_rank")) if "source_rank" in inputs.columns else versions.latest(inputs)
    newest = newest.select("key", "seq", "deleted", "value")
    return versions.live(newest) if drop_tombstones else newest


def swap(tables: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """The manifest after a compaction: its inputs leave by identity, its outputs come."""
    return tables.join(inputs.select("run"), "run", "left_anti").unionByName(outputs)
