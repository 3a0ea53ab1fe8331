"""Last-writer-wins over versioned entries: lookup, scan and their tombstone rules.

Only predicates on the key may pass below ``latest``; one on ``deleted`` or ``value`` would
bring deleted keys back.  Catalyst pushes key predicates through the aggregate by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(entries: DataFrame, *ties: Column) -> DataFrame:
    """The newest version of each key, tombstones included.

    Equal sequences go to the greatest of ``ties`` (for sources: the newest one).  One
    partial aggregation before the shuffle, one after; no order of input rows matters.
    """
    rest = [c for c in entries.columns if c != "key"]
    newest = F.max_by(F.struct(*rest), F.struct("seq", *ties) if ties else F.col("seq"))
    return entries.groupBy("key").agg(newest.alias("v")).select("key", *(F.col(f"v.{c}").alias(c) for c in rest))


def live(versions: DataFrame) -> DataFrame:
    """Keys whose newest version isn't a tombstone."""
    return versions.where(~F.col("deleted"))


def snapshot(entries: DataFrame, *ties: Column) -> DataFrame:
    return live(latest(entries, *ties)).select("key", "value")


def get(entries: DataFrame, key: str) -> DataFrame:
    """One row (key, status, found, value); a missing key is OK and not found."""
    hit = snapshot(entries.where(F.col("key") == key))
    asked = entries.sparkSession.createDataFrame([(key,)], "key string")
    return asked.join(hit, "key", "left").select("key", F.lit("OK").alias("status"), F.col("value").isNotNull().alias("found"), "value")


def multi_get(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """A row for each asked key; entries of other keys are dropped before they are aggregated."""
    keys = asked.select("key").distinct()
    hit = snapshot(entries.join(keys, "key", "left_semi"))
    return asked.join(hit, "key", "left").select("key", F.col("value").isNotNull().alias("found"), "value")


def first_hit(entries: DataFrame) -> DataFrame:
    """Layered read: each key's entry in the newest source that has it, tombstones included."""
    w = Window.partitionBy("key").orderBy("source_rank", F.desc("seq"))
    return entries.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def in_range(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Keys in [start, end) by bytes; an end of '' is below every key, so it gives nothing."""
    return rows.where((F.col("key") >= start) & (F.col("key") < end))


def scan(entries: DataFrame, start: str, end: str, limit: int | None = None) -> DataFrame:
    """Live rows of [start, end) in key order; with ``limit`` the first ones."""
    out = snapshot(in_range(entries, start, end), *([-F.col("source_rank")] if "source_rank" in entries.columns else [])).orderBy("key")
    return out if limit is None else out.limit(limit)


def history(entries: DataFrame) -> DataFrame:
    """Versions, puts and deletes of each key."""
    return entries.groupBy("key").agg(F.count("*").alias("versions"), F.count_if(~F.col("deleted")).alias("puts"), F.count_if("deleted").alias("deletes"))


def resurrected(entries: DataFrame) -> DataFrame:
    """Keys that are deleted by their newest version although an older source still has a value."""
    newest = latest(entries, -F.col("source_rank")).where("deleted").select("key", F.col("seq").alias("newest_seq"))
    puts = entries.where(~F.col("deleted")).groupBy("key").agg(F.count("*").alias("older_puts"))
    return newest.join(puts, "key")


def as_of_reads(entries: DataFrame, is_read: Column) -> DataFrame:
    """What a read just after each picked entry sees: the newest version up to that sequence."""
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = entries.withColumn("v", F.last(F.struct("deleted", "value")).over(w))
    return seen.where(is_read).select("seq", "key", (~F.col("v.deleted")).alias("found"), F.when(~F.col("v.deleted"), F.col("v.value")).alias("value"))


def memory_stats(entries: DataFrame, budget: int, overhead: int = 48) -> DataFrame:
    """Entries, bytes (each first insert costs key, value and ``overhead``), whether to flush, last sequence."""
    size = F.octet_length("key") + F.octet_length("value") + overhead
    return latest(entries).agg(F.count("*").alias("entries"), F.sum(size).cast("bigint").alias("bytes"), F.max("seq").alias("last_seq")).withColumn("should_flush", F.col("bytes") >= budget)
