"""A log tail as a stream: each micro-batch is appended to a store, whose snapshot is the fold.

A batch that runs again after a failure replaces its own log batch; last-writer-wins makes
the fold itself idempotent.  The store keeps tombstones until compaction, so late and
out-of-order records are judged by their sequence.  A batch costs what it brings: the log is
flushed and a level compacted only every ``FLUSH_EVERY`` batches, and old files go with that.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lamina.operators import versions
from lamina.plans.store import Store

FLUSH_EVERY = 8


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, or one under the warehouse where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def fold(stream: DataFrame, folder: str) -> Store:
    """Runs all that is available of a stream of mutations; the store that holds the result."""
    store = Store(stream.sparkSession, f"{folder}/store")

    def step(batch: DataFrame, number: int) -> None:
        store.apply(batch.select("key", "seq", "deleted", "value"), batch=number + 1)
        if number % FLUSH_EVERY == FLUSH_EVERY - 1:
            store.flush()
            store.compact()

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return store


def snapshot(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Live (key, value) rows after all that is available."""
    return fold(stream, folder or f"{shared_folder(stream.sparkSession)}/tail-{uuid.uuid4().hex}").snapshot()


def counts(stream: DataFrame) -> DataFrame:
    """Versions of each key as a running aggregate, for update or complete mode."""
    return versions.history(stream)


def source(spark: SparkSession, path: str, most_files: int = 64) -> DataFrame:
    """A stream over the Parquet files at a path, be it a folder or one file (a glob takes both)."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(f"{path}*")


def changes(stream: DataFrame) -> DataFrame:
    """(key, seq, deleted, value) each time a key's newest version becomes another one.

    The state of a key is its newest version; records that are older than it change nothing,
    whatever batch they come in.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        before = best
        for part in parts:
            row = part.loc[part["seq"].idxmax()]
            if best is None or row["seq"] >= best[0]:
                best = (int(row["seq"]), bool(row["deleted"]), row["value"])
        if best != before:
            state.update(best)
            yield pd.DataFrame([(key[0], *best)], columns=["key", "seq", "deleted", "value"])

    kinds = "key string, seq bigint, deleted boolean, value string", "seq bigint, deleted boolean, value string"
    return stream.select("key", "seq", "deleted", "value").groupBy("key").applyInPandasWithState(step, *kinds, "update", GroupStateTimeout.NoTimeout)
