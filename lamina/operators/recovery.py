"""Log recovery: the valid prefix of each segment, retirement of segments, checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators import versions


def valid_prefix(log: DataFrame, segment: str = "segment", pos: str = "pos", ok: str = "crc_ok") -> DataFrame:
    """Records before the first bad one of their segment; later segments still count.

    The first bad position of a segment is a partial aggregate over bad records only, joined
    back, so no segment has to be sorted or held by one task.
    """
    bad = log.where(~F.col(ok)).groupBy(segment).agg(F.min(pos).alias("__bad"))
    return log.join(bad, segment, "left").where(F.col("__bad").isNull() | (F.col(pos) < F.col("__bad"))).drop("__bad")


def recover(log: DataFrame) -> DataFrame:
    """The newest version of each key of what survived."""
    return versions.latest(valid_prefix(log).select("seq", "key", "deleted", "value"))


def retirable(log: DataFrame, installed_seq: int) -> DataFrame:
    """Segments whose records are all in installed tables, without the active (last) one."""
    last = log.agg(F.max("segment")).first()[0]
    per = log.groupBy("segment").agg(F.max("seq").alias("max_seq"), F.count("*").alias("records"))
    return per.where((F.col("max_seq") <= installed_seq) & (F.col("segment") < F.lit(last)))
