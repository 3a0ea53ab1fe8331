"""Operational telemetry: latency ranks, batch results, status rollups, log events, activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The words that make a log line an event, as the log writes them.
EVENT_WORDS = ("LEADER", "election", "vote", "Granted", "term", "candidate")


def latency_stats(rows: DataFrame, by: str, value: str) -> DataFrame:
    """n, avg, p50 and p99 of each class by nearest rank: places n // 2 and floor(0.99 n) from 0.

    Ranks are picked from a histogram of exact values, which partial aggregation shrinks before
    the shuffle; only distinct values of a class are put in order, with their running counts.
    """
    each = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("m"))
    upto = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("upto", F.sum("m").over(upto)).join(rows.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("avg")), by)
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col(value)))
    return placed.groupBy(by, "n", "avg").agg(at(F.floor(F.col("n") / 2)).alias("p50"), at(F.floor(F.col("n") * 99 / 100)).alias("p99"))


def batch_results(rows: DataFrame, by: str, latency: str, ok: Column) -> DataFrame:
    """Successes, failures, total and mean milliseconds, operations a second of each class."""
    out = rows.groupBy(by).agg(F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"), F.sum(F.col(latency).cast("decimal(38,6)")).alias("t"), F.count("*").alias("n"))
    t = F.col("t").cast("double")
    return out.select(by, "success", "failed", F.round(t, 2).alias("total_ms"), F.round(t / F.col("n"), 2).alias("avg_ms"), F.round(F.col("n") * 1000 / t, 2).alias("ops_per_sec"))


def node_status(code: Column) -> tuple[Column, Column]:
    """(status, role) of a node from the status code of its last answer; null: no answer."""
    status = F.when(code.isNull(), "offline").when(code == 3, "degraded").otherwise("healthy")
    role = F.when(code == 0, "leader").when(code == 2, "follower").when(code == 3, "candidate").otherwise("unknown")
    return status, role


def log_events(lines: DataFrame, line: str = "line", node: str = "node", most: int = 50) -> DataFrame:
    """(node, timestamp, message, type) of the newest ``most`` event lines."""
    text = F.col(line)
    hit = lines.where(text.rlike("|".join(EVENT_WORDS)))
    framed = F.contains(text, F.lit("]"))
    head, tail = F.substring_index(text, "]", 1), text.substr(F.locate("]", text) + 1, F.length(text))
    kind = (
        F.when(F.contains(text, F.lit("LEADER")), "leader")
        .when(F.contains(F.lower(text), F.lit("vote")) | F.contains(text, F.lit("Granted")), "vote")
        .when(F.contains(F.lower(text), F.lit("candidate")), "candidate")
        .otherwise("election")
    )
    out = hit.select(node, F.when(framed, F.trim(F.replace(head, F.lit("["), F.lit("")))).otherwise("").alias("timestamp"), F.when(framed, F.trim(tail)).otherwise(text).alias("message"), kind.alias("type"))
    return out.orderBy(F.desc("timestamp"), "node", "message").limit(most)


def newest(rows: DataFrame, most: int, *order: Column) -> DataFrame:
    """The newest rows; planned as a top-k without a full sort."""
    return rows.orderBy(*order).limit(most)
