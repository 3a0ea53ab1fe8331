"""Replicated-log computations as set operations: commit index, matching, votes, quorum, apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators import versions

#: Members of one consensus group; peer tables of more are refused where they are collected.
MOST_PEERS = 10_000


def term_at(log: DataFrame, asked: DataFrame, idx: str = "idx") -> DataFrame:
    """``asked`` with ``term_at``: the term of the log at the index, 0 where there is none."""
    terms = log.select(F.col("idx").alias("__i"), F.col("term").alias("__t"))
    return asked.join(terms, F.col(idx) == F.col("__i"), "left").withColumn("term_at", F.coalesce("__t", F.lit(0).cast("bigint"))).drop("__i", "__t")


def commit_index(peers: DataFrame, log: DataFrame) -> DataFrame:
    """The index that most of each cluster has, valid only if its term is the current one, else 0."""
    w = Window.partitionBy("cluster").orderBy(F.desc("match_index"), "peer")
    n = F.count("*").over(Window.partitionBy("cluster"))
    ranked = peers.select("cluster", "match_index", "current_term", F.row_number().over(w).alias("place"), n.alias("n"))
    median = ranked.where(F.col("place") == F.floor(F.col("n") / 2) + 1).select("cluster", "current_term", F.col("match_index").alias("candidate"))
    return term_at(log, median, "candidate").select("cluster", "candidate", "term_at", F.when(F.col("term_at") == F.col("current_term"), F.col("candidate")).otherwise(0).cast("bigint").alias("commit_index"))


def better(term: Column, idx: Column, other_term: Column, other_idx: Column) -> Column:
    """Whether a log end is strictly better: greater last term, then greater last index."""
    return (term > other_term) | ((term == other_term) & (idx > other_idx))


def needed(n: Column) -> Column:
    """Members of a majority."""
    return (F.floor(n / 2) + 1).cast("bigint")


def grants(term_ok: Column, voted_for: Column, candidate: Column, strictly_better: Column) -> Column:
    """A vote is granted for no older term, not against another vote, and unless the voter's log is better."""
    return term_ok & (voted_for.isNull() | (voted_for == candidate)) & ~strictly_better


def votes(peers: DataFrame, candidates: DataFrame) -> DataFrame:
    """(cluster, candidate, granted, needed, won); peers has last_term, last_index, voted_for, current_term."""
    c = candidates.select(F.col("cluster").alias("c"), F.col("peer").alias("candidate"), F.col("term").alias("c_term"), F.col("last_term").alias("c_last_term"), F.col("last_index").alias("c_last_index"))
    ballot = peers.join(c, F.col("cluster") == F.col("c"))
    granted = grants(F.col("c_term") >= F.col("current_term"), F.col("voted_for"), F.col("candidate"), better(F.col("last_term"), F.col("last_index"), F.col("c_last_term"), F.col("c_last_index")))
    tally = ballot.groupBy("cluster", "candidate").agg(F.count_if((F.col("peer") == F.col("candidate")) | granted).alias("granted"), F.count("*").alias("n"))
    return tally.select("cluster", "candidate", "granted", needed(F.col("n")).alias("needed"), (F.col("granted") >= needed(F.col("n"))).alias("won"))


def quorum(peers: DataFrame, timeout_ms: int) -> DataFrame:
    """Whether each cluster's leader still hears from a majority; peers has ``is_leader`` and ``age_ms``."""
    seen = F.count_if(F.col("is_leader") | (F.col("age_ms") < timeout_ms))
    per = peers.groupBy("cluster").agg(seen.alias("reachable"), F.count("*").alias("n"))
    return per.select("cluster", "reachable", needed(F.col("n")).alias("needed"), (F.col("reachable") < needed(F.col("n"))).alias("step_down"))


def _gap(entries: DataFrame, last: int, most: int, parts: int = 256) -> int:
    """The last of the indexes last + 1, last + 2, ... that all have an entry.

    The interval that holds the first gap is the first one that isn't full; it is narrowed by
    counting ``parts`` intervals at a time, so nothing is sorted.
    """
    while most > last:
        width = -(-(most - last) // parts)
        held = entries.where((F.col("idx") > last) & (F.col("idx") <= most)).groupBy(F.floor((F.col("idx") - F.lit(last + 1)) / width).alias("i")).agg(F.count("*").alias("n")).collect()
        full = {r.i for r in held if r.n == min(width, most - last - r.i * width)}
        i = next(i for i in range(parts + 1) if i not in full)
        last, most = min(most, last + i * width), min(most, last + (i + 1) * width)
        if width == 1:
            break
    return last


def merge_logs(own: DataFrame, incoming: DataFrame) -> DataFrame:
    """Append entries: the first index whose terms differ truncates all from there; equal entries stay.

    Incoming entries follow what is kept; entries after a gap are ignored.
    """
    both = own.select("idx", F.col("term").alias("own")).join(incoming.select("idx", F.col("term").alias("new")), "idx")
    conflict = both.where("own <> new").agg(F.min("idx")).first()[0]
    kept = own if conflict is None else own.where(F.col("idx") < conflict)
    last = kept.agg(F.max("idx")).first()[0] or 0
    fresh = incoming.where(F.col("idx") > last)
    # indexes are unique, so without a gap the greatest one follows from their number
    count, most = fresh.agg(F.count("*"), F.max("idx")).first()
    if count and most != last + count:
        fresh = fresh.where(F.col("idx") <= _gap(fresh, last, most))
    return kept.withColumn("origin", F.lit("kept")).unionByName(fresh.withColumn("origin", F.lit("appended")))


def backlog(peers: DataFrame, log: DataFrame) -> DataFrame:
    """Entries and bytes that each peer still has to get.

    The log is reduced to one row for each interval between the peers' positions, so it is
    read once and never joined with the peers entry by entry.
    """
    points = sorted({r[0] for r in peers.select("match_index").distinct().limit(MOST_PEERS + 1).collect()})
    if len(points) > MOST_PEERS:
        raise ValueError("too many peers")
    place = F.size(F.filter(F.array(*(F.lit(p) for p in points)), lambda p: p < F.col("idx"))) if points else F.lit(0)
    size = F.octet_length("key") + F.octet_length("value")
    per = log.groupBy(place.alias("interval")).agg(F.count("*").alias("entries"), F.sum(size).cast("bigint").alias("bytes"))
    behind = peers.select("cluster", "peer", "match_index", F.size(F.filter(F.array(*(F.lit(p) for p in points)), lambda p: p <= F.col("match_index"))).alias("from"))
    joined = behind.join(F.broadcast(per), F.col("interval") >= F.col("from"), "left")  # an interval for each position at most
    return joined.groupBy("cluster", "peer", "match_index").agg(F.coalesce(F.sum("entries"), F.lit(0)).cast("bigint").alias("entries"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes"))


def apply_committed(log: DataFrame, commit: int, applied: int = 0) -> DataFrame:
    """The snapshot that the committed entries after ``applied`` make."""
    entries = log.where((F.col("idx") > applied) & (F.col("idx") <= commit))
    return versions.snapshot(entries.select(F.col("idx").alias("seq"), "key", "deleted", "value"))


def acknowledged(proposals: DataFrame, log: DataFrame, applied: int) -> DataFrame:
    """A proposal (idx, term) is acknowledged if it is applied and the log still has its term there."""
    at = term_at(log, proposals.select("idx", "term"))
    return at.select("idx", "term", ((F.col("idx") <= applied) & (F.col("term") == F.col("term_at"))).alias("acked"))
