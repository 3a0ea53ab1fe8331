"""The driver's tables seen as mutation logs, runs, segments, replicated logs, peers and telemetry.

Each adapter has its SQL twin in ``CTE``, which the oracles begin with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(n: Column, size: int, head: str) -> Column:
    return F.concat(F.lit(head), F.lpad(n.cast("string"), size, "0"))


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as puts and (errors) deletes; event ids are unique and dense."""
    deleted = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("seq"), padded(F.col("user_id"), 4, "user_").alias("key"), deleted.alias("deleted"), F.when(deleted, F.lit("")).otherwise(F.col("props")).alias("value"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log cut into eight runs of equal length (the first ones one longer), each reduced to the newest version of a key.

    Run 8 is the active memory table, 7 the frozen one, 6 to 3 are level 0, 2 and 1 deeper levels.
    """
    log = ops(spark, sf_dir)
    n = log.count()
    q, r = divmod(n, 8)
    at = F.col("seq") - 1
    run = F.floor(at / (q + 1)) + 1 if not q else F.when(at < r * (q + 1), F.floor(at / (q + 1)) + 1).otherwise(F.floor((at - r * (q + 1)) / q) + r + 1)
    cut = log.withColumn("run", run.cast("int")).groupBy("run", "key").agg(F.max_by(F.struct("seq", "deleted", "value"), "seq").alias("v")).select("run", "key", "v.*")
    rank = F.when(F.col("run") >= 7, 8 - F.col("run")).otherwise(9 - F.col("run"))
    level = F.when(F.col("run") >= 7, -1).when(F.col("run") >= 3, 0).when(F.col("run") == 2, 1).otherwise(2)
    return cut.select("seq", "key", "deleted", "value", "run", rank.cast("int").alias("source_rank"), level.cast("int").alias("level"))


def wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of 500 records, some records damaged."""
    return ops(spark, sf_dir).select(F.floor((F.col("seq") - 1) / 500).cast("bigint").alias("segment"), ((F.col("seq") - 1) % 500).alias("pos"), "seq", "key", "deleted", "value", (F.col("seq") % 1777 != 0).alias("crc_ok"))


def leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a replicated log."""
    deleted = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("idx"), (1 + F.floor(F.col("o_orderkey") / 2000)).cast("bigint").alias("term"), padded(F.col("o_custkey"), 8, "cust_").alias("key"), deleted.alias("deleted"), F.when(deleted, F.lit("")).otherwise(F.col("o_orderpriority")).alias("value"))


def log_size(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "orders").count()


def follower(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shorter log that diverges from the leader's after four fifths of it."""
    n = log_size(spark, sf_dir)
    own = F.when(F.col("idx") > n * 4 // 5, F.lit(0)).otherwise(F.col("term")).cast("bigint")
    return leader(spark, sf_dir).where(F.col("idx") <= n * 14 // 15).withColumn("term", own)


def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five clusters of five peers: region, nation, customers of the nation."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    per = customer.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    joined = nation.join(per, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return joined.select(F.col("n_regionkey").alias("cluster"), F.col("n_nationkey").alias("peer"), F.coalesce("n", F.lit(0)).cast("bigint").alias("match_index"), F.when(F.col("n_regionkey") < 3, 1).otherwise(2).cast("bigint").alias("current_term"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("op"), F.col("value").alias("latency_ms"), (F.col("event_id") % 6).cast("int").alias("status_code"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as lines of node logs."""
    said = F.when(F.col("event_type") == "click", "became LEADER of term 3").when(F.col("event_type") == "view", "Granted ballot").when(F.col("event_type") == "purchase", "now a candidate").when(F.col("event_type") == "signup", "election timeout").otherwise("heartbeat")
    line = F.concat(F.lit("["), F.lpad(F.col("event_id").cast("string"), 12, "0"), F.lit("] [INFO] "), said, F.lit(" "), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select(F.concat(F.lit("node"), (F.col("user_id") % 3).cast("string")).alias("node"), line.alias("line"))


CTE = """
a1_ops AS (
  SELECT event_id + 1 AS seq, 'user_' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS key, event_type = 'error' AS deleted,
         CASE WHEN event_type = 'error' THEN '' ELSE props END AS value FROM events
), a2_runs AS (
  SELECT seq, key, deleted, value, run, CAST(CASE WHEN run >= 7 THEN 8 - run ELSE 9 - run END AS INTEGER) AS source_rank,
         CAST(CASE WHEN run >= 7 THEN -1 WHEN run >= 3 THEN 0 WHEN run = 2 THEN 1 ELSE 2 END AS INTEGER) AS level
  FROM (SELECT *, row_number() OVER (PARTITION BY run, key ORDER BY seq DESC) AS rn
        FROM (SELECT *, CAST(ntile(8) OVER (ORDER BY seq) AS INTEGER) AS run FROM a1_ops)) WHERE rn = 1
), a3_wal AS (
  SELECT CAST(floor((seq - 1) / 500e0) AS BIGINT) AS segment, (seq - 1) % 500 AS pos, seq, key, deleted, value, seq % 1777 <> 0 AS crc_ok FROM a1_ops
), a4_leader AS (
  SELECT o_orderkey + 1 AS idx, 1 + CAST(floor(o_orderkey / 2000e0) AS BIGINT) AS term, 'cust_' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS key,
         o_orderstatus = 'F' AS deleted, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END AS value FROM orders
), a4_n AS (SELECT count(*) AS n FROM orders
), a4_follower AS (
  SELECT idx, CASE WHEN idx > n * 4 // 5 THEN CAST(0 AS BIGINT) ELSE term END AS term, key, deleted, value FROM a4_leader, a4_n WHERE idx <= n * 14 // 15
), a5_peers AS (
  SELECT n_regionkey AS cluster, n_nationkey AS peer, count(c_custkey) AS match_index,
         CAST(CASE WHEN n_regionkey < 3 THEN 1 ELSE 2 END AS BIGINT) AS current_term
  FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_regionkey, n_nationkey
), a6_tele AS (
  SELECT event_id, ts, event_type AS op, value AS latency_ms, CAST(event_id % 6 AS INTEGER) AS status_code FROM events
), newest AS (
  SELECT key, arg_max(struct_pack(seq := seq, deleted := deleted, value := value), seq) AS v FROM a1_ops GROUP BY key
), manifest AS (
  SELECT run, level, count(*) AS n_entries, count(*) FILTER (deleted) AS n_deletes, min(seq) AS min_seq, max(seq) AS max_seq,
         min(key) AS first_key, max(key) AS last_key, CAST(sum(strlen(key) + strlen(value) + 17) AS BIGINT) AS bytes
  FROM a2_runs WHERE level >= 0 GROUP BY run, level
)
"""
