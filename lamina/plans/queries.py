"""The registered queries of the core engine and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.functions import codec, messages
from lamina.operators import bloom, recovery, replication, tables, telemetry, versions
from lamina.plans import adapters as A
from lamina.plans.store import Store, StoreConfig
from lamina.streaming import tail

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {}


def _query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _ALL[f.__name__] = f, sql
        return f

    return add


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.with_path(tables.manifest(A.runs(spark, sf_dir).where("level >= 0")))


LIVE = "SELECT key, v.value AS value FROM newest WHERE NOT v.deleted"


@_query(LIVE)
def kv_snapshot(spark, sf):
    return versions.snapshot(A.ops(spark, sf))


@_query("SELECT key, v.seq AS seq, v.deleted AS deleted, v.value AS value FROM newest")
def kv_latest_with_tombstones(spark, sf):
    return versions.latest(A.ops(spark, sf))


@_query(f"SELECT 'user_0007' AS key, 'OK' AS status, count(*) > 0 AS found, max(value) AS value FROM ({LIVE}) WHERE key = 'user_0007'")
def kv_get(spark, sf):
    return versions.get(A.ops(spark, sf), "user_0007")


@_query(f"SELECT k.key, s.value IS NOT NULL AS found, s.value FROM (SELECT 'user_' || lpad(CAST(range AS VARCHAR), 4, '0') AS key FROM range(400)) k LEFT JOIN ({LIVE}) s USING (key)")
def kv_multi_get(spark, sf):
    asked = spark.range(400).select(A.padded(F.col("id"), 4, "user_").alias("key"))
    return versions.multi_get(A.ops(spark, sf), asked)


@_query("SELECT key, seq, source_rank, NOT deleted AS found FROM a2_runs QUALIFY row_number() OVER (PARTITION BY key ORDER BY source_rank) = 1")
def kv_get_layered(spark, sf):
    return versions.first_hit(A.runs(spark, sf)).select("key", "seq", "source_rank", (~F.col("deleted")).alias("found"))


@_query(f"SELECT * FROM ({LIVE}) WHERE key >= 'user_0010' AND key < 'user_0050'")
def kv_scan_range(spark, sf):
    return versions.scan(A.ops(spark, sf), "user_0010", "user_0050")


@_query("""SELECT n.key, n.v.seq AS newest_seq, p.older_puts FROM newest n
JOIN (SELECT key, count(*) AS older_puts FROM a2_runs WHERE NOT deleted GROUP BY key) p USING (key) WHERE n.v.deleted""")
def kv_scan_tombstone(spark, sf):
    runs = A.runs(spark, sf)
    hidden = versions.resurrected(runs)
    return hidden.join(versions.scan(runs, "user_", "user_~"), "key", "left_anti")


@_query("SELECT CAST(0 AS BIGINT) AS no_end, CAST(0 AS BIGINT) AS reversed")
def kv_scan_empty(spark, sf):
    ops = A.ops(spark, sf)
    both = versions.in_range(ops, "user_0010", "").select(F.lit(1).alias("a")).unionByName(versions.in_range(ops, "user_0050", "user_0010").select(F.lit(2).alias("a")))
    return both.agg(F.count_if(F.col("a") == 1).alias("no_end"), F.count_if(F.col("a") == 2).alias("reversed"))


@_query(f"SELECT * FROM ({LIVE}) WHERE key >= 'user_0010' AND key < 'user_9999' ORDER BY key LIMIT 25")
def kv_scan_limit(spark, sf):
    return versions.scan(A.ops(spark, sf), "user_0010", "user_9999", 25)


@_query("SELECT 'ghost_' || lpad(CAST(range AS VARCHAR), 4, '0') AS key, range + 1 + (SELECT max(seq) FROM a1_ops) AS seq, TRUE AS deleted FROM range(10)")
def kv_blind_delete(spark, sf):
    ops = A.ops(spark, sf)
    last = ops.agg(F.max("seq")).first()[0] or 0
    ghosts = spark.range(10).select((F.col("id") + 1 + last).alias("seq"), A.padded(F.col("id"), 4, "ghost_").alias("key"), F.lit(True).alias("deleted"), F.lit("").alias("value"))
    return versions.in_range(versions.latest(ops.unionByName(ghosts)), "ghost_", "ghost_~").select("key", "seq", "deleted")


@_query(LIVE)
def kv_upsert_order_insensitive(spark, sf):
    ops = A.ops(spark, sf)
    return versions.snapshot(ops.where("seq % 2 = 0").unionByName(ops.where("seq % 2 = 1")).unionByName(ops.where("seq % 3 = 0")))


def _store(spark, **limits) -> Store:
    return Store(spark, f"{tail.shared_folder(spark)}/store-{uuid.uuid4().hex}", StoreConfig(level0_tables=2, **limits))


@_query(LIVE)
def store_cycle(spark, sf):
    """Batches out of order, flushed and compacted; a store opened again on the same files answers."""
    store, ops = _store(spark), A.ops(spark, sf)
    for part in (2, 0, 3, 1):
        store.apply(ops.where(F.col("seq") % 4 == part))
        if part:
            store.flush()
    store.compact()
    return Store(spark, store.path, store.config).snapshot()


@_query(LIVE)
def store_flush_late(spark, sf):
    """A batch of older sequences that comes after a flush of newer ones is neither hidden nor lost."""
    store, ops = _store(spark), A.ops(spark, sf)
    middle = ops.agg(F.percentile_approx("seq", 0.5)).first()[0]
    store.apply(ops.where(F.col("seq") > middle))
    store.flush()
    store.apply(ops.where(F.col("seq") <= middle))
    store.flush()
    store.flush()
    return store.snapshot()


@_query(f"SELECT * FROM ({LIVE}) WHERE key >= 'user_0010' AND key < 'user_0050'")
def store_compact_readers(spark, sf):
    """A scan planned before a compaction reads the tables of its own version."""
    store, ops = _store(spark), A.ops(spark, sf)
    for part in (0, 1):
        store.apply(ops.where(F.col("seq") % 2 == part))
        store.flush()
    planned = store.scan("user_0010", "user_0050")
    store.compact()
    return planned


@_query("SELECT CAST(1 AS INTEGER) AS level, count(*) AS n_entries, count(*) FILTER (v.deleted) AS n_deletes, min(v.seq) AS min_seq, max(v.seq) AS max_seq, min(key) AS first_key, max(key) AS last_key FROM newest WHERE NOT v.deleted")
def store_manifest(spark, sf):
    """What the manifest tells after all tables became one and tombstones had nothing to hide."""
    store, ops = _store(spark), A.ops(spark, sf)
    for part in (1, 0):
        store.apply(ops.where(F.col("seq") % 2 == part))
        store.flush()
    store.compact()
    return store.manifest().select("level", "n_entries", "n_deletes", "min_seq", "max_seq", "first_key", "last_key")


_REQUEST = "CASE WHEN event_type = 'error' THEN 'delete' WHEN event_id % 3 = 0 THEN 'put' WHEN event_id % 11 = 5 THEN 'ping' ELSE 'get' END"


@_query(f"""WITH r AS (SELECT event_id + 1 AS seq, 'user_' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS key, props, {_REQUEST} AS kind FROM events),
w AS (SELECT *, last_value(CASE WHEN kind IN ('put', 'delete') THEN seq END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq) AS at FROM r)
SELECT w.seq, w.kind, 'OK' AS status, w.kind = 'get' AND coalesce(x.kind = 'put', FALSE) AS found, CASE WHEN w.kind = 'get' AND x.kind = 'put' THEN x.props END AS value
FROM w LEFT JOIN r x ON w.kind = 'get' AND x.seq = w.at""")
def request_dispatch(spark, sf):
    """Framed requests are opened, decoded by kind and answered in order by one pass over each key."""
    e = A.table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_id") % 3 == 0, "put").when(F.col("event_id") % 11 == 5, "ping").otherwise("get")
    sent = e.select((F.col("event_id") + 1).alias("seq"), A.padded(F.col("user_id"), 4, "user_").alias("key"), "props", kind.alias("kind"))
    frame = F.lit(None).cast("binary")
    for name in ("get", "put", "delete", "ping"):
        frame = F.when(F.col("kind") == name, messages.message(name, {"key": F.col("key"), "value": F.col("props")})).otherwise(frame)
    return messages.dispatch(sent.select("seq", frame.alias("frame")))


@_query("SELECT key, count(*) AS versions, count(*) FILTER (NOT deleted) AS puts, count(*) FILTER (deleted) AS deletes FROM a1_ops GROUP BY key")
def kv_history_depth(spark, sf):
    return versions.history(A.ops(spark, sf))


@_query("SELECT count(*) AS entries, CAST(sum(strlen(key) + strlen(value) + 48) AS BIGINT) AS bytes, max(seq) AS last_seq, sum(strlen(key) + strlen(value) + 48) >= 16384 AS should_flush FROM a2_runs WHERE run = 8")
def mem_stats(spark, sf):
    return versions.memory_stats(A.runs(spark, sf).where("run = 8"), 16384)


@_query("SELECT * FROM manifest")
def sst_manifest(spark, sf):
    return tables.manifest(A.runs(spark, sf).where("level >= 0"))


@_query("""SELECT run, block, max(key) AS last_key, count(*) AS entries, CAST(sum(b) AS BIGINT) AS bytes FROM fold GROUP BY run, block""")
def sst_block_index(spark, sf):
    return tables.block_index(A.runs(spark, sf).where("level >= 0"))


@_query("""SELECT run, level, row_number() OVER (PARTITION BY level ORDER BY CASE WHEN level = 0 THEN -max_seq END, CASE WHEN level > 0 THEN first_key END, run) AS place FROM manifest""")
def l0_recency(spark, sf):
    return tables.read_order(_manifest(spark, sf)).select("run", "level", "place")


_LEVELS = """SELECT level, count(*) AS n_tables, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(CASE WHEN level = 0 THEN 0 ELSE 8192 * power(10, level - 1) END AS BIGINT) AS budget,
CASE WHEN level = 0 THEN count(*) >= 4 ELSE sum(bytes) > 8192 * power(10, level - 1) END AS over FROM manifest GROUP BY level"""


@_query(_LEVELS)
def level_stats(spark, sf):
    return tables.level_stats(_manifest(spark, sf), base=8192)


@_query(f"SELECT min(level) AS level FROM ({_LEVELS}) WHERE over")
def compact_pick(spark, sf):
    return tables.pick_level(_manifest(spark, sf), base=8192)


_MERGE = "SELECT key, seq, deleted, value FROM a2_runs WHERE level IN ({}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC, source_rank) = 1"


@_query(_MERGE.format("0, 1"))
def compact_merge(spark, sf):
    return tables.merge(A.runs(spark, sf).where("level in (0, 1)"), drop_tombstones=False)


@_query(f"SELECT * FROM ({_MERGE.format('1, 2')}) WHERE NOT deleted")
def compact_gc(spark, sf):
    return tables.merge(A.runs(spark, sf).where("level in (1, 2)"), drop_tombstones=True)


@_query(f"""SELECT run, level, n_entries, max_seq FROM manifest WHERE level > 1
UNION ALL SELECT 9 AS run, 1 AS level, count(*) AS n_entries, max(seq) AS max_seq FROM ({_MERGE.format('0, 1')})""")
def compact_swap(spark, sf):
    runs = A.runs(spark, sf)
    have = tables.manifest(runs.where("level >= 0"))
    merged = tables.merge(runs.where("level in (0, 1)"), drop_tombstones=False)
    new = tables.manifest(merged.withColumn("run", F.lit(9)).withColumn("level", F.lit(1)))
    return tables.swap(have, have.where("level in (0, 1)"), new).select("run", "level", "n_entries", "max_seq")


@_query("""SELECT segment, pos, seq, key, deleted, value FROM a3_wal w
WHERE NOT EXISTS (SELECT 1 FROM a3_wal b WHERE b.segment = w.segment AND NOT b.crc_ok AND b.pos <= w.pos)""")
def wal_recover_prefix(spark, sf):
    return recovery.valid_prefix(A.wal(spark, sf)).drop("crc_ok")


@_query("""SELECT key, arg_max(struct_pack(seq := seq, deleted := deleted), seq).seq AS seq, arg_max(deleted, seq) AS deleted FROM a3_wal w
WHERE NOT EXISTS (SELECT 1 FROM a3_wal b WHERE b.segment = w.segment AND NOT b.crc_ok AND b.pos <= w.pos) GROUP BY key""")
def wal_recover_state(spark, sf):
    return recovery.recover(A.wal(spark, sf)).select("key", "seq", "deleted")


@_query("SELECT segment, max(seq) AS max_seq, count(*) AS records FROM a3_wal WHERE segment < (SELECT max(segment) FROM a3_wal) GROUP BY segment HAVING max(seq) <= (SELECT max(max_seq) FROM manifest)")
def wal_retire(spark, sf):
    installed = tables.manifest(A.runs(spark, sf).where("level >= 0")).agg(F.max("max_seq")).first()[0] or 0
    return recovery.retirable(A.wal(spark, sf), installed)


@_query(None)
def wal_crc(spark, sf):
    payload = codec.wal_payload(F.col("deleted"), F.col("seq"), F.col("key"), F.col("value"))
    return A.ops(spark, sf).select("seq", F.octet_length(payload).alias("bytes"), F.crc32(payload).alias("crc"))


@_query("SELECT * FROM (VALUES ('', CAST(0 AS BIGINT)), ('a', 3904355907), ('abc', 891568578), ('123456789', 3421780262)) t(bytes, crc)")
def crc_known_answers(spark, sf):
    return spark.createDataFrame([("",), ("a",), ("abc",), ("123456789",)], "bytes string").select("bytes", F.crc32(F.col("bytes").cast("binary")).alias("crc"))


@_query("""SELECT seq, CASE WHEN deleted THEN 'DELETE' ELSE 'PUT' END || '|' || strlen(key) || '|' || key || '|' || strlen(value) || '|' || value AS command, deleted, key, value, TRUE AS same FROM a1_ops""")
def cmd_codec(spark, sf):
    rows = A.ops(spark, sf).select("seq", codec.command(F.col("deleted"), F.col("key"), F.col("value")).alias("c"), "deleted", "key", "value")
    rows = rows.withColumn("d", codec.decode_command(F.col("c")))
    same = (F.col("d.deleted") == F.col("deleted")) & (F.col("d.key").cast("string") == F.col("key")) & (F.col("d.value").cast("string") == F.col("value"))
    return rows.select("seq", F.col("c").cast("string").alias("command"), "deleted", "key", "value", same.alias("same"))


_STATUS = "CASE status_code WHEN 0 THEN 'OK' WHEN 1 THEN 'NOT_FOUND' WHEN 2 THEN 'NOT_LEADER' WHEN 3 THEN 'TIMEOUT' WHEN 4 THEN 'OVERLOADED' WHEN 5 THEN 'ERROR' ELSE 'UNKNOWN' END"


@_query(f"SELECT {_STATUS} AS status, count(*) AS n FROM a6_tele GROUP BY 1")
def frame_status(spark, sf):
    return A.telemetry(spark, sf).groupBy(codec.status_name(F.col("status_code")).alias("status")).agg(F.count("*").alias("n"))


@_query("SELECT event_id, 21 + strlen(props) AS bytes, CAST(2 AS BIGINT) AS kind, CAST(event_id % 6 AS BIGINT) AS status, user_id AS leader, event_id % 2 = 0 AS found, props AS value FROM events")
def msg_codec(spark, sf):
    """Answers to gets, framed and opened again."""
    fields = {"status": F.col("event_id") % 6, "leader": F.col("user_id"), "found": F.col("event_id") % 2 == 0, "value": F.col("props")}
    sent = A.table(spark, sf, "events").select("event_id", messages.message("got", fields).alias("m"))
    read = sent.withColumn("f", messages.open_frame(F.col("m"))).withColumn("d", messages.decode("got", F.col("f.payload")))
    return read.select("event_id", F.octet_length("m").cast("bigint").alias("bytes"), F.col("f.kind").alias("kind"), F.col("d.status").alias("status"), F.col("d.leader").alias("leader"), F.col("d.found").alias("found"), F.col("d.value").cast("string").alias("value"))


@_query("""SELECT CASE WHEN event_id % 7 = 0 THEN 'NOT_LEADER' WHEN status_code = 0 THEN 'OK' WHEN latency_ms >= 100 THEN 'TIMEOUT' ELSE 'ERROR' END AS status, count(*) AS n FROM a6_tele GROUP BY 1""")
def proposal_status(spark, sf):
    t = A.telemetry(spark, sf)
    return t.groupBy(codec.proposal_status(F.col("event_id") % 7 != 0, F.col("status_code") == 0, F.col("latency_ms"), 100).alias("status")).agg(F.count("*").alias("n"))


@_query("""WITH r AS (SELECT cluster, match_index, current_term, row_number() OVER (PARTITION BY cluster ORDER BY match_index DESC, peer) AS place, count(*) OVER (PARTITION BY cluster) AS n FROM a5_peers)
SELECT cluster, match_index AS candidate, coalesce(l.term, 0) AS term_at, CASE WHEN coalesce(l.term, 0) = current_term THEN match_index ELSE 0 END AS commit_index
FROM r LEFT JOIN a4_leader l ON l.idx = r.match_index WHERE place = n // 2 + 1""")
def raft_commit_index(spark, sf):
    return replication.commit_index(A.peers(spark, sf), A.leader(spark, sf))


def _ends(spark, sf):
    """Peers with the end of their log."""
    at = replication.term_at(A.leader(spark, sf), A.peers(spark, sf), "match_index")
    return at.withColumnRenamed("term_at", "last_term").withColumnRenamed("match_index", "last_index")


_ENDS = "ends AS (SELECT cluster, peer, match_index AS last_index, current_term, coalesce(l.term, 0) AS last_term FROM a5_peers LEFT JOIN a4_leader l ON l.idx = match_index)"


@_query(f"""WITH {_ENDS} SELECT a.cluster, a.peer, b.peer AS candidate, (a.last_term, a.last_index) > (b.last_term, b.last_index) AS strictly_better
FROM ends a JOIN ends b ON a.cluster = b.cluster AND a.peer <> b.peer""")
def raft_up_to_date(spark, sf):
    a = _ends(spark, sf)
    b = a.select(F.col("cluster").alias("c"), F.col("peer").alias("candidate"), F.col("last_term").alias("t"), F.col("last_index").alias("i"))
    joined = a.join(b, (F.col("cluster") == F.col("c")) & (F.col("peer") != F.col("candidate")))
    return joined.select("cluster", "peer", "candidate", replication.better(F.col("last_term"), F.col("last_index"), F.col("t"), F.col("i")).alias("strictly_better"))


@_query(f"""WITH {_ENDS}, voter AS (SELECT *, CASE WHEN peer % 7 = 0 THEN 3 END AS voted_for FROM ends),
c AS (SELECT *, current_term + 1 AS term FROM ends QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY last_term DESC, last_index, peer) <= 2)
SELECT v.cluster, c.peer AS candidate, count(*) FILTER (v.peer = c.peer OR (c.term >= v.current_term AND (v.voted_for IS NULL OR v.voted_for = c.peer) AND NOT (v.last_term, v.last_index) > (c.last_term, c.last_index))) AS granted,
count(*) // 2 + 1 AS needed, granted >= count(*) // 2 + 1 AS won FROM voter v JOIN c ON v.cluster = c.cluster GROUP BY v.cluster, c.peer""")
def raft_vote_tally(spark, sf):
    ends = _ends(spark, sf)
    w = Window.partitionBy("cluster").orderBy(F.desc("last_term"), "last_index", "peer")
    candidates = ends.withColumn("n", F.row_number().over(w)).where("n <= 2").withColumn("term", F.col("current_term") + 1)
    return replication.votes(ends.withColumn("voted_for", F.when(F.col("peer") % 7 == 0, F.lit(3))), candidates)


@_query("""SELECT cluster, count(*) FILTER (is_leader OR age_ms < 500) AS reachable, count(*) // 2 + 1 AS needed, reachable < count(*) // 2 + 1 AS step_down
FROM (SELECT cluster, peer = min(peer) OVER (PARTITION BY cluster) AS is_leader, (peer * 373) % 1000 AS age_ms FROM a5_peers) GROUP BY cluster""")
def raft_quorum(spark, sf):
    p = A.peers(spark, sf).withColumn("is_leader", F.col("peer") == F.min("peer").over(Window.partitionBy("cluster"))).withColumn("age_ms", F.col("peer") * 373 % 1000)
    return replication.quorum(p, 500)


@_query("""WITH c AS (SELECT coalesce(min(f.idx), 9223372036854775807) AS first_bad FROM a4_follower f JOIN a4_leader l USING (idx) WHERE f.term <> l.term)
SELECT idx, term, key, deleted, value, 'kept' AS origin FROM a4_follower, c WHERE idx < first_bad UNION ALL
SELECT idx, term, key, deleted, value, 'appended' AS origin FROM a4_leader WHERE idx > (SELECT max(idx) FROM a4_follower, c WHERE idx < first_bad)""")
def raft_log_merge(spark, sf):
    return replication.merge_logs(A.follower(spark, sf), A.leader(spark, sf))


@_query("""SELECT cluster, peer, match_index, count(l.idx) AS entries, CAST(coalesce(sum(strlen(l.key) + strlen(l.value)), 0) AS BIGINT) AS bytes
FROM a5_peers LEFT JOIN a4_leader l ON l.idx > match_index GROUP BY ALL""")
def raft_peer_backlog(spark, sf):
    return replication.backlog(A.peers(spark, sf), A.leader(spark, sf))


@_query("SELECT r.idx, coalesce(l.term, 0) AS term_at FROM (SELECT range * 997 AS idx FROM range(40)) r LEFT JOIN a4_leader l USING (idx)")
def raft_term_at(spark, sf):
    return replication.term_at(A.leader(spark, sf), spark.range(40).select((F.col("id") * 997).alias("idx")))


@_query("SELECT max(idx) AS last_index, arg_max(term, idx) AS last_term, count(*) AS size FROM a4_leader")
def raft_log_end(spark, sf):
    return A.leader(spark, sf).agg(F.max("idx").alias("last_index"), F.max_by("term", "idx").alias("last_term"), F.count("*").alias("size"))


@_query("SELECT idx, term FROM a4_leader, a4_n WHERE idx >= n * 19 // 20")
def raft_entries_from(spark, sf):
    return A.leader(spark, sf).where(F.col("idx") >= A.log_size(spark, sf) * 19 // 20).select("idx", "term")


@_query("SELECT key, arg_max(value, idx) AS value FROM a4_leader, a4_n WHERE idx <= n * 2 // 3 GROUP BY key HAVING NOT arg_max(deleted, idx)")
def raft_apply_committed(spark, sf):
    return replication.apply_committed(A.leader(spark, sf), A.log_size(spark, sf) * 2 // 3)


@_query("SELECT f.idx, f.term, f.idx <= n * 9 // 10 AND f.term = coalesce(l.term, 0) AS acked FROM a4_n, a4_follower f LEFT JOIN a4_leader l ON f.idx = l.idx")
def raft_ack(spark, sf):
    return replication.acknowledged(A.follower(spark, sf), A.leader(spark, sf), A.log_size(spark, sf) * 9 // 10)


@_query("SELECT CAST(CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) % 16 AS BIGINT) AS shard, count(DISTINCT key) AS keys, count(*) AS entries FROM a1_ops GROUP BY 1")
def shard_route(spark, sf):
    per = A.ops(spark, sf).groupBy("key").agg(F.count("*").alias("n"))
    return per.groupBy(codec.shard(F.col("key"), 16).alias("shard")).agg(F.count("*").alias("keys"), F.sum("n").alias("entries"))


@_query("""SELECT run, p, CAST(greatest(64, ceil(-n_entries * ln(p) / (ln(2e0) * ln(2e0)))) AS BIGINT) AS raw, CAST(ceil(raw / 8e0) * 8 AS BIGINT) AS bits,
CAST(least(16, greatest(1, ceil(ceil(raw / 8e0) * 8 / n_entries * ln(2e0)))) AS BIGINT) AS hashes FROM manifest, (VALUES (0.01e0), (0.05e0)) t(p)""")
def bloom_sizing(spark, sf):
    m = tables.manifest(A.runs(spark, sf).where("level >= 0")).select("run", "n_entries", F.explode(F.array(F.lit(0.01), F.lit(0.05))).alias("p"))
    bits, k = bloom.sizing_columns(F.col("n_entries"), F.col("p"))
    raw = F.greatest(F.lit(64), F.ceil(-F.col("n_entries") * F.log("p") / F.lit(0.6931471805599453 * 0.6931471805599453))).cast("bigint")
    return m.select("run", "p", raw.alias("raw"), bits.alias("bits"), k.alias("hashes"))


@_query(None)
def bloom_probe(spark, sf):
    """Members all pass; the share of others that pass stays near the rate asked for."""
    labels, docs = A.table(spark, sf, "labels"), A.table(spark, sf, "documents")
    held = bloom.build(labels.select(A.padded(F.col("doc_id"), 8, "doc_").alias("key")), "key", 0.05)
    members = labels.select("doc_id").distinct().withColumn("is_member", F.lit(True))
    probed = docs.join(members, "doc_id", "left").select(A.padded(F.col("doc_id"), 8, "doc_").alias("key"), F.coalesce("is_member", F.lit(False)).alias("is_member"))
    probed = probed.withColumn("passes", held.might_contain(F.col("key")))
    return probed.groupBy("is_member").agg(F.count("*").alias("n"), F.count_if("passes").alias("passed")).withColumn("fill_ratio", F.lit(held.fill_ratio()))


@_query("SELECT run, count(*) AS n, count(*) AS passed, count(*) AS passed_again FROM a2_runs WHERE level >= 0 GROUP BY run")
def bloom_members(spark, sf):
    """Each table's filter, stored as bytes and loaded again, passes all of the table's keys."""
    rows = A.runs(spark, sf).where("level >= 0").select("run", "key")
    out = None
    for r in rows.select("run").distinct().orderBy("run").collect():
        own = rows.where(F.col("run") == r.run)
        held = bloom.build(own, "key", 0.01)
        again = bloom.Bloom.load(held.serialize())
        one = own.select("run", held.might_contain(F.col("key")).alias("p"), again.might_contain(F.col("key")).alias("q"))
        one = one.groupBy("run").agg(F.count("*").alias("n"), F.count_if("p").alias("passed"), F.count_if("q").alias("passed_again"))
        out = one if out is None else out.unionByName(one)
    return out


@_query("""WITH r AS (SELECT op, latency_ms, row_number() OVER (PARTITION BY op ORDER BY latency_ms) - 1 AS place, count(*) OVER (PARTITION BY op) AS n FROM a6_tele)
SELECT op, n, max(latency_ms) FILTER (place = n // 2) AS p50, max(latency_ms) FILTER (place = n * 99 // 100) AS p99 FROM r GROUP BY op, n""")
def bench_latency_stats(spark, sf):
    return telemetry.latency_stats(A.telemetry(spark, sf), "op", "latency_ms").drop("avg")


_T = "CAST(sum(CAST(latency_ms AS DECIMAL(38, 6))) AS DOUBLE)"


@_query(f"""SELECT op, count(*) FILTER (status_code = 0) AS success, count(*) FILTER (status_code <> 0) AS failed, round({_T}, 2) AS total_ms, round({_T} / count(*), 2) AS avg_ms, round(count(*) * 1000 / {_T}, 2) AS ops_per_sec FROM a6_tele GROUP BY op""")
def tele_batch_write(spark, sf):
    return telemetry.batch_results(A.telemetry(spark, sf), "op", "latency_ms", F.col("status_code") == 0)


@_query("""WITH last AS (SELECT event_id % 5 AS node, arg_max(status_code, event_id) AS code FROM a6_tele WHERE event_id % 5 <> 4 GROUP BY 1)
SELECT n_nationkey AS node, n_name AS name, CASE WHEN code IS NULL THEN 'offline' WHEN code = 3 THEN 'degraded' ELSE 'healthy' END AS status,
CASE code WHEN 0 THEN 'leader' WHEN 2 THEN 'follower' WHEN 3 THEN 'candidate' ELSE 'unknown' END AS role FROM nation LEFT JOIN last ON node = n_nationkey WHERE n_nationkey < 5""")
def tele_cluster_status(spark, sf):
    t = A.telemetry(spark, sf).where("event_id % 5 <> 4")
    last = t.groupBy((F.col("event_id") % 5).alias("at")).agg(F.max_by("status_code", "event_id").alias("code"))
    nodes = A.table(spark, sf, "nation").where("n_nationkey < 5").select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("name"))
    status, role = telemetry.node_status(F.col("code"))
    return nodes.join(last, F.col("at") == F.col("node"), "left").select("node", "name", status.alias("status"), role.alias("role"))


@_query("""SELECT 'node' || (user_id % 3) AS node, lpad(CAST(event_id AS VARCHAR), 12, '0') AS timestamp,
'[INFO] ' || CASE event_type WHEN 'click' THEN 'became LEADER of term 3' WHEN 'view' THEN 'Granted ballot' WHEN 'purchase' THEN 'now a candidate' ELSE 'election timeout' END || ' ' || user_id AS message,
CASE event_type WHEN 'click' THEN 'leader' WHEN 'view' THEN 'vote' WHEN 'purchase' THEN 'candidate' ELSE 'election' END AS type
FROM events WHERE event_type IN ('click', 'view', 'purchase', 'signup') ORDER BY event_id DESC LIMIT 50""")
def tele_raft_events(spark, sf):
    return telemetry.log_events(A.log_lines(spark, sf))


@_query("SELECT event_id, op, status_code FROM a6_tele ORDER BY ts DESC, event_id DESC LIMIT 50")
def tele_activity(spark, sf):
    return telemetry.newest(A.telemetry(spark, sf), 50, F.desc("ts"), F.desc("event_id")).select("event_id", "op", "status_code")


@_query("SELECT seq, key, NOT deleted AS found, CASE WHEN NOT deleted THEN value END AS value FROM a1_ops")
def read_your_writes(spark, sf):
    """A read just after each write; sequences are unique, so what it must see is the write itself."""
    return versions.as_of_reads(A.ops(spark, sf), F.lit(True))


@_query("""SELECT r.seq, r.key, NOT arg_max(w.deleted, w.seq) AS found, CASE WHEN NOT arg_max(w.deleted, w.seq) THEN arg_max(w.value, w.seq) END AS value
FROM (SELECT seq, key, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS before FROM a1_ops) r JOIN a1_ops w ON w.key = r.key AND w.seq = r.before GROUP BY r.seq, r.key""")
def read_before_write(spark, sf):
    """A read just before each write sees the write before it; first writes have none."""
    ops = A.ops(spark, sf)
    reads = versions.as_of_reads(ops, F.lit(True))
    after = ops.select("key", F.col("seq").alias("at"))
    w = Window.partitionBy("key").orderBy("at")
    before = after.withColumn("seq", F.lag("at").over(w)).where("seq IS NOT NULL")
    return before.join(reads, ["key", "seq"]).select(F.col("at").alias("seq"), "key", "found", "value")


@_query("SELECT v.value IS NOT NULL AND v.value = 'v2' AS updated, FALSE AS found_after_delete FROM (SELECT struct_pack(value := 'v2') AS v)")
def crud_cycle(spark, sf):
    """put, update and get; delete and get again."""
    rows = spark.createDataFrame([(1, "k", False, "v1"), (2, "k", False, "v2"), (3, "other", False, "x")], "seq bigint, key string, deleted boolean, value string")
    gone = rows.unionByName(spark.createDataFrame([(4, "k", True, "")], rows.schema))
    before = versions.get(rows, "k").select((F.col("found") & (F.col("value") == "v2")).alias("updated"), "key")
    return before.join(versions.get(gone, "k").select("key", F.col("found").alias("found_after_delete")), "key").drop("key")


@_query(LIVE)
def stream_snapshot(spark, sf):
    path = f"{sf}/events.parquet"
    stream = tail.source(spark, path)
    deleted = F.col("event_type") == "error"
    ops = stream.select((F.col("event_id") + 1).alias("seq"), A.padded(F.col("user_id"), 4, "user_").alias("key"), deleted.alias("deleted"), F.when(deleted, F.lit("")).otherwise(F.col("props")).alias("value"))
    return tail.snapshot(ops)


# the running size of a block restarts, so its oracle folds each run row by row
_FOLD = """o AS (SELECT run, key, strlen(key) + strlen(value) + 17 AS b, row_number() OVER (PARTITION BY run ORDER BY key) AS i FROM a2_runs WHERE level >= 0),
fold AS (SELECT run, key, i, b, b AS size, CAST(0 AS BIGINT) AS block FROM o WHERE i = 1 UNION ALL
SELECT o.run, o.key, o.i, o.b, CASE WHEN f.size >= 4096 THEN o.b ELSE f.size + o.b END, CASE WHEN f.size >= 4096 THEN f.block + 1 ELSE f.block END FROM fold f JOIN o ON o.run = f.run AND o.i = f.i + 1)"""


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for k, (_, sql) in _ALL.items():
        if sql is None:
            continue
        with_clause = A.CTE + (f", {_FOLD}" if k == "sst_block_index" else "")
        head = "WITH RECURSIVE" if k == "sst_block_index" else "WITH"
        out[k] = f"{head} {with_clause} " + (", " + sql[5:] if sql.startswith("WITH ") else sql)
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live rows of a key range of the event log, in key order."""
    return versions.scan(A.ops(spark, sf_dir), "user_0000", "user_0100")
