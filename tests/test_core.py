"""Properties of the core operators that tables alone don't show."""

import random
import struct
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamina import schema
from lamina.functions import codec, messages
from lamina.operators import bloom, recovery, replication, tables, telemetry, versions
from lamina.plans.store import Store, StoreConfig
from lamina.sources import framed
from lamina.streaming import tail

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def ops(spark, rows):
    return spark.createDataFrame([(i, k, v is None, v or "") for i, (k, v) in enumerate(rows, 1)], schema.OPS)


def model(rows):
    out = {}
    for k, v in rows:
        out[k] = v
    return {k: v for k, v in out.items() if v is not None}


@few
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.one_of(st.none(), st.text("xyz", max_size=2))), max_size=25), st.randoms())
def test_last_writer_wins_in_any_order(spark, rows, rnd):
    df = ops(spark, rows)
    shuffled = df.collect()
    rnd.shuffle(shuffled)
    got = versions.snapshot(spark.createDataFrame(shuffled, df.schema)).collect()
    assert {r.key: r.value for r in got} == model(rows)


def test_empty_value_is_found_and_tombstone_is_not(spark):
    df = ops(spark, [("a", ""), ("b", "1"), ("b", None)])
    assert versions.get(df, "a").first()[1:] == ("OK", True, "")
    assert versions.get(df, "b").first()[1:] == ("OK", False, None)
    assert versions.get(df, "c").first()[1:] == ("OK", False, None)


def test_scan_is_half_open_and_ordered(spark):
    df = ops(spark, [("d", "4"), ("a", "1"), ("c", "3"), ("b", "2")])
    assert [r.key for r in versions.scan(df, "b", "d").collect()] == ["b", "c"]
    assert versions.scan(df, "b", "").count() == versions.scan(df, "d", "b").count() == 0


def test_equal_sequences_go_to_the_newest_source(spark):
    df = spark.createDataFrame([("k", 5, False, "old", 3), ("k", 5, False, "new", 1)], "key string, seq bigint, deleted boolean, value string, source_rank int")
    assert versions.snapshot(df, -F.col("source_rank")).first().value == "new"


def test_key_filter_reaches_the_scan(spark, tmp_path):
    ops(spark, [("a", "1"), ("b", "2")]).write.parquet(f"{tmp_path}/t")
    df = versions.get(spark.read.parquet(f"{tmp_path}/t"), "a")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,a)" in plan
    plan = versions.live(versions.latest(spark.read.parquet(f"{tmp_path}/t")))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: []" in plan


def test_tombstones_stay_until_the_deepest_level(spark):
    rows = [(3, "k", True, "", 0), (1, "k", False, "old", 2), (2, "z", False, "1", 1)]
    df = spark.createDataFrame(rows, "seq bigint, key string, deleted boolean, value string, source_rank int")
    kept = {r.key: r.deleted for r in tables.merge(df.where("source_rank < 2"), drop_tombstones=False).collect()}
    assert kept == {"k": True, "z": False}
    assert [r.key for r in tables.merge(df, drop_tombstones=True).collect()] == ["z"]


def test_read_order_of_level_0(spark):
    rows = [(1, 0, "a", 5, "k"), (2, 0, "b", 9, "a"), (3, 0, "c", 9, "b"), (4, 1, "d", 1, "m"), (5, 1, "e", 2, "b")]
    df = spark.createDataFrame(rows, "run int, level int, path string, max_seq bigint, first_key string")
    got = [r.run for r in tables.read_order(df).orderBy("level", "place").collect()]
    assert got == [3, 2, 1, 5, 4]


def test_block_index_restarts(spark):
    df = spark.createDataFrame([(i, f"k{i:03d}", False, "v" * 30, 1) for i in range(100)], "seq bigint, key string, deleted boolean, value string, run int")
    got = tables.block_index(df, 200).orderBy("block").collect()
    size, block, count, want = 0, 0, 0, []
    for i in range(100):
        size, count = size + 17 + 4 + 30, count + 1
        if size >= 200:
            want.append((block, f"k{i:03d}", count, size))
            size, count, block = 0, 0, block + 1
    if count:
        want.append((block, "k099", count, size))
    assert [tuple(r)[1:] for r in got] == want


def test_recovery_keeps_the_prefix_of_each_segment(spark):
    rows = [(0, 0, True), (0, 1, False), (0, 2, True), (1, 0, True), (2, 0, False), (2, 1, True)]
    df = spark.createDataFrame(rows, "segment bigint, pos bigint, crc_ok boolean")
    assert sorted((r.segment, r.pos) for r in recovery.valid_prefix(df).collect()) == [(0, 0), (1, 0)]


def test_crc_check_value(spark):
    assert spark.range(1).select(F.crc32(F.lit("123456789"))).first()[0] == 0xCBF43926


MALFORMED = [b"", b"PUT", b"PUT|", b"PUT|x|k|1|v", b"PUT|5|k|1|v", b"GET|1|k|1|v", b"PUT|1|k1|v", b"PUT|1|k|9|v", b"PUT|1|k|", b"PUT||k|1|v", b"PUT|99999999999999999999|k|1|v"]


def test_commands_round_trip(spark):
    pairs = [(b"key", b"value"), (b"a|b|3|", b"|x|"), (b"", b""), (b"\x00\xff|", b"\xfe\x00"), (b"k", b"v" * 100_000)]
    df = spark.createDataFrame([(d, bytearray(k), bytearray(v)) for k, v in pairs for d in (False, True)], "deleted boolean, key binary, value binary")
    got = df.select("*", codec.decode_command(codec.command(F.col("deleted"), F.col("key"), F.col("value"))).alias("d")).collect()
    for r in got:
        assert (r.d.deleted, bytes(r.d.key), bytes(r.d.value)) == (r.deleted, bytes(r.key), b"" if r.deleted else bytes(r.value))
    bad = spark.createDataFrame([(bytearray(b),) for b in MALFORMED], "c binary").select(codec.decode_command(F.col("c")).alias("d"))
    assert bad.where("d IS NOT NULL").count() == 0
    extra = spark.createDataFrame([(bytearray(b"PUT|1|k|1|vTRAILING"),)], "c binary").select(codec.decode_command(F.col("c")).alias("d")).first().d
    assert bytes(extra.value) == b"v"


def test_names_and_lists(spark):
    row = spark.range(1).select(codec.comma_list(F.lit(" a, ,b ,")).alias("l"), codec.sync_mode(F.lit("Always")).alias("m"), codec.sync_mode(F.lit("NONE")).alias("n"), codec.status_name(F.lit(9)).alias("s"), codec.peers(F.lit("2:h1:70, h2:71")).alias("p")).first()
    assert row.l == ["a", "b"] and (row.m, row.n, row.s) == ("group", "none", "UNKNOWN")
    assert [(p.id, p.address) for p in row.p] == [(2, "h1:70"), (None, "h2:71")]


def wal_bytes(records):
    out = b""
    for seq, key, value in records:
        v = b"" if value is None else value
        p = bytes([2 if value is None else 1]) + struct.pack(">QI", seq, len(key)) + key + struct.pack(">I", len(v)) + v
        out += struct.pack(">II", len(p), zlib.crc32(p)) + p
    return out


def test_framed_log_written_and_read(spark, tmp_path):
    df = ops(spark, [("k1", "v1"), ("k2", "v2"), ("k3", None)])
    payload = codec.wal_payload(F.col("deleted"), F.col("seq"), F.col("key"), F.col("value"))
    framed.write_frames(df.select(codec.record(payload).alias("record")).coalesce(1), f"{tmp_path}/wal")
    got = framed.read_wal(spark, f"{tmp_path}/wal").orderBy("seq").collect()
    assert [(r.seq, bytes(r.key), r.deleted, bytes(r.value), r.crc_ok) for r in got] == [(1, b"k1", False, b"v1", True), (2, b"k2", False, b"v2", True), (3, b"k3", True, b"", True)]
    raw = next((tmp_path / "wal").glob("*.wal")).read_bytes()
    assert raw == wal_bytes([(1, b"k1", b"v1"), (2, b"k2", b"v2"), (3, b"k3", None)])


@pytest.mark.parametrize("harm", ["cut", "flip", "garbage"])
def test_damaged_log_keeps_its_prefix(spark, tmp_path, harm):
    raw = wal_bytes([(1, b"a", b"1"), (2, b"b", b"2" * 1000)])
    raw = {"cut": raw[:-5], "flip": raw[:-3] + b"\x00" + raw[-2:], "garbage": raw + b"\xff" * 11}[harm]
    (tmp_path / "00000001.wal").write_bytes(raw)
    (tmp_path / "00000002.wal").write_bytes(wal_bytes([(3, b"c", b"3")]))
    df = framed.read_wal(spark, str(tmp_path))
    kept = recovery.valid_prefix(df)
    assert [r.seq for r in kept.orderBy("seq").collect()] == ([1, 3] if harm != "garbage" else [1, 2, 3])
    assert df.where("NOT crc_ok").count() == 1


def test_raft_log_file(spark, tmp_path):
    def entry(term, idx, command):
        p = struct.pack(">QQQ", term, idx, len(command)) + command
        return struct.pack(">II", len(p), zlib.crc32(p)) + p

    good = framed.raft_header() + entry(1, 1, b"x") + entry(2, 2, b"y" * 100)
    (tmp_path / "a.log").write_bytes(good + entry(2, 3, b"z")[:-1])
    (tmp_path / "b.log").write_bytes(b"garbage header that is long enough")
    (tmp_path / "c.log").write_bytes(b"")
    got = framed.read_raft_log(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r.idx, r.term, bytes(r.command)) for r in got] == [(1, 1, b"x"), (2, 2, b"y" * 100)]


def log(spark, *entries):
    return spark.createDataFrame(list(entries), "idx bigint, term bigint")


def test_conflicts_truncate_and_gaps_are_ignored(spark):
    own = log(spark, (1, 1), (2, 1), (3, 2), (4, 2))
    merged = lambda new: sorted((r.idx, r.term) for r in replication.merge_logs(own, new).collect())
    assert merged(log(spark, (3, 3))) == [(1, 1), (2, 1), (3, 3)]
    assert merged(log(spark, (2, 1), (3, 2))) == [(1, 1), (2, 1), (3, 2), (4, 2)]
    assert merged(log(spark, (5, 3), (7, 3))) == [(1, 1), (2, 1), (3, 2), (4, 2), (5, 3)]
    assert merged(log(spark, (9, 9))) == [(1, 1), (2, 1), (3, 2), (4, 2)]


def test_commit_index_needs_the_current_term(spark):
    l = log(spark, *[(i, 1 if i < 4 else 2) for i in range(1, 7)])
    peers = spark.createDataFrame([(0, 1, 6, 2), (0, 2, 5, 2), (0, 3, 3, 2), (1, 1, 3, 2), (1, 2, 3, 2), (1, 3, 6, 2), (1, 4, 2, 2)], "cluster int, peer int, match_index bigint, current_term bigint")
    got = {r.cluster: (r.candidate, r.commit_index) for r in replication.commit_index(peers, l).collect()}
    assert got == {0: (5, 5), 1: (3, 0)}


def test_majority_of_even_clusters(spark):
    rows = spark.createDataFrame([(2,), (3,), (4,), (5,)], "n int").select(replication.needed(F.col("n")).alias("m")).collect()
    assert [r.m for r in rows] == [2, 2, 3, 3]


def test_acknowledged_only_with_its_term(spark):
    got = replication.acknowledged(log(spark, (1, 1), (2, 1), (3, 1)), log(spark, (1, 1), (2, 2), (3, 1)), 2).orderBy("idx").collect()
    assert [r.acked for r in got] == [True, False, False]


def test_bloom(spark):
    keys = spark.range(1000).select(F.concat(F.lit("key_"), "id").alias("key"))
    held = bloom.build(keys, "key", 0.05)
    assert (held.bits, held.hashes) == bloom.sizing(1000, 0.05)
    assert keys.where(~held.might_contain(F.col("key"))).count() == 0
    others = spark.range(10_000).select(F.concat(F.lit("nonexistent_key_"), "id").alias("key"))
    assert others.where(held.might_contain(F.col("key"))).count() < 1000
    assert 0 < held.fill_ratio() < 1
    empty = bloom.build(keys.limit(0), "key", 0.01)
    assert empty.fill_ratio() == 0 and others.where(empty.might_contain(F.col("key"))).count() == 0


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", float(x)) for x in random.Random(1).sample(range(100), 100)] + [("b", 7.0)], "op string, ms double")
    got = {r.op: (r.n, r.p50, r.p99) for r in telemetry.latency_stats(df, "op", "ms").collect()}
    assert got == {"a": (100, 50.0, 99.0), "b": (1, 7.0, 7.0)}


def test_log_events_class(spark):
    lines = ["[t5] LEADER and vote", "[t4] a Vote of term 3", "[t3] Granted", "[t2] the candidate", "[t1] election x]y", "vote without a frame", "[t9] heartbeat"]
    df = spark.createDataFrame([("n", x) for x in lines], "node string, line string")
    assert [(r.timestamp, r.type) for r in telemetry.log_events(df).collect()] == [("t5", "leader"), ("t4", "vote"), ("t3", "vote"), ("t2", "candidate"), ("t1", "election"), ("", "vote")]


def test_store_life_cycle(spark, tmp_path):
    store = Store(spark, str(tmp_path / "kv"), StoreConfig(level0_tables=2))
    kv = lambda d: spark.createDataFrame(list(d.items()), "key string, value string")
    state = lambda s: {r.key: r.value for r in s.snapshot().collect()}
    want = {}
    assert store.flush() is False and store.compact() is None and state(store) == {}
    for i in range(4):
        new = {f"k{j}": f"v{i}-{j}" for j in range(i, i + 4)}
        assert store.put(kv(new)) == len(new)
        want |= new
        store.delete(spark.createDataFrame([(f"k{i}",), ("ghost",)], "key string"))
        want.pop(f"k{i}", None)
        assert state(store) == want
        if i % 2:
            assert store.flush()
        assert state(store) == want
        before = store.last_seq()
        store = Store(spark, store.path, store.config)
        assert store.last_seq() == before
    assert {r.level for r in store.manifest().collect()} == {0}
    assert store.compact() == 0 and store.compact() is None
    m = store.manifest().collect()
    assert [(r.level, r.n_deletes) for r in m] == [(1, 0)] and state(store) == want
    assert [r.key for r in store.scan("k", "l").collect()] == sorted(want)
    asked = spark.createDataFrame([(k,) for k in ("k6", "k0", "none")], "key string")
    assert {r.key: r.value for r in store.multi_get(asked).collect()} == {k: want.get(k) for k in ("k6", "k0", "none")}
    assert store.get("k6").first().value == want["k6"]
    assert store.maybe_flush() is False


def test_compaction_of_only_tombstones_installs_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "kv"), StoreConfig(level0_tables=2))
    for k in "ab":
        store.delete(spark.createDataFrame([(k,)], "key string"))
        store.flush()
    assert store.compact() == 0
    assert store.manifest().count() == 0


def test_config():
    c = StoreConfig.from_env({"LAMINA_MEMORY_BYTES": "10", "LAMINA_BLOOM_RATE": "x", "LAMINA_STALE_READS": "yes", "LAMINA_COMPACTION": "True"})
    assert (c.memory_bytes, c.bloom_rate, c.stale_reads, c.compaction) == (10, 0.01, True, False)


def test_stream_restarts_where_it_was(spark, tmp_path):
    rows = [(f"k{i % 7}", None if i % 5 == 0 else f"v{i}") for i in range(60)]
    df = ops(spark, rows)
    parts = [df.where(f"seq % 3 = {i}") for i in range(3)]
    parts[2].coalesce(1).write.parquet(f"{tmp_path}/log")
    src = lambda: tail.source(spark, f"{tmp_path}/log", 1)
    tail.fold(src(), f"{tmp_path}/state")
    for p in parts[:2]:
        p.coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    got = tail.snapshot(src(), f"{tmp_path}/state")
    assert {r.key: r.value for r in got.collect()} == model(rows)


def test_messages_round_trip(spark):
    entries = F.array(*(F.struct(F.lit(t).cast("bigint").alias("term"), F.lit(i).cast("bigint").alias("idx"), F.lit(c).cast("binary").alias("command")) for t, i, c in ((1, 1, "a|b"), (2, 2, ""), (2, 3, "x" * 300))))
    none = F.array().cast(f"array<{messages.ENTRY}>")
    values = {"u32": F.lit(2**32 - 1), "u64": F.lit(2**40 + 3), "flag": F.lit(True), "text": F.lit("kéy|\0"), "entries": entries}
    for name, fields in messages.FIELDS.items():
        for e in (entries, none) if name == "append" else (none,):
            given = {f: (e if kind == "entries" else values[kind]) for f, kind in fields}
            df = spark.range(1).select(messages.message(name, given).alias("m"))
            df = df.select(messages.open_frame(F.col("m")).alias("f"), messages.open_frame(F.col("m").substr(F.lit(1), F.octet_length("m") - 1)).alias("short"), *(c.alias(f) for f, c in given.items()))
            got = df.select("*", messages.decode(name, F.col("f.payload")).alias("d"), messages.decode(name, F.col("f.payload").substr(F.lit(1), F.octet_length("f.payload") - 1)).alias("cut")).first()
            assert got.f.kind == messages.KINDS[name] and (got.short is None)
            for f, kind in fields:
                want = got[f].encode() if kind == "text" else got[f]
                have = bytes(got.d[f]) if kind == "text" else got.d[f]
                assert have == want
            assert (got.cut is None) == bool(fields)


def test_damaged_entry_count_is_cheap(spark):
    bad = spark.createDataFrame([(bytearray(struct.pack(">IIQIQQI", 1, 2, 3, 4, 5, 6, 2**32 - 1) + b"x" * 8),)], "m binary")
    assert bad.select(messages.decode("append", F.col("m")).alias("d")).first().d is None


def test_wal_tail_and_changes(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "00000001.wal").write_bytes(wal_bytes([(1, b"a", b"1"), (2, b"b", b"2"), (5, b"a", None)]))
    seen: list = []

    def run():
        rows = framed.tail_wal(spark, f"{tmp_path}/w").where("crc_ok").select(F.col("key").cast("string").alias("key"), "seq", "deleted", F.col("value").cast("string").alias("value"))
        query = tail.changes(rows).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend((r.key, r.seq, r.deleted) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    assert sorted(seen) == [("a", 5, True), ("b", 2, False)]
    seen.clear()
    (tmp_path / "w" / "00000002.wal").write_bytes(wal_bytes([(4, b"a", b"late"), (6, b"b", b"new"), (3, b"c", b"3")]))
    run()
    assert sorted(seen) == [("b", 6, False), ("c", 3, False)]


def test_a_late_batch_of_old_sequences_stays_visible(spark, tmp_path):
    store = Store(spark, str(tmp_path / "kv"))
    store.apply(ops(spark, [("b", "new")]).withColumn("seq", F.lit(100).cast("bigint")))
    store.flush()
    late = ops(spark, [("a", "late")]).withColumn("seq", F.lit(5).cast("bigint"))
    store.apply(late, batch=7)
    store.apply(late, batch=7)
    assert store.get("a").first().value == "late" and store.last_seq() == 100
    assert store.flush() and not store.flush()
    store = Store(spark, store.path)
    assert {r.key: r.value for r in store.snapshot().collect()} == {"a": "late", "b": "new"}


def test_frames_of_the_version_before_still_read(spark, tmp_path):
    store = Store(spark, str(tmp_path / "kv"), StoreConfig(level0_tables=2))
    for i in range(2):
        store.put(spark.createDataFrame([(f"k{j}", f"v{i}") for j in range(3)], "key string, value string"))
        before = store.snapshot()
        store.flush()
        assert {r.value for r in before.collect()} == {f"v{i}"}
    before = store.snapshot()
    store.compact()
    assert {r.value for r in before.collect()} == {"v1"}
    store.put(spark.createDataFrame([("z", "z")], "key string, value string"))
    store.flush()
    assert len(store._names("tables")) == 2 and len(store._names("manifest")) == 2


def test_a_version_that_never_came_retires_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "kv"), StoreConfig(level0_tables=1))
    store.put(spark.createDataFrame([("a", "1")], "key string, value string"))
    store.flush()
    store.put(spark.createDataFrame([("b", "2")], "key string, value string"))
    # a flush that broke off between its markers and its manifest
    for n in store._batches():
        store._fs.mkdirs(store._path(f"retired/v{store._version() + 1:08d}.{n}"))
    assert store.compact() == 0
    assert {r.key for r in store.snapshot().collect()} == {"a", "b"}


def test_compaction_takes_overlapping_tables_only(spark, tmp_path):
    rows = [(1, 0, "a", "c", 9), (2, 0, "d", "f", 8), (3, 1, "b", "b", 1), (4, 1, "e", "k", 2), (5, 1, "m", "z", 3), (6, 2, "a", "n", 0)]
    have = spark.createDataFrame(rows, "run int, level int, first_key string, last_key string, min_seq bigint")
    picked = lambda level: sorted(r.run for r in tables.overlapping(have, level).collect())
    assert picked(0) == [1, 2, 3, 4] and picked(1) == [3, 6] and picked(2) == [6] and picked(5) == []


def test_stored_bloom_filters(spark):
    held = bloom.build(spark.range(100).select(F.col("id").cast("string").alias("k")), "k", 0.02)
    assert bloom.Bloom.load(held.serialize()) == held
    for bad in (b"", held.serialize()[:-1], held.serialize()[:8] + bytes(8) + held.data):
        with pytest.raises(ValueError):
            bloom.Bloom.load(bad)


def test_gaps_in_long_logs(spark):
    for gap, n in ((1, 3000), (2, 3000), (700, 3000), (2999, 3000), (3000, 3000), (None, 3000)):
        have = spark.range(1, n + 1).withColumnRenamed("id", "idx").where(F.col("idx") != (gap or 0))
        assert replication._gap(have, 0, n, parts=7) == (n if gap is None else gap - 1)


def test_damaged_requests_are_errors(spark):
    good = messages.message("put", {"key": F.lit("k"), "value": F.lit("v")})
    df = spark.range(1).select(F.explode(F.array(
        F.struct(F.lit(1).cast("bigint").alias("seq"), good.alias("frame")),
        F.struct(F.lit(2).cast("bigint").alias("seq"), messages.message("get", {"key": F.lit("k")}).alias("frame")),
        F.struct(F.lit(3).cast("bigint").alias("seq"), good.substr(F.lit(1), F.octet_length(good) - 1).alias("frame")),
        F.struct(F.lit(4).cast("bigint").alias("seq"), messages.message("ping", {}).alias("frame")),
        F.struct(F.lit(5).cast("bigint").alias("seq"), messages.message("delete", {"key": F.lit("k")}).alias("frame")),
        F.struct(F.lit(6).cast("bigint").alias("seq"), messages.message("get", {"key": F.lit("k")}).alias("frame")),
        F.struct(F.lit(7).cast("bigint").alias("seq"), F.lit(None).cast("binary").alias("frame")),
    )).alias("m")).select("m.*")
    got = [tuple(r) for r in messages.dispatch(df).orderBy("seq").collect()]
    assert got == [(1, "put", "OK", False, None), (2, "get", "OK", True, "v"), (3, None, "ERROR", False, None), (4, "ping", "OK", False, None), (5, "delete", "OK", False, None), (6, "get", "OK", False, None), (7, None, "ERROR", False, None)]
