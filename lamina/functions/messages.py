"""Wire messages as column expressions: fields to payload bytes and back.

Numbers are big-endian, a text is its bytes behind their size in four bytes.  Decoding gives
null where a payload is too short; bytes after the last field are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import codec

# Message types and the order of their fields.
KINDS = {"get": 1, "got": 2, "put": 3, "put_done": 4, "delete": 5, "delete_done": 6, "vote": 7, "voted": 8, "append": 9, "appended": 10, "ping": 11, "pong": 12}
FIELDS = {
    "get": [("key", "text")],
    "got": [("status", "u32"), ("leader", "u32"), ("found", "flag"), ("value", "text")],
    "put": [("key", "text"), ("value", "text")],
    "put_done": [("status", "u32"), ("leader", "u32")],
    "delete": [("key", "text")],
    "delete_done": [("status", "u32"), ("leader", "u32")],
    "vote": [("shard", "u32"), ("peer", "u32"), ("term", "u64"), ("candidate", "u32"), ("last_index", "u64"), ("last_term", "u64"), ("pre_vote", "flag")],
    "voted": [("shard", "u32"), ("term", "u64"), ("granted", "flag")],
    "append": [("shard", "u32"), ("peer", "u32"), ("term", "u64"), ("leader", "u32"), ("prev_index", "u64"), ("prev_term", "u64"), ("entries", "entries"), ("leader_commit", "u64")],
    "appended": [("shard", "u32"), ("term", "u64"), ("success", "flag"), ("match_index", "u64")],
    "ping": [],
    "pong": [("node", "u32"), ("leader", "u32"), ("term", "u64")],
}
ENTRY = "struct<term:bigint,idx:bigint,command:binary>"
_SIZE = {"u32": 4, "u64": 8, "flag": 1}


def _bytes(kind: str, c: Column) -> Column:
    if kind == "flag":
        return F.when(c, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))
    if kind == "text":
        return codec.sized(c)
    if kind == "entries":
        one = lambda a, e: F.concat(a, codec.big_endian(e["term"], 8), codec.big_endian(e["idx"], 8), codec.sized(e["command"]))
        return F.concat(codec.big_endian(F.size(c), 4), F.aggregate(c, F.lit("").cast("binary"), one))
    return codec.big_endian(c, _SIZE[kind])


def payload(name: str, fields: dict[str, Column]) -> Column:
    """The payload of a message from its fields."""
    return F.concat(F.lit("").cast("binary"), *(_bytes(kind, fields[f]) for f, kind in FIELDS[name]))


def message(name: str, fields: dict[str, Column]) -> Column:
    """The whole frame of a message."""
    return codec.frame(F.lit(KINDS[name]), payload(name, fields))


def _cut(data: Column, at: Column, size: Column | int) -> Column:
    return F.substring(data, (at + 1).cast("int"), F.lit(size).cast("int") if isinstance(size, int) else size.cast("int"))


def decode(name: str, data: Column) -> Column:
    """struct of a payload's fields, null if it is too short."""
    end, at, ok, out = F.octet_length(data).cast("bigint"), F.lit(0).cast("bigint"), F.lit(True), []
    for field, kind in FIELDS[name]:
        if kind in _SIZE:
            raw = _cut(data, at, _SIZE[kind])
            value = codec.from_big_endian(raw)
            out.append((value != 0 if kind == "flag" else value).alias(field))
            at = at + _SIZE[kind]
        elif kind == "text":
            size = F.coalesce(codec.from_big_endian(_cut(data, at, 4)), F.lit(0))
            ok = ok & (at + 4 <= end)
            out.append(_cut(data, at + 4, size).alias(field))
            at = at + 4 + size
        else:
            entries, at = _entries(data, at, end)
            out.append(entries.alias(field))
        ok = ok & (at <= end)
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(*out) if out else F.struct(F.lit(True).alias("empty")))


def _entries(data: Column, at: Column, end: Column) -> tuple[Column, Column]:
    """Entries of a count and as many (term, index, command); the place after them, beyond the end if they don't fit."""
    count = F.coalesce(codec.from_big_endian(_cut(data, at, 4)), F.lit(0))
    # an entry has 20 bytes at least, so a damaged count is seen before anything is made of it
    steps = F.when((count > 0) & (count * 20 <= end - at), F.sequence(F.lit(1).cast("bigint"), count)).otherwise(F.array().cast("array<bigint>"))
    start = F.when(count * 20 <= end - at, at + 4).otherwise(end + 1)

    def step(a: Column, _: Column) -> Column:
        p = a["at"]
        size = F.coalesce(codec.from_big_endian(_cut(data, p + 16, 4)), F.lit(0))
        after = F.when(p + 20 + size <= end, p + 20 + size).otherwise(end + 1)
        entry = F.struct(codec.from_big_endian(_cut(data, p, 8)).alias("term"), codec.from_big_endian(_cut(data, p + 8, 8)).alias("idx"), _cut(data, p + 20, size).alias("command"))
        return F.struct(after.alias("at"), F.when(after <= end, F.concat(a["out"], F.array(entry))).otherwise(a["out"]).alias("out"))

    done = F.aggregate(steps, F.struct(start.alias("at"), F.array().cast(f"array<{ENTRY}>").alias("out")), step)
    return done["out"], done["at"]


def open_frame(data: Column) -> Column:
    """struct(kind, payload) of a frame's bytes, null if the frame isn't whole."""
    size = codec.from_big_endian(_cut(data, F.lit(0), 4))
    ok = F.octet_length(data) >= 8 + size
    return F.when(ok, F.struct(codec.from_big_endian(_cut(data, F.lit(4), 4)).alias("kind"), _cut(data, F.lit(8), size).alias("payload")))


def dispatch(requests: DataFrame) -> DataFrame:
    """(seq, kind, status, found, value): the answers to framed requests (seq, frame), in the order of seq.

    A get sees the last put or delete of its key before it; a key that was never written or
    is deleted is OK and not found.  Frames that can't be opened or read, and kinds that
    aren't requests, are answered with ERROR.
    """
    opened = requests.withColumn("f", open_frame(F.col("frame")))
    body = {name: decode(name, F.col("f.payload")) for name in ("get", "put", "delete")}
    kind = F.lit(None).cast("string")
    for name in ("get", "put", "delete", "ping"):
        ok = F.col("f.kind") == KINDS[name]
        kind = F.when(ok if name == "ping" else ok & body[name].isNotNull(), name).otherwise(kind)
    rows = opened.withColumn("kind", kind)
    key = F.coalesce(*(F.when(F.col("kind") == name, body[name]["key"]) for name in body))
    rows = rows.select("seq", "kind", key.alias("key"), F.when(F.col("kind") == "put", body["put"]["value"]).alias("value"))
    # pings and what can't be read have no key; by their sequence they aren't dealt to one task
    w = Window.partitionBy("key", F.when(F.col("key").isNull(), F.col("seq"))).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    written = F.when(F.col("kind").isin("put", "delete"), F.struct("kind", "value"))
    rows = rows.withColumn("w", F.last(written, ignorenulls=True).over(w))
    found = F.coalesce((F.col("kind") == "get") & (F.col("w.kind") == "put"), F.lit(False))
    return rows.select("seq", "kind", F.when(F.col("kind").isNull(), "ERROR").otherwise("OK").alias("status"), found.alias("found"), F.when(found, F.col("w.value").cast("string")).alias("value"))
