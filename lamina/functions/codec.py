"""Codecs as column expressions: big-endian numbers, commands, frames, status names, config values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status names by code.
STATUS = ("OK", "NOT_FOUND", "NOT_LEADER", "TIMEOUT", "OVERLOADED", "ERROR")
SYNC_MODES = ("always", "group", "none")


def big_endian(n: Column, size: int) -> Column:
    """A number as ``size`` bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 2 * size, "0"))


def from_big_endian(b: Column) -> Column:
    return F.conv(F.hex(b), 16, 10).cast("bigint")


def sized(b: Column) -> Column:
    """Bytes behind their length in four bytes."""
    b = b.cast("binary")
    return F.concat(big_endian(F.octet_length(b), 4), b)


def wal_payload(deleted: Column, seq: Column, key: Column, value: Column) -> Column:
    """A log record: type, sequence, key and value (empty for a delete)."""
    return F.concat(F.when(deleted, F.unhex(F.lit("02"))).otherwise(F.unhex(F.lit("01"))), big_endian(seq, 8), sized(key), F.when(deleted, sized(F.lit(""))).otherwise(sized(value)))


def raft_payload(term: Column, idx: Column, command: Column) -> Column:
    command = command.cast("binary")
    return F.concat(big_endian(term, 8), big_endian(idx, 8), big_endian(F.octet_length(command), 8), command)


def record(payload: Column) -> Column:
    """A payload behind its length and CRC-32."""
    return F.concat(big_endian(F.octet_length(payload), 4), big_endian(F.crc32(payload), 4), payload)


def frame(kind: Column, payload: Column) -> Column:
    """A message behind the length of its payload and its type."""
    return F.concat(big_endian(F.octet_length(payload), 4), big_endian(kind, 4), payload)


def command(deleted: Column, key: Column, value: Column) -> Column:
    """A state-machine command: operation, then key and value behind their sizes, joined by pipes; as bytes."""
    key, value = key.cast("binary"), F.when(deleted, F.lit("").cast("binary")).otherwise(value.cast("binary"))
    text = lambda c: c.cast("string").cast("binary")
    pipe = F.lit("|").cast("binary")
    return F.concat(F.when(deleted, F.lit("DELETE")).otherwise(F.lit("PUT")).cast("binary"), pipe, text(F.octet_length(key)), pipe, key, pipe, text(F.octet_length(value)), pipe, value)


def decode_command(data: Column) -> Column:
    """struct(deleted, key, value) of a command's bytes, null when malformed; bytes after the value are ignored."""
    data = data.cast("binary")
    size = F.octet_length(data)
    # the head is ASCII up to the key; work on hex, where every byte has two digits
    h = F.hex(data)
    first = F.regexp_extract(h, "^(505554|44454C455445)7C((?:3[0-9])+)7C", 0)
    op = F.regexp_extract(h, "^(505554|44454C455445)7C((?:3[0-9])+)7C", 1)
    digits = lambda x: F.regexp_replace(x, "3([0-9])", "$1").try_cast("bigint")
    key_size = digits(F.regexp_extract(h, "^(505554|44454C455445)7C((?:3[0-9])+)7C", 2))
    at = F.octet_length(first) / 2
    fits = (first != "") & key_size.isNotNull() & (key_size <= size - at)
    rest = F.when(fits, F.substring(h, (2 * (at + key_size) + 1).cast("int"), F.length(h)))
    second = F.regexp_extract(rest, "^7C((?:3[0-9])+)7C", 0)
    value_size = digits(F.regexp_extract(rest, "^7C((?:3[0-9])+)7C", 1))
    start = at + key_size + F.octet_length(second) / 2
    ok = fits & (second != "") & value_size.isNotNull() & (value_size <= size - start)
    out = F.struct(
        (op == "44454C455445").alias("deleted"),
        F.substring(data, (at + 1).cast("int"), key_size.cast("int")).alias("key"),
        F.substring(data, (start + 1).cast("int"), value_size.cast("int")).alias("value"),
    )
    return F.when(ok, out)


def status_name(code: Column) -> Column:
    out = F.when(code == 0, STATUS[0])
    for i, name in enumerate(STATUS[1:], 1):
        out = out.when(code == i, name)
    return out.otherwise("UNKNOWN")


def proposal_status(is_leader: Column, acked: Column, waited_ms: Column, timeout_ms: int) -> Column:
    """What a client is told about its proposal."""
    return F.when(~is_leader, "NOT_LEADER").when(acked, "OK").when(waited_ms >= timeout_ms, "TIMEOUT").otherwise("ERROR")


def sync_mode(name: Column) -> Column:
    """always and none in lower or upper case; everything else is group."""
    return F.when(name.isin("always", "ALWAYS"), "always").when(name.isin("none", "NONE"), "none").otherwise("group")


def comma_list(text: Column) -> Column:
    """Items between commas, trimmed of blanks, empty ones dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def peers(text: Column) -> Column:
    """array<struct(id, address)> of ``id:host:port`` items; items without an id have none yet."""
    item = lambda x: F.struct(F.regexp_extract(x, "^([0-9]+):([^:]+:[0-9]+)$", 1).try_cast("int").alias("id"), F.regexp_extract(x, "([^:]+:[0-9]+)$", 1).alias("address"))
    return F.transform(comma_list(text), item)


def shard(key: Column, n: int) -> Column:
    """The shard of a key: the first 32 bits of its MD5, modulo n."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(n))
