"""Schemas of the tables that the engine works on, as DDL."""

#: One mutation: a put or, when ``deleted``, a tombstone.
OPS = "seq bigint, key string, deleted boolean, value string"
#: A mutation as a source of some recency holds it; 0 is the newest source.
ENTRY = f"{OPS}, run int, source_rank int, level int"
#: One sorted table of a level.
MANIFEST = "table_id bigint, level int, path string, n_entries bigint, n_deletes bigint, min_seq bigint, max_seq bigint, first_key string, last_key string, bytes bigint"
#: One entry of a replicated log.
RAFT_LOG = "idx bigint, term bigint, key string, deleted boolean, value string"
PEER = "cluster int, peer int, match_index bigint, current_term bigint"
#: A decoded frame of a write-ahead log; ``crc_ok`` is false for the record that ends a segment's valid prefix.
FRAMES = "segment string, pos bigint, seq bigint, key binary, deleted boolean, value binary, crc_ok boolean"
RAFT_FRAMES = "path string, pos bigint, idx bigint, term bigint, command binary"
