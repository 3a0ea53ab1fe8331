"""Suffix-array dedup of repeated byte strings, over shards that content chooses.

Strings of ``size`` bytes that start anywhere else are removed.  Strings of ``short`` bytes
(about fifty words of five bytes) that another text has, too, are only told: ``shared`` is 1 for
texts that hold one.  Every window of ``short`` bytes has an anchor: the least of its k-grams under an order that
depends on content alone and puts k-grams that are rare in the corpus first (by a count
sketch of fixed size).  Equal windows have equal anchors at equal places.  Only anchors that
occur at two places can belong to repeated windows; the stretch of text whose windows have
such an anchor is a piece, and pieces go to the shard that their anchor's hash names.  A shard
builds its suffix array by induced sorting, finds the common prefixes in text order, and
marks each window that also starts somewhere else in the shard; pieces hold ``size`` bytes
from each of their windows on, so the marks of both lengths are those of one suffix array of
the whole corpus.  Rare anchors first keep the pieces of a passage that
very many texts share to that passage, and equal pieces of a task are sent once.

Equal texts of ``size`` bytes or more are removed whole by their digest and are represented
once in the shards.  The text is shuffled once; pieces are what repeats, some windows wide.

Defined results: null text is empty; a text shorter than ``size`` is kept; rows that repeat
id and text are copies of each other; very long texts are cut like others, piece by piece; an
empty table gives no rows; other columns, whatever their names, are passed over.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import suffixes
from lamina.llm import textkit as tk
from lamina.llm.decontam import ranges

SIZE, SHORT, GRAM = 400, 250, 64
CELLS, SLICES = 1 << 20, 16
#: One k-gram in so many (by hash) is counted and preferred as an anchor.
EVERY = 16
SHARD_BYTES = 1_500_000
#: Bytes of text whose anchors are sought at a time: some twenty arrays of eight bytes each, which fit a core's cache.
NEAR = 1 << 17
_POST = 500_000


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k-gram of the bytes."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    up, down = tk.powers(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(tk._byte_values()[data] * up[: len(data)], out=total[1:])
    return tk.mix((total[k:] - total[:-k]) * down[: len(data) - k + 1])


def _inside(off: np.ndarray, length: int) -> np.ndarray:
    """Positions where a string of ``length`` bytes starts that doesn't leave its text."""
    size = np.diff(off)
    return ranges(off[:-1][size >= length], size[size >= length] - length + 1)


def sketch(texts: DataFrame, k: int) -> np.ndarray:
    """Logarithms of the sampled k-grams' counts: CELLS bytes reach the driver at any input size."""

    @tk.tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            data, off = tk.buffers(batch.column(0))
            for _, _, d, o in tk.chunks(data, off):
                h = gram_hashes(d, k)
                h = h[_inside(o, k)] if len(h) else h
                h = h[(h % np.uint64(EVERY)) == 0]
                cells += np.bincount((h >> np.uint64(44)).astype(np.int64), minlength=CELLS)
        part = CELLS // SLICES
        packed = [zlib.compress(np.minimum(cells[i * part : (i + 1) * part], (1 << 32) - 1).astype(np.uint32).tobytes(), 1) for i in range(SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(packed, pa.binary())], names=["slice", "cells"])

    @tk.tidy
    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS // SLICES, np.uint64)
        for batch in parts:
            for c in batch.column("cells"):
                total += np.frombuffer(zlib.decompress(c.as_py()), np.uint32)
        level = np.minimum(127, np.floor(2 * np.log2(total + np.uint64(1)))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["slice", "levels"])

    out = np.zeros(CELLS, np.uint8)
    for r in texts.select("text").mapInArrow(count, "slice int, cells binary").groupBy("slice").applyInArrow(add, "slice int, levels binary").collect():
        out[r.slice * (CELLS // SLICES) : (r.slice + 1) * (CELLS // SLICES)] = np.frombuffer(r.levels, np.uint8)
    return out


def anchors(data: np.ndarray, off: np.ndarray, levels: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of windows of ``size`` bytes with one anchor: row, first and last window start, hash of the anchor."""
    start = _inside(off, size)
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    h = gram_hashes(data, k)
    n, w = len(data), size - k + 1
    value = np.full(n, 0xFFFFFFFF, np.uint32)
    at = _inside(off, k)
    g = h[at]
    counted = (g % np.uint64(EVERY)) == 0
    rare = (levels[(g >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(24)) | ((g >> np.uint64(8)) & np.uint64(0xFFFFFF))
    value[at] = np.where(counted, rare, np.uint64(0x80000000) | np.minimum(g >> np.uint64(33), np.uint64(0x7FFFFFFE))).astype(np.uint32)
    blocks = -(-n // w)
    key = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    key[:n] = (value.astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    key = key.reshape(blocks, w)
    ahead = np.minimum.accumulate(key, axis=1).ravel()
    behind = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    least = (np.minimum(behind[start], ahead[start + w - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(least)) - 1
    lo = start[first]
    return np.searchsorted(off, lo, "right") - 1, lo, start[last], h[least[first]]


def repeated_anchors(texts: DataFrame, levels: np.ndarray, buckets: int, size: int, k: int) -> DataFrame:
    """(h1, lo) of pieces whose anchor occurs at two places of distinct texts."""
    shared = texts.sparkSession.sparkContext.broadcast(levels)
    shift = np.uint64(64 - max(1, (buckets - 1).bit_length()))

    def split(key: np.ndarray, text: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted by key without repeats, and whether the key has another place (a text of 0 with lo -1 stands for some)."""
        order = np.lexsort((lo, text, key))
        key, text, lo = key[order], text[order], lo[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | (lo[1:] != lo[:-1])
        key, text, lo = key[new], text[new], lo[new]
        same = key[1:] == key[:-1]
        many = np.zeros(len(key), bool)
        many[1:] |= same
        many[:-1] |= same
        return key, text, lo, many | (lo < 0)

    def emit(key: np.ndarray, text: np.ndarray, lo: np.ndarray) -> pa.RecordBatch:
        key, text, lo, many = split(key, text, lo)
        found = np.stack([text[many], lo[many]])
        # a key with several places here is posted once for all of them
        head = many.copy()
        head[1:] &= key[1:] != key[:-1]
        text, lo = np.where(head, 0, text), np.where(head, -1, lo)
        post = head | ~many
        key, text, lo = key[post], text[post], lo[post]
        bucket = (key >> shift).astype(np.int64)
        cut = np.flatnonzero(np.diff(np.concatenate([[-1], bucket, [-1]]))).tolist()
        packed = [np.stack([key[a:b].view(np.int64), text[a:b], lo[a:b]]).tobytes() for a, b in zip(cut, cut[1:], strict=False)]
        mine = [found[:, a : a + 65536].tobytes() for a in range(0, found.shape[1], 65536)]
        return pa.RecordBatch.from_arrays([pa.array([*bucket[cut[:-1]].tolist(), *tk.own_keys(text, len(mine), buckets)], pa.int64()), pa.array([*packed, *mine], pa.binary())], names=["bucket", "body"])

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = shared.value, set()
        held: list[tuple] = []
        for batch in batches:
            names = batch.column(1).to_numpy()
            fresh = np.zeros(len(names), bool)
            for i, x in enumerate(names.tolist()):
                if x not in seen:
                    seen.add(x)
                    fresh[i] = True
            data, off = tk.buffers(batch.column(0).filter(pa.array(fresh)))
            names = names[fresh]
            for a, _, d, o in tk.chunks(data, off, NEAR):
                row, lo, _, key = anchors(d, o, level, size, k)
                held.append((key, names[a + row], lo - o[row]))
            if sum(len(x[0]) for x in held) > _POST:
                yield emit(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
                if len(seen) > 500_000:
                    seen.clear()
        if held:
            yield emit(*(np.concatenate(x) for x in zip(*held, strict=True)))

    @tk.tidy
    def meet(bucket: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        direct = bucket[0].as_py() < 0
        bodies = []
        for batch in parts:
            for b in batch.column("body"):
                x = np.frombuffer(b.as_py(), np.int64)
                if direct:
                    x = x.reshape(2, -1)
                    yield pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1])], names=["h1", "lo"])
                else:
                    bodies.append(x.reshape(3, -1))
        if bodies:
            key, text, lo = np.concatenate(bodies, 1)
            # the posts of two tasks that stand for several places each don't need each other
            _, text, lo, many = split(key, text, lo)
            many &= lo >= 0
            yield pa.RecordBatch.from_arrays([pa.array(text[many]), pa.array(lo[many])], names=["h1", "lo"])

    return texts.select("text", "h1").mapInArrow(run, "bucket bigint, body binary").groupBy("bucket").applyInArrow(meet, "h1 bigint, lo bigint")


def _copies(at: list[tuple[int, int]], length: int, size: int) -> list[tuple[int, int, int]]:
    """(h1, a, b), as ``covered`` has them, of equal pieces of ``length`` bytes at several places (h1, start)."""
    if len(at) < 2:
        return []
    # windows that the piece holds whole; the first piece of each text tells of the others' texts
    found = [(h, lo, lo + length) for h, lo in at if length >= size]
    texts = {h for h, _ in at}
    return found + [(h, -1, -1) for h in texts if len(texts) > 1]


def _marks(pieces: dict[tuple[int, int], tuple[int, bytes]], size: int, short: int) -> np.ndarray:
    """h1, a and b, as ``covered`` has them, of a shard's pieces: (h1, start) and their windows and bytes."""
    # pieces that several tasks have sent are one in the suffix array, as those of one task are
    alike: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
    for at, piece in pieces.items():
        alike.setdefault(piece, []).append(at)
    direct = [d for (_, p), v in alike.items() for d in _copies(v, len(p), size)]
    size_of = np.array([len(p) for _, p in alike], np.int64)
    windows = np.array([w for w, _ in alike], np.int64)
    at = np.cumsum(size_of + 1) - size_of - 1
    t = np.full(int(size_of.sum()) + len(alike) + 1, suffixes.GAP, np.int16)
    t[-1] = suffixes.END
    t[ranges(at, size_of)] = np.frombuffer(b"".join(p for _, p in alike), np.uint8).astype(np.int16) + suffixes.SHIFT
    names = np.array([v[0][0] for v in alike.values()], np.int64)
    los = np.array([v[0][1] for v in alike.values()], np.int64)
    del alike
    # the bytes behind a piece's last window are windows of other pieces
    start = np.full(len(t), -1, np.int64)
    start[ranges(at, windows)] = np.repeat(np.unique(names, return_inverse=True)[1], windows)
    long, across = suffixes.repeats(t, start, size, short)
    edge = np.diff(np.concatenate([[0], long.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0) - 1
    piece = np.searchsorted(at, first, "right") - 1
    shift = los[piece] - at[piece]
    told = np.unique(names[np.searchsorted(at, np.flatnonzero(across), "right") - 1])
    none = np.full(len(told), -1, np.int64)
    found = np.stack([np.concatenate([names[piece], told]), np.concatenate([first + shift, none]), np.concatenate([last + shift + size, none])])
    return np.concatenate([found, np.array(direct, np.int64).reshape(-1, 3).T], 1)


def covered(chosen: DataFrame, levels: np.ndarray, shards: int, size: int, short: int, k: int) -> DataFrame:
    """(h1, a, b) of byte ranges whose windows of ``size`` bytes repeat; a range with b = -1 tells that a string of ``short`` bytes is in another text, too.

    ``chosen`` has h1, text and the pieces' starts ``los``.
    """
    shared = chosen.sparkSession.sparkContext.broadcast(levels)

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = shared.value, set()

        def emit(held: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
            """held: shard, text, start, windows, bytes of each piece."""
            once: dict[tuple[int, bytes], list[int]] = {}
            for i, p in enumerate(held):
                once.setdefault((p[3], hashlib.blake2b(p[4], digest_size=16).digest()), []).append(i)
            direct = []
            for v in once.values():
                direct += _copies([held[i][1:3] for i in v], len(held[v[0]][4]), size)
            by: dict[int, list[int]] = {}
            for v in once.values():
                by.setdefault(held[v[0]][0], []).append(v[0])
            part = lambda v, f: [held[i][f] for i in v]
            shard, body = list(by), [pickle.dumps((part(v, 1), part(v, 2), part(v, 3), [len(held[i][4]) for i in v], b"".join(part(v, 4)))) for v in by.values()]
            if direct:
                found = np.array(direct, np.int64).T
                shard += tk.own_keys(found[0], 1, shards)
                body.append(pickle.dumps(found))
            return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(body, pa.binary())], names=["shard", "body"])

        held, total = [], 0
        for batch in batches:
            texts, starts = batch.column("h1").to_pylist(), batch.column("los").to_pylist()
            data, off = tk.buffers(batch.column("text"))
            for a, b, d, o in tk.chunks(data, off, NEAR):
                row, lo, hi, key = anchors(d, o, level, short, k)
                shard = (tk.mix(key) % np.uint64(shards)).astype(np.int64).tolist()
                fresh = [texts[i] not in seen for i in range(a, b)]
                seen.update(texts[a:b])
                if len(set(texts[a:b])) < b - a:  # a text twice in one chunk
                    known: set[int] = set()
                    fresh = [f and not (t in known or known.add(t)) for f, t in zip(fresh, texts[a:b], strict=True)]
                wanted = [set(starts[i]) for i in range(a, b)]
                ends = np.minimum(hi + size, o[row + 1])
                for r, x, y, z, s in zip(row.tolist(), lo.tolist(), hi.tolist(), ends.tolist(), shard, strict=True):
                    p = x - int(o[r])
                    if fresh[r] and p in wanted[r]:
                        held.append((s, texts[a + r], p, y - x + 1, d[x:z].tobytes()))
                        total += z - x
                if total > 8_000_000:
                    yield emit(held)
                    held, total = [], 0
        if held:
            yield emit(held)

    @tk.tidy
    def search(shard: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda h, a, b: pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["h1", "a", "b"])
        if shard[0].as_py() < 0:
            for batch in parts:
                for body in batch.column("body"):
                    yield out(*pickle.loads(body.as_py()))
            return
        pieces: dict[tuple[int, int], tuple[int, bytes]] = {}
        for batch in parts:
            for body in batch.column("body"):
                texts, los, windows, sizes, joined = pickle.loads(body.as_py())
                at = 0
                for h, lo, w, n in zip(texts, los, windows, sizes, strict=True):
                    pieces[h, lo] = w, joined[at : at + n]
                    at += n
        if pieces:
            yield out(*_marks(pieces, size, short))

    return chosen.select("h1", "text", "los").mapInArrow(run, "shard bigint, body binary").groupBy("shard").applyInArrow(search, "h1 bigint, a bigint, b bigint")


def _cut(digest: bool):
    """Merged ranges are removed from the bytes of each text; what stays is told as its digest or whole."""

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tk.buffers(batch.column("text"))
            removed, kept = [], []
            for i, found in enumerate(batch.column("found").to_pylist()):
                raw, merged = data[off[i] : off[i + 1]].tobytes(), []
                for r in sorted((r["a"], r["b"]) for r in found):
                    if merged and r[0] <= merged[-1]["b"]:
                        merged[-1]["b"] = max(merged[-1]["b"], r[1])
                    else:
                        merged.append({"a": r[0], "b": r[1]})
                ends = [0, *(m["b"] for m in merged)]
                rest = b"".join(raw[x:y] for x, y in zip(ends, [*(m["a"] for m in merged), len(raw)], strict=True))
                removed.append(merged)
                kept.append(hashlib.sha256(rest).hexdigest().encode() if digest else rest)
            spans = pa.array(removed, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), spans, pa.array(kept, pa.binary())], names=["h1", "h2", "spans", "kept"])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, short: int = SHORT, gram: int = GRAM, digest: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, shared of every row.

    Without ``digest``: doc_id, the removed spans (bytes, end exclusive) and the bytes that stay,
    null where the whole text stays.
    """
    short = min(short, size)
    t = F.coalesce(F.col(text_col), F.lit(""))
    texts = tk.bounded(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), t.alias("text"), F.xxhash64(F.lit(1), t).alias("h1"), F.xxhash64(F.lit(2), t).alias("h2"))
    rows = tk.materialize(texts.select("doc_id", "h1", "h2", F.octet_length("text").cast("bigint").alias("n"), F.sha2("text", 256).alias("sha")))
    long = texts.where(F.octet_length("text") >= short)
    levels = sketch(long, gram)
    n_rows, total = rows.agg(F.count("*"), F.sum("n")).first()
    total = total or 0
    buckets = min(1 << 20, max(32, int(total / 64 / _POST)))
    found = repeated_anchors(long, levels, buckets, short, gram)
    los = tk.materialize(found.groupBy("h1").agg(F.collect_set("lo").alias("los")))
    distinct = tk.materialize(rows.where(F.col("n") >= short).groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("d")))
    wanted = distinct.join(los, "h1")
    chosen = wanted.join(long.withColumnRenamed("h1", "g1").withColumnRenamed("h2", "g2"), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & F.col("d").eqNullSafe(F.col("doc_id")))
    chosen = tk.materialize(chosen.select("h1", "h2", "copies", "text", "los"))
    pieces = los.agg(F.sum(F.size("los"))).first()[0] or 0
    shards = max(1, int(pieces * (size + (short - gram) / 2) / SHARD_BYTES))
    spans = covered(chosen, levels, shards, size, short, gram)
    spans = spans.groupBy(F.col("h1").alias("s1")).agg(F.collect_list(F.when(F.col("b") >= 0, F.struct("a", "b"))).alias("found"), F.max((F.col("b") < 0).cast("int")).alias("shared"))
    spans = tk.materialize(spans)
    # texts with copies go whole, whatever was found in them
    cut = chosen.where("copies = 1").join(spans.where(F.size("found") > 0), F.col("h1") == F.col("s1")).select("h1", "h2", "text", "found")
    cut = cut.mapInArrow(_cut(digest), "h1 bigint, h2 bigint, spans array<struct<a:bigint,b:bigint>>, kept binary")
    told = spans.where("shared = 1").select(F.col("s1").alias("h1"), "shared")
    per = tk.materialize(distinct.select("h1", "h2", "copies").join(cut, ["h1", "h2"], "left").join(told, "h1", "left").where("copies > 1 OR kept IS NOT NULL OR shared = 1"))
    joined = tk.join_hot(rows, per, ["h1", "h2"], "copies", n_rows, "left")
    whole = (F.col("copies") > 1) & (F.col("n") >= size)
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    found = F.when(whole, F.array(F.struct(F.lit(0).cast("bigint").alias("a"), F.col("n").alias("b")))).otherwise(F.coalesce("spans", none))
    out = joined.withColumn("spans", found)
    if not digest:
        return out.select("doc_id", "spans", F.when(whole, F.lit("").cast("binary")).otherwise(F.col("kept")).alias("kept"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["b"] - x["a"])
    kept = F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce(F.col("kept").cast("string"), "sha"))
    shared = F.greatest((F.col("copies") > 1).cast("int"), "shared")
    return out.select("doc_id", F.col("n").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), kept.alias("kept_sha256"), F.coalesce(shared, F.lit(0)).alias("shared"))
