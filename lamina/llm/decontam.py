"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of about ``SHARD_BYTES``.  Its words that can take part in a
match (adjacent words that some benchmark window has as neighbours, in runs of at least the
shortest window) form the indexed text; equal runs are indexed once.  Every benchmark window
is searched backwards through the ranks of a wavelet matrix over the Burrows-Wheeler
transform, its occurrences are located from sampled suffix positions, and overlapping ones
are merged into removal spans.

The benchmark is cut into blocks of ``BLOCK_BYTES`` of text; the windows of one block are made
once, on the driver, and broadcast as arrays.  A benchmark of one block takes one pass over
the documents, without a shuffle.  A larger one is searched block after block: a pass holds the
windows of one block only, and tells of hit documents alone; what all passes found is merged
by document and met with the texts again.

Defined results: null text has no words; an item without words has no window; items with
the same id count once; an item without an id marks words but isn't listed; repeated rows
give repeated results; an empty benchmark hits nothing; very long texts form shards of their
own; no documents give no rows; other columns, whatever their names, are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import textkit as tk

WINDOW = 13
SHARD_BYTES = 4 << 20
#: Benchmark text of one pattern block; a larger benchmark is searched block after block.
BLOCK_BYTES = 4 << 20
#: Hit documents whose spans may be broadcast.
BROADCAST = 100_000
SAMPLE = 8
NOTHING = hashlib.sha256(b"").hexdigest()


class Windows:
    """The distinct windows of some benchmark items as word numbers (1 and up)."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        data, off = tk.buffers(pa.array([t.decode() for _, t in items], pa.large_string()))
        data = tk.LOWER[data]
        start, end, row = tk.words(data, off, tk.ALNUM)
        vocab, ids = np.unique(tk.word_hashes(data, start, end), return_inverse=True)
        ids = ids.astype(np.int32).ravel() + 1
        self.vocab, self.names = vocab, sorted({k for k, _ in items if k is not None})
        place = {k: i for i, k in enumerate(self.names)}
        count = np.bincount(row, minlength=len(items)).astype(np.int64)
        # windows of an item: all of ``window`` words, or its only one
        many = np.where(count > 0, np.maximum(1, count - window + 1), 0)
        owner = np.repeat(np.arange(len(items)), many)
        first = ranges((np.cumsum(count) - count)[count > 0], many[count > 0])
        length = np.minimum(count[owner], window)
        back = np.arange(window)
        inside = back[None, :] < length[:, None]
        #: words of each window from its last backwards, 0 beyond its first
        words = np.where(inside, ids[np.where(inside, (first + length)[:, None] - 1 - back[None, :], 0)], 0).astype(np.int32) if len(first) else np.zeros((0, window), np.int32)
        self.backward, which = np.unique(words, axis=0, return_inverse=True)
        self.length = (self.backward > 0).sum(1).astype(np.int64)
        self.shortest = int(self.length.min()) if len(self.length) else 0
        named = np.array([-1 if k is None else place[k] for k, _ in items], np.int64)[owner] if len(owner) else np.zeros(0, np.int64)
        pair = np.unique(np.stack([which.ravel().astype(np.int64), named], 1)[named >= 0], axis=0)
        self.item_off = np.searchsorted(pair[:, 0], np.arange(len(self.length) + 1)).astype(np.int64)
        self.items = pair[:, 1].copy()
        after, before = self.backward[:, :-1].astype(np.int64), self.backward[:, 1:].astype(np.int64)
        self.pairs = np.unique((before << 32 | after)[before > 0])
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(vocab & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers, 0 for words that no item has."""
        out = np.zeros(len(hashes), np.int64)
        at = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFFF)).astype(np.int64)]) if len(self.vocab) else out[:0]
        if len(at):
            k = np.minimum(np.searchsorted(self.vocab, hashes[at]), len(self.vocab) - 1)
            out[at] = np.where(self.vocab[k] == hashes[at], k + 1, 0)
        return out

    def neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether some window has word a just before word b."""
        ok = (a > 0) & (b > 0)
        if len(self.pairs):
            at = np.flatnonzero(ok)
            key = a[at] << 32 | b[at]
            k = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            ok[at] = self.pairs[k] == key
        else:
            ok[:] = False
        return ok


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; an end before all other symbols is implied."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    k = 1
    while True:
        key = rank * (n + 2)
        key[: n - k] += rank[k:]
        order = np.argsort(key, kind="stable")
        step = np.empty(n, np.int64)
        step[0] = 1
        step[1:] = key[order][1:] != key[order][:-1]
        rank[order] = np.cumsum(step)
        if rank[order[-1]] == n or k >= n:
            return order
        k *= 2


class FMIndex:
    """Backward search and locating over a sequence of small numbers."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        text = np.append(text + 1, 0)  # 0 ends the text and sorts first
        n = len(text)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.n, self.high = n, int(text.max())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.high + 1))])
        self.levels = max(1, self.high.bit_length())
        self.ones, self.zeros = [], []
        seq = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(int(n - bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.bwt = bwt
        marked = sa % sample == 0
        self.marks = marked
        self.mark_rank = np.concatenate([[0], np.cumsum(marked)])
        self.samples = sa[marked]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c among the first i symbols of the transform."""
        low = np.zeros_like(i)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            bit = ((c >> level) & 1).astype(bool)
            ones = self.ones[k]
            i = np.where(bit, self.zeros[k] + ones[i], i - ones[i])
            low = np.where(bit, self.zeros[k] + ones[low], low - ones[low])
        return i - low

    def search(self, backward: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each pattern; patterns are given backwards."""
        m = len(length)
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.arange(m)
        for j in range(backward.shape[1]):
            live = live[length[live] > j]
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
            c = backward[live, j] + 1
            out = c > self.high
            lo[live[out]] = hi[live[out]] = 0
            live, c = live[~out], c[~out]
            lo[live] = self.before[c] + self.rank(c, lo[live])
            hi[live] = self.before[c] + self.rank(c, hi[live])
        return lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to a sampled one."""
        out = np.empty(len(row), np.int64)
        todo, steps = np.arange(len(row)), 0
        row = row.copy()
        while len(todo):
            r = row[todo]
            hit = self.marks[r]
            done = todo[hit]
            out[done] = self.samples[self.mark_rank[r[hit]]] + steps
            todo = todo[~hit]
            r = r[~hit]
            c = self.bwt[r]
            row[todo] = self.before[c] + self.rank(c, r)
            steps += 1
        return out


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, then the next range, and so on."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    return np.arange(total) + shift


def hits(windows: Windows, ids: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a shard's words (their numbers and rows): which are hit; (row, item place) pairs, sorted."""
    n = len(ids)
    hit = np.zeros(n, bool)
    none = hit, np.zeros((0, 2), np.int64)
    if not n or not len(windows.length):
        return none
    joined = np.zeros(n, bool)  # with the next word
    joined[:-1] = windows.neighbours(ids[:-1], ids[1:]) & (row[:-1] == row[1:])
    begin = ids > 0
    begin[1:] &= ~joined[:-1]
    first = np.flatnonzero(begin)
    last = np.flatnonzero((ids > 0) & ~joined)
    size = last - first + 1
    long = size >= windows.shortest
    first, size = first[long], size[long]
    if not len(first):
        return none
    # equal runs are indexed once
    flat = ids[ranges(first, size)]
    begins = np.concatenate([[0], np.cumsum(size)[:-1]])
    key = run_hashes(flat, begins, size)
    _, which, inverse = np.unique(key, return_index=True, return_inverse=True)
    text = np.zeros(int(size[which].sum()) + len(which), np.int64)
    at = np.cumsum(size[which] + 1) - size[which] - 1
    text[ranges(at, size[which])] = flat[ranges(begins[which], size[which])]
    index = FMIndex(text)
    lo, hi = index.search(windows.backward, windows.length)
    found = np.flatnonzero(hi > lo)
    pattern = np.repeat(found, (hi - lo)[found])
    place = index.locate(ranges(lo[found], (hi - lo)[found]))
    # each place lies in one distinct run; bring it to all rows that have this run
    run = np.searchsorted(at, place, "right") - 1
    inside = place - at[run]
    order = np.argsort(inverse, kind="stable")
    copies = np.bincount(inverse, minlength=len(which))
    head = np.cumsum(copies) - copies
    each = order[ranges(head[run], copies[run])]
    start = first[each] + np.repeat(inside, copies[run])
    pattern = np.repeat(pattern, copies[run])
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + windows.length[pattern], -1)
    hit = np.cumsum(edge[:-1]) > 0
    per = np.diff(windows.item_off)[pattern]
    item = windows.items[ranges(windows.item_off[pattern], per)]
    pair = np.unique(np.repeat(row[start], per).astype(np.int64) * max(1, len(windows.names)) + item)
    return hit, np.stack([pair // max(1, len(windows.names)), pair % max(1, len(windows.names))], 1)


def run_hashes(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    up, down = tk.powers(len(flat))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(flat.astype(np.uint64)) * up[: len(flat)])])
    return tk.mix((sums[begin + size] - sums[begin]) * down[begin] + size.astype(np.uint64))


def _pattern_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[tuple[Broadcast, int]]:
    """Broadcasts of the windows of about BLOCK_BYTES of benchmark text each, one after another, and how many there are."""
    items = benchmark.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("t")).where("t IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES)
    if blocks > 1:
        items = tk.materialize(items)
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == b)
        yield benchmark.sparkSession.sparkContext.broadcast(Windows([(r.k, r.t.encode()) for r in part.collect()], window)), blocks


def _shard_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and hash of each word of a shard."""
    parts = []
    for a, _, d, o in tk.chunks(data, off):
        d = tk.LOWER[d]
        s, e, r = tk.words(d, o, tk.ALNUM)
        parts.append((s + off[a], e + off[a], (r + a).astype(np.int32), tk.word_hashes(d, s, e)))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]


def _shards(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    """Runs of batches of about SHARD_BYTES of text as one batch."""
    held, size = [], 0
    one = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(text_at).nbytes
            if size >= SHARD_BYTES:
                yield one()
                held, size = [], 0
    if held:
        yield one()


def _cleaned(shard: pa.RecordBatch, columns: list[str], text_at: int, merged: dict[int, list[tuple[int, int]]], bad: np.ndarray) -> pa.RecordBatch:
    """A shard without contaminated rows, with merged word ranges cut from the texts of others."""
    data, off = tk.buffers(shard.column(text_at))
    start, end, row, _ = _shard_words(data, off)
    first = np.searchsorted(row, np.arange(shard.num_rows + 1))
    texts: list = shard.column(text_at).to_pylist()
    sizes = shard.column(columns.index("n_chars")).to_pylist() if "n_chars" in columns else None
    for i, spans in merged.items():
        raw, at, kept = data[off[i] : off[i + 1]].tobytes(), 0, []
        for a, b in spans:
            kept.append(raw[at : start[first[i] + a] - off[i]])
            at = end[first[i] + b - 1] - off[i]
        texts[i] = b"".join([*kept, raw[at:]]).decode()
        if sizes is not None:
            sizes[i] = len(texts[i])
    arrays = list(shard.columns)
    arrays[text_at] = pa.array(texts, shard.column(text_at).type)
    if sizes is not None:
        arrays[columns.index("n_chars")] = pa.array(sizes, shard.column(columns.index("n_chars")).type)
    return pa.RecordBatch.from_arrays(arrays, schema=shard.schema).filter(pa.array(~bad))


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, clean: bool = False) -> DataFrame:
    """Find the benchmark's windows in every whole text.

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (merged word
    ranges, end exclusive, as text).  With ``clean`` returns the input's columns: contaminated documents go,
    removal spans are cut from the text of the others, and n_chars, if there is one, follows.
    """
    tk.bounded(docs)
    found, whole = [], None
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    for windows, blocks in _pattern_blocks(benchmark, item_col, item_text_col, window):
        if blocks == 1:
            whole = windows
        else:
            found.append(tk.materialize(_block_hits(_keyed(docs, id_col, text_col, "k1", "k2").select("k1", "k2", F.col(text_col).alias("text")), windows)))
            windows.unpersist()
    if found:
        return _merged(docs, found, id_col, text_col, clean)
    columns = docs.columns if clean else ["doc_id", "text"]
    text_at = columns.index(text_col if clean else "text")

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = None if whole is None else whole.value
        for shard in _shards(batches, text_at):
            _, _, row, hashed = _shard_words(*tk.buffers(shard.column(text_at)))
            n = shard.num_rows
            hit, pairs = (np.zeros(len(row), bool), np.zeros((0, 2), np.int64)) if windows is None else hits(windows, windows.number(hashed), row)
            n_words, n_hit = np.bincount(row, minlength=n), np.bincount(row[hit], minlength=n)
            bad = (n_hit > 0) & (20 * n_hit >= n_words)
            first = np.concatenate([[0], np.cumsum(n_words)])
            merged = {i: _merge(hit[first[i] : first[i + 1]]) for i in np.flatnonzero(n_hit).tolist()}
            if clean:
                yield _cleaned(shard, columns, text_at, {i: x for i, x in merged.items() if not bad[i]}, bad)
                continue
            listed, count = _listed(windows, pairs, n)
            told = [",".join(f"{a}:{b}" for a, b in merged.get(i, ())) for i in range(n)]
            digests = [hashlib.sha256(",".join(x).encode()).hexdigest() if x else NOTHING for x in listed]
            yield pa.RecordBatch.from_arrays([shard.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(count, pa.int64()), pa.array(digests), pa.array(bad), pa.array(told, pa.string())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    return (docs if clean else source).mapInArrow(run, docs.schema if clean else RESULT)


RESULT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans string"


def _listed(windows: Windows | None, pairs: np.ndarray, n: int) -> tuple[list[list[str]], np.ndarray]:
    """The items of each row, in order, and how many they are."""
    listed: list[list[str]] = [[] for _ in range(n)]
    for group in np.split(pairs, np.flatnonzero(np.diff(pairs[:, 0])) + 1) if len(pairs) else ():
        listed[int(group[0, 0])] = [windows.names[k] for k in group[:, 1].tolist()]
    return listed, np.array([len(x) for x in listed], np.int64)


def _keyed(docs: DataFrame, id_col: str, text_col: str, one: str, two: str) -> DataFrame:
    """``docs`` with two hashes that tell rows with different id or text apart."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(one, F.xxhash64(F.lit(1), F.col(id_col), t)).withColumn(two, F.xxhash64(F.lit(2), F.col(id_col), t))


def _block_hits(texts: DataFrame, block: Broadcast) -> DataFrame:
    """(k1, k2, spans, items) of the rows that one block's windows hit."""

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = block.value
        for shard in _shards(batches, 2):
            _, _, row, hashed = _shard_words(*tk.buffers(shard.column(2)))
            hit, pairs = hits(windows, windows.number(hashed), row)
            n = shard.num_rows
            at = np.flatnonzero(np.bincount(row[hit], minlength=n))
            first = np.searchsorted(row, np.arange(n + 1))
            listed, _ = _listed(windows, pairs, n)
            spans = [[{"a": a, "b": b} for a, b in _merge(hit[first[i] : first[i + 1]])] for i in at.tolist()]
            keys = [shard.column(i).take(pa.array(at)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array([listed[i] for i in at.tolist()], pa.list_(pa.string()))], names=["k1", "k2", "spans", "items"])

    return texts.mapInArrow(run, f"k1 bigint, k2 bigint, spans {SPANS}, items array<string>")


SPANS = "array<struct<a:bigint,b:bigint>>"


def _merged(docs: DataFrame, found: list[DataFrame], id_col: str, text_col: str, clean: bool) -> DataFrame:
    """The result of ``scan`` from the hits of several blocks (few rows each, by document)."""
    names = tk.unused(docs, "k1", "k2", "spans", "items")
    k1, k2, spans, items = names
    every = reduce(DataFrame.unionByName, found)
    every = every.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.flatten(F.collect_list("spans")).alias(spans), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias(items))
    every = tk.small(tk.materialize(every), BROADCAST)
    joined = _keyed(docs, id_col, text_col, k1, k2).join(every, [k1, k2], "left").drop(k1, k2)
    columns = docs.columns
    if not clean:
        joined = joined.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.col(spans).alias("spans"), F.col(items).alias("items"))
    else:
        joined = joined.select(*columns, spans)
    text_at = columns.index(text_col) if clean else 1
    spans_at = len(columns) if clean else 2

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, text_at):
            n = shard.num_rows
            _, _, row, _ = _shard_words(*tk.buffers(shard.column(text_at)))
            n_words, n_hit, merged = np.bincount(row, minlength=n), np.zeros(n, np.int64), {}
            for i, x in enumerate(shard.column(spans_at)):
                if x.is_valid:
                    hit = np.zeros(n_words[i], bool)
                    for r in x.as_py():
                        hit[r["a"] : r["b"]] = True
                    n_hit[i], merged[i] = hit.sum(), _merge(hit)
            bad = (n_hit > 0) & (20 * n_hit >= n_words)
            if clean:
                rows = pa.RecordBatch.from_arrays(shard.columns[:-1], names=columns)
                yield _cleaned(rows, columns, text_at, {i: x for i, x in merged.items() if not bad[i]}, bad)
                continue
            listed = [x.as_py() or [] for x in shard.column(3)]
            told = [",".join(f"{a}:{b}" for a, b in merged.get(i, ())) for i in range(n)]
            digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed]
            yield pa.RecordBatch.from_arrays([shard.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit), pa.array([len(x) for x in listed], pa.int64()), pa.array(digests), pa.array(bad), pa.array(told, pa.string())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    return joined.mapInArrow(run, docs.schema if clean else RESULT)


def _merge(hit: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of true values, end exclusive."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
