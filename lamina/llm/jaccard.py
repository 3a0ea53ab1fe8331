"""N-gram Jaccard join with filters under several global token orders.

Over the corpus, m global orders of the tokens are used, where order j ranks the j-th part
of the token universe (by hash) first.  Linked sets differ in a bounded number of tokens, so
with more orders than that their heads, all tokens of the first-ranked part, are equal under
at least one order, and under one with a head that isn't empty.  Heads are posted by hash:
each map task links the sets with an equal head by a star and posts each head once, and the
owners of all tasks meet in stars again; no posting list is ever collected and no pairs are
emitted.  The components of the stars are families; linked sets are in one family.  (Single
prefix tokens instead of heads join a corpus into one family: common shingles percolate.)
Tokens that a count sketch over the whole corpus, which grows with it, finds common are left
out of the heads, for what differs in few tokens differs in few rare ones; sets with too few
rare tokens to fill their heads post the rare ones of a prefix besides, and heads of all tokens
only where a prefix isn't rare throughout.

Within a family the exact token counts give further global orders.  A candidate must share a
prefix token under each of them, the filters are intersected, and only then is a pair
verified on the whole sets.  In families of more than ``BLOCK`` sets, those that link with a
pivot are one component at once; only the others are compared with all, by blocks.

Documents with equal sets are one node (least id); sets too small to link with any other set
post nothing.  Shingles are compared by 52-bit hashes, sets are told apart by 128 bits.
Defined results: null text and text without words have an empty set and link with nothing;
rows that repeat an id with another text count as one document; a null id has no say in a
component's id; very long texts are whole sets, and blocks are bounded by their tokens; an
empty table gives no rows; other columns, whatever their names, are passed over.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm import graph
from lamina.llm import textkit as tk
from lamina.llm.decontam import ranges

PERCENT, WORDS, BLOCK = 90, 3, 2048
#: Heads beyond the pigeonhole's need, which may be empty without being posted: so many, and half as many again as a class's smallest set is likely to leave empty.
SPARE = 2
#: Cells of the count sketch (so many bits reach the driver), the least and the most as powers of two, for so many tokens each; cells of a slice of it.
CELLS, CELL_TOKENS, SLICE = (20, 25), 16, 1 << 16
#: Rows without texts that may be broadcast.
BROADCAST = 100_000
#: Tokens of one block of a family.
BLOCK_TOKENS = 1 << 21
_POST = 1_000_000
_NULL_ID = 1 << 62
_ROWS, _ROW_SHIFT, _NAME_SHIFT = 1 << 12, np.uint64(52), np.uint64(16)


def shingles(data: np.ndarray, off: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes (52 bits) of at most 4096 rows, sorted by row and hash; where each row begins."""
    data = tk.LOWER[data]
    start, end, row = tk.words(data, off, tk.SPACED)
    h = tk.word_hashes(data, start, end)
    rows = len(off) - 1
    count = np.bincount(row, minlength=rows)
    token = h
    for j in range(1, k):
        token = tk.mix(token[:-1] * tk._ODD + h[j:]) if len(token) > 1 else token[:0]
    inside = row[: len(token)] == row[k - 1 :] if len(token) else np.zeros(0, bool)
    token, owner = token[inside], row[: len(inside)][inside]
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        # fewer words than a shingle: the whole sequence is one
        first = np.cumsum(count) - count
        extra = count[few].astype(np.uint64)
        for j in range(k - 1):
            more = count[few] > j
            extra[more] = tk.mix(extra[more] * tk._ODD + h[first[few[more]] + j])
        token, owner = np.concatenate([token, extra]), np.concatenate([owner, few])
    key = np.sort((owner.astype(np.uint64) << _ROW_SHIFT) | (token >> np.uint64(12)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    begin = np.searchsorted(key >> _ROW_SHIFT, np.arange(rows + 1, dtype=np.uint64))
    return key & np.uint64((1 << 52) - 1), begin


def sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums modulo 2^64 of consecutive slices."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[begin[1:]] - total[begin[:-1]]


def signatures(token: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set."""
    one = sums(tk.mix(token ^ np.uint64(0x5851F42D4C957F2D)), begin)
    two = sums(tk.mix(token * np.uint64(0x2545F4914F6CDD1D) + np.uint64(0x14057B7EF767814F)), begin)
    return one.view(np.int64), two.view(np.int64)


def small_chunks(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks of at most 4096 rows."""
    for a, b, d, o in tk.chunks(data, off):
        for x in range(a, b, _ROWS):
            y = min(b, x + _ROWS)
            yield x, y, d[o[x - a] : o[y - a]], o[x - a : y - a + 1] - o[x - a]


def prefix_length(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Of a set's n tokens, so many first ones under any order hold one shared with each partner."""
    return n - (percent * n + 99) // 100 + 1


def size_classes(percent: int, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sizes of classes such that linked sets lie in one class or in neighbours; orders of each class, and how many of them are to spare.

    Class c serves pairs of the classes c and c + 1: with sizes up to b, linked sets differ
    in at most 2 b (100 - percent) / (100 + percent) tokens.
    """
    first = [1]
    while first[-1] <= largest:
        first.append(first[-1] * 100 // percent + 1)
    first += [first[-1] * 100 // percent + 1, first[-1] * 200 // percent + 2]
    need = [2 * (b - 1) * (100 - percent) // (100 + percent) + 1 for b in first[2:]]
    spare = []
    for n, least in zip(first, need, strict=False):
        s = SPARE
        for _ in range(8):  # more orders leave more heads empty
            s = min(SPARE + n // 8, SPARE + int(1.5 * (least + s) * math.exp(-n / (least + s))))
        spare.append(s)
    return np.array(first[:-2]), np.array(need) + np.array(spare), np.array(spare)


def least_size(percent: int) -> int:
    """Smaller sets link with equal ones only."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 60


def sketch_size(tokens: int) -> int:
    """Cells for so many tokens, as a power of two: with a fixed number, what the sketch takes for rare would grow with the corpus."""
    return min(max((tokens // CELL_TOKENS).bit_length(), CELLS[0]), CELLS[1])


def cells(token: np.ndarray, log: int) -> np.ndarray:
    return (tk.mix(token ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(64 - log)).astype(np.uint32)


def common_cells(texts: DataFrame, k: int, log: int) -> np.ndarray:
    """Cells (``1 << log`` of them) that count far more sets than most do, as packed bits; all texts are counted."""
    slices = (1 << log) // SLICE

    @tk.tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << log, np.uint16)
        for batch in batches:
            for _, _, d, o in small_chunks(*tk.buffers(batch.column(0))):
                cell = np.sort(cells(shingles(d, o, k)[0], log))
                first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])[: len(cell)])
                here = cell[first]
                total[here] = np.minimum(total[here] + np.diff(np.append(first, len(cell))), 65535)
        for i in range(slices):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(total[i * SLICE : (i + 1) * SLICE].tobytes(), 1)], pa.binary())], names=["slice", "counts"])

    @tk.tidy
    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLICE, np.uint64)
        for batch in parts:
            for c in batch.column("counts"):
                total += np.frombuffer(zlib.decompress(c.as_py()), np.uint16)
        usual = float(np.median(total))
        bits = np.packbits(total > usual + 6 * usual**0.5 + 8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["slice", "bits"])

    found = {r.slice: r.bits for r in texts.select("text").mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, bits binary").collect()}
    none = bytes(SLICE // 8)
    return np.frombuffer(b"".join(found.get(i, none) for i in range(slices)), np.uint8)


def heads(token: np.ndarray, begin: np.ndarray, percent: int, rare: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the heads of each set under the orders of its own class and the class before.

    With ``rare``, heads are of the tokens that it marks; sets that have more empty ones than
    are to spare post rare tokens of their prefix (by hash), too, and those with fewer rare
    tokens than a prefix has, heads of all tokens.  Of two linked sets, either one has not too
    many empty heads, and both share a rare one that isn't; or both post prefixes, and they
    share a token if either one's is all rare; or both post all.
    """
    size = np.diff(begin)
    if not len(token):
        return token, np.zeros(0, np.int64)
    rare = np.ones(len(token), bool) if rare is None else rare
    first, orders, spare = size_classes(percent, int(size.max()))
    own = np.searchsorted(first, size, "right") - 1
    keys, rows = [], []
    hashed = tk.mix(token)
    prefix, of_row = prefix_length(size, percent), np.repeat(np.arange(len(size)), size)
    few = np.bincount(of_row[rare], minlength=len(size)) < prefix
    for back in (0, 1):
        c = own - back
        m = np.where((size > 0) & (c >= 0), orders[np.maximum(c, 0)], 0)
        to_spare = spare[np.maximum(c, 0)]
        use = np.repeat(m, size)
        at = np.cumsum(m) - m
        part = ((hashed >> np.uint64(32)) * use.astype(np.uint64)) >> np.uint64(32)
        slot = (np.repeat(at, size) + part.astype(np.int64))[use > 0]
        value = tk.mix(hashed ^ np.uint64(0x94D049BB133111EB))[use > 0]
        some = rare[use > 0]
        owner = np.repeat(np.arange(len(m)), m)
        place = np.arange(len(owner)) - at[owner]
        named = tk.mix((np.maximum(c, 0)[owner].astype(np.uint64) << np.uint64(32)) | place.astype(np.uint64))
        lacking = np.ones(len(m), bool)
        for only in (some, None):
            of, what = (slot, value) if only is None else (slot[only], value[only])
            order = np.argsort(of, kind="stable")
            filled = np.bincount(of, minlength=int(m.sum()))
            head = sums(what[order], np.concatenate([[0], np.cumsum(filled)]))
            empty = np.bincount(owner[filled == 0], minlength=len(m))
            if only is None:
                # empty heads are posted only by the few sets that have more of them than are to spare
                post = ((filled > 0) | (empty > to_spare)[owner]) & lacking[owner]
            else:
                post, lacking = filled > 0, empty > to_spare
            keys.append(tk.mix(head + named + np.uint64(only is None))[post])
            rows.append(owner[post])
            if only is not None:
                single = np.flatnonzero(rare & (lacking & (m > 0))[of_row])
                single = single[np.lexsort((hashed[single], of_row[single]))]
                mine = of_row[single]
                single = single[np.arange(len(mine)) - np.searchsorted(mine, mine) < prefix[mine]]
                mine = of_row[single]
                keys.append(tk.mix(hashed[single] + tk.mix(np.maximum(c, 0)[mine].astype(np.uint64) + np.uint64(0x9FB21C651E98DF25))))
                rows.append(mine)
                lacking &= few
    return np.concatenate(keys), np.concatenate(rows)


def profile(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, s1, s2) of each document: its set's size and signature."""

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tk.buffers(batch.column(1))
            parts = []
            for _, _, d, o in small_chunks(data, off):
                token, begin = shingles(d, o, k)
                parts.append((np.diff(begin), *signatures(token, begin)))
            n, a, b = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n", "s1", "s2"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, s1 bigint, s2 bigint")


def pack(texts: DataFrame) -> DataFrame:
    """(doc_id, text) with compressed texts: they are shuffled more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 3)
        for batch in batches:
            packed = [None if t is None else len(t).to_bytes(8, "big") + codec.compress(t, asbytes=True) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc_id", "text"])

    return texts.mapInArrow(run, "doc_id bigint, text binary")


def unpacked(packed: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks as ``small_chunks`` has them, of compressed texts."""
    codec, held, size, first = pa.Codec("zstd"), [], 0, 0
    for i, p in enumerate(packed):
        raw = b"" if (p := p.as_py()) is None else codec.decompress(p[8:], int.from_bytes(p[:8], "big"), asbytes=True)
        held.append(raw)
        size += len(raw)
        if size >= tk.CHUNK_BYTES or len(held) == _ROWS or i == len(packed) - 1:
            yield first, i + 1, np.frombuffer(b"".join(held), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in held])])
            held, size, first = [], 0, i + 1


def _stars(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (2, k) from each key's least owner to its others; the keys and their least owners."""
    order = np.argsort(key)
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(owner, first) if len(first) else owner
    of = least[np.cumsum(new) - 1] if len(first) else owner
    other = of != owner
    pairs = np.stack([owner[other], of[other]])
    return np.unique(pairs, axis=1) if pairs.shape[1] else pairs, key[new], least


def _posts(key: np.ndarray, owner: np.ndarray, bits: int) -> bytes:
    """Keys, of which the first ``bits`` are known, and owners, in six bytes each."""
    key = (key << np.uint64(bits)) >> np.uint64(16)
    return np.stack([key, owner.view(np.uint64)]).astype("<u8").view(np.uint8).reshape(2, -1, 8)[:, :, :6].tobytes()


def _posted(body: bytes) -> np.ndarray:
    """The two rows that ``_posts`` has packed."""
    six = np.frombuffer(body, np.uint8).reshape(2, -1, 6)
    wide = np.zeros((2, six.shape[1], 8), np.uint8)
    wide[:, :, :6] = six
    return wide.view("<i8")[:, :, 0]


def family_edges(docs: DataFrame, buckets: int, k: int, percent: int, tokens: int) -> DataFrame:
    """Edges (a, b) between sets with an equal head under some order, named by 48 bits of their signatures (``family_name``)."""
    bits = max(1, (buckets - 1).bit_length())
    shift = np.uint64(64 - bits)
    least, log = least_size(percent), sketch_size(tokens)
    common = docs.sparkSession.sparkContext.broadcast(common_cells(docs, k, log))

    def emit(key: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
        edges, key, owner = _stars(key, owner)
        # keys are hashes in order, so a bucket's keys lie together
        bucket = (key >> shift).astype(np.int64)
        cut = np.flatnonzero(np.diff(np.concatenate([[-1], bucket, [-1]]))).tolist()
        packed = [_posts(key[a:b], owner[a:b], bits) for a, b in zip(cut, cut[1:], strict=False)]
        # local edges go out in pieces under buckets of their own
        edges = np.stack(graph.star(edges[0], edges[1]))
        mine = [edges[:, a : a + 65536].tobytes() for a in range(0, edges.shape[1], 65536)]
        return pa.RecordBatch.from_arrays([pa.array([*bucket[cut[:-1]].tolist(), *tk.own_keys(edges[0], len(mine), buckets)], pa.int64()), pa.array([*packed, *mine], pa.binary())], names=["bucket", "body"])

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys, owners, held = [], [], 0
        marked = common.value
        for batch in batches:
            data, off = tk.buffers(batch.column(1))
            for _, _, d, o in small_chunks(data, off):
                token, begin = shingles(d, o, k)
                mine = (signatures(token, begin)[0].view(np.uint64) >> _NAME_SHIFT).view(np.int64)
                # sets that this task has posted are left out
                fresh = np.zeros(len(mine), bool)
                for i, x in enumerate(mine.tolist()):
                    if x not in seen and begin[i + 1] - begin[i] >= least:
                        seen.add(x)
                        fresh[i] = True
                size = np.diff(begin)
                token = token[np.repeat(fresh, size)]
                mine, size = mine[fresh], size[fresh]
                cell = cells(token, log)
                rare = (marked[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 0
                key, row = heads(token, np.concatenate([[0], np.cumsum(size)]), percent, rare)
                keys.append(key)
                owners.append(mine[row])
                held += len(key)
                if held >= _POST:
                    yield emit(np.concatenate(keys), np.concatenate(owners))
                    keys, owners, held = [], [], 0
                    if len(seen) > 500_000:
                        seen.clear()
        if held:
            yield emit(np.concatenate(keys), np.concatenate(owners))

    @tk.tidy
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # two sets with many equal heads meet in many buckets; a task's buckets are merged before edges leave it
        at, key, owner = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        found, held = [np.zeros((2, 0), np.int64)], 0

        def out() -> pa.RecordBatch:
            a, b = found[0]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])[: len(bucket) + 1]).tolist()
            for x, y in zip(cut, cut[1:], strict=False):
                raw = [b.as_py() for b in batch.column("body")[x:y]]
                if bucket[x] < 0:
                    edges = np.concatenate([np.frombuffer(b, np.int64).reshape(2, -1) for b in raw], 1)
                else:
                    if at != bucket[x]:
                        at, key, owner = bucket[x], key[:0], owner[:0]
                    posts = np.concatenate([np.stack([key, owner]), *map(_posted, raw)], 1)
                    edges, key, owner = _stars(posts[0], posts[1])
                found.append(edges)
                held += edges.shape[1]
                if held >= _POST:
                    e = np.concatenate(found, 1)
                    found, held = [np.stack(graph.star(e[0], e[1]))], 0
                    if found[0].shape[1] > 2 * _POST:  # they don't shrink: hand them on
                        yield out()
                        found = [found[0][:, :0]]
        e = np.concatenate(found, 1)
        found = [np.stack(graph.star(e[0], e[1]))]
        yield out()

    return docs.mapInArrow(run, "bucket bigint, body binary").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, graph.EDGES)


def link_family(sets: list[np.ndarray], part: np.ndarray | None = None, percent: int = PERCENT) -> np.ndarray:
    """The component (least index) of each set; with ``part``, only pairs of different parts are compared."""
    m = len(sets)
    comp = np.arange(m)
    n = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), n)
    names, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    salt = tk.mix(names)
    begin = np.concatenate([[0], np.cumsum(n)])
    keep = prefix_length(n, percent)
    files = []
    # orders: rare first; rare first with ties the other way; by a hash alone
    for order in (np.lexsort((salt, df)), np.lexsort((~salt, df)), np.argsort(tk.mix(salt))):
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        by = np.argsort(owner * len(names) + rank[token])
        first = by[np.arange(len(by)) - begin[owner] < keep[owner]]
        who, what = owner[first], token[first]
        post = np.argsort(what, kind="stable")
        head = np.searchsorted(what[post], np.arange(len(names) + 1))
        files.append((who[post], head, what, np.concatenate([[0], np.cumsum(keep)])))
    mark = np.zeros(len(names), bool)
    for i in range(1, m):
        ok = comp[:i] != comp[i]
        small, large = np.minimum(n[:i], n[i]), np.maximum(n[:i], n[i])
        ok &= 100 * small >= percent * large
        if part is not None:
            ok &= part[:i] != part[i]
        for who, head, what, at in files:
            if not ok.any():
                break
            t = what[at[i] : at[i + 1]]
            shares = np.zeros(m, bool)
            shares[who[ranges(head[t], head[t + 1] - head[t])]] = True
            ok &= shares[:i]
        some = np.flatnonzero(ok)
        if not len(some):
            continue
        mine = token[begin[i] : begin[i + 1]]
        mark[mine] = True
        while len(some):
            j = int(some[0])
            both = int(mark[token[begin[j] : begin[j + 1]]].sum())
            some = some[1:]
            if 100 * both >= percent * (n[i] + n[j] - both):
                a, b = comp[i], comp[j]
                comp[comp == max(a, b)] = min(a, b)
                some = some[comp[some] != comp[i]]
        mark[mine] = False
    return comp


def _family_links(k: int, percent: int):
    """Streams groups of (family, i, j), sorted; emits (node, root, blocks) stars."""

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sets, nodes, part = None, [], [], []
        a, b, big = [], [], []

        def close() -> None:
            if len(sets) < 2:
                return
            # smaller sets first keeps the marks short; ties by node
            order = sorted(range(len(sets)), key=lambda x: (len(sets[x]), nodes[x]))
            comp = link_family([sets[x] for x in order], np.array([part[x] for x in order]) if key[1] != key[2] else None, percent)
            own = np.array([nodes[x] for x in order])
            root = np.full(len(own), np.iinfo(np.int64).max)
            np.minimum.at(root, comp, own)
            root = root[comp]
            for x, y in zip(own[own != root].tolist(), root[own != root].tolist(), strict=True):
                a.append(x)
                b.append(y)
                big.append(key[3] > 1)

        def out() -> pa.RecordBatch:
            r = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(big, pa.bool_())], names=["a", "b", "big"])
            a.clear(), b.clear(), big.clear()
            return r

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("family", "i", "j", "blocks")), strict=True))
            node, block = batch.column("node").to_pylist(), batch.column("block").to_pylist()
            s1, s2 = batch.column("s1").to_pylist(), batch.column("s2").to_pylist()
            for first, end, d, o in unpacked(batch.column("text")):
                token, begin = shingles(d, o, k)
                one, two = signatures(token, begin)
                for x in range(first, end):
                    y = x - first
                    if (one[y], two[y]) != (s1[x], s2[x]):
                        continue  # a row that repeats the id with another text
                    s = token[begin[y] : begin[y + 1]]
                    if keys[x] != key:
                        close()
                        key, sets, nodes, part = keys[x], [], [], []
                    sets.append(s)
                    nodes.append(node[x])
                    part.append(block[x])
            yield out()
        close()
        yield out()

    return run


def _around_pivot(members: DataFrame, k: int, percent: int) -> DataFrame:
    """Members of large families with their family's pivot (least node) and whether they link with it.

    Those that do are one component already, so later they are compared with the others only.
    """
    pivots = members.groupBy("family").agg(F.min_by(F.struct("node", "text"), F.struct("node", "s1")).alias("p")).select(F.col("family").alias("f"), F.col("p.node").alias("pivot"), F.col("p.text").alias("ptext"))

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, center = None, None
        for batch in batches:
            core = []
            owners, origin = batch.column("pivot").to_pylist(), batch.column("ptext")
            for a, b, d, o in unpacked(batch.column("text")):
                token, begin = shingles(d, o, k)
                for x in range(a, b):
                    if owners[x] != seen:
                        seen, (center, _) = owners[x], shingles(*next(unpacked(origin[x : x + 1]))[2:], k)
                    s = token[begin[x - a] : begin[x - a + 1]]
                    both = len(np.intersect1d(s, center, assume_unique=True))
                    core.append(100 * both >= percent * (len(s) + len(center) - both))
            kept = ["family", "node", "n", "s1", "s2", "text", "pivot"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(core, pa.bool_())], names=[*kept, "core"])

    joined = members.join(pivots, F.col("family") == F.col("f")).select("family", "node", "n", "s1", "s2", "text", "pivot", "ptext")
    return joined.mapInArrow(run, "family bigint, node bigint, n bigint, s1 bigint, s2 bigint, text binary, pivot bigint, core boolean")


def _blocks(which: Column, block: int) -> Column:
    """How many blocks the sets that ``which`` picks need, by their number and their tokens."""
    rows, tokens = F.count_if(which) / F.lit(block), F.sum(F.when(which, F.col("n")).otherwise(0)) / F.lit(BLOCK_TOKENS)
    return F.ceil(F.greatest(rows, tokens)).cast("int")


def _block_pairs(around: DataFrame, block: int) -> DataFrame:
    """Members of large families under each pair of blocks that has a block without core members."""
    sizes = around.groupBy("family").agg(_blocks(~F.col("core"), block).alias("others"), _blocks(F.col("core"), block).alias("cores"))
    rows = around.join(sizes, "family")
    hashed = F.xxhash64("s2", "s1")
    rows = rows.withColumn("block", F.when(F.col("core"), F.col("others") + F.pmod(hashed, F.greatest("cores", F.lit(1)))).otherwise(F.pmod(hashed, F.greatest("others", F.lit(1)))).cast("int"))
    last = F.when(F.col("core"), F.col("others")).otherwise(F.col("others") + F.col("cores")) - 1
    other = F.explode(F.when(last >= 0, F.sequence(F.lit(0), last)))
    rows = rows.select("family", "block", "node", "s1", "s2", "text", other.alias("other"))
    return rows.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.lit(2).alias("blocks"), "block", "node", "s1", "s2", "text")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id of every row, for links of at least ``percent`` Jaccard."""
    texts = tk.bounded(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = tk.materialize(profile(texts, words))
    node = F.coalesce(F.min("doc_id"), F.first("s1").bitwiseAND(F.lit(_NULL_ID - 1)).bitwiseOR(F.lit(_NULL_ID)))
    nodes = tk.materialize(rows.where("n > 0").groupBy("s1", "s2").agg(node.alias("node"), F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.count("*").alias("copies")))
    n_rows, total = rows.agg(F.count("*"), F.sum("n")).first()
    total = total or 0
    buckets = min(1 << 20, max(32, int(total * 4 * (100 - percent) / 100 / _POST)))
    edges = family_edges(texts, buckets, words, percent, total)
    family = graph.components(edges, stars=True)
    family = family.union(family.select("root", "root").distinct())
    named = nodes.withColumn("name", F.shiftrightunsigned("s1", int(_NAME_SHIFT)))
    members = tk.materialize(named.join(family.select(F.col("node").alias("name"), F.col("root").alias("family")), "name").drop("name", "copies"))
    blocks = tk.materialize(members.groupBy("family").agg(_blocks(F.lit(True), block).alias("blocks"), F.count("*").alias("size")).where("size > 1"))
    members = tk.materialize(tk.join_hot(members, blocks, ["family"], "size", members.count()))
    # only texts of members are packed and shuffled
    wanted, _ = tk.sift(texts, F.col("doc_id"), members.select("doc_id"))
    members = tk.small(members, BROADCAST)
    with_text = members.join(pack(wanted).withColumnRenamed("doc_id", "d"), members["doc_id"].eqNullSafe(F.col("d"))).select("family", "blocks", "node", "n", "s1", "s2", "text")
    with_text = tk.materialize(with_text)
    zero = F.lit(0)
    spread = with_text.where("blocks = 1").select("family", zero.alias("i"), zero.alias("j"), "blocks", zero.alias("block"), "node", "s1", "s2", "text")
    large, near = not members.where("blocks > 1").isEmpty(), None
    if large:
        around = tk.materialize(_around_pivot(with_text.where("blocks > 1"), words, percent))
        near = around.where("core AND node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
        spread = spread.unionByName(_block_pairs(around, block))
    spread = spread.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "blocks")
    links = tk.materialize(spread.mapInArrow(_family_links(words, percent), "a bigint, b bigint, big boolean"))
    roots = links.where("NOT big").select(F.col("a").alias("node"), F.col("b").alias("root"))
    if large:
        roots = roots.union(graph.components(links.where("big").select("a", "b").union(near), stars=True))
    own = tk.materialize(nodes.join(roots, "node", "left").select("s1", "s2", "copies", F.coalesce("root", "node").alias("root")))
    joined = tk.join_hot(rows, own, ["s1", "s2"], "copies", n_rows, "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("root") < _NULL_ID, F.col("root"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are the first of their component: those with its least id.

    Rows without an id and rows with an empty set always stay, but of rows that repeat id and
    text one stays; of rows that repeat an id with other texts, all or none stay.
    """
    found = tk.materialize(join(docs, id_col, text_col, words, percent))
    gone, = tk.unused(docs, "gone")
    dropped = tk.materialize(found.where("doc_id != component_id").select(F.col("doc_id").alias(gone)).distinct())
    # rows that the filter passes are few, and only they are shuffled
    maybe, others = tk.sift(docs, F.col(id_col).cast("bigint"), dropped)
    kept = others.unionByName(maybe.join(dropped, F.col(id_col).cast("bigint") == F.col(gone), "left_anti"))
    # rows that repeat id and text are copies of each other, too
    again = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(gone))
    if again.isEmpty():
        return kept
    test = F.col(id_col).cast("bigint") == F.col(gone)
    return kept.join(again, test, "left_anti").unionByName(kept.join(again, test, "left_semi").dropDuplicates([id_col, text_col]))
