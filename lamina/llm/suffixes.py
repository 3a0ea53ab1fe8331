"""Suffix arrays by induced sorting, vectorised by bucket, and permuted common prefixes."""

from __future__ import annotations

import numpy as np

from lamina.llm import textkit as tk

#: The separator between pieces; text bytes are moved up by two, 0 ends the text.
END, GAP, SHIFT = 0, 1, 2


def _types(t: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than their right neighbour's."""
    step = np.sign(np.diff(t.astype(np.int32)))
    n = len(t)
    where = np.where(step != 0, np.arange(n - 1, dtype=np.int32), n - 1)
    nearest = np.minimum.accumulate(where[::-1])[::-1]
    s = np.empty(n, bool)
    s[-1] = True
    s[:-1] = np.append(step, 1)[nearest] > 0
    return s


def _grouped(t: np.ndarray, at: np.ndarray, lists: list[list[np.ndarray]]) -> None:
    """Hand positions to the lists of their symbols, in order."""
    if not len(at):
        return
    k = t[at]
    o = np.argsort(k, kind="stable")
    k, at = k[o], at[o]
    cut = np.flatnonzero(k[1:] != k[:-1]) + 1
    heads = k[np.concatenate([[0], cut])].tolist()
    for c, part in zip(heads, np.split(at, cut), strict=True):
        lists[c].append(part)


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in order: first the larger, then the smaller types."""
    none = np.zeros(0, np.int32)
    ends: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    _grouped(t, lms, ends)
    large_lists: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    large: list[np.ndarray] = [none] * symbols
    for c in range(symbols):
        parts, others = [], []
        cur = np.concatenate(large_lists[c]) if large_lists[c] else none
        large_lists[c] = []
        while len(cur):
            parts.append(cur)
            j = cur - 1
            j = j[j >= 0]
            j = j[~small[j]]
            same = t[j] == c
            others.append(j[~same])
            cur = j[same]
        if parts:
            large[c] = np.concatenate(parts)
        if ends[c]:
            j = np.concatenate(ends[c]) - 1
            others.append(j[j >= 0])
        if others:
            _grouped(t, np.concatenate(others), large_lists)
    small_lists: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    out: list[np.ndarray] = []
    for c in range(symbols - 1, -1, -1):
        parts, others = [], []
        cur = np.concatenate(small_lists[c]) if small_lists[c] else none
        small_lists[c] = []
        while len(cur):
            parts.append(cur)
            j = cur - 1
            j = j[j >= 0]
            j = j[small[j]]
            same = t[j] == c
            others.append(j[~same])
            cur = j[same]
        if c == END:
            parts = [np.array([len(t) - 1], np.int32)]
        j = large[c][::-1] - 1
        j = j[j >= 0]
        others.append(j[small[j]])
        if parts:
            out.append(np.concatenate(parts)[::-1])
        out.append(large[c])
        if c:
            _grouped(t, np.concatenate(others), small_lists)
    return np.concatenate(out[::-1])


def _ranked(names: np.ndarray) -> np.ndarray:
    """Suffixes of a sequence of names in order, by ranks of prefixes that grow by as many as a key of 63 bits holds."""
    n = len(names)
    rank, k = names.astype(np.int64) + 1, 1
    while True:
        bits = int(rank.max()).bit_length()
        times = max(2, 63 // bits)
        key = np.zeros(n, np.int64)
        for i in range(times):
            key <<= bits
            key[: max(0, n - i * k)] |= rank[i * k :]
        k *= times
        order = np.argsort(key)
        key = key[order]
        step = np.ones(n, np.int64)
        step[1:] = key[1:] != key[:-1]
        rank[order] = np.cumsum(step)
        if rank[order[-1]] == n:
            return order


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffixes of ``t``, which ends with its only END, in order."""
    symbols = int(t.max()) + 1
    small = _types(t)
    first = np.zeros(len(t), bool)
    first[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(first).astype(np.int32)
    if len(lms) < 2:
        return _induce(t, small, lms, symbols)
    order = _induce(t, small, lms[np.argsort(t[lms], kind="stable")], symbols)
    order = order[first[order]]
    # equal leftmost-smaller substrings get equal names; they are told apart by their hash
    up, down = tk.powers(len(t))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(t.astype(np.uint64) + np.uint64(1)) * up[: len(t)])])
    stop = np.append(lms[1:], lms[-1]) + 1
    content = (sums[stop] - sums[lms]) * down[lms] + tk.mix((stop - lms).astype(np.uint64))
    number = np.empty(len(t), np.int32)
    number[lms] = np.arange(len(lms), dtype=np.int32)
    content = content[number[order]]
    step = np.zeros(len(lms), np.int32)
    step[1:] = content[1:] != content[:-1]
    names = np.empty(len(lms), np.int32)
    names[number[order]] = np.cumsum(step)
    del sums, content
    if names.max() + 1 == len(lms):
        ordered = order
    elif int(names.max()) < 500 and len(lms) > 2000:
        # few names: the same induced sorting, one level down
        ordered = lms[suffix_array(np.append(names + 1, END).astype(np.int16))[1:]]
    else:
        ordered = lms[_ranked(names)]
    return _induce(t, small, ordered.astype(np.int32), symbols)


def repeats(t: np.ndarray, owner: np.ndarray, size: int, short: int, lanes: int = 1 << 12) -> tuple[np.ndarray, np.ndarray]:
    """Where a string of ``size`` symbols without GAP starts that also starts somewhere else; where one of ``short`` symbols starts that another owner has.

    ``owner`` is -1 where nothing counts as a start.  The common prefix of each start with the
    start before it in order is found in text order (permuted), so it shrinks by at most one from
    a start to the next one as long as the other's right neighbour is a start, too; many such
    stretches of the text advance side by side.  Prefixes are compared as far as they matter.
    """
    n, most = len(t), max(size, short)
    sa = suffix_array(t)
    counts = np.append(owner >= 0, False)
    order = sa[counts[sa]]
    start = np.flatnonzero(counts)
    m = len(start)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    other = before[start]
    stops = np.flatnonzero(t < SHIFT)
    room = lambda at: stops[np.searchsorted(stops, at)] - at
    limit = np.where(other >= 0, np.minimum(np.minimum(room(start), room(np.maximum(other, 0))), most), 0)
    # symbols beyond a limit are never told apart, so bytes do
    raw = np.concatenate([(t - SHIFT).astype(np.uint8), np.zeros(8, np.uint8)])
    words = np.ndarray((n + 1,), "<u8", raw, 0, (1,)).copy()
    fresh = np.ones(m, bool)
    fresh[1:] = (start[1:] != start[:-1] + 1) | (other[:-1] < 0) | ~counts[other[:-1] + 1]
    run = np.flatnonzero(fresh)
    at = np.flatnonzero(fresh | ((np.arange(m) - np.repeat(run, np.diff(np.append(run, m)))) % -(-n // lanes) == 0))
    end = np.append(at[1:], m)
    common = np.zeros(m, np.int64)
    h = np.zeros(len(at), np.int64)
    while len(at):
        a, b, far = start[at], other[at], limit[at]
        h = np.minimum(np.maximum(h - 1, 0), far)
        live = np.flatnonzero(h < far)
        while len(live):
            x = words[a[live] + h[live]] ^ words[b[live] + h[live]]
            differs = x != 0
            x = x[differs]
            h[live[differs]] += np.log2((x & (~x + np.uint64(1))).astype(np.float64)).astype(np.int64) >> 3
            live = live[~differs]
            h[live] += 8
            live = live[h[live] < far[live]]
        np.minimum(h, far, out=h)
        common[at] = h
        at = at + 1
        keep = at < end
        at, end, h = at[keep], end[keep], h[keep]
    # runs of starts in order that share so many symbols
    plcp = np.zeros(n, np.int64)
    plcp[start] = common
    shares, mine = plcp[order], owner[order]
    out = []
    for length, apart in ((size, False), (short, True)):
        new = shares < length
        new[:1] = True
        head = np.flatnonzero(new)
        at = np.cumsum(new) - 1
        if apart:
            several = np.minimum.reduceat(mine, head) != np.maximum.reduceat(mine, head) if len(head) else new
        else:
            several = np.bincount(at, minlength=len(head)) > 1
        marks = np.zeros(n, bool)
        marks[order[several[at]]] = True
        out.append(marks)
    return out[0], out[1]
