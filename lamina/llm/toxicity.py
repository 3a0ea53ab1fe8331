"""Toxicity by averaged subword embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its hashed character n-grams (3 to 7 bytes, with word borders) and of
itself; a window of ``WINDOW`` words averages the embeddings of its words (a word right after itself
counts once, missing words of short texts count as zero vectors), and a linear softmax turns
the average into two class probabilities.  A text scores as its worst window, so that a short
insult in a long text isn't averaged away; texts of up to ``WINDOW`` words are one window.
Embeddings begin at smoothed log-odds and are then trained with the softmax.  Misspelt words share most n-gram vectors with the words they come from.
Scoring needs only one number a subword, because the softmax is linear in the average.

Training takes a bounded sample (``FIT_ROWS`` a label, texts up to ``FIT_BYTES``); scoring
takes every whole text.  Defined results: null, empty or wordless text scores as a window
without words (the bias alone); without labels the score is 0 everywhere; a score of exactly
0.5 counts as toxic; repeated rows give repeated results; repeated labels count once, and a
document with both labels counts as toxic; an empty table gives no rows; other columns, whatever their names, are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm import textkit as tk

BUCKETS, WIDTH, WINDOW, GRAMS = 1 << 19, 8, 6, (3, 4, 5, 6, 7)
FIT_ROWS, FIT_BYTES, EPOCHS, RATE, BATCH, SEED = 1200, 1 << 14, 16, 0.05, 32, 11
#: Smoothing of the log-odds that the embeddings begin with, and their scale.
SMOOTH, START = 4.0, 6.0
_EDGE = np.uint64(0xABC98388FB8FAC03)


def subwords(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Row of each word, repeats dropped; pairs (word, bucket) for each n-gram length and for whole words."""
    data = tk.LOWER[data]
    start, end, row = tk.words(data, off, tk.ALNUM)
    whole = tk.word_hashes(data, start, end)
    new = np.ones(len(start), bool)
    new[1:] = (whole[1:] != whole[:-1]) | (row[1:] != row[:-1])
    start, end, row, whole = start[new], end[new], row[new], whole[new]
    n = len(start)
    each = np.arange(n)
    out = [(each, (whole % np.uint64(BUCKETS)).astype(np.int64))]
    if not n:
        return row, out
    # words with a border symbol on either side, one after another
    size = end - start + 2
    at = np.cumsum(size) - size
    value = np.full(int(size.sum()), _EDGE, np.uint64)
    word = np.repeat(each, size)
    place = np.arange(len(value)) - at[word]
    body = (place > 0) & (place < size[word] - 1)
    value[body] = tk._byte_values()[data[(start[word] + place - 1)[body]]]
    h = value.copy()
    for g in range(2, max(GRAMS) + 1):
        h = h[:-1] * tk._ODD + value[g - 1 :]
        if g in GRAMS:
            ok = place[: len(h)] + g <= size[word[: len(h)]]
            out.append((word[: len(h)][ok], (tk.mix(h[ok]) % np.uint64(BUCKETS)).astype(np.int64)))
    return row, out


@dataclass
class Model:
    #: what each subword adds to the log-odds of the toxic class, times its share
    worth: np.ndarray
    bias: float

    def word_worths(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, parts = subwords(data, off)
        n = len(row)
        total, count = np.zeros(n), np.zeros(n)
        for word, bucket in parts:
            total += np.bincount(word, self.worth[bucket], n)
            count += np.bincount(word, minlength=n)
        return row, total / np.maximum(count, 1)

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        row, worth = self.word_worths(data, off)
        n = len(off) - 1
        out = np.full(n, self.bias)
        if len(row):
            mean, owner = windows(row, worth, n)
            best = np.full(n, -np.inf)
            np.maximum.at(best, owner, mean)
            has = best > -np.inf
            out[has] += best[has]
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def window_starts(row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of each window: steps of half a window, the last one full."""
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    step = WINDOW // 2
    per = np.where(count > 0, np.maximum(1, -(-(count - WINDOW) // step) + 1), 0)
    owner = np.repeat(np.arange(n), per)
    k = np.arange(len(owner)) - (np.cumsum(per) - per)[owner]
    size = np.minimum(count[owner], WINDOW)
    return first[owner] + np.minimum(k * step, count[owner] - size), size


def windows(row: np.ndarray, worth: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean worth of each window, and its text."""
    at, size = window_starts(row, n)
    sums = np.concatenate([[0], np.cumsum(worth)])
    return (sums[at + size] - sums[at]) / WINDOW, row[at]


def fit(texts: list[str], toxic: list[int], epochs: int = EPOCHS) -> Model | None:
    """Joint gradient steps (Adagrad) on embeddings and softmax, each through a text's worst window."""
    if not texts or len(set(toxic)) < 2:
        return None
    rng = np.random.default_rng(SEED)
    data, off = tk.buffers(pa.array(texts, pa.large_string()))
    n = len(texts)
    rows, buckets, shares = [], [], []
    for a, _, d, o in tk.chunks(data, off, 1 << 19):
        r, parts = subwords(d, o)
        word = np.concatenate([w for w, _ in parts])
        order = np.argsort(word, kind="stable")
        rows.append(r + a)
        buckets.append(np.concatenate([b for _, b in parts])[order].astype(np.int32))
        shares.append(np.bincount(word, minlength=len(r)))
    row, bucket, share = np.concatenate(rows), np.concatenate(buckets), np.concatenate(shares)
    del rows, buckets, shares, data
    begin = np.concatenate([[0], np.cumsum(share)])
    y = np.array(toxic, np.int64)
    soft = rng.normal(0, 0.3, (WIDTH, 2)).astype(np.float32)
    soft[:, 1] = -soft[:, 0]
    # embeddings begin along the softmax, as far as a subword's texts are toxic more often than others
    odds = _log_odds(row, begin, bucket, y) * START
    gap = soft[:, 1] - soft[:, 0]
    emb = odds[:, None].astype(np.float32) * (gap / (gap @ gap))[None, :]
    bias = np.array([1.5, -1.5])
    seen_e, seen_s, seen_b = np.full(BUCKETS, 1e-4, np.float32), np.full(soft.shape, 1e-4, np.float32), np.full(2, 1e-4)
    at, size = window_starts(row, n)
    owner = row[at]
    first = np.searchsorted(owner, np.arange(n + 1))
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * n
    for _ in range(epochs):
        mix = rng.permutation(n)
        for a in range(0, n, BATCH * 4):
            # the worst windows of some batches under the present weights
            some = np.sort(mix[a : a + BATCH * 4])
            worth = emb @ (soft[:, 1] - soft[:, 0])
            ws = [np.arange(first[i], first[i + 1]) for i in some.tolist() if first[i + 1] > first[i]]
            if not ws:
                continue
            chosen = []
            for w in ws:
                lo, hi = at[w[0]], at[w[-1]] + size[w[-1]]
                s = worth[bucket[begin[lo] : begin[hi]]]
                per = np.add.reduceat(s, begin[lo:hi] - begin[lo]) / share[lo:hi]
                sums = np.concatenate([[0], np.cumsum(per)])
                mean = (sums[at[w] + size[w] - lo] - sums[at[w] - lo]) / WINDOW
                chosen.append(int(w[mean.argmax()]))
            for k in range(0, len(chosen), BATCH):
                _step(np.array(chosen[k : k + BATCH]), at, size, owner, begin, share, bucket, y, weight, emb, soft, bias, seen_e, seen_s, seen_b)
    worth = (emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
    return Model(worth, float(bias[1] - bias[0]))


def _log_odds(row: np.ndarray, begin: np.ndarray, bucket: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smoothed log-odds of the toxic class by the texts that hold each subword."""
    held = np.zeros((2, BUCKETS))
    first = np.searchsorted(row, np.arange(len(y) + 1))
    for i, label in enumerate(y.tolist()):
        held[label, np.unique(bucket[begin[first[i]] : begin[first[i + 1]]])] += 1
    share = y.mean()
    toxic, clean = held[1] + SMOOTH * share, held[0] + SMOOTH * (1 - share)
    return np.where(held.sum(0) > 0, np.log(toxic / clean) - np.log(share / (1 - share)), 0)


def _step(win, at, size, owner, begin, share, bucket, y, weight, emb, soft, bias, seen_e, seen_s, seen_b) -> None:
    """One Adagrad step on a batch of windows."""
    m = len(win)
    word = np.concatenate([np.arange(at[w], at[w] + size[w]) for w in win.tolist()])
    of = np.repeat(np.arange(m), size[win])
    per = share[word]
    sub = np.concatenate([bucket[begin[w] : begin[w + 1]] for w in word.tolist()])
    which = np.repeat(of, per)
    part = np.repeat(1.0 / (per * WINDOW), per).astype(np.float32)
    bag = np.zeros((m, WIDTH), np.float32)
    np.add.at(bag, which, emb[sub] * part[:, None])
    z = bag @ soft + bias
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    g = p.copy()
    g[np.arange(m), y[owner[win]]] -= 1
    g *= weight[owner[win]][:, None]
    g_soft = bag.T @ g
    g_bag = (g @ soft.T).astype(np.float32)
    # the step on a subword isn't diluted by the length of its window
    ids, inverse = np.unique(sub, return_inverse=True)
    g_emb = np.zeros((len(ids), WIDTH), np.float32)
    np.add.at(g_emb, inverse, g_bag[which] * (part * WINDOW)[:, None])
    seen_e[ids] += (g_emb**2).mean(1)
    emb[ids] -= (RATE * WINDOW) * g_emb / np.sqrt(seen_e[ids])[:, None]
    seen_s += g_soft**2
    soft -= RATE * g_soft / np.sqrt(seen_s)
    seen_b += g.sum(0) ** 2
    bias -= RATE * g.sum(0) / np.sqrt(seen_b)


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS) -> Model | None:
    """Fit on a bounded sample of the labelled rows for which ``learn`` holds.

    The ids of the sample are picked from the labels first, so only their texts are read.
    """
    known = labels.where(learn & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(id_col, label_col).distinct()
    counts = {r[0]: r[1] for r in known.groupBy(label_col).count().collect()}
    hashed = F.pmod(F.xxhash64(F.lit(17), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    pick: Column = F.lit(False)
    for value, n in counts.items():
        pick = pick | ((F.col(label_col) == F.lit(value)) & (hashed < F.lit(min(1.0, rows / n))))
    ids: dict[int, int] = {}
    for r in known.where(pick).limit(3 * rows).collect():
        ids[r[0]] = max(ids.get(r[0], 0), r[1])
    if not ids:
        return None
    # at most 3 * rows ids
    found = docs.where(F.col(id_col).isin(list(ids)) & F.col(text_col).isNotNull() & (F.octet_length(text_col) <= FIT_BYTES)).select(id_col, text_col).limit(6 * rows).collect()
    pairs = sorted((r[0], r[1]) for r in found)
    return fit([t for _, t in pairs], [ids[i] for i, _ in pairs])


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text; one pass in Arrow batches."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, off = tk.buffers(batch.column(1))
            out = np.zeros(batch.num_rows)
            for a, b, d, o in tk.chunks(data, off, 1 << 20) if m is not None else ():
                out[a:b] = m.scores(d, o)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])

    return tk.bounded(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, score double")
