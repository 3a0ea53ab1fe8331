"""Language identification by string kernels.

The kernel is the normalised blended-spectrum presence kernel: texts become sets of byte
n-grams (n = 1 to 3, ASCII letters lower-cased, all other ASCII bytes one boundary symbol),
k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|), over the n-grams that the fit sample has.
Nystroem landmarks give phi(x) = K(landmarks)^(-1/2) k(x, landmarks); one ridge regression
for each language (one versus rest) is solved on phi, and scoring is a batched product of a
presence matrix, the landmark matrix and the folded coefficients.

Fitting takes a bounded sample of labelled rows (``FIT_ROWS`` a language, texts up to
``FIT_BYTES``), the scoring takes every whole text.  Defined results: null text or text
without a letter gets ``und`` and score 0; rows without a label are never learned from; with
no labelled rows every text is ``und``; equal scores go to the language that comes first by
name; texts of any length are scored whole; repeated rows give repeated results; an empty table
gives no rows; other columns, whatever their names, are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm import textkit as tk

FIT_ROWS, FIT_BYTES, LANDMARKS, RIDGE = 400, 1 << 18, 48, 1e-3
UNKNOWN = "und"
ROWS = 256


@cache
def _classes() -> np.ndarray:
    """Byte classes: 0 boundary, 1 to 26 letters, 27 to 154 the bytes of other characters."""
    t = np.zeros(256, np.int32)
    t[65:91] = t[97:123] = np.arange(1, 27)
    t[128:] = np.arange(27, 155)
    return t


SYMBOLS = 155


def gram_codes(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, code) of all 1-, 2- and 3-grams; codes of different lengths differ."""
    c = _classes()[data]
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    yield row, c
    two = c[:-1] * SYMBOLS + c[1:]
    same = row[:-1] == row[1:]
    yield row[:-1][same], two[same] + SYMBOLS
    three = two[:-1] * SYMBOLS + c[2:]
    same = row[:-2] == row[2:]
    yield row[:-2][same], three[same] + (SYMBOLS + SYMBOLS**2)


CODES = SYMBOLS + SYMBOLS**2 + SYMBOLS**3


@dataclass
class Model:
    langs: list[str]
    #: column of each n-gram code, the last column for n-grams outside the sample
    column: np.ndarray
    #: landmark presence over n-grams, columns divided by the landmark's norm
    landmarks: np.ndarray
    #: Nystroem projection times the ridge coefficients
    weights: np.ndarray
    bias: np.ndarray

    def presence(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        p = np.zeros((len(off) - 1, self.landmarks.shape[0] + 1), bool)
        for row, code in gram_codes(data, off):
            p[row, self.column[code]] = True
        return p[:, :-1]

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """One-versus-rest scores, a row for each text."""
        return self.kernel(self.presence(data, off)) @ self.weights + self.bias

    def kernel(self, p: np.ndarray) -> np.ndarray:
        k = p.astype(np.float32) @ self.landmarks
        norm = np.sqrt(np.maximum(1, p.sum(1, dtype=np.int64)))
        return (k / norm[:, None]).astype(np.float64)


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Fit on texts with labels; the first ``landmarks`` of each language become landmarks."""
    if not texts:
        return None
    names = sorted(set(langs))
    data, off = tk.buffers(pa.array(texts, pa.large_string()))
    seen = np.zeros(CODES, bool)
    for a, _, d, o in tk.chunks(data, off):
        for _, code in gram_codes(d, o):
            seen[code] = True
    column = np.full(CODES, int(seen.sum()), np.uint16 if seen.sum() < 65536 else np.int32)
    column[seen] = np.arange(int(seen.sum()))
    model = Model(names, column, np.zeros((int(seen.sum()), 0), np.float32), np.zeros(0), np.zeros(0))
    rows = np.concatenate([[i for i, x in enumerate(langs) if x == name][:landmarks] for name in names]).astype(int)

    def parts() -> Iterator[tuple[int, np.ndarray]]:
        for a in range(0, len(texts), ROWS):
            b = min(len(texts), a + ROWS)
            yield a, model.presence(data[off[a] : off[b]], off[a : b + 1] - off[a])

    marks = np.concatenate([p[rows[(rows >= a) & (rows < a + ROWS)] - a] for a, p in parts()]).astype(np.float32)
    model.landmarks = np.ascontiguousarray((marks / np.sqrt(np.maximum(1, marks.sum(1)))[:, None]).T)
    k = np.concatenate([model.kernel(p) for _, p in parts()])
    inner = (marks / np.sqrt(np.maximum(1, marks.sum(1)))[:, None]).astype(np.float64)
    value, vector = np.linalg.eigh(inner @ inner.T)
    ok = value > 1e-8 * value[-1]
    root = vector[:, ok] / np.sqrt(value[ok])
    phi = k @ root
    y = np.array([[1.0 if x == name else 0.0 for name in names] for x in langs])
    middle, level = phi.mean(0), y.mean(0)
    phi -= middle
    beta = np.linalg.solve(phi.T @ phi + ridge * len(texts) * np.eye(phi.shape[1]), phi.T @ (y - level))
    model.weights, model.bias = root @ beta, level - middle @ beta
    return model


def sample(docs: DataFrame, label: str, rows: int, text_col: str, id_col: str, longest: int) -> list:
    """About ``rows`` labelled rows of each label value, picked by a hash of the id; (text, label)."""
    counts = {r[0]: r[1] for r in docs.groupBy(label).count().collect()}
    if not counts:
        return []
    hashed = F.pmod(F.xxhash64(F.lit(17), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    pick: Column = F.lit(False)
    for value, n in counts.items():
        pick = pick | ((F.col(label) == F.lit(value)) & (hashed < F.lit(min(1.0, rows / n))))
    found = docs.where(pick & (F.octet_length(text_col) <= longest)).select(F.col(text_col).alias("text"), F.col(label).alias("label"), F.col(id_col).alias("id"))
    return sorted(((r.text, r.label, r.id) for r in found.limit(2 * rows * len(counts)).collect()), key=lambda r: (str(r[2]), r[0]))


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS) -> Model | None:
    """Fit on a bounded sample of the rows for which ``learn`` holds and the label is known."""
    labelled = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    found = [(t, x) for t, x, _ in sample(labelled, lang_col, rows, text_col, id_col, FIT_BYTES) if any(c.isalpha() for c in t)]
    model = fit([t for t, _ in found], [x for _, x in found])
    del found
    tk.release()  # the driver lives on
    return model


def predictor(docs: DataFrame, model: Model | None, text_at: int, finish):
    """For mapInArrow: ``finish(batch, langs, scores, has_letter)`` makes the result of each batch."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, off = tk.buffers(batch.column(text_at))
            n = batch.num_rows
            letter = _has_letter(data, off)
            langs, score = np.full(n, UNKNOWN, object), np.zeros(n)
            for a, b, d, o in tk.chunks(data, off) if m is not None else ():
                for i in range(0, b - a, ROWS):
                    j = min(b - a, i + ROWS)
                    s = m.scores(d[o[i] : o[j]], o[i : j + 1] - o[i])
                    best = s.argmax(1)
                    e = np.exp(8 * (s - s.max(1, keepdims=True)))
                    langs[a + i : a + j] = np.array(m.langs, object)[best]
                    score[a + i : a + j] = 1 / e.sum(1)
            langs[~letter], score[~letter] = UNKNOWN, 0.0
            yield finish(batch, langs, score, letter)

    return run


def _has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    low = data | 0x20
    sums = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122) & (data < 128))])
    out = sums[off[1:]] > sums[off[:-1]]
    for i in np.flatnonzero(~out & (np.diff(off) > 0)).tolist():
        out[i] = any(c.isalpha() for c in data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    texts = tk.bounded(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    run = predictor(docs, model, 1, lambda b, langs, score, _: pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"]))
    return texts.mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a language; the others are rejected.

    Without a model (no labels at all), texts with a letter stay.
    """
    bare = model is None  # the model itself goes by broadcast
    run = predictor(docs, model, docs.columns.index(text_col), lambda b, langs, _, letter: b.filter(pa.array(letter if bare else langs != UNKNOWN)))
    return tk.bounded(docs).mapInArrow(run, docs.schema)
