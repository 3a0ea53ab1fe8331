"""BPE encoding and decoding by a pair occurrence index.

All distinct words of a block of texts lie in one array of symbols.  An index maps each
mergeable pair to all its positions; the active ranks are applied in ascending order, each
to all of its positions at once, and the lists of the pairs that a merge creates are
extended.  A block takes as many rows as ``BLOCK_BYTES`` allow, so memory does not grow
with the partition, and a lost task is simply run again.

Defined results: null text encodes as empty text (no ids, hash of the empty string);
repeated rows give repeated results; ranks are unique, and overlapping places of one pair are
merged from the left; a text of any length is encoded whole, in a block of its own if it is
longer than one; an empty table gives no rows; other columns, whatever their names, are
passed over.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import textkit as tk

BLOCK_BYTES = 3 << 20
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    out = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [out[b] for b in range(256)]


class Vocabulary:
    """A word-end BPE vocabulary: normaliser, word pattern, ranked merges and special tokens."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.tokens = [""] * size
        for t, i in [*vocab.items(), *self.specials.items()]:
            self.tokens[i] = t
        #: shared texts of ids and tokens, so that a block holds references only
        self.id_texts, self.token_texts = (np.array(x, object) for x in (list(map(str, range(size))), self.tokens))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.key_rank = key[order], order.astype(np.int64)
        self.left, self.right, self.made = left, right, made
        stand = _byte_symbols()
        self.byte_id = np.array([vocab[c] for c in stand], np.int64)
        self.last_id = np.array([vocab[c + self.end] for c in stand], np.int64)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None

    def pieces(self, text: str) -> list[str]:
        """Words of the normalised text; special tokens stand as themselves with a NUL before."""
        if self.special is None or not any(s in text for s in self.specials):
            return self._words(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self._words(text[at : m.start()])
            out.append("\0" + m[0])
            at = m.end()
        return out + self._words(text[at:])

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            # a capital sigma has one lower-case form here, wherever it stands
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.word.findall(text.lower())

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, -1 where there is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], -1)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, and where each word's ids begin (length + 1)."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        off = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(b"".join(raw), np.uint8)
        n = len(data)
        sym = self.byte_id[data]
        ends = off[1:][size > 0] - 1
        sym[ends] = self.last_id[data[ends]]
        nxt = np.arange(1, n + 1)
        nxt[ends] = n
        prv = np.arange(-1, n - 1)
        prv[off[:-1][size > 0]] = -1
        sym = np.append(sym, -1)
        pos = np.flatnonzero(nxt < n)
        rank = self.ranks(sym[pos], sym[nxt[pos]])
        pos, rank = pos[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        pos, rank = pos[order], rank[order]
        cut = np.flatnonzero(np.diff(rank)) + 1
        #: the pair occurrence index: rank of a pair -> arrays of its positions
        index: dict[int, list] = {int(rank[a]): [p] for a, p in zip(np.concatenate([[0], cut]), np.split(pos, cut), strict=True)} if len(pos) else {}
        active = list(index)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            after = nxt[at]
            live = (sym[at] == a) & (sym[after] == b)
            at, after = at[live], after[live]
            if a == b and len(at) > 1:
                keep, last = [], -1
                for i, (p, q) in enumerate(zip(at.tolist(), after.tolist(), strict=True)):
                    if p != last:
                        keep.append(i)
                        last = q
                at, after = at[keep], after[keep]
            if not len(at):
                continue
            sym[at] = self.made[r]
            sym[after] = -1
            follow = nxt[after]
            nxt[at] = follow
            inner = follow < n
            prv[follow[inner]] = at[inner]
            before = prv[at]
            first = np.concatenate([before[before >= 0], at[inner]])
            if not len(first):
                continue
            new = self.ranks(sym[first], sym[nxt[first]])
            ok = new >= 0
            first, new = first[ok], new[ok]
            if not len(first):
                continue
            if len(first) > 1:
                order = np.argsort(new, kind="stable")
                first, new = first[order], new[order]
                cut = np.flatnonzero(np.diff(new)) + 1
                heads, parts = new[np.concatenate([[0], cut])].tolist(), np.split(first, cut)
            else:
                heads, parts = [int(new[0])], [first]
            for k, p in zip(heads, parts, strict=True):
                if k in index:
                    index[k].append(p)
                else:
                    index[k] = [p]
                    heapq.heappush(active, k)
        kept = np.concatenate([[0], np.cumsum(sym[:n] >= 0)])
        return sym[:n][sym[:n] >= 0], kept[off]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        return Vocabulary(json.load(f))


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def encode_block(v: Vocabulary, texts: list[str | None]) -> tuple[list[np.ndarray], list[str], list[np.ndarray], list[str]]:
    """Of each text the word numbers; of each word the ids as text, their count and the tokens as text."""
    number = _Numbers()
    rows = []
    for t in texts:
        ws = v.pieces(t) if t else []
        rows.append(np.array(list(map(number.__getitem__, ws)), np.int32))
    plain = [w if w[:1] != "\0" or w[1:] not in v.specials else "" for w in number]
    ids, off = v.encode_words(plain)
    counts = np.diff(off)
    cut = off.tolist()
    id_text, token = v.id_texts[ids].tolist(), v.token_texts[ids].tolist()
    as_ids = [" ".join(id_text[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
    as_tokens = [" ".join(token[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
    for w, k in number.items():
        if w[:1] == "\0" and w[1:] in v.specials:
            as_ids[k], as_tokens[k], counts[k] = str(v.specials[w[1:]]), w[1:], 1
    return rows, as_ids, counts, as_tokens


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = True) -> DataFrame:
    """Encode every whole text and decode it again.

    ``digest`` gives (doc_id, n_tokens, ids_sha256, decoded_sha256); otherwise the rows are
    (doc_id, n_tokens, ids array<int>, decoded string).  No shuffle: one pass in Arrow batches.
    """

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)

        def flush(ids: list, texts: list) -> pa.RecordBatch:
            rows, as_ids, counts, as_tokens = encode_block(v, texts)
            n, a, b = [], [], []
            for r in rows:
                k = r.tolist()
                n.append(int(counts[r].sum()))
                coded, decoded = " ".join([as_ids[i] for i in k]), " ".join([as_tokens[i] for i in k])
                if digest:
                    a.append(hashlib.sha256(coded.encode()).hexdigest())
                    b.append(hashlib.sha256(decoded.encode()).hexdigest())
                else:
                    a.append(list(map(int, coded.split())))
                    b.append(decoded)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string() if digest else pa.list_(pa.int32())), pa.array(b, pa.string())], names=names)

        names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"])]
        ids, texts, held = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_py()
                ids.append(i)
                texts.append(t)
                held += len(t or "")
                if held >= BLOCK_BYTES:
                    yield flush(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield flush(ids, texts)

    schema = SCHEMA if digest else "doc_id bigint, n_tokens bigint, ids array<int>, decoded string"
    return tk.bounded(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
