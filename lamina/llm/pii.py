"""Personal data by bootstrapped contextual extraction.

Base entities (email, ip, card, phone) are found by fixed expressions and are the seeds.
Other identifier-like runs are candidates: groups of digits joined by blanks, dots, hyphens or
brackets (6 digits or more), codes of letters and digits (4 digits or more), and users at
hosts in words ("jane [at] example [dot] com") or without a dot.  A run ends where its own
characters end, not at white space or a length.  Seeds and candidates induce lexical patterns:
the word before with the word after, and the two words before; lower case, digits masked.

Spark scores the pattern-instance graph in rounds.  A pattern's kind is that of most of its
accepted instances, its confidence the share of its instances, weighted by their own
confidence, that are accepted as this kind.  Patterns with ``MIN_SEEDS`` of them and a
confidence of ``ACCEPT`` are accepted, and so are all their instances, with the pattern's
kind and confidence.  These count as seeds in the next round and can induce further patterns;
the rounds end when nothing new is accepted.  What an accepted pattern surrounds is a span.

The text is scanned once; candidates (never the text) are checkpointed.  Edges are
aggregated by (pattern, instance) before any join, so copies weigh once.  Defined results:
null text is empty; a text of any length is scanned whole, in linear time; rows are told
apart by a row key, so repeated rows give repeated results; equal counts of a pattern go to the
kind that comes first, equal confidences of an instance too; an empty table gives no rows;
other columns, whatever their names, are passed over.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import textkit as tk

KINDS = ("email", "ip", "card", "phone")
ACCEPT, MIN_SEEDS = 0.8, 3
#: Digits of a candidate: groups of digits, codes with letters.
GROUP_DIGITS, CODE_DIGITS = 6, 4
#: Patterns or instances that may be broadcast.
BROADCAST = 100_000
# The base expressions.  Digit runs are taken whole (possessive, not after a
# digit), which leaves the leftmost matches as they are and bounds the work on long runs.
AFTER_AT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Bytes without which a text has no entity and no candidate: digits, @ and the brackets of "(at)".
SIGNS = np.isin(np.arange(256), list(b"0123456789@[({<"))
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := AFTER_AT.match(text, at + 1)):
            yield a, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of all base entities, in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        d = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


GROUPS = re.compile(r"[0-9]++(?:[\x20().-]{1,3}+[0-9]++)*+")
AT = re.compile(r"@|\x20?[\[({<]\x20?(?:at|AT)\x20?[\])}>]\x20?")
HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({<]\x20?(?:dot|DOT)\x20?[\])}>]\x20?)[A-Za-z0-9-]++)*+")
_CODE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
_DIGITS = re.compile("[0-9]+")


def _in_word(c: str) -> bool:
    return c.isalnum() or c in "_'"


def _shape(word: str) -> str:
    return _DIGITS.sub("0", word.lower())


def _word_before(text: str, at: int) -> tuple[int, int]:
    """The last run of letters or of digits that ends before ``at``; empty at the text's start."""
    end = at
    while end > 0 and not _in_word(text[end - 1]):
        end -= 1
    start = end
    while start > 0 and _in_word(text[start - 1]) and text[start - 1].isdigit() == text[end - 1].isdigit():
        start -= 1
    return start, end


def contexts(text: str, a: int, b: int) -> tuple[str, str]:
    """The lexical patterns of a span: word before and word after; two words before."""
    x, y = _word_before(text, a)
    v, w = _word_before(text, x)
    start = b
    while start < len(text) and not _in_word(text[start]):
        start += 1
    end = start
    while end < len(text) and _in_word(text[end]) and text[end].isdigit() == text[start].isdigit():
        end += 1
    near = _shape(text[x:y]) or "^"
    return f"{near} _ {_shape(text[start:end]) or '$'}", f"{_shape(text[v:w]) or '^'} {near} _"


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like runs between the base entities, in order, none over another."""
    out: list[tuple[int, int]] = []
    ends = [0, *(y for _, _, y in taken)]
    low = 0
    for a, b in zip(ends, [*(x for x, _, _ in taken), len(text)], strict=True):
        low = max(low, a)
        if low < b:
            out += _between(text, low, b)
    return out


def _between(text: str, low: int, high: int) -> list[tuple[int, int]]:
    found, done = [], low
    for m in AT.finditer(text, low, high):
        a = m.start()
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        if a < m.start() and (host := HOST.match(text, m.end(), high)):
            found.append((a, host.end()))
            done = host.end()
    out, done, k = [], low, 0
    for m in GROUPS.finditer(text, low, high):
        a, b = m.span()
        if a < done:
            continue
        while a > done and text[a - 1] in _CODE:
            a -= 1
        while b < high and text[b] in _CODE:
            b += 1
        done = b
        while text[a] in "_-":
            a += 1
        while text[b - 1] in "_-":
            b -= 1
        run = text[a:b]
        letters = any("A" <= c <= "Z" or "a" <= c <= "z" for c in run)
        if sum("0" <= c <= "9" for c in run) < (CODE_DIGITS if letters else GROUP_DIGITS):
            continue
        while k < len(found) and found[k][1] <= a:
            k += 1
        if k == len(found) or b <= found[k][0]:
            out.append((a, b))
    return sorted(out + found)


def extract(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each document: base results, and candidates (kind or -1, start, end, pattern, instance)."""

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("patterns", pa.list_(pa.int64())), ("instance", pa.int64())]))
        key = lambda s: int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
        for batch in batches:
            data, off = tk.buffers(batch.column(1))
            sign = np.concatenate([[0], np.cumsum(SIGNS[data])])
            may = sign[off[1:]] > sign[off[:-1]]
            spans, found = [], []
            for i, t in enumerate(batch.column(1)):
                text = t.as_py() if may[i] else None
                if not text:
                    spans.append([])
                    found.append([])
                    continue
                b = base(text)
                rows = [(k, x, y) for x, k, y in b] + [(-1, x, y) for x, y in candidates(text, b)]
                spans.append([(x, k, y) for x, k, y in b])
                found.append([{"kind": k, "start": x, "end": y, "patterns": [key(c) for c in contexts(text, x, y)], "instance": key(text[x:y])} for k, x, y in rows])
            told = [",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in s) for s in spans]
            count = lambda k: pa.array([sum(x[1] == k for x in s) for s in spans], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(count, range(4)), pa.array(told), pa.array(found, kind_type)], names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "found"])

    texts = tk.bounded(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, found array<struct<kind:int,start:bigint,end:bigint,patterns:array<bigint>,instance:bigint>>")


def confident(found: DataFrame, accept: float = ACCEPT, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """(pattern, kind) of the patterns that discover identifiers."""
    each = found.select(F.explode("found").alias("m")).select(F.explode("m.patterns").alias("pattern"), "m.instance", "m.kind")
    # an instance that is a seed of several kinds counts as the first of them
    seed = F.min(F.when(F.col("kind") >= 0, F.col("kind")))
    edges = each.groupBy("pattern", "instance").agg(seed.alias("kind"))
    seeds = edges.where("kind IS NOT NULL").groupBy("instance").agg(F.min("kind").alias("own"))
    # a candidate has its own kind of run, so it is no seed elsewhere; edges know at once what is accepted
    edges = tk.materialize(edges.join(seeds, "instance", "left").select("pattern", "instance", F.col("own").alias("kind"), F.when(F.col("own").isNotNull(), 1.0).alias("trust")))
    while True:
        per = edges.groupBy("pattern", "kind").agg(F.count("*").alias("n"), F.sum("trust").alias("trust"))
        # kind null: what isn't accepted
        best = F.max(F.when(F.col("kind").isNotNull(), F.struct("n", (-F.col("kind")).alias("k"), "trust")))
        patterns = per.groupBy("pattern").agg(F.sum("n").alias("all"), best.alias("b")).where(F.col("b.n") >= min_seeds)
        patterns = patterns.select("pattern", (-F.col("b.k")).alias("as"), (F.col("b.trust") / F.col("all")).alias("confidence")).where(F.col("confidence") >= accept)
        patterns = tk.small(tk.materialize(patterns), BROADCAST)
        reached = edges.where("kind IS NULL").join(patterns, "pattern").groupBy("instance").agg(F.max(F.struct("confidence", (-F.col("as")).alias("k"))).alias("b"))
        new = tk.materialize(reached.select("instance", (-F.col("b.k")).alias("now"), F.col("b.confidence").alias("sure")))
        if new.isEmpty():
            return patterns.select("pattern", F.col("as").alias("kind"))
        joined = edges.join(tk.small(new, BROADCAST), "instance", "left")
        edges = tk.materialize(joined.select("pattern", "instance", F.coalesce("kind", "now").alias("kind"), F.coalesce("trust", "sure").alias("trust")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found for every row."""
    found = tk.materialize(extract(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    good = confident(found, accept, min_seeds)
    new = found.where(F.exists("found", lambda m: m["kind"] < 0)).select("row", F.explode(F.filter("found", lambda m: m["kind"] < 0)).alias("m"))
    new = new.select("row", "m.start", "m.end", F.posexplode("m.patterns").alias("place", "pattern")).join(good, "pattern")
    # the pattern of both sides goes before that of the words before
    new = new.groupBy("row", "start", "end").agg(F.min(F.struct("place", "kind")).alias("k"))
    new = tk.small(tk.materialize(new.groupBy("row").agg(F.collect_list(F.struct("start", F.col("k.kind").alias("kind"), "end")).alias("new"))), BROADCAST)
    names = F.array(*map(F.lit, KINDS))
    old = F.transform(F.filter("found", lambda m: m["kind"] >= 0), lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    every = F.array_sort(F.concat(old, F.col("new")))
    told = F.array_join(F.transform(every, lambda m: F.concat_ws(":", F.element_at(names, m["kind"] + 1), m["start"].cast("string"), m["end"].cast("string"))), ",")
    joined = found.join(new, "row", "left")
    return joined.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), F.when(F.col("new").isNull(), F.col("base")).otherwise(told).alias("spans"), F.coalesce(F.size("new"), F.lit(0)).cast("bigint").alias("n_found"))
