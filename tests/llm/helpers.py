"""Documents that hold every awkward case, and brute-force versions of the operators."""

import hashlib
import re
import zlib

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, start bigint, gone boolean"


def docs(spark, texts, first=0, lang=None):
    rows = [(first + i, t, lang[i] if lang else None, f"s{i % 3}", None if t is None else len(t), "k", 7, True) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


#: null, empty, blank, no letters, one word, unusual characters
AWKWARD = [None, "", " \n\t ", "12345 !!! ...", "word", "Ünïcödé 日本語 \U0001f600 é", "\x00\x01 a\x00b", "a" * 50_000, "tie tie", "tie tie"]


def fold(doc_id, k):
    return zlib.crc32(str(doc_id).encode()) % k


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(_LOWER)


def shingle_set(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def components(rows, percent=90, words=3):
    """{doc_id: (n, component)} by comparing all pairs; rows: (doc_id, text)."""
    sets = [(i, shingle_set(t, words)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            both = len(s & u)
            if s and u and 100 * both >= percent * (len(s) + len(u) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def repeats(texts, size):
    """Per text: (bytes, removed, spans, digest of what stays)."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for i, b in enumerate(data):
        for k in range(len(b) - size + 1):
            seen.setdefault(b[k : k + size], []).append((i, k))
    gone = [bytearray(len(b)) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for i, k in places:
                gone[i][k : k + size] = b"\x01" * size
    out = []
    for b, g in zip(data, gone, strict=True):
        spans = len(re.findall(b"\x01+", bytes(g)))
        out.append((len(b), sum(g), spans, sha(bytes(x for x, y in zip(b, g, strict=True) if not y))))
    return out


def shared(texts, size):
    """Per text: whether a string of so many bytes is in another row's text, too."""
    data = [(t or "").encode() for t in texts]
    has = {}
    for i, b in enumerate(data):
        for k in range(len(b) - size + 1):
            has.setdefault(b[k : k + size], set()).add(i)
    some = {i for v in has.values() if len(v) > 1 for i in v}
    return [int(i in some) for i in range(len(data))]


SECRETS = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}


def base_secrets(text):
    out, n = [], dict.fromkeys(SECRETS, 0)
    for place, (kind, p) in enumerate(SECRETS.items()):
        for m in p.finditer(text or ""):
            if len(m[2] if kind == "assign" else m[0]) < {"assign": 8, "access": 16, "hex": 32}[kind]:
                continue
            n[kind] += 1
            out.append((m.start(), place, f"{kind}:{m.start()}:{m.end()}"))
    return n, [x[2] for x in sorted(out)]


PII = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def base_pii(text):
    out = []
    for kind, p in enumerate(PII):
        for m in p.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == 2 and not (12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0):
                continue
            if kind == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def contamination(text, items, window=13):
    """(n_words, n_hit, items, contaminated) of one text; items: (item_id, text)."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = word.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        v = word.findall(lower(t))
        n = min(window, len(v))
        grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in grams:
                hit.update(range(k, k + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)
