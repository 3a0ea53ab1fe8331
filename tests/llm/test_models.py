"""The two trained models against plain versions of their formulas."""

import random
import re

import numpy as np
import pyarrow as pa

from lamina.llm import langid, toxicity
from lamina.llm import textkit as tk
from tests.llm import helpers as H


def gram_set(text):
    """The distinct n-grams of 1 to 3 bytes: letters small, other ASCII bytes one symbol."""
    b = [bytes([c]).lower() if c >= 128 or bytes([c]).isalpha() else b" " for c in text.encode()]
    return {b"".join(b[i : i + n]) for n in (1, 2, 3) for i in range(len(b) - n + 1)}


def test_language_scores_by_sets():
    rnd = random.Random(21)
    words = {"a": "the quick brown fox jumps over lazy dog".split(), "b": "der schnelle braune fuchs springt über den faulen hund".split(), "c": "le renard brun saute par dessus été chien".split()}
    langs = [rnd.choice("abc") for _ in range(90)]
    texts = [" ".join(rnd.choice(words[x]) for _ in range(rnd.randrange(1, 12))) + rnd.choice(["", "!", " 12", "\n"]) for x in langs]
    model = langid.fit(texts, langs, landmarks=7, ridge=0.01)
    known = set().union(*map(gram_set, texts))
    kernel = lambda x, y: len(x & y) / np.sqrt(max(1, len(x)) * max(1, len(y)))
    sets = [gram_set(t) & known for t in texts]
    marks = [sets[i] for name in "abc" for i in [i for i, x in enumerate(langs) if x == name][:7]]
    asked = [*texts[:20], "fox und renard", "zzz qqq", "", "日本", "Ünder THE dog"]
    k = np.array([[kernel(s, m) for m in marks] for s in sets])
    value, vector = np.linalg.eigh(np.array([[kernel(s, m) for m in marks] for s in marks]))
    ok = value > 1e-8 * value[-1]
    root = vector[:, ok] / np.sqrt(value[ok])
    phi, y = k @ root, np.array([[float(x == name) for name in "abc"] for x in langs])
    middle, level = phi.mean(0), y.mean(0)
    # ridge regression as least squares with as many rows of penalty as features
    lower = np.sqrt(0.01 * len(texts)) * np.eye(phi.shape[1])
    beta = np.linalg.lstsq(np.concatenate([phi - middle, lower]), np.concatenate([y - level, np.zeros((phi.shape[1], 3))]), rcond=None)[0]
    want = (np.array([[kernel(gram_set(t) & known, m) for m in marks] for t in asked]) @ root - middle) @ beta + level
    data, off = tk.buffers(pa.array(asked, pa.large_string()))
    assert np.abs(model.scores(data, off) - want).max() < 1e-3


def test_toxicity_scores_by_windows():
    rnd = random.Random(22)
    words = [w + e for w in ("river", "stone", "cloud", "tree") for e in ("", "s", "y")]
    texts, toxic = [], []
    for i in range(120):
        w = [rnd.choice(words) for _ in range(rnd.randrange(3, 30))]
        if i % 2:
            w.insert(rnd.randrange(len(w)), "grumblefrot")
        texts.append(" ".join(w))
        toxic.append(i % 2)
    model = toxicity.fit(texts, toxic, epochs=3)
    one = lambda w: float(model.word_worths(*tk.buffers(pa.array([w], pa.large_string())))[1][0])

    def score(text):
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", H.lower(text))
        found = [w for i, w in enumerate(found) if not i or found[i - 1] != w]
        n, size = len(found), toxicity.WINDOW
        starts = {min(k, max(0, n - size)) for k in range(0, max(1, n), size // 2)} if n else set()
        sums = [sum(one(w) for w in found[k : k + size]) / size for k in starts]
        return 1 / (1 + np.exp(-(model.bias + (max(sums) if sums else 0))))

    asked = [*texts[:30], "stone stone stone river", "Grumblefrots!", "grumblfrot here", *[t or "" for t in H.AWKWARD if len(t or "") < 100]]
    got = model.scores(*tk.buffers(pa.array(asked, pa.large_string())))
    assert np.abs(got - np.array([score(t) for t in asked])).max() < 1e-9
    # a misspelt insult is nearer to it than a clean word is
    near, clean = model.scores(*tk.buffers(pa.array(["grumblefrott", "riverr"], pa.large_string())))
    assert near > 0.5 > clean


def test_joint_training_lowers_the_loss():
    rnd = random.Random(23)
    w = lambda: " ".join(rnd.choice("aeiou") + rnd.choice("bcdfg") + rnd.choice("aeiou") for _ in range(12))
    texts = [w() + (" snarkwit" if i % 2 else "") for i in range(200)]
    y = np.array([i % 2 for i in range(200)])
    loss = []
    for epochs in (0, 8):
        s = toxicity.fit(texts, y.tolist(), epochs=epochs).scores(*tk.buffers(pa.array(texts, pa.large_string())))
        loss.append(-np.mean(y * np.log(s) + (1 - y) * np.log(1 - s)))
    assert loss[1] < loss[0]
