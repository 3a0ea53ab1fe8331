"""Cases of the first review round: what the operators left out before."""

import random

import corpus_pipeline
from lamina.llm import licenses, secrets
from tests.llm import helpers as H


def test_near_duplicate_stage_at_five_words_and_four_fifths(spark):
    rnd = random.Random(11)
    texts = []
    for n in (3, 5, 9, 40, 60, 100, 200):
        w = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
        texts += [" ".join(w), " ".join(w + [f"more{i}" for i in range(n // 5)]), " ".join([*w[: n // 2], "edit", *w[n // 2 + 1 :]])]
    texts += H.AWKWARD
    df = H.docs(spark, texts)
    sets = [H.shingle_set(t, 5) for t in texts]
    root = list(range(len(texts)))
    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if s and sets[j] and 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    kept = {i for i, r in enumerate(root) if r == i}
    assert len(kept) < len({r for _, r in H.components(list(enumerate(texts))).values()})
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == kept


def best_window(text, body):
    w, t, n = licenses.normal(text), licenses.bigrams(body), len(licenses.normal(body)) - 1
    g = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    return max((2 * len(set(g[i : i + n]) & set(t)) / (len(set(g[i : i + n])) + len(t)) for i in range(len(g)) if g[i] in t), default=0)


def test_whole_licenses_wrapped_and_above_code(spark):
    prose = "\n".join(f"value_{i} = compute(value_{i - 1}, {i}) + the other" for i in range(80))
    comment = lambda t: "".join(f" * {x}\n" for x in t.splitlines())
    small = [k for k, v in licenses.TEXTS.items() if len(v) < 3000]
    names = [*small, *small, "apache-2.0", "gpl-3.0"]
    texts = [f"/*\n{comment(licenses.TEXTS[k])}*/\n{prose}" if i < len(small) else licenses.TEXTS[k] for i, k in enumerate(names)]
    mit = licenses.TEXTS["mit"]
    texts += [prose + mit + licenses.TEXTS["isc"], mit[: len(mit) * 6 // 10] + prose, mit[: len(mit) * 8 // 10] + prose, *H.AWKWARD]
    got = {r.doc_id: r for r in licenses.scan(H.docs(spark, texts)).collect()}
    for i, name in enumerate(names):
        assert (got[i].license, f"0:{name}" in got[i].matches.split(",")) == (name, True)
    n = len(names)
    assert {"0:mit", "0:isc"} <= set(got[n].matches.split(","))
    for i, t in enumerate(texts):
        if len(t or "") < 8000:
            want = {f"0:{k}" for k in small if best_window(t or "", licenses.TEXTS[k]) >= licenses.THRESHOLD}
            assert {m for m in got[i].matches.split(",") if m[2:] in small and m[:2] == "0:"} == want


def test_live_values_of_any_form_standing_bare(spark):
    values = ["Zk39xLq8Tt71", "eyJhbGci.eyJzdWIi.SflKxwRJ", "correcthorsebattery"]
    texts = [f'password = "{v}"' for v in values] + [f"see {v}. Then (\U0001f600 {v}) ends" for v in values] + ["token: everything"] + ["everything is fine"] * 4
    owners = ["a"] * 7 + ["b", "c", "d", "e"]
    df = H.docs(spark, texts).drop("source").join(spark.createDataFrame(list(enumerate(owners)), "doc_id bigint, source string"), "doc_id")
    got = {r.doc_id: r.spans for r in secrets.scan(df).collect()}
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    for i, v in enumerate(values):
        t = texts[3 + i]
        a, b = t.index(v), t.rindex(v)
        assert got[3 + i] == f"bare:{a}:{a + len(v)},bare:{b}:{b + len(v)}"
        assert clean[3 + i] == t.replace(v, "[SECRET]")
    assert all(got[i] == "" and clean[i] == texts[i] for i in range(7, 11))


def test_wrapped_notices(spark):
    code = "\n".join(f"value_{i} = compute(value_{i - 1}, {i}) + the other" for i in range(30))
    wrap = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    names = [k for k, v in licenses.TEMPLATES.items() if len(licenses.bigrams(v)) >= licenses.WRAPPED]
    texts = [f"{code}\n{wrap(licenses.TEMPLATES[k], 10)}\n{code}" for k in names] + [f"{code}\n{licenses.TEMPLATES[k]}\n{code}" for k in names]
    got = {r.doc_id: r for r in licenses.scan(H.docs(spark, texts)).collect()}
    for i, k in enumerate(names):
        # lgpl's first ten words are enough of it on their own line
        assert ("31:" if k == "lgpl-3.0-notice" else "0:") + k in got[i].matches.split(",")
        # on one line it is told by its line alone
        assert f"31:{k}" in got[len(names) + i].matches.split(",") and f"0:{k}" not in got[len(names) + i].matches.split(",")
