"""The registered queries on the smallest tables: SQL where there is some, brute force elsewhere."""

import os
import random

import duckdb
import pytest

import corpus_pipeline
from lamina.llm import bpe
from lamina.llm import queries as llm
from lamina.llm.queries import table
from tests.llm import helpers as H

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op2_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op3_jaccard": ["doc_id", "n_shingles", "component_id"],
    "op4_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op5_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op6_licenses": ["doc_id", "n_units", "license", "dice", "matches"],
    "op7_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op8_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op9_nearest": ["query_id", "rank", "vec_id", "score"],
    "op10_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.fixture(scope="module")
def results(spark):
    return {k: f(spark, SF).toArrow() for k, f in llm.queries().items()}


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())


def test_contracts(results, texts):
    assert list(results) == list(COLUMNS)
    for name, got in results.items():
        assert got.column_names[: len(COLUMNS[name])] == COLUMNS[name]
        if name != "op9_nearest":
            assert sorted(got["doc_id"].to_pylist()) == sorted(texts)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_oracle(results, duck, name):
    want = duck.sql(llm.oracle_sql()[name]).to_arrow_table()
    rows = lambda t: sorted(map(repr, zip(*(t[c].to_pylist() for c in sorted(t.column_names)), strict=True)))
    assert sorted(want.column_names) == sorted(results[name].column_names) and rows(results[name]) == rows(want)


def test_folds_and_accuracy(results, duck, texts):
    lang = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
    rows = results["op1_language"].to_pylist()
    assert all(r["held_out"] == (H.fold(r["doc_id"], 3) == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)
    toxic = dict(duck.sql("SELECT doc_id, toxic FROM labels").fetchall())
    rows = results["op5_toxicity"].to_pylist()
    assert all(r["held_out"] == (H.fold(r["doc_id"], 5) == 0) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    known = [r for r in rows if r["doc_id"] in toxic]
    assert sum(r["predicted"] == toxic[r["doc_id"]] for r in known) >= 0.9 * len(known)


def test_base_spans(results, texts):
    for r in results["op2_pii"].to_pylist():
        told = [f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, k, b in H.base_pii(texts[r["doc_id"]])]
        assert r["base_sha256"] == H.sha(",".join(told)) and set(told) <= set(r["spans"].split(",")) | set()
    for r in results["op7_secrets"].to_pylist():
        assert r["base_sha256"] == H.sha(",".join(H.base_secrets(texts[r["doc_id"]])[1]))


def test_suffix_dedup_against_all_windows(results, texts):
    ids = sorted(texts)
    want = dict(zip(ids, H.repeats([texts[i] for i in ids], 400), strict=True))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in results["op8_suffix_dedup"].to_pylist()}
    assert got == want and sum(x[1] for x in got.values()) > 0
    assert {r["doc_id"]: r["shared"] for r in results["op8_suffix_dedup"].to_pylist()} == dict(zip(ids, H.shared([texts[i] for i in ids], 250), strict=True))


def test_stages_one_by_one(spark, tmp_path):
    """Each stage on what the one before it kept, against brute force."""
    table(spark, SF, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    rnd = random.Random(3)
    rows = [r.asDict() for r in table(spark, SF, "documents").collect()]
    extra = [None, "", "... 123", rows[5]["text"], 'a fine text with password = "Zk39xLq8Tt71" in it']
    rows += [dict(doc_id=5000 + i, text=t, lang="en", source="x", n_chars=len(t or "")) for i, t in enumerate(extra)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, table(spark, SF, "documents").schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = table(spark, str(tmp_path), "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        schema, docs = docs.columns, spark.read.parquet(f"{tmp_path}/{name}")
        if name != "encode":
            assert docs.columns == schema
        seen[name] = before, ({r.doc_id: r.text for r in docs.collect()} if name != "encode" else None)
    before, after = seen["language"]
    assert after == {i: t for i, t in before.items() if any(c.isalpha() for c in t or "")}
    before, after = seen["near_duplicates"]
    comp = H.components(sorted(before.items()), percent=80, words=5)
    assert after == {i: t for i, t in before.items() if comp[i][1] == i} and 5003 not in after
    before, after = seen["decontaminate"]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    for i, t in before.items():
        _, hit, _, bad = H.contamination(t, items)
        assert (i not in after) if bad else (after[i] == t if not hit else len(after[i]) < len(t))
    before, after = seen["mask_secrets"]
    assert set(before) == set(after) and after[5004] == 'a fine text with [SECRET]" in it'
    assert all(after[i] == t for i, t in before.items() if not H.base_secrets(t)[1])
    got = sorted(map(str, docs.collect()))
    assert got == sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert got == sorted(map(str, bpe.encode(spark.read.parquet(f"{tmp_path}/mask_secrets"), llm.public_tokenizers.path("word_bpe_49k.json")).collect()))


def tables(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    table(spark, SF, "benchmark").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline_without_rows(spark, tmp_path):
    got = corpus_pipeline.run(spark, tables(spark, tmp_path, table(spark, SF, "documents").limit(0)))
    assert got.count() == 0 and got.columns[:2] == ["doc_id", "n_tokens"]


def test_pipeline_with_repeated_rows_and_clashing_columns(spark, tmp_path):
    """Repeated rows count once, nulls and texts without letters leave; columns of any name do no harm."""
    rnd = random.Random(2)
    prose = [" ".join(f"{rnd.choice(['river', 'stone', 'cloud'])}{chr(97 + rnd.randrange(26))}{chr(97 + rnd.randrange(26))}" for _ in range(60)) for _ in range(6)]
    texts = [*prose, prose[0], prose[1] + " tail", *H.AWKWARD, 'token = "Zk39xLq8Tt71mM" here']
    docs = H.docs(spark, texts)
    names = ["k1", "k2", "spans", "items", "h1", "h2", "hot", "family", "row", "found", "live", "s1", "node"]
    wide = docs
    for n in names:
        wide = wide.withColumn(n, docs["doc_id"])
    plain = corpus_pipeline.run(spark, tables(spark, tmp_path / "a", docs.unionByName(docs))).orderBy("doc_id").collect()
    wider = corpus_pipeline.run(spark, tables(spark, tmp_path / "b", wide.unionByName(wide))).orderBy("doc_id").collect()
    assert plain == wider
    kept = [i for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")]
    kept = [i for i in kept if i not in (6, 7) and not (texts[i] == "tie tie" and texts.index("tie tie") != i)]
    assert [r.doc_id for r in plain] == kept


def test_encoding_against_the_library(results, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(llm.public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    for r in results["op4_bpe"].to_pylist():
        ids = t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), H.sha(" ".join(map(str, ids))))
        assert r["decoded_sha256"] == H.sha(t.decode(ids, skip_special_tokens=False))


def test_neighbours_against_brute_force(results, duck):
    import numpy as np

    ids, x = zip(*duck.sql("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall(), strict=True)
    x, hits, n = np.array(x, np.float64), 0, 0
    got = {}
    for r in results["op9_nearest"].to_pylist():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    assert sorted(got) == [i for i in ids if i % 20 == 0]
    for q, found in got.items():
        s = x @ x[ids.index(q)]
        s[ids.index(q)] = -np.inf
        best = {ids[i] for i in np.lexsort((np.array(ids), -s))[:20]}
        hits, n = hits + len(best & set(found)), n + 20
        assert all(abs(found[v] - s[ids.index(v)]) < 1e-9 for v in found)
    assert hits >= 0.9 * n
