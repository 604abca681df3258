"""Language and quality models: held-out accuracy, exact text counts."""

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np
from logvigil.llm import language_id as L
from logvigil.llm import quality_rules as Q
from logvigil.llm.linear import Ftrl, platt, temperature
from logvigil.llm.textkit import text_buffer

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab #é\n\t", max_size=40), min_size=1, max_size=6))
def test_text_counts(texts):
    buf, off = text_buffer(pa.array(texts, pa.string()))
    c = Q.text_counts(buf, off)
    for d, t in enumerate(texts):
        assert tuple(int(c[n][d]) for n in COUNTS[:5]) == Q.brute_counts(t)[:5]


def test_ftrl_separates_and_is_sparse():
    rng = np.random.default_rng(0)
    m = Ftrl(50, 3, l1=0.05)
    for _ in range(900):
        y = int(rng.integers(3))
        at = np.unique(np.append(rng.integers(10, 50, 5), y))
        m.update(at, np.ones(len(at)), y)
    w = m.weights()
    assert [int(w[y].argmax()) for y in range(3)] == [0, 1, 2]
    assert (w[10:] == 0).sum() > 0


def test_calibration():
    rng = np.random.default_rng(1)
    z = rng.normal(size=4000) * 2
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 * z + 1)))).astype(int)
    a, b = platt(z, y, np.ones(4000))
    assert abs(a - 0.5) < 0.1 and abs(b - 1) < 0.15
    logits = np.stack([np.zeros(4000), z], axis=1)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z / 3))).astype(int)
    assert 2.4 < temperature(logits, y) < 3.8


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet") \
        .withColumn("held_out", L.in_fold("doc_id"))
    out = L.fit_predict(docs, keep=("doc_id", "held_out", "lang")).toPandas()
    assert len(out) == 1000 and out["score"].between(0, 1).all()
    held = out[out["held_out"]]
    assert len(held) > 150 and (held["lang"] == held["lang_pred"]).mean() > 0.97


def test_language_odd_rows(spark, make_docs):
    base = [(i, "the and of with" if i % 2 else "x") for i in range(40)]
    docs = make_docs([*base, (100, None), (101, ""), (102, "12 !?"), (103, "日本"), (None, "the")])
    out = {r.doc_id: r for r in L.fit_predict(docs).collect()}
    assert {out[i].lang_pred for i in (100, 101, 102)} == {"und"}
    assert {out[i].score for i in (100, 101, 102)} == {0.0}
    assert out[103].lang_pred == "en" and out[None].lang_pred == "en"
    from pyspark.sql import functions as F
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.fit_predict(bare).collect()} == {"und"}
    assert L.fit_predict(docs.where("false")).count() == 0


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train = labels.where("doc_id % 3 != 0")
    out = Q.judge(docs, Q.fit(docs, train)).toPandas().set_index("doc_id")
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for i, r in out.iterrows():
        assert tuple(r[COUNTS]) == Q.brute_counts(text[i])
    assert not (out["kept"] & out["base_failed"]).any()
    test = {r.doc_id: r.quality for r in labels.where("doc_id % 3 = 0").collect()}
    good = [out.loc[i, "kept"] for i, q in test.items() if q == 1 and not out.loc[i, "base_failed"]]
    bad = [out.loc[i, "kept"] for i, q in test.items() if q == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.4


def test_quality_odd_rows(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (3, "w " * 60), (4, " ".join(map(str, range(60)))),
                      (4, "a b"), (None, "x y")])
    labels = spark.createDataFrame([(4, 1), (9, 0), (None, 1)], "doc_id long, quality int")
    out = Q.judge(docs, Q.fit(docs, labels)).collect()
    assert len(out) == 6 and {r.kept for r in out if r.n_words == 60} == {False, True}
    none = labels.where("false")
    assert all(r.quality is None for r in Q.judge(docs, Q.fit(docs, none)).collect())
    assert Q.judge(docs.where("false"), None).count() == 0


def test_sample_is_bounded_whatever_repeats(spark, make_docs):
    """One repeated row, one key of many texts, texts beyond the size bound."""
    rows = [(1, "the same text")] * 4000 + [(2, f"text {i}") for i in range(500)] + [(i, f"t {i}") for i in range(3, 90)]
    docs = make_docs(rows)
    d = docs.selectExpr("doc_id k", "text", "lang")
    drawn, there = L.balanced_sample(d, "lang", 50)
    assert len(drawn) == 50 and there == {"en": 4587} and len({(r["k"], r["text"]) for r in drawn}) == 50
    again, _ = L.balanced_sample(d.repartition(7), "lang", 50)
    assert {(r["k"], r["text"]) for r in again} == {(r["k"], r["text"]) for r in drawn}
    few, _ = L.balanced_sample(d.where("k = 1"), "lang", 50)
    assert len(few) == 1
    labels = spark.createDataFrame([(1, 1)] * 900 + [(2, 0)] * 900 + [(3, 1)], "doc_id long, quality int")
    seen = []
    old, Q.sparse_texts = Q.sparse_texts, lambda texts, f: seen.append(texts) or old(texts, f)
    try:
        assert Q.fit(docs, labels, sample_rows=40) is not None
    finally:
        Q.sparse_texts = old
    assert len(seen[0]) <= 40


def test_only_long_texts_still_give_a_model(make_docs):
    from pyspark.sql import functions as F
    long_ = lambda w: (w + " ") * 30_000
    docs = make_docs([(i, long_("the and" if i % 2 else "der und")) for i in range(12)]) \
        .withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de"))
    out = {r.doc_id: r.lang_pred for r in L.fit_predict(docs).collect()}
    assert out == {i: "en" if i % 2 else "de" for i in range(12)}
