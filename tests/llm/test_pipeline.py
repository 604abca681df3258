"""The pipeline's stages against brute force, and as a whole."""

import corpus_pipeline as C
import pytest

from logvigil.llm import decontaminate as D
from logvigil.llm import jaccard_join as J
from logvigil.llm import language_id as L
from logvigil.llm import secret_scan as S

SF = "/root/testdata/sf0.001"
COLS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(df):
    return sorted((tuple(r) for r in df.select(*COLS).collect()), key=repr)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for i, (_, f) in enumerate(C.STAGES):
        at = str(tmp_path_factory.mktemp("stages") / str(i))
        f(spark, out[-1], SF).write.parquet(at)
        out.append(spark.read.parquet(at))
    return out


def test_language(stages):
    docs, kept = stages[0], stages[1]
    assert kept.columns == docs.columns
    model = L.fit(docs.where(~L.in_fold("doc_id")))
    ok = {r.doc_id for r in L.identify(docs, model, keep=("doc_id",)).collect()
          if r.lang_pred != "und" and r.score >= C.MIN_LANGUAGE_SCORE}
    assert table(kept) == [r for r in table(docs) if r[0] in ok]
    assert len(ok) > 0.9 * docs.count()


def test_near_copies(stages):
    docs = [(r.doc_id, r.text) for r in stages[1].collect()]
    low = {k for k, n, c in J.brute_force(docs, C.SHINGLE_WORDS, C.SIMILARITY_PERCENT) if c == k}
    assert table(stages[2]) == [r for r in table(stages[1]) if r[0] in low]
    assert len(low) < len(docs)


def test_decontamination(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in stages[2].collect()]
    clean = {r[0] for r in D.brute_force(docs, items) if not r[-1]}
    assert table(stages[3]) == [r for r in table(stages[2]) if r[0] in clean]


def test_secrets(stages):
    after = {r.doc_id: r for r in stages[4].collect()}
    seen = 0
    for r in stages[3].collect():
        spans = S.base_spans(r.text)
        got = after[r.doc_id]
        assert got.n_chars == len(got.text) and got.lang == r.lang and got.source == r.source
        assert not S.base_spans(got.text)
        if "[SECRET]" not in got.text:
            assert got.text == r.text and not spans
        seen += bool(spans)
    assert seen and len(after) == stages[3].count()


def test_packing_and_whole_run(spark, stages):
    ids = {r.doc_id for r in stages[4].collect()}
    assert {r.doc_id for r in stages[5].collect()} == ids
    want = sorted(map(tuple, stages[5].select("doc_id", "start", "length", "ids_crc32").collect()))
    got = C.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_odd_rows(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (3, "12 34"), (4, "the cat sat on the mat again"),
                      (4, "the cat sat on the mat again"), (5, "THE cat sat on the mat again"),
                      (None, "the cat sat on the mat again"), (6, "token = abcdefghijkl0 of the cat")])
    docs = docs.select(*COLS)
    out = C.near_copies(spark, docs, SF)
    assert sorted(repr(r.doc_id) for r in out.collect()) == ["1", "2", "3", "4", "6"]
    assert {r.text for r in C.secrets(spark, docs, SF).where("doc_id = 6").collect()} == {
        "[SECRET] of the cat"}
    for _, f in C.STAGES:
        assert f(spark, docs.where("false"), SF).count() == 0
