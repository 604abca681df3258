"""Repeated-substring removal against a dictionary of all windows."""

import random

import pytest

from logvigil.llm import suffix_dedup as S

COLS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def rows(df):
    return sorted(map(tuple, df.select(*COLS).collect()), key=repr)


def synthetic(n=60, seed=3):
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abcé \n", k=rng.randrange(5, 160))) for _ in range(12)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(6)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            parts.append(p[a:] if rng.random() < 0.5 else
                         "".join(rng.choices("abcé", k=rng.randrange(40))))
        docs.append((i, "".join(parts)))
    docs += [(i, "x" * i) for i in range(90, 130)]
    docs += [(200, None), (201, ""), (7, "same key " * 20), (7, "same key " * 20),
             (None, "null key " * 20), (None, "null key " * 20), (300, "ab" * 4000),
             (301, "y" + "ab" * 3000)]
    return docs


@pytest.mark.parametrize("cell,hot", [(S.CELL_BYTES, S.HOT_CELLS), (300, S.HOT_CELLS), (300, 1)])
def test_synthetic(make_docs, cell, hot):
    docs = synthetic()
    got = S.remove_repeats(make_docs(docs), cell_bytes=cell, hot_cells=hot)
    assert rows(got) == sorted(S.brute_force(docs), key=repr)


def test_one_row_many_times(spark, make_docs):
    """Copies of a row travel as a number; its text once for each task."""
    docs = [(5, "the same passage again " * 9), (None, "no key at all " * 9), (7, "the same passage again " * 9)]
    many = [docs[0]] * 9000 + [docs[1]] * 5000 + docs + [(6, None), (6, ""), (6, None)]
    df = make_docs(many)
    sent = S._combine(df.selectExpr("doc_id k", "coalesce(text, '') text")).collect()
    assert sum(r.n for r in sent) == len(many)
    assert sum(r.text is not None for r in sent) <= 4 * df.rdd.getNumPartitions()
    want = {r: 0 for r in S.brute_force([*docs, (6, "")])}
    for k, text in many:
        want[next(r for r in want if r[0] == k and r[1] == len((text or "").encode()))] += 1
    got = S.remove_repeats(df).groupBy(*COLS).count().collect()
    assert {tuple(r)[:-1]: r["count"] for r in got} == want


def test_short_threshold(make_docs):
    docs = synthetic(30, 9)
    got = S.remove_repeats(make_docs(docs), threshold=12, gram=5, cell_bytes=500)
    assert rows(got) == sorted(S.brute_force(docs, 12), key=repr)


def test_real_rows(real_docs):
    docs = [tuple(r) for r in real_docs.select("doc_id", "text").collect()]
    assert rows(S.remove_repeats(real_docs)) == sorted(S.brute_force(docs), key=repr)


def test_kept_text_and_empty_table(make_docs):
    docs = [(1, "p" * 60), (2, "a" + "p" * 60 + "b")]
    out = {r.doc_id: r for r in S.remove_repeats(make_docs(docs), keep_text=True).collect()}
    assert bytes(out[2].kept) == b"ab" and out[2].spans == [1, 61] and out[1].spans == []
    assert S.remove_repeats(make_docs(docs).where("false")).count() == 0
