"""Decontamination, sharding and packing against brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logvigil.llm import decontaminate as D
from logvigil.llm import packing as P
from logvigil.llm import sharding as S
from logvigil.llm.textkit import SPACE_WORDS, span_hashes, text_buffer, windows, word_spans

TOK = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (4, "a b"), (None, "x Y z"),
       (5, "éa é-B 12 <|endoftext|> z"), (6, "word " * 9000)]


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aB \n\té", max_size=12), max_size=6), st.integers(1, 4))
def test_word_windows(texts, k):
    import pyarrow as pa
    buf, off = text_buffer(pa.array(texts, pa.string()))
    s, e, first = word_spans(buf, off, SPACE_WORDS)
    raw = buf.tobytes()
    want = [t.split() for t in texts]
    got = [[raw[s[i]:e[i]].decode() for i in range(first[d], first[d + 1])]
           for d in range(len(texts))]
    assert got == want
    h, at = windows(span_hashes(buf, s, e, fold=True), first, k)
    runs = [tuple(x.lower() for x in w[i:i + k]) for w in want for i in range(len(w) - k + 1)]
    assert len(runs) == len(h) and len(set(runs)) == len(set(h.tolist()))
    assert len({(r, x) for r, x in zip(runs, h.tolist())}) == len(set(runs))


def test_long_words_hash_alike_wherever_they_stand():
    w = b"x" * 200_000
    raw = np.frombuffer(b"ab " + w + b" cd " + w + b" ab", np.uint8)
    s, e, _ = word_spans(raw, np.array([0, len(raw)]), SPACE_WORDS)
    h = span_hashes(raw, s, e)
    assert h[1] == h[3] and h[0] == h[4] and len(set(h.tolist())) == 3


# ------------------------------------------------------------ decontamination
BENCH = [(1, "One two three four five six seven eight nine ten eleven"), (2, "alpha beta"),
         (10, "alpha beta"), (3, None), (4, ""), (5, "- -"), (None, "gamma"),
         (6, " ".join(f"w{i % 3}" for i in range(30))), (7, "solo")]


def bench(spark):
    return spark.createDataFrame(BENCH, "item_id int, text string")


def contaminated_docs():
    rng = random.Random(5)
    words = ["one", "TWO", "three", "alpha", "beta", "w0", "w1", "w2", "solo", "x", "é"]
    out = [(i, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(40)]
    out += [(100, "pre one two, three four FIVE six seven eight nine ten eleven post"),
            (101, "w0 w1 w2 " * 400), (102, "x " * 700 + "alpha; beta " + "y " * 700)]
    return out + ODD


def test_decontamination_brute_force(spark, make_docs):
    docs = contaminated_docs()
    want = sorted(D.brute_force(docs, [b for b in BENCH if b[0] is not None]), key=repr)
    found = D.find_contamination(make_docs(docs), bench(spark))
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert rows(D.digest(found), *cols) == want
    blocks = D.find_contamination(make_docs(docs), bench(spark), block_bytes=60)
    assert rows(D.digest(blocks), *cols) == want


def test_decontamination_real_rows(spark, real_docs):
    b = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = D.brute_force([tuple(r) for r in real_docs.select("doc_id", "text").collect()],
                         [tuple(r) for r in b.collect()])
    got = rows(D.digest(D.find_contamination(real_docs, b)), "doc_id", "n_words", "n_hit",
               "n_items", "items_sha256", "contaminated")
    assert got == sorted(want, key=repr) and any(r[-1] for r in got)


def test_decontamination_empty_tables(spark, make_docs):
    none = bench(spark).where("false")
    assert {r.n_hit for r in D.find_contamination(make_docs(ODD), none).collect()} == {0}
    assert D.find_contamination(make_docs(ODD).where("false"), bench(spark)).count() == 0


# ------------------------------------------------------------------- sharding
def jump_plain(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=20), st.integers(1, 200))
def test_jump_hash(keys, n):
    k = np.array(keys, np.uint64)
    got, grown = S.jump_hash(k, n), S.jump_hash(k, n + 1)
    assert got.tolist() == [jump_plain(x, n) for x in keys]
    assert all(a == b or b == n for a, b in zip(got, grown))


def test_shards(spark, make_docs):
    docs = ODD + [(i, f"t{i % 5}") for i in range(500)] + [(7, "same")] * 300
    out = S.with_slots(S.assign_shards(make_docs(docs), 24), rows_per_bucket=50).toPandas()
    assert len(out) == len(docs)
    want = sorted(((t or "").encode() for _, t in docs))
    assert sorted(out["size"]) == sorted(len(t) + 8 for t in want)
    assert sorted(out["text_crc32"]) == sorted(map(zlib.crc32, want))
    assert out.groupby("doc_id")["shard"].nunique().max() == 1
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert set(out["shard"]) <= set(range(24)) and out["shard"].nunique() > 20
    moved = out[out["shard"] != out["grown_shard"]]
    assert set(moved["grown_shard"]) == {24}
    assert S.with_slots(S.assign_shards(make_docs(docs).where("false"), 24)).count() == 0


# -------------------------------------------------------------------- packing
def test_nnls_solves_known_systems():
    a = np.array([[1.0, 1, 0], [0, 1, 1], [1, 0, 1]])
    x = P.nnls(a, a @ np.array([3.0, 0, 5]))
    assert np.allclose(x, [3, 0, 5], atol=1e-6) and (x >= 0).all()
    y = np.array([1.0, -2, 1])
    x = P.nnls(a, y)
    assert (x >= 0).all() and (a.T @ (y - a @ x) <= 1e-6).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=16, max_size=16))
def test_plan_uses_each_length_once(counts):
    hist = np.array([0, *counts])
    used = np.zeros(17, int)
    for pattern, k in P.plan_packing(hist, 16):
        assert sum(pattern) <= 16 and k > 0
        for b in pattern:
            used[b] += k
    assert (used == hist).all()


def check_packing(spark, df, docs):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(TOK)
    out = P.pack(P.cut_pieces(df, TOK, keep_ids=True)).toPandas()
    want = sorted((repr(i), tuple(tok.encode(t or "", add_special_tokens=False).ids + [1]))
                  for i, t in docs)
    total = sum(len(x) for _, x in want)
    assert out["length"].sum() == total
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g["offset"]) == list(np.cumsum([0, *g["length"][:-1]]))
        assert g["length"].sum() <= 2048
    assert sorted(out["sequence_id"].unique()) == list(range(out["sequence_id"].nunique()))
    for r in out.itertuples():
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    whole = {}
    for r in out.itertuples():
        whole.setdefault((repr(None if np.isnan(r.doc_id) else int(r.doc_id)), r.doc_tokens,
                          r.start), []).append(tuple(r.ids))
    for i, ids in want:
        for s in range(0, len(ids), 2048):
            assert ids[s:s + 2048] in whole[i, len(ids), s]
    return total / (2048 * out["sequence_id"].nunique())


def test_packing_round_trip(spark, make_docs, real_docs):
    check_packing(spark, make_docs(ODD), ODD)
    fill = check_packing(spark, real_docs,
                         [tuple(r) for r in real_docs.select("doc_id", "text").collect()])
    assert fill > 0.9
    assert P.pack_documents(make_docs(ODD).where("false"), TOK).count() == 0


def test_filled_windows(make_docs):
    docs = [(i, "one two three " * (i + 1)) for i in range(60)]
    pieces = P.cut_pieces(make_docs(docs), TOK, keep_ids=True)
    out = P.fill_windows(P.pack(pieces)).collect()
    assert all(len(r.ids) == 2048 for r in out)
    assert sum(r.n_tokens for r in out) == sum(r.length for r in pieces.collect())


@pytest.mark.parametrize("run", [" ", "\n", "\t", "\r\n", " \n\t ", "\x0b\x0c", "　"], ids=repr)
def test_long_white_space_packs(run):
    """Runs that the fast path's pattern engine refuses have the ids of the
    file's own library."""
    from tokenizers import Tokenizer
    text = "start" + run * (2_000_000 // len(run)) + "end"
    own = Tokenizer.from_file(TOK).encode(text, add_special_tokens=False).ids
    assert P.ByteBpe(TOK).ids(text).tolist() == own


def test_query_survives_long_white_space(make_docs):
    docs = [(1, " " * 2_000_000), (2, "\n" * 1_000_000 + "x"), (3, "plain")]
    out = P.pack_documents(make_docs(docs), TOK).toPandas()
    assert out.groupby("doc_id")["length"].sum().tolist() == out.groupby("doc_id")["doc_tokens"].max().tolist()
    assert set(out["doc_id"]) == {1, 2, 3} and len(out) > 3


def test_repeated_benchmark_rows_are_one(spark, make_docs):
    bench = spark.createDataFrame([("a", "one two three four")] * 5000 + [("b", "x y")], "item_id string, text string")
    blocks = list(D._blocks(bench, "item_id", "text", 1 << 20))
    assert [sorted(b) for b in blocks] == [[("a", "one two three four"), ("b", "x y")]]
    out = D.digest(D.find_contamination(make_docs([(1, "one two three four five"), (2, "y x")]), bench))
    assert {r.doc_id: (r.n_hit, r.n_items) for r in out.collect()} == {1: (4, 1), 2: (0, 0)}
