"""op13: sum-of-squares packing, its tokenizer shortcut and whole round trips."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from logvigil.llm.best_fit import (END_ID, WordIds, cut_pieces, pack, pack_documents, pack_lengths,
                                   sum_of_squares)
from logvigil.llm.packing import fill_windows
from logvigil.llm.textkit import durable

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def own():
    return Tokenizer.from_file(PATH)


def test_chunks_have_the_ids_of_whole_texts(own, real_docs):
    kept = WordIds(PATH)
    alphabet = ["\x0b", "\x0c", "\x1c", "\x85", " ", " ", "　", " ", "\n", "\t", "\r", "a", "B",
                "'s", "'S", "́", "é", "Σ", "ς", "İ", "1", "²", "<|endoftext|>", "<|ENDOFTEXT|>", "日",
                "​", "ß", "!", "…", "'", "ll", "'ll", "ι", "한", "\x00"]
    rng = random.Random(5)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 15))) for _ in range(3000)]
    for t in texts + [r["text"] for r in real_docs.collect() if r["text"]]:
        assert np.frombuffer(kept.ids(t), "<u4").tolist() == own.encode(t, add_special_tokens=False).ids


def test_plain_way_and_bounded_cache(own, real_docs, monkeypatch):
    import logvigil.llm.best_fit as B
    monkeypatch.setattr(B, "PARTS_KEPT", 500)
    kept = B.WordIds(PATH)
    assert kept.plain
    every = "".join(map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x180)]))
    rng = random.Random(6)
    words = [c + "x" for c in every] + ["".join(rng.choice(every) for _ in range(rng.randrange(1, 12)))
                                        for _ in range(20_000)]
    for w in [*words, " ".join(words), "\t\n".join(words[:999]) + "\u3000" + "\r\x0b\x0c".join(words)]:
        assert np.frombuffer(kept.ids(w), "<u4").tolist() == own.encode(w, add_special_tokens=False).ids, w
    assert len(kept) <= 500 and len(kept.old) <= 500 and len(kept.other) <= 500


def plain_sum_of_squares(lengths, window):
    """The rule, tried out bin kind by bin kind."""
    levels, squares = [], lambda ls: sum(c * c for c in np.bincount([x for x in ls if x < window]).tolist())
    for a in lengths:
        options = [(squares(levels[:i] + levels[i + 1:] + [x + a]), -x, i)
                   for i, x in enumerate(levels) if x + a <= window]
        options.append((squares([*levels, a]), 0, None))
        _, _, i = min(options, key=lambda o: (o[0], o[1]))
        if i is None:
            levels.append(a)
        else:
            levels[i] += a
    return sorted(levels)


def test_each_piece_goes_where_the_squares_become_smallest():
    rng = random.Random(2)
    for _ in range(60):
        window = rng.randrange(4, 40)
        lengths = [rng.randrange(1, window + 1) for _ in range(rng.randrange(0, 60))]
        bins = sum_of_squares(lengths, window)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert sorted(sum(lengths[i] for i in b) for b in bins) == plain_sum_of_squares(lengths, window)


def test_bins_near_the_lower_bound():
    rng = np.random.default_rng(1)
    lengths = np.r_[rng.integers(1, 2048, 6000), rng.integers(1, 300, 6000)]
    bins, n_full = pack_lengths(lengths, 2048)
    sizes = [lengths[b].sum() for b in bins]
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert max(sizes) <= 2048 and all(s == 2048 for s in sizes[:n_full])
    assert len(bins) <= -(-lengths.sum() // 2048) + 2


def check(docs, rows, own, slack):
    """Every id once, offsets gapless, sequences within 2048 and few."""
    ids = {k: (own.encode(t or "", add_special_tokens=False).ids + [END_ID]) for k, t in docs}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for k, got in by_doc.items():
        got.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in got] == list(range(-(-len(ids[k]) // 2048)))
        for r in got:
            part = ids[k][2048 * r["piece"]:2048 * (r["piece"] + 1)]
            assert (r["start"], r["length"]) == (2048 * r["piece"], len(part))
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    for got in by_seq.values():
        at = 0
        for r in sorted(got, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    least = -(-sum(map(len, ids.values())) // 2048)
    assert len(by_seq) <= least + slack


def test_real_documents(own, real_docs):
    docs = [(r["doc_id"], r["text"]) for r in real_docs.collect()]
    check(docs, pack_documents(real_docs, PATH).collect(), own, 2)


def test_many_buckets_and_rounds(own, real_docs):
    docs = [(r["doc_id"], r["text"]) for r in real_docs.collect()]
    check(docs, pack_documents(real_docs, PATH, rows_per_bucket=20).collect(), own, 14)


def test_odd_rows(own, make_docs):
    docs = [(1, None), (2, ""), (3, " \n\t\x0b"), (4, "word " * 2047), (5, "word " * 2048), (6, "x" * 300_000),
            (7, "a <|endoftext|> b<|startoftext|>"), (8, " " * 2_000_000), (9, "\n" * 2_000_000 + "end"),
            (10, "one two three")]
    check(docs, pack_documents(make_docs(docs), PATH).collect(), own, 2)


def test_repeated_and_null_keys(make_docs):
    rows = pack_documents(make_docs([(1, "same text")] * 5 + [(None, "no key"), (None, None)]), PATH).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows) == [(0, 1), (0, 3), *[(1, 3)] * 5]
    assert len({r["sequence_id"] for r in rows}) == 1 and len({r["offset"] for r in rows}) == 7


def test_lengths_that_do_not_combine(spark, make_docs):
    docs = make_docs([(i, "word " * 1199) for i in range(90)])
    rows = pack_documents(docs, PATH, rows_per_bucket=20).collect()
    assert len({r["sequence_id"] for r in rows}) == 90


def test_real_output_and_empty_table(own, make_docs):
    docs = make_docs([(1, "Some words here"), (2, "more")])
    pieces = durable(cut_pieces(docs, PATH, keep_ids=True))
    window = fill_windows(pack(pieces)).collect()
    assert len(window) == 1 and window[0]["n_tokens"] == 6 and len(window[0]["ids"]) == 2048
    want = [own.encode(t, add_special_tokens=False).ids + [END_ID] for t in ("Some words here", "more")]
    assert window[0]["ids"][:6] in (want[0] + want[1], want[1] + want[0])
    assert pack_documents(docs.limit(0), PATH).count() == 0
