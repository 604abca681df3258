"""op11: every maximal repetition of words, against a lag-by-lag search."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from logvigil.llm.periodic_runs import brute_force, digest, find_runs, plant, word_runs


def runs_of(words):
    got = find_runs(np.array(words, np.int64), np.array([0, len(words)], np.int64))
    return [tuple(r[1:]) for r in got.tolist()]


def random_words(rng):
    n, v = rng.randrange(0, 130), rng.choice([1, 2, 3, 6])
    words = []
    while len(words) < n:
        words += [rng.randrange(v) for _ in range(rng.randrange(1, 30))] * rng.randrange(1, 5)
        if rng.random() < 0.3:
            words.append(rng.randrange(50))
    return words


def test_equals_brute_force():
    rng = random.Random(7)
    for _ in range(600):
        words = random_words(rng)
        assert runs_of(words) == brute_force(words)


def test_documents_do_not_meet():
    rng = random.Random(8)
    docs = [random_words(rng) for _ in range(60)] + [[], [1] * 20, [1] * 20]
    bounds = np.cumsum([0, *map(len, docs)])
    got = find_runs(np.array([w for d in docs for w in d], np.int64), bounds)
    for i, d in enumerate(docs):
        assert [tuple(r[1:]) for r in got[got[:, 0] == i].tolist()] == brute_force(d)


@pytest.mark.parametrize("length", [2, 5, 9, 13, 20])
def test_other_shortest_lengths(length):
    rng = random.Random(length)
    for _ in range(80):
        words = random_words(rng)
        got = find_runs(np.array(words, np.int64), np.array([0, len(words)]), length)
        assert [tuple(r[1:]) for r in got.tolist()] == brute_force(words, length)


def test_repetitive_long_text_stays_near_linear():
    started = time.time()
    assert runs_of([1] * 300_000) == [(0, 300_000, 1)]
    unit = list(range(997))
    assert runs_of(unit * 300) == [(0, 997 * 300, 997)]
    mixed = runs_of(([0] * 100 + [1]) * 1000)  # one long run and 1000 of a single word
    assert len(mixed) == 1001 and (0, 101_000, 101) in mixed
    assert time.time() - started < 60


def expected(key, text):
    words = plant((text or "").encode().split(), key)
    runs = brute_force(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (len(words), len(runs), *(best or (None,) * 3),
            1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_operator_and_odd_rows(make_docs):
    planted = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0]
    assert len(planted) > 20
    rng = random.Random(3)
    texts = {k: " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 90))) for k in planted}
    rows = [*texts.items(), (1, None), (2, ""), (3, " \t\n"), (None, "a b " * 10), (None, None),
            (5, "é ñ\x0bé ñ\x0c" * 8), (6, "x " * 40), (6, "x " * 40), (7, "a b " * 15),
            (8, "tail " + "one two three " * 9 + "one two"), (9, "q " * 11), (10, "q " * 12),
            (planted[0], ""), (planted[1], None), (11, "long " * 50_000)]
    got = digest(word_runs(make_docs(rows), planted=True)).collect()
    assert len(got) == len(rows)
    want = sorted((k, *expected(k, t)) if k != 11 else (11,) for k, t in rows if k is not None)
    assert sorted(tuple(r) if r[0] != 11 else (11,) for r in got if r[0] is not None) == want
    assert [tuple(r)[1:7] for r in got if r[0] == 11] == [(50_000, 1, 0, 50_000, 1, 50_000_000)]
    assert sorted(tuple(r)[1:] for r in got if r[0] is None) == sorted(
        expected(None, t) for t in ("a b " * 10, None))


def test_real_output_and_empty_table(make_docs):
    found = word_runs(make_docs([(8, "so " + "one two three " * 5 + "end")])).first()
    assert found["collapsed"] == "so one two three end"
    assert [r.asDict() for r in found["runs"]] == [{"start": 1, "length": 15, "period": 3}]
    assert digest(word_runs(make_docs([(1, "a")]).limit(0))).count() == 0
