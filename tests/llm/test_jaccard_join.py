"""The grouped prefix join and its components against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from logvigil.llm import jaccard_join as J
from logvigil.llm.graph import components


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def near_copies(seed=4, families=6, size=14):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)]
    passage = rng.choices(vocab, k=25)
    docs, k = [], 0
    for _ in range(families):
        base = rng.choices(vocab, k=rng.randrange(30, 120)) + passage
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocab + ["W%d" % rng.randrange(9)])
            docs.append((k, " ".join(w).upper() if rng.random() < 0.2 else "\n".join(w)))
            k += 1
    docs += [(k + i, " ".join(rng.choices(vocab, k=rng.randrange(1, 60)) + passage))
             for i in range(30)]
    docs += [(900, None), (901, ""), (902, " \t"), (903, "one two"), (904, "One  TWO"),
             (905, "one two three"), (906, "one"), (5, docs[5][1]), (5, docs[9][1]),
             (None, "one two"), (None, "no id here at all"), (907, "ab " * 5000)]
    return docs


@pytest.mark.parametrize("seed", [4, 11])
def test_brute_force(make_docs, seed):
    docs = near_copies(seed)
    assert rows(J.jaccard_components(make_docs(docs))) == sorted(J.brute_force(docs), key=repr)


def test_real_rows(real_docs):
    docs = [tuple(r) for r in real_docs.select("doc_id", "text").collect()]
    assert rows(J.jaccard_components(real_docs)) == sorted(J.brute_force(docs), key=repr)


def test_other_widths_and_empty(make_docs):
    docs = near_copies(6, 2, 6)
    got = J.jaccard_components(make_docs(docs), width=5, percent=80)
    assert rows(got) == sorted(J.brute_force(docs, 5, 80), key=repr)
    assert J.jaccard_components(make_docs(docs).where("false")).count() == 0


def test_components_of_a_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(40)]
    hub = [(100, 101 + i) for i in range(30)]
    out = dict(map(tuple, components(spark.createDataFrame(path + hub, "a long, b long")).collect()))
    assert {out[i] for i in range(41)} == {0} and {out[100 + i] for i in range(31)} == {100}


def shuffled_bytes(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    found = (files.apply(i) for i in range(files.size()))
    return sum(f.length() for f in found if f.getName().startswith("shuffle_"))


def test_keep_one_shuffles_less_than_the_texts(spark):
    rng = random.Random(11)
    docs = [(i, " ".join(f"{rng.getrandbits(48):012x}" for _ in range(15000))) for i in range(40)]
    docs += [(100, docs[7][1] + " x"), (3, docs[3][1]), (None, docs[5][1]), (50, " \n"), (50, " \n"), (51, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    before = shuffled_bytes(spark)
    left = J.keep_one(df).select("doc_id").collect()
    took = shuffled_bytes(spark) - before
    assert sorted(r[0] for r in left) == [*range(40), 50, 50, 51]
    assert took < sum(len(t or "") for _, t in docs)


def test_held_tokens_by_counting(spark):
    rng = random.Random(12)
    docs = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    docs += [d + " z" for d in docs[:20]] + docs[:5]
    src = spark.createDataFrame([(d,) for d in docs], "text string").repartition(4)
    counts = np.zeros(J.SKETCH, np.uint32)
    sketch = spark.sparkContext.broadcast(counts.tobytes())
    held = {}
    batch = pa.RecordBatch.from_pydict({"text": docs})
    token, c, g, n, pos, _, last = J._elements([*J.shingle_sets(batch, 2)], 80, counts)
    g[last] = c[last]
    for t, m, a, p in zip(token.tolist(), g.tolist(), n.tolist(), pos.tolist()):
        held.setdefault(t, {})[m] = (a, p)

    def fits(x, y):
        need = ((x[0] + y[0]) * 80 + 179) // 180
        return min(x[0], y[0]) * 100 >= max(x[0], y[0]) * 80 and all(p < a - need + J.COMMON for a, p in (x, y))

    want = {t for t, m in held.items() if len(m) > 2 or (len(m) == 2 and fits(*m.values()))}
    for buckets in (1, 5):
        got = [r[0] for r in J._held_tokens(src, 2, 80, sketch, buckets).collect()]
        assert len(got) == len(set(got)) and set(got) == want
