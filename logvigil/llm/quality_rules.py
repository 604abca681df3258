"""Document quality: plain text counts, base rules, and a hashed word and
character n-gram logistic regression with calibrated probabilities.

The model is fitted on a bounded sample of labelled rows: at most
``sample_rows`` different ones, half of each label, drawn by a hash of key and
text, texts beyond ``SAMPLE_TEXT_BYTES`` only where a label has too few others
(then their beginnings are learned from).  Sample weights restore the labels' real
shares when the probabilities are calibrated (Platt scaling on a held-out
fifth).  Every document is scored in Arrow batches against a fixed threshold.

Defined results: a null text has no words; a text without words fails the base
rules; without labels of both kinds the base rules alone decide; labels that
are null or of unknown keys are left out; a key with several labels or texts
counts once per pair; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvigil.llm.language_id import SAMPLE_TEXT_BYTES, balanced_sample
from logvigil.llm.linear import (SLOT_BITS, Ftrl, family_means, platt, sparse_texts,
                                 word_and_char_families)
from logvigil.llm.textkit import (SPACE_WORDS, byte_class, covered, doc_of, mix, per_doc, slices,
                                  span_hashes, windows, word_spans)

SYMBOLS = byte_class(b"#*$%&|<>")
SAMPLE_ROWS = 4000
EPOCHS = 3
SCALE = 20.0
THRESHOLD = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def text_counts(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each document in a slice."""
    docs = len(off) - 1
    s, e, firsts = word_spans(buf, off, SPACE_WORDS)
    h = span_hashes(buf, s, e)
    doc = doc_of(firsts)
    points = np.concatenate([[0], np.cumsum(((buf & 0xC0) != 0x80) & SPACE_WORDS[buf])])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[buf])])
    # words inside three-word windows that the document has twice
    grams, at = windows(h, firsts, 3)
    key = mix(grams ^ (doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k), bool)
    if len(k):
        twin = k[1:] == k[:-1]
        same[1:] |= twin
        same[:-1] |= twin
    hit = covered(at[order[same]], 3, len(h))
    # lines with a word that equal an earlier one of the document
    brk = np.flatnonzero(buf == 10)
    line_start = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], brk + 1]))
    line_start = line_start[line_start < len(buf)]
    line_doc = np.searchsorted(off, line_start, "right") - 1
    nxt = np.append(brk, len(buf))
    line_end = np.minimum(nxt[np.searchsorted(nxt, line_start)], off[line_doc + 1])
    worded = np.searchsorted(s, line_end) > np.searchsorted(s, line_start)
    ls, le, ld = line_start[worded], line_end[worded], line_doc[worded]
    lh = mix(span_hashes(buf, ls, le) ^ (ld.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    _, first_seen = np.unique(lh, return_index=True)
    dup = np.ones(len(lh), bool)
    dup[first_seen] = False
    return {"n_words": np.diff(firsts), "word_chars": points[off[1:]] - points[off[:-1]],
            "n_symbols": symbols[off[1:]] - symbols[off[:-1]],
            "n_dup_lines": np.bincount(ld[dup], minlength=docs),
            "n_repeat_words": per_doc(hit, firsts)}


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
        quality: str = "quality", sample_rows: int = SAMPLE_ROWS) -> dict | None:
    lab = labels.select(F.col(key).alias("k"), F.col(quality).cast("int").alias("y")) \
        .where("k is not null and y in (0, 1)").distinct()
    # keys first (with a text that tells them apart), then the texts of the drawn keys
    keys, there = balanced_sample(lab.withColumn("text", F.lit("")), "y", sample_rows)
    if len(there) < 2:
        return None
    want = docs.sparkSession.createDataFrame([(r["k"], r["y"]) for r in keys], "k long, y int")
    rows, _ = balanced_sample(
        docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("text"))
        .where("text is not null").join(F.broadcast(want), "k"), "y", sample_rows)
    rows.sort(key=lambda r: (r["k"], r["y"], r["text"]))
    y = np.array([r["y"] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    x = sparse_texts([r["text"] for r in rows], word_and_char_families)
    del rows
    rng = np.random.default_rng(11)
    order = rng.permutation(len(x))
    held, train = order[:len(order) // 5], order[len(order) // 5:]
    model = Ftrl(1 << SLOT_BITS, 2, l1=0.0005, l2=0.0005)
    for _ in range(EPOCHS):
        for d in rng.permutation(train):
            model.update(x[d][0], x[d][1] * SCALE, int(y[d]))
    w = model.weights()
    table = (w[:, 1] - w[:, 0]) * SCALE
    z = np.array([v @ table[at] for at, v in (x[d] for d in held)])
    share = {c: there[c] / max(1, int((y[held] == c).sum())) for c in (0, 1)}
    weight = np.array([share[int(c)] for c in y[held]])
    a, b = platt(z, y[held], weight * len(held) / weight.sum()) if len(held) > 20 else (1.0, 0.0)
    return {"table": table.astype(np.float32), "a": a, "b": b}


def judge(df: DataFrame, model: dict | None, key: str = "doc_id", text: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """Per document: key, the counts, base_failed, quality (the calibrated
    probability of a good text; null without a model), kept."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    src = df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b, buf, off in slices(batch):
                c = text_counts(buf, off)
                bad = (c["n_words"] < MIN_WORDS) | (
                    100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
                good, quality = ~bad, pa.nulls(b - a, pa.float64())
                if m is not None:
                    z = family_means(word_and_char_families(buf, off), m["table"])
                    p = np.round(1 / (1 + np.exp(-np.clip(m["a"] * z + m["b"], -30, 30))), 6)
                    good, quality = good & (p >= threshold), pa.array(p)
                yield pa.RecordBatch.from_pydict({
                    "k": batch.column("k").slice(a, b - a),
                    **{n: pa.array(v.astype(np.int64)) for n, v in c.items()},
                    "base_failed": pa.array(bad), "kept": pa.array(good), "quality": quality})

    return src.mapInArrow(score, "k long, n_words long, word_chars long, n_symbols long, "
                                 "n_dup_lines long, n_repeat_words long, base_failed boolean, "
                                 "kept boolean, quality double").withColumnRenamed("k", key)


def brute_counts(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed) in plain Python (for tests)."""
    import re
    t = text or ""
    word = re.compile("[^\x20\x09-\x0D]+")
    w = word.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if word.search(line):
            dup += line in seen
            seen.add(line)
    where: dict[tuple, list[int]] = {}
    for i in range(len(w) - 2):
        where.setdefault(tuple(w[i:i + 3]), []).append(i)
    hit = {j for v in where.values() if len(v) > 1 for i in v for j in range(i, i + 3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit),
            len(w) < MIN_WORDS or 100 * len(hit) > MAX_REPEAT_PERCENT * len(w))
