"""Language identification: sparse multinomial logistic regression on TF-IDF
character 1- to 3-grams, trained by follow-the-regularised-leader with an
elastic net, then temperature-scaled.

The model is fitted on a bounded sample of labelled rows: at most
``sample_rows`` different ones, evenly over the languages, drawn by a hash of key
and text, texts beyond ``SAMPLE_TEXT_BYTES`` only where a language has too few
others (then their beginnings are learned from).  Every document's whole text is
scored.  A feature's value is its relative count times
its inverse document frequency in the sample.

Defined results: a null text or one without a letter is ``und`` with score 0;
without labelled rows every document is; repeated rows are judged alike; a null
key is never learned from and not held out; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logvigil.llm.linear import (SLOT_BITS, Ftrl, char_families, code_points, family_means, softmax,
                                 sparse_texts, temperature)
from logvigil.llm.textkit import slices

UNKNOWN = "und"
SAMPLE_ROWS = 2400
SAMPLE_TEXT_BYTES = 1 << 16
EPOCHS = 3
SCALE = 30.0


def in_fold(key: str, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the key as text leaves ``fold`` modulo ``folds``."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def balanced_sample(rows: DataFrame, label: str, most: int, key: str = "k",
                    text: str = "text") -> tuple[list, dict]:
    """(rows drawn, rows there are by label): at most ``most`` different rows in
    all, the same number of each label, those of the smallest hash of key and
    text; texts of more than ``SAMPLE_TEXT_BYTES`` come last, and only their
    beginnings are learned from.

    Equal rows are one, so a repeated row is drawn once however often it is
    there, and hashes are drawn before any text is."""
    there = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # one row per label
    if not there:
        return [], {}
    per = -(-most // len(there))
    d = rows.select(F.col(label), F.col(key), F.col(text), (F.octet_length(text) > SAMPLE_TEXT_BYTES).alias("_long"),
                    F.xxhash64(key, text, F.lit("draw")).alias("_u"))
    lowest = Window.partitionBy(label).orderBy("_long", "_u")
    share = F.create_map(*[F.lit(x) for v, n in there.items() for x in (v, min(1.0, 4.0 * per / n))])
    part = F.pmod(F.col("_u"), F.lit(1 << 30)) / float(1 << 30)
    for few in (d.where(part < share[F.col(label)]), d):  # the same draw, from fewer rows if those suffice
        few = few.withColumn("_u", F.struct(part.alias("p"), F.col("_u").alias("u")))
        ids = few.select(label, "_long", "_u").distinct() \
            .withColumn("_i", F.row_number().over(lowest)).where(F.col("_i") <= per).collect()
        got = Counter(r[label] for r in ids if not r["_long"])
        if all(got[v] >= per for v in there):
            break
    drawn = d.where(F.col("_u").isin([r["_u"]["u"] for r in ids])).groupBy(label, "_u").agg(
        F.first(key).alias(key), F.first(F.substring(text, 1, SAMPLE_TEXT_BYTES)).alias(text))
    return drawn.collect(), there


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
        sample_rows: int = SAMPLE_ROWS) -> dict | None:
    """A model of labelled rows (null labels and texts are left out)."""
    rows = labelled.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"),
                           F.col(lang).cast("string").alias("lang")) \
        .where("k is not null and text is not null and lang is not null")
    drawn, there = balanced_sample(rows, "lang", sample_rows)
    drawn.sort(key=lambda r: (r["k"], r["text"]))
    langs = sorted(there)
    if not drawn:
        return None
    docs = sparse_texts([r["text"] for r in drawn], char_families)
    y = np.array([langs.index(r["lang"]) for r in drawn])
    rng = np.random.default_rng(7)
    order = rng.permutation(len(docs))
    held, train = order[:len(order) // 5], order[len(order) // 5:]
    df = np.zeros(1 << SLOT_BITS)
    for d in train:
        df[docs[d][0]] += 1
    idf = np.log((1 + len(train)) / (1 + df)) + 0.1
    model = Ftrl(1 << SLOT_BITS, len(langs))
    for _ in range(EPOCHS):
        for d in rng.permutation(train):
            at, x = docs[d]
            model.update(at, x * idf[at] * SCALE, y[d])
    w = model.weights() * (idf * SCALE)[:, None]
    logits = np.array([x @ w[at] for at, x in (docs[d] for d in held)]).reshape(-1, len(langs))
    return {"langs": langs, "table": w.T.astype(np.float32).copy(),
            "temperature": temperature(logits, y[held])}


def _has_letter(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    cps, at = code_points(buf, off)
    ascii_letter = np.concatenate([[0], np.cumsum((cps >= 97) & (cps <= 122))])
    out = ascii_letter[at[1:]] > ascii_letter[at[:-1]]
    for d in np.flatnonzero(~out):
        out[d] = any(chr(c).isalpha() for c in np.unique(cps[at[d]:at[d + 1]]).tolist())
    return out


def identify(df: DataFrame, model: dict | None, text: str = "text", keep: tuple[str, ...] = (),
             lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Columns ``keep`` (read as they are), the predicted language and the
    calibrated probability of it.  Only ``text`` enters the prediction."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    src = df.select(*keep, F.col(text).cast("string").alias("_id_text"))
    names = [f for f in src.schema.fields if f.name != "_id_text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b, buf, off in slices(batch, "_id_text"):
                lang, best = np.full(b - a, UNKNOWN, object), np.zeros(b - a)
                if m is not None:
                    fam = char_families(buf, off)
                    z = np.stack([family_means(fam, t) for t in m["table"]], axis=1)
                    p = softmax(z / m["temperature"])
                    known = _has_letter(buf, off)
                    top = p.argmax(axis=1)
                    lang[known] = np.array(m["langs"], object)[top[known]]
                    best[known] = np.round(p[np.arange(b - a), top], 6)[known]
                cols = {f.name: batch.column(f.name).slice(a, b - a) for f in names}
                cols[lang_col] = pa.array(lang.tolist(), pa.string())
                cols[score_col] = pa.array(best, pa.float64())
                yield pa.RecordBatch.from_pydict(cols)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in names),
                        f"`{lang_col}` string", f"`{score_col}` double"])
    return src.mapInArrow(score, schema)


def fit_predict(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
                keep: tuple[str, ...] = ()) -> DataFrame:
    """Fit on the rows outside the held-out fold, predict every row."""
    model = fit(df.where(~in_fold(key)), key, text, lang)
    return identify(df, model, text, keep=keep or (key,))
