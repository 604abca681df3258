"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The symbols are words (64-bit hashes of their lower-cased bytes).  Patterns are
all windows of ``width`` consecutive item words; an item of fewer words is one
shorter pattern.  For each pattern length m there is one searcher:

* SHIFT[hash of a block of B words]: how far the search may jump when the block
  ends at the current word without missing a pattern; m - B + 1 where no
  pattern holds the block,
* patterns in buckets by the hash of their last block (suffix), looked up where
  the shift is 0,
* direct comparison: the words' hashes, then the bytes themselves.

The documents of a slice are cut into lanes that advance together in numpy.
Patterns are broadcast in blocks of at most ``block_bytes`` of item text; with
more benchmark text, each block scans the documents in turn and the found
spans are united per document.

Defined results: a null text has no words; an item with a null id is ignored;
repeated rows are judged one by one; items of one id are one item; an empty
benchmark contaminates nothing.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvigil.llm.textkit import (byte_class, covered, doc_of, per_doc, ranges, slices,
                                  span_hashes, word_spans)

#: words: anything but ASCII other than 0-9 A-Z a-z
WORD_BYTES = byte_class(bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B))
                        + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))
WIDTH = 10
BLOCK_BYTES = 8 << 20
SHIFT_BITS = 18
LANE = 512


def fold_ascii(raw: bytes) -> bytes:
    return raw.lower()  # bytes.lower changes A-Z only


def words_of(text: str) -> list[bytes]:
    buf = np.frombuffer((text or "").encode(), np.uint8)
    s, e, _ = word_spans(buf, np.array([0, len(buf)]), WORD_BYTES)
    raw = fold_ascii(buf.tobytes())
    return [raw[i:j] for i, j in zip(s.tolist(), e.tolist())]


def _block_hash(h: np.ndarray, at: np.ndarray, b: int) -> np.ndarray:
    """Hash of the b words that end at each position."""
    x = h[at]
    if b == 2:
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[at - 1]
    return x ^ (x >> np.uint64(29))


class Searcher:
    """Wu-Manber tables of the patterns of one length."""

    def __init__(self, patterns: dict[bytes, int], m: int):
        """patterns: words joined by spaces -> pattern number."""
        self.m, self.b = m, min(2, m)
        texts = list(patterns)
        raw = np.frombuffer(b" ".join(texts), np.uint8)
        s, e, _ = word_spans(raw, np.array([0, len(raw)]), WORD_BYTES)
        self.words = span_hashes(raw, s, e, fold=True).reshape(len(texts), m)
        flat = self.words.reshape(-1)
        default = m - self.b + 1
        self.shift = np.full(1 << SHIFT_BITS, default, np.int32)
        row = np.arange(len(texts)) * m
        for end in range(self.b - 1, m):  # the last block's shift is 0
            slot = self._slot(_block_hash(flat, row + end, self.b))
            np.minimum.at(self.shift, slot, m - 1 - end)
        suffix = _block_hash(flat, row + m - 1, self.b)
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.order = suffix[order], order
        self.texts = [texts[i] for i in order]
        self.words = self.words[order]
        self.ids = np.array([patterns[t] for t in self.texts])

    @staticmethod
    def _slot(x: np.ndarray) -> np.ndarray:
        return (x >> np.uint64(64 - SHIFT_BITS)).astype(np.int64)

    def find(self, h: np.ndarray, firsts: np.ndarray, text_at) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern number) of every occurrence.  ``text_at(i, j)``
        gives words i .. j - 1 joined by spaces."""
        m, n = self.m, len(h)
        none = np.zeros(0, np.int64)
        if n < m:
            return none, none
        lanes = np.arange(m - 1, n, LANE)
        pos, stop = lanes.copy(), np.minimum(lanes + LANE, n)
        hits = []
        while len(pos):
            block = _block_hash(h, pos, self.b)
            jump = self.shift[self._slot(block)]
            zero = jump == 0
            if zero.any():
                hits.append(pos[zero])
            pos = pos + np.maximum(jump, 1)
            live = pos < stop
            pos, stop = pos[live], stop[live]
        if not hits:
            return none, none
        end = np.concatenate(hits)
        block = _block_hash(h, end, self.b)
        lo = np.searchsorted(self.suffix, block, "left")
        count = np.searchsorted(self.suffix, block, "right") - lo
        pat = ranges(lo, count)
        first = np.repeat(end, count) - (m - 1)
        same = np.ones(len(pat), bool)
        for i in range(m):
            same[same] = h[first[same] + i] == self.words[pat[same], i]
        pat, first = pat[same], first[same]
        if not len(pat):
            return none, none
        doc = doc_of(firsts)
        inside = doc[first] == doc[first + m - 1]
        pat, first = pat[inside], first[inside]
        real = [text_at(i, i + m) == self.texts[p] for i, p in zip(first.tolist(), pat.tolist())]
        real = np.array(real, bool)
        return first[real], self.ids[pat[real]]


def build_searchers(items: list[tuple[str, str]], width: int):
    """(searchers, item ids of each pattern number)."""
    by_len: dict[int, dict[bytes, int]] = defaultdict(dict)
    owners: list[set[str]] = []
    for item, text in items:
        w = words_of(text)
        m = min(width, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            key = b" ".join(w[i:i + m])
            num = by_len[m].setdefault(key, len(owners))
            if num == len(owners):
                owners.append(set())
            owners[num].add(item)
    return [Searcher(p, m) for m, p in sorted(by_len.items())], owners


def _scan(docs: DataFrame, items: list[tuple[str, str]], width: int) -> DataFrame:
    """Per row of docs (k, text): k, th, n_words, hit spans and item ids."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers, owners = build_searchers(shared.value, width)
        for batch in batches:
            for a, b, buf, off in slices(batch):
                s, e, firsts = word_spans(buf, off, WORD_BYTES)
                h = span_hashes(buf, s, e, fold=True)
                doc = doc_of(firsts)

                def text_at(i, j, buf=buf, s=s, e=e):
                    return b" ".join(fold_ascii(buf[s[x]:e[x]].tobytes()) for x in range(i, j))

                found = [set() for _ in range(b - a)]
                hit = np.zeros(len(h), bool)
                for sr in searchers:
                    first, pats = sr.find(h, firsts, text_at)
                    if len(first):
                        hit |= covered(first, sr.m, len(h))
                        pair = np.unique(np.stack([doc[first], pats]), axis=1)
                        for d, p in pair.T.tolist():
                            found[d] |= owners[p]
                edge = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]
                                                             & (doc[1:] == doc[:-1])]))
                last = np.flatnonzero(hit & ~np.concatenate([hit[1:] & (doc[1:] == doc[:-1]),
                                                             [False]])) + 1
                spans = [[] for _ in range(b - a)]
                for d, i, j in zip(doc[edge].tolist(), edge.tolist(), last.tolist()):
                    spans[d] += [i - int(firsts[d]), j - int(firsts[d])]
                yield pa.RecordBatch.from_pydict({
                    "k": batch.column("k").slice(a, b - a),
                    "th": batch.column("th").slice(a, b - a),
                    "n_words": pa.array(np.diff(firsts), pa.int64()),
                    "n_hit": pa.array(per_doc(hit, firsts), pa.int64()),
                    "spans": pa.array(spans, pa.list_(pa.int64())),
                    "items": pa.array([sorted(x) for x in found], pa.list_(pa.string()))})

    src = docs.withColumn("th", F.xxhash64("text"))
    return src.mapInArrow(scan, "k long, th long, n_words long, n_hit long, "
                                "spans array<long>, items array<string>")


def find_contamination(df: DataFrame, benchmark: DataFrame, key: str = "doc_id",
                       text: str = "text", item: str = "item_id", item_text: str = "text",
                       width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: key, n_words, n_hit, spans (first word, end word,
    ... of the hit runs), items (ids with an occurring window, sorted)."""
    docs = df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("text"))
    parts = [_scan(docs, items, width) for items in
             _blocks(benchmark, item, item_text, block_bytes)]
    if len(parts) == 1:
        return parts[0].drop("th").withColumnRenamed("k", key)
    return _unite(parts).withColumnRenamed("k", key)


def _blocks(benchmark: DataFrame, item: str, item_text: str, block_bytes: int):
    """The benchmark's (id, text) rows, in lists of about block_bytes of text;
    each is collected alone."""
    bench = benchmark.select(F.col(item).cast("string").alias("item"),
                             F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("t")) \
        .where(F.col("item").isNotNull()).distinct()  # a repeated row is one item
    size = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    for i in range(blocks):
        part = bench if blocks == 1 else bench.where(
            F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == i)
        yield [(r[0], r[1]) for r in part.toLocalIterator()]


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                      item_text: str = "text", width: int = WIDTH,
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of df (all columns) in which no window occurs: one pass over
    the documents for each block, without a shuffle."""
    spark = df.sparkSession
    out = df.withColumn("_words", F.col(text).cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    for items in _blocks(benchmark, item, item_text, block_bytes):
        shared = spark.sparkContext.broadcast(items)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searchers, _ = build_searchers(shared.value, width)
            for batch in batches:
                for a, b, buf, off in slices(batch, "_words"):
                    s, e, firsts = word_spans(buf, off, WORD_BYTES)
                    h = span_hashes(buf, s, e, fold=True)
                    doc = doc_of(firsts)

                    def text_at(i, j, buf=buf, s=s, e=e):
                        return b" ".join(fold_ascii(buf[s[x]:e[x]].tobytes()) for x in range(i, j))

                    ok = np.ones(b - a, bool)
                    for sr in searchers:
                        first, _ = sr.find(h, firsts, text_at)
                        ok[doc[first]] = False
                    yield batch.slice(a, b - a).filter(pa.array(ok))

        out = out.mapInArrow(clean, schema)
    return out.drop("_words")


def _unite(parts: list[DataFrame]) -> DataFrame:
    """Unite the blocks' spans and items of each document.  Repeated rows find
    the same in every block; they are counted and given back."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)

    def merge(pdf):
        import pandas as pd
        cuts = sorted({(int(s[i]), int(s[i + 1])) for s in pdf["spans"] for i in range(0, len(s), 2)})
        runs: list[list[int]] = []
        for i, j in cuts:
            if runs and i <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], j)
            else:
                runs.append([i, j])
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "n_words": [pdf["n_words"].iloc[0]],
                             "n_hit": [sum(j - i for i, j in runs)],
                             "spans": [[x for r in runs for x in r]],
                             "items": [sorted({x for y in pdf["items"] for x in y})],
                             "copies": [pdf["copies"].iloc[0]]})

    own = every.groupBy("k", "th", "n_words", "spans", "items").agg(
        F.count(F.lit(1)).alias("same"))
    rows = parts[0].groupBy("k", "th").agg(F.count(F.lit(1)).alias("copies"))
    # null keys join too
    joined = own.join(rows, own.k.eqNullSafe(rows.k) & (own.th == rows.th)) \
        .select(own.k, own.th, "n_words", "spans", "items", "copies")
    out = joined.groupBy("k", "th").applyInPandas(
        merge, "k long, n_words long, n_hit long, spans array<long>, items array<string>, copies long")
    return out.withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))) \
        .drop("copies", "_c")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns."""
    return found.select(key, "n_words", "n_hit",
                        F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def brute_force(docs: list[tuple], items: list[tuple], width: int = WIDTH) -> list[tuple]:
    """Contract rows by plain search (for tests)."""
    pats = defaultdict(set)
    for i, t in items:
        w = words_of(t)
        m = min(width, len(w))
        for x in range(len(w) - m + 1 if m else 0):
            pats[tuple(w[x:x + m])].add(str(i))
    lens = sorted({len(p) for p in pats})
    out = []
    for d, t in docs:
        w = words_of(t)
        hit, got = set(), set()
        for m in lens:
            for x in range(len(w) - m + 1):
                if (own := pats.get(tuple(w[x:x + m]))) is not None:
                    hit.update(range(x, x + m))
                    got |= own
        ids = ",".join(sorted(got))
        out.append((d, len(w), len(hit), len(got), hashlib.sha256(ids.encode()).hexdigest(),
                    bool(hit)))
    return out
