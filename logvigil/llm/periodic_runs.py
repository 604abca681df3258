"""Periodic runs of words (maximal repetitions), by seeds extended on diagonals.

A run of period q and length L repeats itself q words later on at least
``max(min_length - q, q)`` consecutive words: that is the overlap its seeds may
count on.  Lags are taken in scales; the first holds the lags below
``min_length``, every further one twice the lags of the one before, so all lags
of a scale are guaranteed the overlap ``m`` of its smallest one.

For each scale, over all documents of a slice at once:

1. grams of ``k = m // 2`` words are numbered exactly (pairs of the numbers of
   the scale before); a position stays only if its gram recurs in its document;
2. anchors stand at every ``m - k + 1``-th word, so each stretch of ``m`` equal
   words holds one; an anchor is paired with the occurrences of its gram whose
   lag is in the scale, at most ``m`` of them;
3. a pair inside one run of a period up to ``k`` is left out: by the periodicity
   lemma its lag is no smallest period;
4. pairs are taken by lag and place; a table per lag says how far its diagonal
   is covered, and only pairs beyond it are extended in both directions;
5. a stretch that is long enough is a run if its first q words are no power of
   a shorter word.

There are at most about 2n pairs a scale and log n scales, however repetitive
the text, and all comparisons are of exact word numbers.  Documents never meet,
so nothing is shuffled; a lost executor repeats its own slice.

Defined results: a null or empty text has no words and no run (hashes are those
of the empty string); repeated rows are judged one by one; an empty table gives
an empty result; a null key is left as it is (and never planted); other columns
of the input are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvigil.llm.textkit import covered, ranges, slices

MIN_LENGTH = 12


# ---------------------------------------------------------------- the search
def number_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the pairs (a[i], b[i]): equal pairs, equal numbers."""
    both = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
    return np.unique(both, return_inverse=True)[1].astype(np.int64)


def _prime_divisors(q: int) -> list[int]:
    out, r = [], 2
    while r * r <= q:
        if q % r == 0:
            out.append(r)
            while q % r == 0:
                q //= r
        r += 1
    return out + ([q] if q > 1 else [])


def is_primitive(word: np.ndarray) -> bool:
    """No power of a shorter word."""
    q = len(word)
    return not any(np.array_equal(word[:q - q // r], word[q // r:]) for r in _prime_divisors(q))


def _equal_ahead(w: np.ndarray, i: int, j: int, end: int) -> int:
    """Words that w[i:] and w[j:] share, j + that <= end."""
    done, step = 0, 64
    while j + done < end:
        n = min(step, end - j - done)
        diff = w[i + done:i + done + n] != w[j + done:j + done + n]
        at = int(diff.argmax())
        if diff[at]:
            return done + at
        done, step = done + n, step * 2
    return done


def _equal_behind(w: np.ndarray, i: int, j: int, begin: int) -> int:
    """Words that w[:i] and w[:j] share at their ends, i - that >= begin."""
    done, step = 0, 64
    while i - done > begin:
        n = min(step, i - done - begin)
        diff = (w[i - done - n:i - done] != w[j - done - n:j - done])[::-1]
        at = int(diff.argmax())
        if diff[at]:
            return done + at
        done, step = done + n, step * 2
    return done


def _seed_pairs(gram: np.ndarray, at: np.ndarray, bounds: np.ndarray, k: int, step: int,
                lo: int, hi: int):
    """(positions whose gram recurs in their document, pair starts, pair lags).

    ``gram[x]`` is the number of the k-gram at position ``at[x]`` (ascending)."""
    order = np.argsort(gram, kind="stable")
    g, p = gram[order], at[order]
    doc = np.searchsorted(bounds, p, "right") - 1
    same = (g[1:] == g[:-1]) & (doc[1:] == doc[:-1])
    twice = np.zeros(len(g), bool)
    twice[1:] |= same
    twice[:-1] |= same
    again = np.sort(p[twice])
    g, p, doc = g[twice], p[twice], doc[twice]
    if not len(p):
        return again, p, p
    big = np.int64(bounds[-1]) + hi + 1  # (gram, position) as one number
    place = np.cumsum(np.r_[0, (g[1:] != g[:-1]).astype(np.int64)]) * big + p
    anchor = np.flatnonzero((p - bounds[doc]) % step == 0)
    last = bounds[doc[anchor] + 1] - k  # the document's last gram
    first = np.searchsorted(place, place[anchor] + lo, "left")
    stop = np.searchsorted(place, place[anchor] - p[anchor] +
                           np.minimum(p[anchor] + hi - 1, last), "right")
    n = np.maximum(stop - first, 0)
    start = np.repeat(p[anchor], n)
    return again, start, p[ranges(first, n)] - start


def find_runs(words: np.ndarray, bounds: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """All runs of several documents: rows (document, start, length, period) by
    document, start and period.

    ``words`` are the word numbers of the documents one after the other (equal
    words, equal numbers, below 2^32), ``bounds`` their n + 1 borders."""
    runs: list[tuple[int, int, int, int]] = []
    longest = int(np.diff(bounds).max(initial=0))
    m = max(min_length // 2, 1)
    k, lo, hi = max(m // 2, 1), 1, min_length
    at = np.flatnonzero(np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(words)) >= k)
    gram, have = words.astype(np.int64), 1
    while have < k and len(at):  # the first scale's grams, word by word
        gram = number_pairs(gram[:-1], words[have:])
        have += 1
    gram = gram[at] if len(at) else gram[:0]
    while len(at) and 2 * lo <= longest and min_length <= longest:
        again, start, lag = _seed_pairs(gram, at, bounds, k, m - k + 1, lo, hi)
        if len(start) and runs:
            reach = np.zeros(len(words), np.int64)  # the end of the runs of a period up to k
            short = np.array([(s, s + n) for _, s, n, q in runs if q <= k], np.int64).reshape(-1, 2)
            np.maximum.at(reach, short[:, 0], short[:, 1])
            np.maximum.accumulate(reach, out=reach)
            open_ = reach[start] < start + lag + k
            start, lag = start[open_], lag[open_]
        order = np.lexsort((start, lag))
        doc = np.searchsorted(bounds, start, "right") - 1
        furthest: dict[int, int] = {}  # per lag: where its covered diagonal ends
        for i, q, d in zip(start[order].tolist(), lag[order].tolist(), doc[order].tolist()):
            if i < furthest.get(q, 0):
                continue
            first = i - _equal_behind(words, i, i + q, int(bounds[d]))
            last = i + k + _equal_ahead(words, i + k, i + k + q, int(bounds[d + 1]))
            furthest[q] = last
            if last - first >= max(min_length - q, q) and is_primitive(words[first:first + q]):
                runs.append((d, first, last - first + q, q))
        # grams of twice the words, where both halves recur
        pos = np.full(len(words) + 1, -1, np.int64)
        pos[at] = np.arange(len(at))
        recurs = np.zeros(len(words) + 1, bool)
        recurs[again] = True
        here = again[again + k < len(words)]
        here = here[recurs[here + k]]
        end = bounds[np.searchsorted(bounds, here, "right")]
        here = here[here + 2 * k <= end]
        gram = number_pairs(gram[pos[here]], gram[pos[here + k]]) if len(here) else gram[:0]
        at = here
        lo, hi = hi, 2 * hi
        m, k = lo, 2 * k
    out = np.array(sorted((d, s - int(bounds[d]), n, q) for d, s, n, q in runs), np.int64)
    return out.reshape(-1, 4)


def brute_force(words: list, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """Runs of one document, lag by lag (for tests)."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            part = words[s:i + q]
            if len(part) >= max(min_length, 2 * q) and not any(
                    all(part[x] == part[x + p] for x in range(len(part) - p)) for p in range(1, q)):
                out.append((s, len(part), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


# ------------------------------------------------------------ the operator
def plant(words: list, key) -> list:
    """The contract's test repetition: one key in ten has its words from place
    a on replaced by a repetition of p of them.  A null key is left alone."""
    if key is None or not words:
        return words
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[:n - a]


RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def word_runs(df: DataFrame, key: str = "doc_id", text: str = "text", planted: bool = False,
              min_length: int = MIN_LENGTH) -> DataFrame:
    """Rows (key, n_words, runs, collapsed): the runs of words of every text
    (start in words) and the text without the words that repeat a run's first
    period, joined by one space."""
    src = df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for batch in batches:
            keys = batch.column("k")
            for a, b, buf, off in slices(batch):
                raw = buf.tobytes()
                docs = [raw[off[i]:off[i + 1]].split() for i in range(b - a)]  # ASCII white space
                if planted:
                    docs = [plant(w, keys[a + i].as_py()) for i, w in enumerate(docs)]
                bounds = np.cumsum([0, *map(len, docs)], dtype=np.int64)
                first: dict[bytes, int] = {}  # a word's number is the place where it first stands
                numbers = np.fromiter((x for w, s in zip(docs, bounds) for x in map(
                    first.setdefault, w, range(s, s + len(w)))), np.int64, int(bounds[-1]))
                found = find_runs(numbers, bounds, min_length)
                per = np.searchsorted(found[:, 0], np.arange(b - a + 1))
                gone = covered(bounds[found[:, 0]] + found[:, 1] + found[:, 3],
                               found[:, 2] - found[:, 3], int(bounds[-1]))
                texts, lists = [], []
                for i, words in enumerate(docs):
                    mine = found[per[i]:per[i + 1]]
                    if len(mine):
                        drop = gone[bounds[i]:bounds[i + 1]]
                        words = [w for w, g in zip(words, drop.tolist()) if not g]
                    texts.append(b" ".join(words).decode("utf-8", "replace"))
                    lists.append([dict(zip(("start", "length", "period"), r[1:])) for r in mine.tolist()])
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, b - a), pa.array(np.diff(bounds)), pa.array(lists, run),
                     pa.array(texts, pa.string())], ["k", "n_words", "runs", "collapsed"])

    out = src.mapInArrow(scan, f"k long, n_words long, runs {RUN}, collapsed string")
    return out.withColumnRenamed("k", key)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns: counts, the longest run (ties: smallest start,
    then period) and hashes of all runs and of the collapsed text."""
    best = F.try_element_at(F.array_sort("runs", lambda x, y: F.when(
        x["length"] != y["length"], F.when(x["length"] > y["length"], -1).otherwise(1)).when(
        x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1)).otherwise(
        (x["period"] - y["period"]).cast("int"))), F.lit(1))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.withColumn("_b", best).select(
        key, "n_words", F.size("runs").cast("long").alias("n_runs"), F.col("_b.start").alias("start"),
        F.col("_b.length").alias("length"), F.col("_b.period").alias("period"),
        F.expr("1000 * _b.length div _b.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
