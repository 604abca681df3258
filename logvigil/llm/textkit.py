"""Vectorised text helpers for Arrow batches (numpy only, no per-row Python).

A batch's string column is one UTF-8 byte array plus offsets; all helpers work
on that pair, in slices of about ``SLICE_BYTES`` so memory does not grow with
the batch.  A null text is an empty text.
"""

from __future__ import annotations

import sys
import tempfile
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 19
PART_ROWS = 512
_LONG_WORD = 1 << 16
_ODD = 0x9E3779B97F4A7C15


# ------------------------------------------------------------------ session
def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  Unset, a temporary one is
    set on a local master (tests); on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="logvigil-llm-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker (functions are shipped
    by value, so their module globals last for one task only)."""
    name = "_logvigil_worker_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].store = {}
    return sys.modules[name].store


# ------------------------------------------------------------------ buffers
def text_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes uint8, offsets int64 of n + 1) of an Arrow string array."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], kind)[col.offset:col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size \
        else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def doc_slices(off: np.ndarray, budget: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about ``budget`` bytes each (one row at least)."""
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + budget, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of up to PART_ROWS rows, for work on Python strings."""
    for b in batches:
        for i in range(0, b.num_rows, PART_ROWS):
            yield b.slice(i, PART_ROWS)


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator:
    """(row range start, end, bytes, offsets) of a batch's text, in slices."""
    buf, off = text_buffer(batch.column(column))
    for a, b in doc_slices(off):
        yield a, b, buf[off[a]:off[b]], off[a:b + 1] - off[a]


# -------------------------------------------------------------------- words
def byte_class(chars: bytes, invert: bool = False) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return ~table if invert else table


#: words are runs of anything but space and \t \n \v \f \r
SPACE_WORDS = byte_class(b"\x20\x09\x0a\x0b\x0c\x0d", invert=True)


def word_spans(buf: np.ndarray, off: np.ndarray, table: np.ndarray):
    """(starts, ends, index of each document's first word, n + 1 entries) of
    the maximal runs of table bytes; a run ends with its document."""
    if len(buf) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = table[buf]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    full = off[1:] > off[:-1]
    s, e = off[:-1][full], off[1:][full] - 1
    first[s] = w[s]
    last[e] = w[e]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def doc_of(firsts: np.ndarray) -> np.ndarray:
    """Document index of each word, from word_spans' third result."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (in place on a uint64 array, which is returned)."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _byte_values(fold: bool) -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
    if fold:  # A-Z hash like a-z
        v[65:91] = v[97:123]
    return v


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    cache = worker_cache()
    have = cache.get("powers")
    if have is None or len(have[0]) < n:
        inv = pow(_ODD, -1, 1 << 64)
        out = []
        for base in (_ODD, inv):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        have = cache["powers"] = tuple(out)
    return have


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                fold: bool = False) -> np.ndarray:
    """64-bit hash of each byte span (spans ascend and do not overlap); equal
    bytes give equal hashes wherever they stand."""
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    vals = _byte_values(fold)
    size = ends - starts
    step, i = 1 << 19, 0
    pw, ipw = _powers(step + _LONG_WORD + 1)
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(starts, base + step, "left"))
        j = max(j, i + 1)
        stop = min(int(ends[j - 1]), base + step + _LONG_WORD)
        c = np.zeros(stop - base + 1, np.uint64)
        np.cumsum(vals[buf[base:stop]] * pw[:stop - base], out=c[1:])
        s = starts[i:j] - base
        e = np.minimum(ends[i:j] - base, stop - base)
        out[i:j] = (c[e] - c[s]) * ipw[np.minimum(s, len(ipw) - 1)]
        i = j
    out += size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    mix(out)
    for k in np.flatnonzero(size > _LONG_WORD - 1):  # their own way, wherever they stand
        raw = buf[starts[k]:ends[k]].tobytes()
        out[k] = xxhash.xxh3_64_intdigest(raw.lower() if fold else raw)
    return out


def windows(h: np.ndarray, firsts: np.ndarray, k: int):
    """Hash of every run of k consecutive words inside one document:
    (hashes, word index of each run's first word)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    x = h[:n].copy()
    for i in range(1, k):
        x *= np.uint64(_ODD)
        x += h[i:i + n]
    left = np.repeat(firsts[1:], np.diff(firsts))[:n] - np.arange(n)
    at = np.flatnonzero(left >= k)
    return mix(x[at] + np.uint64(k)), at


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of starts[i] .. starts[i] + counts[i] - 1."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def per_doc(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sum of each document's slice of values (firsts: n + 1 boundaries)."""
    c = np.concatenate([np.zeros(1, np.float64 if values.dtype.kind == "f" else np.int64),
                        np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f"
                                  else np.int64)])
    return c[firsts[1:]] - c[firsts[:-1]]


def covered(starts: np.ndarray, length, n: int) -> np.ndarray:
    """Mask over n positions lying inside any [start, start + length)."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + length, -1)
    return np.cumsum(d[:-1]) > 0
