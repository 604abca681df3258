"""Packing token sequences by non-negative least squares.

1. Every document is tokenised once; its ids (with the end id) are cut into
   full windows and one remainder.  Only piece lengths go on from there.
2. Lengths are counted in bins of ``quantum`` tokens (rounded up): the window
   has ``window / quantum`` bins, whatever the corpus.
3. Shallow combinations of up to three bins that fill the window are the
   columns of A; NNLS solves A x = histogram, x is rounded down, and what is
   left is packed greedily, the largest bin first.
4. The plan says, for each bin, which ranks go to which sequences.  Ranks
   within a bin are counted per (bin, bucket) with running sums, so a length
   that many documents share is never gathered in one task.

Defined results: a null or empty text is one piece holding the end id; repeated
rows are packed one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logvigil.llm.sharding import number_rows
from logvigil.llm.textkit import durable, parts, worker_cache

WINDOW = 2048
END_ID = 1
QUANTUM = 16


def _byte_letters() -> dict[str, int]:
    """The byte-level BPE alphabet: printable bytes stand for themselves, the
    others for the code points from 256 on, in byte order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBpe:
    """Ids of a byte-level BPE tokenizer file.  The vocabulary is run by
    tiktoken (about four times as fast as the file's own library, same ids);
    a text that holds a special token's string, or that tiktoken refuses, goes
    to the file's own library, as does everything if the two differ on a probe."""

    PROBE = " Ab  c\n\n x'll 12é日本\t—…\u00a0z\x00"

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.own = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items()
                 if t not in self.special}
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN,
                                      mergeable_ranks=ranks, special_tokens={})
        if self.fast.encode_ordinary(self.PROBE) != self._slow(self.PROBE):
            self.fast = None
        self.own = None  # a worker keeps one vocabulary, not two

    def _slow(self, text: str) -> list[int]:
        if self.own is None:
            from tokenizers import Tokenizer
            self.own = Tokenizer.from_file(self.path)
            self.own.no_truncation()
            self.own.no_padding()
        return self.own.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(t in text for t in self.special):
            return np.array(self._slow(text), "<u4")
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        except Exception:  # its pattern engine gives up on very long runs of white space
            return np.array(self._slow(text), "<u4")


def load_tokenizer(path: str) -> ByteBpe:
    cache = worker_cache()
    if ("tokenizer", path) not in cache:
        cache["tokenizer", path] = ByteBpe(path)
    return cache["tokenizer", path]


def cut_pieces(df: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID,
               key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Tokenise and cut: rows (key, start, length, ids_crc32, doc_tokens
    [, ids])."""
    src = df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load_tokenizer(tokenizer_path)
        for b in parts(batches):
            cols = {c: [] for c in ("k", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            for k, t in zip(b.column("k").to_pylist(), b.column("text").to_pylist()):
                ids = np.append(tok.ids(t or ""), np.uint32(end_id)).astype("<u4")
                for s in range(0, len(ids), window):
                    piece = ids[s:s + window]
                    cols["k"].append(k)
                    cols["start"].append(s)
                    cols["length"].append(len(piece))
                    cols["ids_crc32"].append(zlib.crc32(piece.tobytes()))
                    cols["doc_tokens"].append(len(ids))
                    if keep_ids:
                        cols["ids"].append(piece.tolist())
            if not keep_ids:
                del cols["ids"]
            kind = {"ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_pydict({c: pa.array(v, kind.get(c, pa.int64()))
                                              for c, v in cols.items()})

    schema = "k long, start long, length long, ids_crc32 long, doc_tokens long"
    return src.mapInArrow(cut, schema + (", ids array<int>" if keep_ids else "")) \
        .withColumnRenamed("k", key)


# ---------------------------------------------------------------- the plan
def combinations(bins: int) -> np.ndarray:
    """All multisets of up to three bins 1..bins that sum to ``bins``, as rows
    (a >= b >= c, 0 for none)."""
    out = [(bins, 0, 0)]
    out += [(bins - b, b, 0) for b in range(1, bins // 2 + 1)]
    for c in range(1, bins // 3 + 1):
        out += [(bins - b - c, b, c) for b in range(c, (bins - c) // 2 + 1)]
    return np.array(out)


def nnls(a: np.ndarray, y: np.ndarray, tol: float = 1e-9) -> np.ndarray:
    """Active-set non-negative least squares (Lawson and Hanson's method): free
    the variable of steepest descent, solve for the free ones, step back to the
    boundary whenever one would turn negative."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(y).max(initial=0.0)))
    for _ in range(3 * a.shape[0]):
        grad = a.T @ (y - a @ x)
        grad[free] = -np.inf
        j = int(np.argmax(grad))
        if free.all() or grad[j] <= tol * scale:
            break
        free[j] = True
        while True:
            z = np.zeros(n)
            z[free] = np.linalg.lstsq(a[:, free], y, rcond=None)[0]
            low = free & (z <= 0)
            if not low.any():
                break
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = x + step * (z - x)
            free &= x > tol
            x[~free] = 0
        x = z
    return x


def plan_packing(hist: np.ndarray, bins: int) -> list[tuple[list[int], int]]:
    """(bins of one sequence, repeats) so that each bin i is used hist[i] times
    in all (hist has bins + 1 entries, entry 0 unused)."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    plan: list[tuple[list[int], int]] = []

    def take(pattern: list[int], most: int) -> None:
        kinds, mult = np.unique(pattern, return_counts=True)
        k = int(min(most, (left[kinds] // mult).min()))
        if k > 0:
            left[kinds] -= mult * k
            plan.append((pattern, k))

    combos = combinations(bins)
    a = np.zeros((bins + 1, len(combos)))
    for col in range(combos.shape[1]):
        np.add.at(a, (combos[:, col], np.arange(len(combos))), 1.0)
    a[0] = 0
    x = nnls(a, left.astype(float))
    for j in np.argsort(-x, kind="stable"):
        if x[j] < 1:
            break
        take([int(b) for b in combos[j] if b], int(x[j]))
    while left.any():  # largest bin first, each time the largest that still fits
        space, pattern, rest = bins, [], left.copy()
        while space:
            fits = np.flatnonzero(rest[:space + 1])
            if not len(fits):
                break
            b = int(fits[-1])
            pattern.append(b)
            rest[b] -= 1
            space -= b
        take(pattern, int(left.max()))
    return plan


def plan_table(plan: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (bin, first rank, first sequence, slot), by bin and first rank; the
    rank-th piece of the bin goes to sequence + (rank - first rank)."""
    used: dict[int, int] = {}
    rows, seq = [], 0
    for pattern, k in plan:
        for slot, b in enumerate(pattern):
            rows.append((b, used.get(b, 0), seq, slot))
            used[b] = used.get(b, 0) + k
        seq += k
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, window: int = WINDOW, quantum: int = QUANTUM, key: str = "doc_id",
         rows_per_bucket: int = 100_000) -> DataFrame:
    """Add sequence_id and offset to pieces (key, start, length, ...), which
    should be durable: they are read several times."""
    spark = pieces.sparkSession
    bins = window // quantum
    binned = pieces.withColumn("_bin", F.ceil(F.col("length") / quantum).cast("int"))
    hist = np.zeros(bins + 1, np.int64)
    for r in binned.groupBy("_bin").count().toLocalIterator():  # at most one row per bin
        hist[r[0]] = r[1]
    table = plan_table(plan_packing(hist, bins))
    shared = spark.sparkContext.broadcast(table)  # a few rows per bin

    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                  int(hist.sum()) // rows_per_bucket + 1)
    salted = binned.withColumn("_b", F.pmod(F.xxhash64(
        key, "start", F.monotonically_increasing_id() % 64), F.lit(buckets)))
    ranked = number_rows(salted, ["_bin"], "_b", "_rank", [key, "start", "ids_crc32"]).drop("_b")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        big = np.int64(1) << 40
        keys = t[:, 0] * big + t[:, 1]
        for b in batches:
            rank = b.column("_rank").to_numpy(zero_copy_only=False)
            i = np.searchsorted(keys, b.column("_bin").to_numpy(zero_copy_only=False)
                                .astype(np.int64) * big + rank, "right") - 1
            cols = {n: b.column(n) for n in b.schema.names if n not in ("_bin", "_rank")}
            cols["sequence_id"] = pa.array(t[i, 2] + rank - t[i, 1], pa.int64())
            cols["_slot"] = pa.array(t[i, 3], pa.int64())
            yield pa.RecordBatch.from_pydict(cols)

    keep = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields]
    placed = ranked.mapInArrow(place, ", ".join([*keep, "sequence_id long", "_slot long"]))
    w = Window.partitionBy("sequence_id").orderBy("_slot")  # at most window / 1 pieces
    return placed.withColumn("offset", (F.sum("length").over(w) - F.col("length")).cast("long")) \
        .drop("_slot")


def fill_windows(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The real output: (sequence_id, ids padded to the window, n_tokens), from
    pieces that kept their ids."""
    parts = packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    return parts.select("sequence_id", F.concat(ids, F.array_repeat(
        F.lit(pad_id), F.lit(window) - F.size(ids))).alias("ids"),
        F.size(ids).cast("long").alias("n_tokens"))


def pack_documents(df: DataFrame, tokenizer_path: str, key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """Tokenise, cut and pack every document: the contract's columns."""
    pieces = durable(cut_pieces(df, tokenizer_path, key=key, text=text))
    return pack(pieces, key=key).select(key, "start", "length", "ids_crc32", "doc_tokens",
                                        "sequence_id", "offset")
