"""Whitening of embeddings by shifted Cholesky QR.

1. *Fit list.* Every usable vector c becomes integers ``x = floor(64 c) +
   1000000``; equal vectors are one entry.  An entry travels as a code: one byte
   for the width, then the numbers in the narrowest integers that hold the row,
   so equal vectors are equal codes and partial aggregation merges copies before
   the shuffle.  The list is checkpointed; all later passes read it.
2. *Sums.* n and the exact sum of every dimension, as integers.
3. *Orthogonalisation.* A pass forms the Gram matrix of the centred rows after
   the triangular solves so far (each task its own sum, then lanes of tasks, then
   all); the driver takes its Cholesky factor, R.  The first pass is shifted, so
   that it cannot break down; a later one is shifted only if its factor does not
   exist (dependent dimensions).  Passes end when the Gram matrix is a projection
   to ``SETTLED``.
4. *Components.* With Y = Q R (R the product of all factors) and G the last Gram
   matrix of Q, the singular values of sqrt(G) R are those of Y and its right
   singular vectors the components.
5. *Rows.* Each vector is projected; one more pass over the fit list measures
   the covariance of what came out.

What reaches the driver is d x d numbers a pass, whatever the table's size.

Defined results: a vector that is null, empty, or holds a null or non-finite
entry, or one whose integer does not fit 62 bits, is left out; so is one whose
length is not that of most entries of the fit list (ties: the shortest).
Directions without variance (a constant or dependent dimension, one entry
only) are no components, so fewer than ``most`` may come back, or none and no
rows.  Repeated rows each get their own result rows; a null key stays null; a
deviation beyond a long is null.  An empty table gives an empty result; other
columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvigil.llm.textkit import durable, per_doc

SCALE, ORIGIN = 64.0, 1_000_000
BLOCK_VALUES = 1 << 19   # numbers worked on at once
BLOCK_BYTES = 1 << 17    # of a partial Gram matrix in one row
LANES = 64
MAX_PASSES = 8
SETTLED = 1e-9
NO_VARIANCE = 1e-11      # of the largest singular value
_WIDTHS = (np.int8, np.int16, np.int32, np.int64)


# ------------------------------------------------------------- rows to codes
def usable_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, ``floor(64 c)`` as a rows x dimensions array) of the usable
    vectors of a list column, one pair per vector length."""
    n = len(column)
    off = np.asarray(column.offsets, np.int64)
    flat = column.values[off[0]:off[-1]] if n else pa.array([], pa.float64())
    off = off - (off[0] if n else 0)
    c = flat.cast(pa.float64()).to_numpy(zero_copy_only=False) * SCALE  # a null is NaN
    size = np.diff(off)
    with np.errstate(invalid="ignore"):
        bad = per_doc((~(np.abs(c) < 2.0 ** 62)).astype(np.int64), off)
    ok = (size > 0) & (bad == 0) & column.is_valid().to_numpy(zero_copy_only=False)
    for d in np.unique(size[ok]):
        rows = np.flatnonzero(ok & (size == d))
        for i in range(0, len(rows), max(1, BLOCK_VALUES // int(d))):
            part = rows[i:i + max(1, BLOCK_VALUES // int(d))]
            yield part, np.floor(c[off[part][:, None] + np.arange(d)]).astype(np.int64)


def encode_rows(z: np.ndarray) -> list[bytes]:
    """One code per row: its width in bytes, then its integers in that width."""
    top = np.maximum(z.max(axis=1), -(z.min(axis=1) + 1))
    kind = np.searchsorted([2 ** 7, 2 ** 15, 2 ** 31], top, "right")
    out: list[bytes] = [b""] * len(z)
    for k in np.unique(kind):
        rows, t = np.flatnonzero(kind == k), np.dtype(_WIDTHS[k])
        raw = z[rows].astype(t).tobytes()
        step, head = z.shape[1] * t.itemsize, bytes([t.itemsize])
        for j, r in enumerate(rows):
            out[r] = head + raw[j * step:(j + 1) * step]
    return out


def decode_rows(codes: list[bytes]) -> Iterator[np.ndarray]:
    """rows x dimensions arrays, one or more per (width, length)."""
    groups: dict[tuple[int, int], list[bytes]] = {}
    for c in codes:
        groups.setdefault((c[0], len(c)), []).append(c)
    for (w, size), part in groups.items():
        d = (size - 1) // w
        step = max(1, BLOCK_VALUES // d)
        for i in range(0, len(part), step):
            raw = b"".join(c[1:] for c in part[i:i + step])
            yield np.frombuffer(raw, f"i{w}").reshape(-1, d).astype(np.int64)


def fit_list(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Durable distinct codes of the usable vectors."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, z in usable_rows(b.column("v")):
                yield pa.RecordBatch.from_arrays([pa.array(encode_rows(z), pa.binary())], ["code"])

    return durable(df.select(F.col(vector).cast("array<double>").alias("v"))
                   .mapInArrow(encode, "code binary").distinct())


# ---------------------------------------------------------------- the passes
def exact_sums(codes: DataFrame) -> tuple[int, list[int]]:
    """(n, sum of ``floor(64 c)`` per dimension) over the entries of the most
    frequent length; exact whatever their size."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            for z in decode_rows(b.column("code").to_pylist()):
                t = total.setdefault(z.shape[1], [0, 0, 0])
                t[0] += len(z)
                t[1] = t[1] + (z >> 31).sum(axis=0)
                t[2] = t[2] + (z & (2 ** 31 - 1)).sum(axis=0)
        for d, (n, hi, lo) in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(d, x)) for x in (d, n)] + [pa.array(np.arange(d)), pa.array(hi), pa.array(lo)],
                ["d", "n", "i", "hi", "lo"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    table = durable(codes.mapInArrow(sums, "d long, n long, i long, hi long, lo long")
                    .groupBy("d", "i").agg(F.sum("n").alias("n"), wide("hi"), wide("lo")))
    top = table.where("i = 0").orderBy(F.desc("n"), "d").limit(1).collect()
    if not top:
        return 0, []
    rows = sorted(table.where(F.col("d") == top[0]["d"]).collect(), key=lambda r: r["i"])
    return top[0]["n"], [int(r["hi"]) * 2 ** 31 + int(r["lo"]) for r in rows]


def solve_rows(y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Q with Qᵀ R = Yᵀ, for dimensions x rows arrays: substitution, dimension
    by dimension, for an upper triangular R."""
    q = np.empty_like(y)
    for j in range(len(y)):
        q[j] = (y[j] - r[:j, j] @ q[:j]) / r[j, j]
    return q


@dataclass
class Centre:
    """n and the sums S, with S / n split into a whole and a broken part, so
    that centring loses nothing however far off the mean is."""

    n: int
    sums: list[int]

    def __post_init__(self):
        whole = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        self.rest = [s - self.n * w for s, w in zip(self.sums, whole)]
        self.whole = np.array(whole, np.int64)
        self.broken = np.array([r / self.n for r in self.rest])

    def centred(self, z: np.ndarray) -> np.ndarray:
        """dimensions x rows."""
        return ((z - self.whole).astype(np.float64) - self.broken).T.copy()

    def deviation(self, z: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n x - S)^2, exact; null beyond a long."""
        off = z - self.whole
        top = self.n * (int(np.abs(off).max(initial=0)) + 1)
        if top * top * len(self.sums) < 2 ** 63:
            return pa.array(((off * self.n - np.array(self.rest, np.int64)) ** 2).sum(axis=1))
        exact = [sum((v * self.n - r) ** 2 for v, r in zip(row, self.rest)) for row in off.tolist()]
        return pa.array([e if e < 2 ** 63 else None for e in exact], pa.int64())


def gram(codes: DataFrame, centre: Centre, transform) -> np.ndarray:
    """Gram matrix of ``transform(centred rows)`` (dimensions x rows) over the
    fit list: summed per task, per lane of tasks, then over the lanes."""
    d = len(centre.sums)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            for z in decode_rows(b.column("code").to_pylist()):
                if z.shape[1] == d:
                    q = transform(centre.centred(z))
                    total = total + q @ q.T
        if isinstance(total, int):
            return
        step = max(1, BLOCK_BYTES // (8 * len(total)))
        at = list(range(0, len(total), step))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int64()), pa.array([TaskContext.get().partitionId() % LANES] * len(at), pa.int64()),
             pa.array([total[i:i + step].tobytes() for i in at], pa.binary())], ["at", "lane", "m"])

    def add(table: pa.Table) -> pa.Table:
        m = sum(np.frombuffer(x, np.float64) for x in table.column("m").to_pylist())
        return pa.table({"at": table.column("at")[:1], "lane": table.column("lane")[:1],
                         "m": pa.array([m.tobytes()], pa.binary())})

    schema = "at long, lane long, m binary"
    lanes = codes.mapInArrow(partial, schema).groupBy("at", "lane").applyInArrow(add, schema)
    rows = sorted(lanes.groupBy("at").applyInArrow(add, schema).collect(), key=lambda r: r["at"])
    m = np.concatenate([np.frombuffer(bytes(r["m"]), np.float64) for r in rows])
    side = int(round(len(m) ** 0.5))
    return m.reshape(side, side)


def cholesky_upper(g: np.ndarray, shift: float, always: bool) -> np.ndarray:
    """R with Rᵀ R = G (+ shift); shifted where asked, or where G has no factor."""
    while True:
        try:
            return np.linalg.cholesky(g + (shift * np.eye(len(g)) if always else 0.0)).T.copy()
        except np.linalg.LinAlgError:
            shift, always = (10 * shift if always else shift), True


@dataclass
class Whitener:
    """``components`` (one per row), their eigenvalues and shares of the
    variance, for centred rows."""

    centre: Centre
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float
    passes: int


def fit(codes: DataFrame, most: int = 16) -> Whitener | None:
    """Components of the fit list; None where it is empty."""
    n, sums = exact_sums(codes)
    if n == 0:
        return None
    centre, d = Centre(n, sums), len(sums)
    unit = 11.0 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2
    factors: list[np.ndarray] = []

    def through(y: np.ndarray) -> np.ndarray:
        for r in factors:
            y = solve_rows(y, r)
        return y

    g = gram(codes, centre, through)
    none = np.zeros((0, d))
    if not np.trace(g) > 0:
        return Whitener(centre, none, np.zeros(0), np.zeros(0), 0.0, 1)
    passes = 1
    while passes < MAX_PASSES:
        factors.append(cholesky_upper(g, unit * float(np.trace(g)), always=passes == 1))
        g = gram(codes, centre, through)
        passes += 1
        if np.abs(g @ g - g).max() < SETTLED:
            break
    r = np.linalg.multi_dot([*factors[::-1], np.eye(d)])
    lam, u = np.linalg.eigh((g + g.T) / 2)
    root = (u * np.sqrt(np.maximum(lam, 0.0))) @ u.T
    _, sigma, vt = np.linalg.svd(root @ r)
    kept = min(most, int((sigma > NO_VARIANCE * sigma[0]).sum()))
    e = sigma ** 2 / n
    comp, top = vt[:kept], e[:kept]
    white = gram(codes, centre, lambda y: (comp @ y) / np.sqrt(top)[:, None]) / n
    return Whitener(centre, comp, top, top / e.sum(), float(np.abs(white - np.eye(kept)).max()), passes)


# ------------------------------------------------------------- the operator
SCHEMA = ("key long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


def project(df: DataFrame, model: Whitener | None, key: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """One row per usable vector and component."""
    src = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    if model is None or not len(model.components):
        return src.limit(0).mapInArrow(lambda it: iter(()), SCHEMA).withColumnRenamed("key", key)
    shared = df.sparkSession.sparkContext.broadcast(model)  # most x d numbers

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k, d = len(m.components), len(m.centre.sums)
        for b in batches:
            for at, z in usable_rows(b.column("v")):
                if z.shape[1] != d:
                    continue
                w = (m.components @ m.centre.centred(z)) / np.sqrt(m.eigenvalues)[:, None]
                who = pa.array(np.repeat(np.arange(len(at)), k))
                yield pa.RecordBatch.from_arrays(
                    [b.column("key").take(pa.array(at)).take(who),
                     pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                     pa.array(np.full(len(at) * k, m.centre.n)), m.centre.deviation(z).take(who),
                     pa.array(w.T.ravel()), pa.array(np.tile(m.explained, len(at))),
                     pa.array(np.full(len(at) * k, m.identity_error))],
                    ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return src.mapInArrow(rows, SCHEMA).withColumnRenamed("key", key)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 16) -> DataFrame:
    """Fit on the distinct vectors and project all rows."""
    return project(df, fit(fit_list(df, vector), most), key, vector)
