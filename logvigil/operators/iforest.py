"""Isolation forest, scaler and contamination threshold.

MLlib has no isolation forest, so this is the one custom algorithm:

* **Draws are hashes**, not RNG state: ``U(tag)`` = first 32 bits of
  ``md5(tag)`` / 2^32.  A retried task, another partitioning or a SQL engine
  computes the same draws, so fits are reproducible and checkable.
* **Sampling** (fit) reads row ids only: one md5 per row, ``h = md5(seed:row)``,
  gives two 32-bit words ``ka`` and ``kb``; tree t draws ``(ka + t * kb) mod 2^32``
  for the row -- uniform over rows for each tree, pairwise independent across
  trees, integer arithmetic only -- and takes the ``psi`` rows of the smallest
  draws.  The scan keeps, per row, only the trees whose draw lies below a bound
  that lets about 4·psi rows of each tree through, so one aggregate over trees x
  4·psi ids is all that is shuffled, whatever the table's size.  A tree left
  short is drawn again with a wider bound: the result is always the exact sample
  without replacement.  Features are then built for the sampled rows' batches
  alone (:class:`LogSource`), at most trees x psi of them.
* **Building** runs on the bounded sample only (trees x psi rows), one
  ``applyInPandas`` group per tree, with a numpy builder that grows all trees of
  a group level by level.  Node ``i`` has children ``2i`` (x <= threshold) and
  ``2i + 1``; a node splits on a feature drawn among those with max > min, at
  ``min + U * (max - min)``; depth is capped at ``ceil(log2 psi)``.  Small batches
  that are fitted on all of their rows grow on sets of rows instead
  (:func:`_stacked_units`), with the same splits.
* **Scoring** is a vectorised pandas UDF over Arrow batches with the forest
  broadcast (its size is bounded by trees x 2^(depth+1) nodes).  Path lengths
  are summed as fixed-point integers (2^-32 units), so a score does not depend
  on summation order: score = -2^(-(mean path) / c(psi)), in [-1, 0).
* **Sparse features** (:mod:`logvigil.operators.sparse`): a vector column with
  one-hot groups of any number of categories.  Trees grow on the indices their
  sample holds, nodes name their index, scores fill only the forest's indices.
* **Threshold** = the ``contamination`` quantile of the training scores,
  computed exactly by :func:`exact_quantile` in two passes.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logvigil.functions import files
from logvigil.functions.partitioning import groups_partitions
from logvigil.operators import sparse
from logvigil.session import ensure_checkpoint_dir

EULER_GAMMA = 0.5772156649015329
FIXED_POINT = 4294967296  # 2^32 path-length units per unit of depth
DRAW_RANGE = 4294967296   # draws are 32-bit words
OVERSAMPLE = 4            # rows a tree lets through, in units of psi
QUANTILE_BINS = 1024
SKETCH_ACCURACY = 20_000
BRACKET_ROWS = 10_000      # entries the driver takes


# ------------------------------------------------------------- draws, c(n)
def u_hash(tag: str) -> float:
    """First 32 bits of md5(tag), as a number in [0, 1)."""
    return int(hashlib.md5(tag.encode()).hexdigest()[:8], 16) / 4294967296.0


def c_factor(n: int) -> float:
    """Average path length of an unsuccessful BST search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER_GAMMA) - 2.0 * (n - 1) / n


def max_depth_for(psi: int) -> int:
    return int(math.ceil(math.log2(max(psi, 2))))


_DRAWS: dict = {}
_UNITS: dict = {}


def draw_tables(seed: int, tree_ids: tuple[int, ...], n_nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature and threshold draws per (tree, node): ``U(f:seed:tree:node)``
    and ``U(s:seed:tree:node)`` for node 1 .. n_nodes - 1 (cached per worker)."""
    key = (seed, tree_ids, n_nodes)
    if key in _DRAWS:
        return _DRAWS[key]
    uf = np.zeros((len(tree_ids), n_nodes))
    us = np.zeros((len(tree_ids), n_nodes))
    for i, t in enumerate(tree_ids):
        for node in range(1, n_nodes):
            uf[i, node] = u_hash(f"f:{seed}:{t}:{node}")
            us[i, node] = u_hash(f"s:{seed}:{t}:{node}")
    if len(_DRAWS) > 64:
        _DRAWS.clear()
    _DRAWS[key] = (uf, us)
    return uf, us


def leaf_units(max_size: int, max_depth: int) -> np.ndarray:
    """Fixed-point path length ``depth * 2^32 + floor(c(size) * 2^32)`` as a
    table [depth, size] (cached per worker)."""
    if (max_size, max_depth) in _UNITS:
        return _UNITS[(max_size, max_depth)]
    out = np.zeros((max_depth + 1, max_size + 1), dtype=np.int64)
    for d in range(max_depth + 1):
        for s in range(max_size + 1):
            out[d, s] = d * FIXED_POINT + math.floor(c_factor(s) * FIXED_POINT)
    _UNITS[(max_size, max_depth)] = out
    return out


# ------------------------------------------------------------ the builder
@dataclass
class Forest:
    """Heap-indexed arrays, one row per tree: ``feature`` (-1 = leaf),
    ``threshold``, ``size`` (training rows that reached the node)."""

    feature: np.ndarray
    threshold: np.ndarray
    size: np.ndarray
    psi: int
    max_depth: int

    @property
    def trees(self) -> int:
        return self.feature.shape[0]


def build_forest(samples: np.ndarray, seed: int, tree_ids: tuple[int, ...],
                 max_depth: int, psi: int, with_nodes: bool = False):
    """Grow one tree per sample.  ``samples`` is (trees, m, features); all trees
    grow together, level by level, with grouped numpy reductions.  Samples may
    hold several rounds of ``tree_ids`` (one batch after the other).  With
    ``with_nodes`` the result is (forest, leaf of each sample row)."""
    n_trees, m, n_feat = samples.shape
    n_nodes = 2 ** (max_depth + 1)
    uf, us = draw_tables(seed, tree_ids, n_nodes)
    if n_trees > len(tree_ids):
        uf, us = (np.tile(x, (n_trees // len(tree_ids), 1)) for x in (uf, us))
    feature = np.full((n_trees, n_nodes), -1, dtype=np.int64)
    threshold = np.zeros((n_trees, n_nodes))
    size = np.zeros((n_trees, n_nodes), dtype=np.int64)
    node = np.ones((n_trees, m), dtype=np.int64)
    tree_of = np.repeat(np.arange(n_trees), m)
    flat = samples.reshape(n_trees * m, n_feat)
    for depth in range(max_depth + 1):
        nflat = node.reshape(-1)
        active = (nflat >= 2 ** depth) & (nflat < 2 ** (depth + 1))
        if not active.any():
            break
        rows = np.flatnonzero(active)
        key = tree_of[rows] * n_nodes + nflat[rows]
        order = np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        g_key = key[starts]
        g_tree, g_node = g_key // n_nodes, g_key % n_nodes
        g_size = np.diff(np.r_[starts, len(rows)])
        size[g_tree, g_node] = g_size
        if depth == max_depth:
            break
        vals = flat[rows]
        mins = np.minimum.reduceat(vals, starts, axis=0)
        maxs = np.maximum.reduceat(vals, starts, axis=0)
        cand = maxs > mins
        ncand = cand.sum(axis=1)
        split = (g_size > 1) & (ncand > 0)
        if not split.any():
            break
        pick = np.floor(uf[g_tree, g_node] * ncand).astype(np.int64) + 1
        chosen = np.argmax(cand & (np.cumsum(cand, axis=1) == pick[:, None]), axis=1)
        gi = np.arange(len(g_key))
        lo, hi = mins[gi, chosen], maxs[gi, chosen]
        thr = lo + us[g_tree, g_node] * (hi - lo)
        feature[g_tree[split], g_node[split]] = chosen[split]
        threshold[g_tree[split], g_node[split]] = thr[split]
        # route the rows of split groups to their children
        grp = np.repeat(np.arange(len(g_key)), g_size)
        moving = split[grp]
        r, gg = rows[moving], grp[moving]
        right = flat[r, chosen[gg]] > thr[gg]
        nflat[r] = 2 * nflat[r] + right
        node = nflat.reshape(n_trees, m)
    forest = Forest(feature, threshold, size, psi, max_depth)
    return (forest, node) if with_nodes else forest


def path_units(forest: Forest, X: np.ndarray, tree_block: int = 0) -> np.ndarray:
    """Sum over trees of the fixed-point path length of each row of X.

    All trees advance together one level per step ((trees, rows) index
    arrays); ``tree_block`` bounds that working set for very large batches."""
    n = X.shape[0]
    units = leaf_units(int(forest.size.max(initial=0)), forest.max_depth)
    total = np.zeros(n, dtype=np.int64)
    block = tree_block or max(1, min(forest.trees, 4_000_000 // max(n, 1)))
    cols = np.arange(n)[None, :]
    for t0 in range(0, forest.trees, block):
        feat = forest.feature[t0:t0 + block]
        thr = forest.threshold[t0:t0 + block]
        size = forest.size[t0:t0 + block]
        tt = np.arange(feat.shape[0])[:, None]
        idx = np.ones((feat.shape[0], n), dtype=np.int64)
        depth = np.zeros((feat.shape[0], n), dtype=np.int64)
        for _ in range(forest.max_depth):
            f = feat[tt, idx]
            internal = f >= 0
            if not internal.any():
                break
            x = X[cols, np.where(internal, f, 0)]
            go = internal & (x > thr[tt, idx])
            idx = np.where(internal, 2 * idx + go, idx)
            depth += internal
        total += units[depth, size[tt, idx]].sum(axis=0)
    return total


def scores_from_units(total: np.ndarray, trees: int, psi: int) -> np.ndarray:
    """-2^(-mean path / c(psi)), from summed fixed-point units."""
    cpsi = c_factor(psi)
    mean = (total.astype(np.float64) / float(FIXED_POINT)) / trees
    if cpsi == 0.0:
        return np.full(len(total), -1.0)
    return -np.power(2.0, -mean / cpsi)


def score_matrix(forest: Forest, X: np.ndarray) -> np.ndarray:
    return scores_from_units(path_units(forest, X), forest.trees, forest.psi)


def linear_quantile(values: np.ndarray, q: float) -> float:
    """Linear-interpolation quantile (a + (b - a) * frac), as exact_quantile."""
    v = np.sort(values)
    pos = q * (len(v) - 1)
    k = math.floor(pos)
    frac = pos - k
    a = float(v[k])
    b = float(v[min(k + 1, len(v) - 1)])
    return a + (b - a) * frac if frac > 0 else a


# --------------------------------------------------------------- the model
@dataclass
class ForestModel:
    features: list[str]
    forest: Forest
    seed: int
    contamination: float | None = None
    offset: float | None = None
    scale_mean: list[float] | None = None
    scale_std: list[float] | None = None
    meta: dict = field(default_factory=dict)
    #: sparse models: the (slot, category) of each of ``features``, which are
    #: then the indices the forest splits on; ``vector`` names the column
    indices: list[tuple[int, str]] | None = None
    vector: str | None = None

    def transform_matrix(self, X: np.ndarray) -> np.ndarray:
        if self.scale_mean is None:
            return X
        return (X - np.asarray(self.scale_mean)) / np.asarray(self.scale_std)


# -------------------------------------------------------------- M1 scaler
def fit_scaler(df: DataFrame, features: list[str]) -> DataFrame:
    """M1 fit: one row of population mean and std per feature (a constant
    column gets std 1, so it maps to 0).  One global aggregate: partial
    sums per task, a single tiny final merge."""
    aggs = []
    for f in features:
        aggs += [F.avg(f).alias(f"{f}__mean"), F.stddev_pop(f).alias(f"{f}__std")]
    stats = df.agg(*aggs)
    return stats.select(*[c for f in features for c in (
        F.col(f"{f}__mean"),
        F.when(F.coalesce(F.col(f"{f}__std"), F.lit(0.0)) == 0.0, F.lit(1.0))
         .otherwise(F.col(f"{f}__std")).alias(f"{f}__std"))])


def transform_scaler(df: DataFrame, stats: DataFrame, features: list[str]) -> DataFrame:
    """M1 transform: ``(x - mean) / std`` with the fitted statistics (one row,
    2 numbers per feature) inlined as literals -- a projection, no join."""
    row = stats.first()
    return df.withColumns({f: (F.col(f) - F.lit(row[f"{f}__mean"])) / F.lit(row[f"{f}__std"])
                           for f in features})


def scale(df: DataFrame, features: list[str]) -> DataFrame:
    """M1 fit + transform."""
    return transform_scaler(df, fit_scaler(df, features), features)


# ---------------------------------------------------------------- M4 quantile
def exact_quantile(df: DataFrame, column: str, q: float, bins: int = QUANTILE_BINS,
                   accuracy: int = SKETCH_ACCURACY) -> float | None:
    """Exact linear-interpolation quantile of a column, in two passes over it.

    1. A mergeable quantile sketch (with count) brackets the rank: two values
       that surely lie on either side of it, about 6 n / accuracy rows apart.
    2. One counting pass: rows below the bracket, and the rows of each value in
       it.  Ties are one entry, so the table is small however they lie; it is
       checkpointed, and no copy of the column is kept.

    The rank is then found in that table: in the driver if it has at most
    ``BRACKET_ROWS`` entries, else by counting in ``bins`` bins, the one with the
    rank becoming the next range.  Nulls and NaN are left out."""
    spark = df.sparkSession
    base = df.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    slack = 3.0 / accuracy
    ends = F.percentile_approx("x", [max(0.0, q - slack), min(1.0, q + slack)], accuracy)
    n, least, most, mid = base.agg(F.count("x"), F.min("x"), F.max("x"), ends).first()
    if not n:
        return None
    pos = q * (n - 1)
    k = math.floor(pos)
    frac = pos - k
    # the sketch's ends are ranks within n / accuracy; few rows need the true ends
    lo = least if q - slack <= 0 or k < 2 else mid[0]
    hi = most if q + slack >= 1 or k + 3 >= n else mid[1]
    ensure_checkpoint_dir(spark)
    while True:
        inside = F.when((F.col("x") >= lo) & (F.col("x") <= hi), F.col("x"))
        counts = base.groupBy(inside.alias("x")).agg(F.count(F.lit(1)).alias("n"),
                                                     F.count_if(F.col("x") < lo).alias("below")).checkpoint()
        first = counts.agg(F.sum("below"), F.sum(F.when(F.col("x").isNotNull(), F.col("n"))),
                           F.count("x")).first()
        below, held, entries = first[0], first[1] or 0, first[2]
        if below <= k and (below + held > k + 1 or hi == most):
            break
        lo, hi = least, most  # never seen; the sketch's promise covers it
    table = counts.where(F.col("x").isNotNull())
    if entries <= BRACKET_ROWS:
        values = sorted((r["x"], r["n"]) for r in table.collect())
        ranks = np.cumsum([c for _, c in values]) + below
        at = int(np.searchsorted(ranks, k, "right"))
        a, upto = float(values[at][0]), int(ranks[at])
        following = float(values[at + 1][0]) if at + 1 < len(values) else a
    else:
        a, upto = _value_at_rank(table, k, lo, hi, held, bins, below)
        following = None
    if frac == 0 or k + 1 < upto:
        return a
    b = following if following is not None else table.where(F.col("x") > a).agg(F.min("x")).first()[0]
    return a + (b - a) * frac


def _value_at_rank(table: DataFrame, rank: int, lo: float, hi: float, n: int, bins: int,
                   below: int = 0) -> tuple[float, int]:
    """(value at a 0-based rank of column x, rows up to that value), for rows
    (x, n) of which ``below`` more lie under ``lo``."""
    while lo < hi:
        # both ends land in different bins; halves keep a huge range finite
        half = 1.0 if math.isfinite(hi - lo) else 0.5
        share = (F.col("x") * half - lo * half) / (hi * half - lo * half)
        which = F.least(F.floor(share * bins), F.lit(bins - 1))
        rows = table.where((F.col("x") >= lo) & (F.col("x") <= hi)).groupBy(which.alias("b")).agg(
            F.sum("n").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        for r in sorted(rows, key=lambda r: r["lo"]):
            if below + r["n"] > rank:
                lo, hi, n = r["lo"], r["hi"], r["n"]
                break
            below += r["n"]
    return float(lo), below + n


# --------------------------------------------------------------- M2 fit
def row_words(seed: int, row_id: F.Column) -> tuple[F.Column, F.Column]:
    """(ka, kb) from md5(seed:row)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))
    word = lambda i: F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long")
    return word(1), word(2)


def tree_draw(tree: F.Column) -> F.Column:
    """(ka + t * kb) mod 2^32 (exact in 64-bit integers)."""
    return F.pmod(F.col("_ka") + tree.cast("long") * F.col("_kb"), F.lit(DRAW_RANGE))


def trees_below(trees: list[int], bound: int):
    """Arrow function (ka, kb) -> the trees whose draw is below ``bound``: one
    numpy comparison per row and tree, in blocks of rows."""
    every = np.array(trees, np.int64)
    step = max(1, 2_000_000 // len(trees))

    @F.arrow_udf("array<int>")
    def _below(ka: pa.Array, kb: pa.Array) -> pa.Array:
        a, b = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (ka, kb))
        counts, hits = [], []
        for i in range(0, len(a), step):
            draw = (a[i:i + step, None] + every * b[i:i + step, None]) & (DRAW_RANGE - 1)
            low = draw < bound
            counts.append(low.sum(axis=1))
            hits.append(every[np.nonzero(low)[1]])
        off = np.concatenate([[0], np.cumsum(np.concatenate(counts or [np.zeros(0, np.int64)]))])
        flat = np.concatenate(hits or [np.zeros(0, np.int64)])
        return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat, pa.int32()))

    return _below


def tree_draw_py(seed: int, tree: int, row_id) -> int:
    h = hashlib.md5(f"{seed}:{row_id}".encode()).hexdigest()
    ka, kb = int(h[8:16], 16), int(h[16:24], 16)
    return (ka + tree * kb) % DRAW_RANGE


@dataclass
class LogSource:
    """A log and how to build its features: ``build`` maps the rows of whole
    groups (batches) to feature rows, whichever other groups there are, so a fit
    can build those of its sample alone.  ``group`` None: row by row."""

    log: DataFrame
    build: Callable[[DataFrame], DataFrame]
    group: str | None = None

    def features(self) -> DataFrame:
        return self.build(self.log)


def _source(df: DataFrame | LogSource) -> LogSource:
    return df if isinstance(df, LogSource) else LogSource(df, lambda d: d)


def sample_for_trees(df: DataFrame, features: list[str], trees: list[int], psi: int, bound: int,
                     seed: int, row_id: str = "seq") -> DataFrame:
    """Per-tree samples as rows (tree, row_id, features...): the psi rows of the
    smallest draws among those below ``bound``, by one aggregate per tree."""
    ka, kb = row_words(seed, F.col(row_id))
    base = df.select(F.col(row_id).alias("row_id"), *features, ka.alias("_ka"), kb.alias("_kb"))
    mine = trees_below(trees, bound)(F.col("_ka"), F.col("_kb"))
    pairs = base.select("*", F.explode(mine).alias("tree"))
    drawn = F.struct(tree_draw(F.col("tree")).alias("_u"), "row_id", *features)
    # the bound lets about OVERSAMPLE x psi rows of a tree through
    lowest = F.slice(F.array_sort(F.collect_list(drawn)), 1, psi)
    return pairs.groupBy("tree").agg(lowest.alias("_s")).select("tree", F.explode("_s").alias("_s")) \
        .select("tree", "_s.row_id", *[F.col(f"_s.{f}").alias(f) for f in features])


def draw_sample(src: LogSource, trees: int, psi: int, n: int, seed: int, row_id: str) -> DataFrame:
    """Durable (tree, row_id[, group]) rows of every tree's sample."""
    ensure_checkpoint_dir(src.log.sparkSession)
    extra = [src.group] if src.group and src.group != row_id else []
    done, todo = None, list(range(trees))
    bound = min(DRAW_RANGE, OVERSAMPLE * psi * DRAW_RANGE // n + 1)
    while todo:
        part = sample_for_trees(src.log, extra, todo, psi, bound, seed, row_id).checkpoint()
        have = {r["tree"]: r["count"] for r in part.groupBy("tree").count().collect()}
        short = [t for t in todo if have.get(t, 0) < psi] if bound < DRAW_RANGE else []
        full = part if not short else part.where(~F.col("tree").isin(short))
        done = full if done is None else done.unionByName(full)
        todo, bound = short, min(DRAW_RANGE, bound * 8)
    return done


NODE_SCHEMA = "tree int, node int, feature int, threshold double, size long"
SPARSE_NODE_SCHEMA = "tree int, node int, slot int, category string, threshold double, size long"


def fit(df: DataFrame | LogSource, features: list[str] | str, trees: int = 100, psi: int = 256,
        seed: int = 42, contamination: float | None = None, scale_features: bool = False,
        row_id: str = "seq", layout: sparse.Layout | None = None) -> ForestModel:
    """M2 (+ M1, M4): fit a forest on ``df``, a feature frame or a
    :class:`LogSource`; with ``contamination`` also the score threshold (the
    quantile of the training scores).  With a ``layout``, ``features`` names a
    sparse vector column."""
    src = _source(df)
    if layout is not None and scale_features:
        raise ValueError("sparse features are not scaled; splits do not depend on scale")
    mean = std = None
    if scale_features:
        stats = fit_scaler(src.features(), features).first()
        mean = [float(stats[f"{f}__mean"] or 0.0) for f in features]
        std = [float(stats[f"{f}__std"]) for f in features]
    n = src.log.select(row_id).count()
    if n == 0:
        raise ValueError("cannot fit a forest on an empty frame")
    psi_eff = min(psi, n)
    depth = max_depth_for(psi_eff)

    sample = draw_sample(src, trees, psi_eff, n, seed, row_id)
    group = src.group or row_id
    wanted = sample.select(F.col("row_id" if group == row_id else group).alias(group))
    # at most trees x psi groups, whatever the log's size
    rows = src.build(src.log.join(F.broadcast(wanted), group, "left_semi"))
    vector = features if layout is not None else None
    cols = [F.col(vector)] if vector else [F.col(f).cast("double") for f in features]
    rows = rows.select(F.col(row_id).alias("row_id"), *cols)
    grown = F.broadcast(sample.select("tree", "row_id")).join(rows, "row_id").groupBy("tree")
    if vector:
        forest, indices = _grow_sparse(grown, vector, trees, depth, psi_eff, seed)
        names = [layout.name(*i) for i in indices]
        model = ForestModel(names, forest, seed, contamination, indices=indices, vector=vector)
    else:
        forest = _grow_dense(grown, features, trees, depth, psi_eff, seed, mean, std)
        model = ForestModel(list(features), forest, seed, contamination, None, mean, std, {})
    if contamination is not None:
        # scored once: the quantile's passes read the scores, not the scoring stage
        scored = score(src.features(), model, row_id=row_id).select("score").checkpoint(eager=True)
        model.offset = exact_quantile(scored, "score", contamination)
    return model


def _nodes_of(fo: Forest, tree: int) -> pd.DataFrame:
    node = np.arange(fo.feature.shape[1])
    keep = (fo.size[0] > 0) | (fo.feature[0] >= 0)
    return pd.DataFrame({"tree": tree, "node": node[keep].astype(np.int32),
                         "feature": fo.feature[0][keep].astype(np.int32),
                         "threshold": fo.threshold[0][keep], "size": fo.size[0][keep]})


def _grow_dense(grown, features: list[str], trees: int, depth: int, psi: int, seed: int,
                mean: list[float] | None, std: list[float] | None) -> Forest:
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        X = pdf.sort_values("row_id")[features].to_numpy(dtype=np.float64)
        if mean is not None:
            X = (X - np.asarray(mean)) / np.asarray(std)
        return _nodes_of(build_forest(X[None, :, :], seed, (t,), depth, psi), t)

    return forest_from_nodes(grown.applyInPandas(grow, NODE_SCHEMA).toPandas(), trees, depth, psi)


def _grow_sparse(grown, vector: str, trees: int, depth: int, psi: int,
                 seed: int) -> tuple[Forest, list[tuple[int, str]]]:
    """Grow each tree on the indices of its own sample, in feature order; the
    node table names them, and the forest's features are those it splits on."""
    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by("row_id")
        t = table.column("tree")[0].as_py()
        X, indices = sparse.local_matrix(table.column(vector))
        nodes = _nodes_of(build_forest(X[None, :, :], seed, (t,), depth, psi), t)
        at = [indices[f] if f >= 0 else (-1, "") for f in nodes["feature"]]
        return pa.table({"tree": nodes["tree"].astype("int32"), "node": nodes["node"],
                         "slot": pa.array([i for i, _ in at], pa.int32()),
                         "category": pa.array([c for _, c in at], pa.string()),
                         "threshold": nodes["threshold"], "size": nodes["size"]})

    nodes = grown.applyInArrow(grow, SPARSE_NODE_SCHEMA).toPandas()
    split = nodes["slot"] >= 0
    indices = sorted({(int(a), c) for a, c in zip(nodes["slot"][split], nodes["category"][split])})
    number = {i: j for j, i in enumerate(indices)}
    nodes["feature"] = [number.get((int(a), c), -1) for a, c in zip(nodes["slot"], nodes["category"])]
    return forest_from_nodes(nodes, trees, depth, psi), indices


def fit_predict(df: DataFrame | LogSource, features: list[str] | str, contamination: float,
                trees: int = 100, psi: int = 256, seed: int = 42, scale_features: bool = False,
                row_id: str = "seq", out: str = "is_anomaly", score_col: str = "score",
                layout: sparse.Layout | None = None) -> tuple[ForestModel, DataFrame]:
    """M2-M5 in one go: fit, score every row once, threshold, flag.

    The scored frame is checkpointed to the shared folder named by
    ``spark.checkpoint.dir`` (set locally only when unset), so the threshold
    passes and the flags read the scores instead of re-running the Python
    scoring stage, and a lost executor re-reads files rather than re-scoring."""
    src = _source(df)
    model = fit(src, features, trees=trees, psi=psi, seed=seed, contamination=None,
                scale_features=scale_features, row_id=row_id, layout=layout)
    model.contamination = contamination
    ensure_checkpoint_dir(src.log.sparkSession)
    scored = score(src.features(), model, out=score_col, row_id=row_id).checkpoint(eager=True)
    model.offset = exact_quantile(scored, score_col, contamination)
    return model, scored.withColumn(out, F.col(score_col) < F.lit(model.offset))


def forest_from_nodes(nodes: pd.DataFrame, trees: int, depth: int, psi: int) -> Forest:
    n_nodes = 2 ** (depth + 1)
    feature = np.full((trees, n_nodes), -1, dtype=np.int64)
    threshold = np.zeros((trees, n_nodes))
    size = np.zeros((trees, n_nodes), dtype=np.int64)
    t = nodes["tree"].to_numpy(dtype=np.int64)
    nd = nodes["node"].to_numpy(dtype=np.int64)
    feature[t, nd] = nodes["feature"].to_numpy(dtype=np.int64)
    threshold[t, nd] = nodes["threshold"].to_numpy(dtype=np.float64)
    size[t, nd] = nodes["size"].to_numpy(dtype=np.int64)
    return Forest(feature, threshold, size, psi, depth)


# ---------------------------------------------------------- M3, M5 scoring
def score(df: DataFrame, model: ForestModel, out: str = "score", row_id: str = "seq") -> DataFrame:
    """M3: add the anomaly score (lower = more anomalous).  Only the feature
    columns cross to Python, in Arrow batches; the forest travels once per
    executor as a broadcast variable."""
    spark = df.sparkSession
    fo = model.forest
    if model.vector is not None:
        return df.withColumn(out, _sparse_scorer(spark, model)(F.col(model.vector)))
    # plain arrays only: broadcast values are pickled by reference-free pickle
    bc = spark.sparkContext.broadcast((fo.feature, fo.threshold, fo.size, fo.psi, fo.max_depth,
                                       model.scale_mean, model.scale_std))

    @F.pandas_udf(T.DoubleType())
    def _score(*cols: pd.Series) -> pd.Series:
        feature, threshold, size, psi, depth, mean, std = bc.value
        X = np.column_stack([c.to_numpy(dtype=np.float64, na_value=0.0) for c in cols])
        if mean is not None:
            X = (X - np.asarray(mean)) / np.asarray(std)
        return pd.Series(score_matrix(Forest(feature, threshold, size, psi, depth), X))

    return df.withColumn(out, _score(*[F.col(f).cast("double") for f in model.features]))


def _sparse_scorer(spark: SparkSession, model: ForestModel):
    """Arrow function of a vector column; the forest and the indices it splits
    on (bounded by its nodes) travel as a broadcast variable."""
    fo = model.forest
    bc = spark.sparkContext.broadcast((fo.feature, fo.threshold, fo.size, fo.psi, fo.max_depth, model.indices))

    @F.arrow_udf(T.DoubleType())
    def _score(vectors: pa.Array) -> pa.Array:
        feature, threshold, size, psi, depth, indices = bc.value
        forest = Forest(feature, threshold, size, psi, depth)
        used = {i: j for j, i in enumerate(indices)}
        parts = [score_matrix(forest, m) for _, m in sparse.filled(vectors, used)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return _score


def predict(df: DataFrame, model: ForestModel, out: str = "is_anomaly",
            score_col: str = "score") -> DataFrame:
    """M5: anomaly iff score < threshold (strict)."""
    if model.offset is None:
        raise ValueError("model has no threshold: fit with contamination=")
    d = df if score_col in df.columns else score(df, model, score_col)
    return d.withColumn(out, F.col(score_col) < F.lit(model.offset))


# ------------------------------------------------------- M6 per-batch fits
BATCH_GROUP = 64


MASK_ROWS = 62            # rows of a batch whose subsets fit an integer
MASK_NODES = 1 << 11      # root nodes that are grown at a time


def _top(bits: np.ndarray) -> np.ndarray:
    """Number of the highest bit set (1 or more is set)."""
    exact = (bits & ~(bits >> 1)).astype(np.float64)  # cannot round up to the next power
    return (exact.view(np.int64) >> 52) - 1023


def _stacked_units(X: np.ndarray, trees: int, seed: int, depth: int) -> np.ndarray:
    """Summed path units of (batches, rows, features), every batch's trees grown
    on all of its rows, at most MASK_ROWS.

    A node is a set of rows: one integer per feature, bit i of which is the row
    at place i of that feature's order.  A split on feature f cuts every one of
    them by the set of rows above a place of f's order, from a table, so a level
    costs a few integer operations per node instead of a sort of its rows."""
    batches, n, _ = X.shape
    n_nodes = 2 ** (depth + 1)
    uf, us = draw_tables(seed, tuple(range(trees)), n_nodes)
    varies = (X != X[:, :1]).any(axis=(0, 1))                      # no other splits a node
    varies[0] |= not varies.any()
    X = X[:, :, varies]
    n_feat = X.shape[2]
    kind = np.int32 if n <= 30 else np.int64
    cols = np.ascontiguousarray(X.transpose(0, 2, 1))              # batch, feature, row
    order = np.argsort(cols, axis=2, kind="stable")
    sorted_ = np.take_along_axis(cols, order, axis=2)
    bit = np.left_shift(kind(1), np.argsort(order, axis=2).astype(kind))    # of row r in each order
    # above[b, f, k, g]: in g's order, the rows at places k and up of f's order
    above = np.zeros((batches, n_feat, n + 1, n_feat), kind)
    b_at = np.arange(batches)[:, None, None]
    mine = bit.transpose(0, 2, 1)[b_at, order]                     # batch, f, place, g
    above[:, :, :n] = np.cumsum(mine[:, :, ::-1], axis=2)[:, :, ::-1]
    # places at which a new value begins; a node that holds NaN has no range
    fresh = np.ones(sorted_.shape, bool)
    fresh[:, :, 1:] = sorted_[:, :, 1:] != sorted_[:, :, :-1]
    place = np.left_shift(kind(1), np.arange(n, dtype=kind))
    starts = (fresh * place).sum(axis=2, dtype=kind)
    nan = (np.isnan(sorted_) * place).sum(axis=2, dtype=kind)
    nan = nan if nan.any() else None
    above, table = above.reshape(-1, n_feat), sorted_.reshape(-1, n)
    units = leaf_units(n, depth)
    total = np.zeros(batches * n)                                  # whole numbers below 2^53
    batch = np.repeat(np.arange(batches), trees)
    tree = np.tile(np.arange(trees), batches)
    node = np.ones(batches * trees, np.int64)
    sets = np.full((len(batch), n_feat), (1 << n) - 1, kind)
    for level in range(depth + 1):
        size = np.bitwise_count(sets[:, 0]).astype(np.int64)
        split = np.zeros(len(sets), bool)
        if level < depth:
            many = np.flatnonzero(size > 1)
            m = sets[many]
            low = m & -m
            # the next value's first place after the node's lowest row
            later = starts[batch[many]] & -(low << 1)
            later &= -later
            cand = (later != 0) & (m >= later)
            if nan is not None:
                cand &= (m & nan[batch[many]]) == 0
            cand = np.ascontiguousarray(cand.T)                    # feature, node
            ncand = cand.sum(axis=0)
            some = ncand > 0
            many, m, cand, ncand = many[some], m[some], cand[:, some], ncand[some]
            split[many] = True
        leaf = np.flatnonzero(~split)
        at, rest, worth = batch[leaf], sets[leaf, 0], units[level, size[leaf]]
        while len(rest):
            row = order[at, 0, _top(rest & -rest)]
            total += np.bincount(at * n + row, weights=worth, minlength=len(total))
            rest = rest & (rest - 1)
            more = rest != 0
            at, rest, worth = at[more], rest[more], worth[more]
        if not split.any():
            break
        b, t, nd = batch[many], tree[many], node[many]
        left = np.floor(uf[t, nd] * ncand).astype(np.int64)        # candidates before the drawn one
        chosen = (np.cumsum(cand, axis=0) <= left).sum(axis=0)
        own = m[np.arange(len(m)), chosen]
        which = b * n_feat + chosen
        values = table[which]
        i = np.arange(len(m))
        lo, hi = values[i, _top(own & -own)], values[i, _top(own)]
        thr = lo + us[t, nd] * (hi - lo)
        over = (values > thr[:, None]).sum(axis=1)
        if nan is not None:                                        # NaN is at the end and above nothing
            over += np.where(np.isnan(thr), 0, np.bitwise_count(nan.reshape(-1)[which]).astype(np.int64))
        right = m & above[which * (n + 1) + n - over]
        sets = np.concatenate([m ^ right, right])
        batch, tree = np.concatenate([b, b]), np.concatenate([t, t])
        node = np.concatenate([2 * nd, 2 * nd + 1])
        held = sets[:, 0] != 0
        if not held.all():
            sets, batch, tree, node = sets[held], batch[held], tree[held], node[held]
    return total.reshape(batches, n).astype(np.int64)


def score_stacked(X: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """Scores of (batches, rows, features): each batch's forest is fitted on all
    of its rows and scores them; all batches' trees grow in one pass, and a
    row's path ends at the leaf it was grown into."""
    batches, n, n_feat = X.shape
    depth = max_depth_for(n)
    if n <= MASK_ROWS:
        step = max(1, MASK_NODES // trees)
        total = np.concatenate([_stacked_units(X[i:i + step], trees, seed, depth)
                                for i in range(0, batches, step)])
        return scores_from_units(total.reshape(-1), trees, n).reshape(batches, n)
    samples = np.repeat(X, trees, axis=0)
    fo, node = build_forest(samples, seed, tuple(range(trees)), depth, n, with_nodes=True)
    level = np.floor(np.log2(node)).astype(np.int64)
    tree = np.arange(batches * trees)[:, None]
    units = leaf_units(n, depth)[level, fo.size[tree, node]]
    total = units.reshape(batches, trees, n).sum(axis=1)
    return scores_from_units(total.reshape(-1), trees, n).reshape(batches, n)


def _score_batch(X: np.ndarray, rid: np.ndarray, trees: int, psi: int, seed: int) -> np.ndarray:
    """One batch of more rows than psi: sampled trees, then scored."""
    keys = np.array([[tree_draw_py(seed, t, r) for r in rid] for t in range(trees)])
    samples = X[np.argsort(keys, axis=1, kind="stable")[:, :psi]]
    fo = build_forest(np.ascontiguousarray(samples), seed, tuple(range(trees)),
                      max_depth_for(psi), psi)
    return score_matrix(fo, X)


def fit_score_batches(df: DataFrame, features: list[str], batch: str = "batch_id",
                      trees: int = 100, psi: int = 256, contamination: float = 0.15,
                      seed: int = 42, scale_features: bool = False,
                      seq: str = "seq") -> DataFrame:
    """M6: for every batch, fit a forest on the batch, score it and flag scores
    below the batch's contamination quantile.  Isolation splits do not depend
    on a feature's scale, so scaling (M1, per batch) is an option only.

    Groups of ``BATCH_GROUP`` consecutive batches go to one ``applyInPandas``
    call (bounded: BATCH_GROUP x batch size rows); inside, the batches of one
    size are fitted together."""
    cols = [seq, batch, *features]
    d = df.select(*[F.col(c) for c in cols]).withColumn(
        "_grp", F.floor(F.col(batch) / BATCH_GROUP))

    def per_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([batch, seq], ignore_index=True)
        X = pdf[features].to_numpy(dtype=np.float64, na_value=0.0)
        ids = pdf[batch].to_numpy()
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        size = np.diff(np.r_[first, len(ids)])
        if scale_features:
            for a, n in zip(first, size):
                sd = X[a:a + n].std(axis=0)
                X[a:a + n] = (X[a:a + n] - X[a:a + n].mean(axis=0)) / np.where(sd == 0, 1.0, sd)
        score, flag = np.zeros(len(pdf)), np.zeros(len(pdf), bool)
        for n in np.unique(size):
            starts = first[size == n]
            at = starts[:, None] + np.arange(n)[None, :]
            if n <= psi:
                s = score_stacked(X[at], trees, seed)
            else:
                rid = pdf[seq].to_numpy()
                s = np.stack([_score_batch(X[i], rid[i], trees, psi, seed) for i in at])
            thr = np.array([linear_quantile(r, contamination) for r in s])
            score[at], flag[at] = s, s < thr[:, None]
        return pd.DataFrame({seq: pdf[seq], batch: pdf[batch], "score": score, "is_anomaly": flag})

    schema = f"{seq} long, {batch} long, score double, is_anomaly boolean"
    d = d.repartition(groups_partitions(d), "_grp")
    return d.groupBy("_grp").applyInPandas(per_group, schema)


# ------------------------------------------------------------ S5 persistence
MISSING_PATH = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")
VERSIONS_KEPT = 5


def save_model(spark: SparkSession, model: ForestModel, path: str, keep: int = VERSIONS_KEPT) -> str:
    """Write a new version of the model at ``path`` and return its name.

    A version is a folder of its own (node table and a one-row parameter table);
    the pointer, one more row in the ``versions`` table, is written last and in
    one file, so a reader gets the old model or the new one, whole.  A save that
    dies before leaves nothing a reader sees.  Versions beyond the newest
    ``keep`` are removed, after the pointer."""
    fo = model.forest
    t, nd = np.nonzero((fo.size > 0) | (fo.feature >= 0))
    nodes = pd.DataFrame({"tree": t.astype(np.int32), "node": nd.astype(np.int32),
                          "feature": fo.feature[t, nd].astype(np.int32),
                          "threshold": fo.threshold[t, nd], "size": fo.size[t, nd]})
    params = {"features": model.features, "psi": fo.psi, "trees": fo.trees,
              "max_depth": fo.max_depth, "seed": model.seed,
              "contamination": model.contamination, "offset": model.offset,
              "scale_mean": model.scale_mean, "scale_std": model.scale_std,
              "indices": model.indices, "vector": model.vector}
    version = f"v-{uuid.uuid4().hex}"
    at = os.path.join(path, version)
    spark.createDataFrame(nodes, NODE_SCHEMA).coalesce(1).write.parquet(os.path.join(at, "nodes"))
    spark.createDataFrame([(json.dumps(params),)], "params string").coalesce(1) \
        .write.parquet(os.path.join(at, "params"))
    older = model_versions(spark, path)
    number = older[0][0] + 1 if older else 1
    spark.createDataFrame([(number, version)], "number long, version string").coalesce(1) \
        .write.mode("append").parquet(os.path.join(path, "versions"))
    for _, name in older[max(keep - 1, 0):]:
        files.remove(spark, os.path.join(path, name))
    return version


def model_versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of the saved versions, the newest first."""
    from pyspark.errors import AnalysisException
    try:
        rows = spark.read.schema("number long, version string").parquet(os.path.join(path, "versions")).collect()
    except AnalysisException as e:
        if e.getCondition() not in MISSING_PATH:
            raise
        return []
    return sorted(((r["number"], r["version"]) for r in rows), reverse=True)


def load_model(spark: SparkSession, path: str, version: str | None = None) -> ForestModel | None:
    """The newest saved version (or the named one); None if there is none."""
    if version is None:
        versions = model_versions(spark, path)
        if not versions:
            return None
        version = versions[0][1]
    at = os.path.join(path, version)
    params = json.loads(spark.read.parquet(os.path.join(at, "params")).first()[0])
    nodes = spark.read.parquet(os.path.join(at, "nodes")).toPandas()
    forest = forest_from_nodes(nodes, params["trees"], params["max_depth"], params["psi"])
    indices = params.get("indices")
    return ForestModel(params["features"], forest, params["seed"], params["contamination"],
                       params["offset"], params["scale_mean"], params["scale_std"],
                       indices=[(i, c) for i, c in indices] if indices is not None else None,
                       vector=params.get("vector"))


def fit_local_frame(spark: SparkSession, pdf: pd.DataFrame, features: list[str],
                    **kw) -> ForestModel:
    """Bootstrap a model from a small literal frame (the monitor's
    2-row baseline); a real deployment fits on a history table instead."""
    d = spark.createDataFrame(pdf.reset_index(drop=True).reset_index().rename(
        columns={"index": "seq"}))
    return fit(d, features, **kw)
