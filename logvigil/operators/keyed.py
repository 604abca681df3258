"""Running per-key computations that survive a hot key.

A plain ``Window.partitionBy(ip).orderBy(seq)`` puts every row of one IP into
one task; if one IP holds a third of 100 TB that task never finishes.  Only such
keys need more than the plain window, so they are found first:

* *Heavy hitters.*  One row in ``SAMPLE`` (by a hash of ``seq``) is counted per
  key; a key with more than half of ``chunk_rows`` rows' worth of them is hot.
  There are at most ``2 rows / chunk_rows`` hot keys, whatever the data, so their
  table is broadcast.  A wrong guess costs time only, never a result.
* *Cold keys* have chunk -1: one plain window per key, and no second table.
* *Hot keys* are cut along ``seq`` into chunks of about ``chunk_rows`` of their
  own rows (the width follows from the key's sampled rows and range).  Windows
  run per (key, chunk), and each chunk gets an offset (sum / max / last value of
  the key's earlier chunks) from a table with one row per hot key and chunk.

The large side is shuffled once, by (key, chunk); the join back is on the same
columns.  A NULL key is a key like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CHUNK_ROWS = 4_000_000
SAMPLE = 64

_CH, _KEY, _HOT = "_chunk", "_key", "_hot"
_COLD = -1


def _key(key: str) -> Column:
    """The key as text that is never NULL, so equal keys join, NULL included."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))


def heavy_hitters(df: DataFrame, key: str, seq: str = "seq",
                  chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """(key text, chunk width) of the keys that are cut into chunks."""
    picked = F.pmod(F.xxhash64(F.col(seq)), F.lit(SAMPLE)) == 0
    seen = df.where(picked).groupBy(_key(key).alias("_hk")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(seq).alias("_lo"), F.max(seq).alias("_hi"))
    # about chunk_rows rows of the key, and never more than 64 x chunk_rows of a dense stretch
    width = (F.col("_hi") - F.col("_lo") + 1) * F.lit(chunk_rows / SAMPLE) / F.col("_n")
    width = F.greatest(F.lit(float(chunk_rows)), F.least(F.lit(64.0 * chunk_rows), width))
    return seen.where(F.col("_n") > chunk_rows // (2 * SAMPLE)).select("_hk", width.cast("long").alias("_width"))


def _with_chunk(df: DataFrame, key: str, seq: str, chunk_rows: int) -> DataFrame:
    heavy = heavy_hitters(df, key, seq, chunk_rows)
    d = df.withColumn(_KEY, _key(key))
    d = d.join(F.broadcast(heavy), d[_KEY] == heavy["_hk"], "left")  # at most 2 rows / chunk_rows keys
    return d.withColumns({
        _CH: F.when(F.col("_width").isNull(), F.lit(_COLD)).otherwise(F.floor(F.col(seq) / F.col("_width"))).cast("long"),
        _HOT: F.col("_width").isNotNull()}).drop("_hk", "_width")


def _join_back(d: DataFrame, small: DataFrame) -> DataFrame:
    """Offsets to the rows of hot keys (cold ones find none)."""
    return d.join(small, [_KEY, _CH], "left")


def _window(seq: str):
    return Window.partitionBy(_KEY, _CH).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)


def running_sums(df: DataFrame, key: str, sums: dict[str, Column], seq: str = "seq",
                 chunk_rows: int = DEFAULT_CHUNK_ROWS,
                 firsts: dict[str, Column] | None = None,
                 maxes: dict[str, Column] | None = None) -> DataFrame:
    """Add, per output name, the running sum of a numeric expression over the
    rows of the same ``key`` up to and including the current row (by ``seq``).

    ``firsts`` adds, per name, the expression's value on the key's first row,
    ``maxes`` its running maximum (NULLs ignored); for hot keys both travel in the
    same table as the offsets."""
    firsts, maxes = firsts or {}, maxes or {}
    d = _with_chunk(df, key, seq, chunk_rows)
    w = _window(seq)
    d = d.withColumns({f"_v_{n}": e for n, e in [*sums.items(), *maxes.items(), *firsts.items()]})
    d = d.withColumns({**{f"_l_{n}": F.sum(f"_v_{n}").over(w) for n in sums},
                       **{f"_l_{n}": F.max(f"_v_{n}").over(w) for n in maxes},
                       **{f"_l_{n}": F.first(f"_v_{n}").over(w) for n in firsts}})
    tot = d.where(_HOT).groupBy(_KEY, _CH).agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max(f"_v_{n}").alias(f"_t_{n}") for n in maxes],
        *[F.min_by(f"_v_{n}", F.col(seq)).alias(f"_t_{n}") for n in firsts])
    prev = Window.partitionBy(_KEY).orderBy(_CH).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(_KEY).orderBy(_CH).rowsBetween(Window.unboundedPreceding, 0)
    off = tot.select(_KEY, _CH, *[F.coalesce(F.sum(f"_t_{n}").over(prev), F.lit(0)).alias(f"_o_{n}")
                                  for n in sums],
                     *[F.max(f"_t_{n}").over(prev).alias(f"_o_{n}") for n in maxes],
                     *[F.first(f"_t_{n}").over(upto).alias(f"_o_{n}") for n in firsts])
    out = _join_back(d, off)
    out = out.withColumns({
        **{n: F.col(f"_l_{n}") + F.coalesce(F.col(f"_o_{n}"), F.lit(0)) for n in sums},
        **{n: F.greatest(f"_l_{n}", f"_o_{n}") for n in maxes},
        **{n: F.when(F.col(_HOT), F.col(f"_o_{n}")).otherwise(F.col(f"_l_{n}")) for n in firsts}})
    return out.drop(_CH, _KEY, _HOT, *[f"_{p}_{n}" for n in [*sums, *maxes, *firsts] for p in ("v", "l", "o")])


def running_max(df: DataFrame, key: str, name: str, expr: Column, seq: str = "seq",
                chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Running maximum of ``expr`` per key (NULLs ignored) up to the current row."""
    return running_sums(df, key, {}, seq, chunk_rows, maxes={name: expr})


def previous_value(df: DataFrame, key: str, name: str, expr: Column, seq: str = "seq",
                   chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """``lag(expr)`` per key by ``seq`` across chunk boundaries (NULL on the
    key's first row)."""
    d = _with_chunk(df, key, seq, chunk_rows).withColumn("_v", expr)
    w = Window.partitionBy(_KEY, _CH).orderBy(seq)
    d = d.withColumns({"_lag": F.lag("_v").over(w), "_rn": F.row_number().over(w)})
    last = d.where(_HOT).groupBy(_KEY, _CH).agg(F.max_by("_v", seq).alias("_last"))
    prev = Window.partitionBy(_KEY).orderBy(_CH)
    off = last.select(_KEY, _CH, F.lag("_last").over(prev).alias("_o"))
    out = _join_back(d, off)
    return (out.withColumn(name, F.when(F.col(_HOT) & (F.col("_rn") == 1), F.col("_o")).otherwise(F.col("_lag")))
            .drop(_CH, _KEY, _HOT, "_v", "_lag", "_rn", "_o"))


def key_totals(df: DataFrame, key: str, sums: dict[str, Column], seq: str = "seq",
               chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Per-row group totals (``sum(x) over (partition by key)``) for additive
    expressions: a plain window for cold keys; for hot ones partial sums per
    (key, chunk) and the key's total over that small table."""
    d = _with_chunk(df, key, seq, chunk_rows).withColumns({f"_v_{n}": e for n, e in sums.items()})
    w = Window.partitionBy(_KEY, _CH)
    d = d.withColumns({f"_l_{n}": F.sum(f"_v_{n}").over(w) for n in sums})
    per = d.where(_HOT).groupBy(_KEY, _CH).agg(*[F.sum(f"_v_{n}").alias(f"_p_{n}") for n in sums])
    small = per.select(_KEY, _CH, *[F.sum(f"_p_{n}").over(Window.partitionBy(_KEY)).alias(f"_o_{n}") for n in sums])
    out = _join_back(d, small)
    return out.withColumns({n: F.when(F.col(_HOT), F.col(f"_o_{n}")).otherwise(F.col(f"_l_{n}")) for n in sums}) \
        .drop(_CH, _KEY, _HOT, *[f"_{p}_{n}" for n in sums for p in ("v", "l", "o")])
