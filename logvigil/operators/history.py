"""Sliding histories in count batches, as differences of prefix sums (A10).

The history at the end of batch b is the last ``window_rows`` rows up to there:
``window_rows div size`` whole batches and the last ``window_rows mod size`` rows
of one more.  With the running sums P of a key over its batches,

    history(b) = P(b) - P(b - whole) + late(b - whole)

so nothing is copied per batch.  Batches are cut into chunks of
``chunk_batches``; each chunk also gets the last few batches of the one before
(its halo), so its prefix sums may start at zero, and no task holds more than a
chunk however hot a key is.  All windows of a chunk, those of the batch-wise
features too, share the one exchange by chunk.

Sums are exact decimals of 1e-6 units, so means and deviations do not depend on
the order of summation.  A value of 5e9 and more, or NaN, counts as missing (its row
still counts as a row).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logvigil.functions.partitioning import groups_partitions

CHUNK_BATCHES = 256
LIMIT = 5e9
CHUNK, HALO = "_chunk", "_halo"


def halo_batches(window_rows: int, size: int) -> int:
    return -(-window_rows // size)


def chunked(df: DataFrame, batch: str, window_rows: int, size: int,
            chunk_batches: int = CHUNK_BATCHES) -> DataFrame:
    """``df`` by chunk of batches: adds the chunk and whether the row is there
    for the halo only (drop those in the end)."""
    back = halo_batches(window_rows, size)
    c = max(chunk_batches, back)
    own = F.floor(F.col(batch) / F.lit(c)).cast("long")
    again = F.pmod(F.col(batch), F.lit(c)) >= c - back
    d = df.withColumn(CHUNK, F.explode(F.when(again, F.array(own, own + 1)).otherwise(F.array(own))))
    return d.withColumn(HALO, F.col(CHUNK) != own).repartition(groups_partitions(df), CHUNK)


def exact_units(value: str) -> F.Column:
    """1e-6 units as a decimal; NULL beyond the limit."""
    x = F.col(value).cast("double")
    return F.when(F.abs(x) < LIMIT, F.round(x * 1_000_000)).cast("decimal(18,0)")


def sums_of(value: str) -> dict[str, F.Column]:
    """One row as sums: value rows, sum, sum of squares, rows."""
    x = exact_units(value)
    return {"_n": F.when(x.isNotNull(), 1).otherwise(0).cast("long"),
            "_s": F.coalesce(x, F.lit(0).cast("decimal(18,0)")),
            "_q": F.coalesce((x * x).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")),
            "_rows": F.lit(1).cast("long")}


SUMS = ["_n", "_s", "_q", "_rows"]


def history_sums(d: DataFrame, key: str, batch: str, window_rows: int, size: int) -> DataFrame:
    """Turn the sum columns (``SUMS``, and ``late_*`` for the last rows of a
    batch) of a chunked frame into those of the history at the batch's end."""
    whole, edge = divmod(window_rows, size)
    w = Window.partitionBy(CHUNK, key).orderBy(batch)
    upto = w.rangeBetween(Window.unboundedPreceding, 0)
    before = w.rangeBetween(Window.unboundedPreceding, -whole)
    at = w.rangeBetween(-whole, -whole)
    zero = F.lit(0)
    hist = {}
    for c in SUMS:
        kind = "decimal(38,0)" if c == "_q" else "decimal(28,0)" if c == "_s" else "long"
        h = F.sum(c).over(upto) - F.coalesce(F.sum(c).over(before), zero)
        if edge:
            h = h + F.coalesce(F.sum(f"late{c}").over(at), zero)
        hist[f"h{c}"] = h.cast(kind)
    return d.select("*", *[h.alias(c) for c, h in hist.items()]) \
        .drop(*SUMS, *[f"late{c}" for c in SUMS])


def mean_and_std() -> tuple[F.Column, F.Column]:
    """From the history sums: mean and sample standard deviation."""
    n, s, q = F.col("h_n"), F.col("h_s"), F.col("h_q")
    square = (q * n.cast("decimal(10,0)")).cast("decimal(38,0)") - (s.cast("decimal(19,0)") * s.cast("decimal(19,0)"))
    var = F.when(n > 1, square.cast("double") / (n * (n - 1)).cast("double"))
    return F.try_divide(s.cast("double"), n) / 1e6, F.sqrt(var) / 1e6


def with_history(d: DataFrame, key: str, value: str, batch: str, seq: str, window_rows: int,
                 size: int) -> DataFrame:
    """Row form: every row of a chunked frame gets ``baseline_mean``,
    ``baseline_std`` and ``baseline_rows`` of its key at the end of its batch."""
    pos = F.row_number().over(Window.partitionBy(CHUNK, batch).orderBy(seq)) - 1
    d = d.withColumns(sums_of(value)).withColumn("_late", pos >= size - window_rows % size)
    d = d.withColumns({f"late{c}": F.when(F.col("_late"), F.col(c)) for c in SUMS}).drop("_late")
    mean, std = mean_and_std()
    d = history_sums(d, key, batch, window_rows, size)
    return d.withColumns({"baseline_mean": mean, "baseline_std": std, "baseline_rows": F.col("h_rows")}) \
        .drop(*[f"h{c}" for c in SUMS])


def per_batch(df: DataFrame, key: str, value: str, batch: str, seq: str, window_rows: int,
              size: int, position: F.Column, chunk_batches: int = CHUNK_BATCHES) -> DataFrame:
    """Table form: one row per (batch, key present in it), from one row of sums
    each; ``position`` is the row's place in its batch."""
    late = position >= size - window_rows % size
    d = df.select(batch, key, late.alias("_late"), *[c.alias(n) for n, c in sums_of(value).items()])
    total = lambda c, kind: F.sum(c).cast(kind)
    kinds = {"_n": "long", "_s": "decimal(28,0)", "_q": "decimal(38,0)", "_rows": "long"}
    part = d.groupBy(batch, key).agg(
        *[total(c, kinds[c]).alias(c) for c in SUMS],
        *[total(F.when(F.col("_late"), F.col(c)), kinds[c]).alias(f"late{c}") for c in SUMS])
    mean, std = mean_and_std()
    h = history_sums(chunked(part, batch, window_rows, size, chunk_batches).where(F.col(key).isNotNull()),
                     key, batch, window_rows, size)
    return h.where(~F.col(HALO)).select(batch, key, mean.alias("baseline_mean"),
                                        std.alias("baseline_std"), F.col("h_rows").alias("baseline_rows"))
