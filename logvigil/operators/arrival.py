"""The arrival index: dense numbers of a log's rows, whatever its sequence.

``seq`` tells the order of arrival, but a log may have gaps in it (lost or late
files, filtered rows) or start anywhere.  Batches, histories and positions are
counted in rows, so every operator that numbers batches reads the same index:

* a log without gaps (its rows are as many as its range of ``seq``) needs no
  table; a row's rank is ``seq - first``, a projection;
* otherwise the index is a table with one row per chunk of ``seq`` (first and
  last ``seq``, rows, rows before), checkpointed or saved by the caller.  Chunks
  without gaps are numbered by arithmetic as well; only the rows of chunks with
  gaps are shuffled, by chunk, and ranked there.

``seq`` must be unique.  Rows without one have no place in the log: they get no
rank.  No task holds more than a chunk of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logvigil.session import ensure_checkpoint_dir

CHUNK_ROWS = 1_000_000
CHUNK_SCHEMA = "_chunk long, _first long, _last long, _rows long, _before long"


@dataclass
class ArrivalIndex:
    """``rows`` in all, the smallest ``seq`` is ``first``; ``chunks`` is None for
    a log without gaps."""

    rows: int
    first: int
    chunk_rows: int = CHUNK_ROWS
    chunks: DataFrame | None = None

    def save(self, path: str) -> None:
        """Persist the index: one row per chunk (a log without gaps: one)."""
        spark = SparkSession.active()
        table = self.chunks if self.chunks is not None else spark.createDataFrame(
            [(None, self.first, self.first + self.rows - 1, self.rows, 0)], CHUNK_SCHEMA)
        table.withColumn("_size", F.lit(self.chunk_rows)).write.mode("errorifexists").parquet(path)


def load(spark: SparkSession, path: str) -> ArrivalIndex:
    t = spark.read.parquet(path)
    rows, first, size, named = t.agg(F.sum("_rows"), F.min("_first"), F.max("_size"), F.count("_chunk")).first()
    return ArrivalIndex(rows or 0, first or 0, size or CHUNK_ROWS, t.drop("_size") if named else None)


def ranked_already(rows: int = 0, first: int = 0) -> ArrivalIndex:
    """The index of a frame whose ``seq`` is its rank (plus ``first``)."""
    return ArrivalIndex(rows, first)


def build(df: DataFrame, seq: str = "seq", chunk_rows: int = CHUNK_ROWS) -> ArrivalIndex:
    """Count a log: one aggregate over ``seq``, and one more if it has gaps."""
    s = F.col(seq)
    n, lo, hi = df.agg(F.count(s), F.min(s), F.max(s)).first()
    if not n or hi - lo + 1 == n:
        return ArrivalIndex(n, lo or 0, chunk_rows)
    per = df.where(s.isNotNull()).groupBy(F.floor(s / F.lit(chunk_rows)).cast("long").alias("_chunk")).agg(
        F.min(s).alias("_first"), F.max(s).alias("_last"), F.count(s).alias("_rows"))
    ensure_checkpoint_dir(df.sparkSession)
    per = per.checkpoint()
    before = Window.partitionBy(F.lit(0)).orderBy("_chunk")  # one row per chunk
    table = per.withColumn("_before", F.sum("_rows").over(before) - F.col("_rows")).checkpoint()
    return ArrivalIndex(n, lo, chunk_rows, table)


def number(df: DataFrame, index: ArrivalIndex | None = None, seq: str = "seq",
           out: str = "rank") -> DataFrame:
    """Add the 0-based rank of every row that has a ``seq``."""
    index = build(df, seq) if index is None else index
    s = F.col(seq)
    rows = df.where(s.isNotNull())
    if index.chunks is None:
        return rows.withColumn(out, s - F.lit(index.first))
    chunks = index.chunks.withColumn("_gaps", F.col("_last") - F.col("_first") + 1 != F.col("_rows"))
    d = rows.withColumn("_chunk", F.floor(s / F.lit(index.chunk_rows)).cast("long")).join(chunks, "_chunk")
    whole = d.where("not _gaps").withColumn(out, F.col("_before") + s - F.col("_first"))
    own = Window.partitionBy("_chunk").orderBy(seq)
    broken = d.where("_gaps").withColumn(out, F.col("_before") + F.row_number().over(own) - 1)
    return whole.unionByName(broken).drop(*[c for c in chunks.columns if c != out])


def with_batches(df: DataFrame, size: int, index: ArrivalIndex | None = None, seq: str = "seq",
                 batch: str = "batch_id", position: str | None = None) -> DataFrame:
    """Add the count batch (``rank div size``) and, if named, the position in it."""
    d = number(df, index, seq, "_rank")
    d = d.withColumn(batch, F.floor(F.col("_rank") / F.lit(size)).cast("long"))
    if position:
        d = d.withColumn(position, (F.col("_rank") % size).cast("long"))
    return d.drop("_rank")
