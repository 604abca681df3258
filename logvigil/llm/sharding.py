"""Sharding by jump consistent hashing.

``shard = jump(mix64(key), shards)`` depends on the key and the shard count
only; with one more shard a key either stays or moves to the new shard.  Slots
number each shard's rows from 0 without gaps: rows are dealt to buckets by a
hash, each (bucket, shard) is numbered on its own, and its first slot is the
running sum of the (bucket, shard) counts -- no shard is ever gathered in one
task.

Defined results: a null key counts as key 0; a null text is empty; repeated
rows each get a slot of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logvigil.llm.textkit import durable

ROW_OVERHEAD = 8


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread small integer keys over 64 bits (a bijection)."""
    x = x.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of uint64 keys: a row leaps from bucket to bucket
    with falling probability until the next leap would pass ``shards``."""
    if shards < 1:
        raise ValueError("shards must be positive")
    state = keys.astype(np.uint64).copy()
    at = np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    nxt = np.zeros(len(keys), np.int64)
    while len(live):
        at[live] = nxt[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        nxt[live] = ((at[live] + 1) * (2147483648.0 / draw)).astype(np.int64)
        live = live[nxt[live] < shards]
    return at


def assign_shards(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text",
                  keep_text: bool = False) -> DataFrame:
    """Rows (key, size, text_crc32, shard, grown_shard[, text])."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    src = df.select(F.col(key).cast("long").alias("k"), (F.octet_length(t) + ROW_OVERHEAD).cast("long").alias("size"),
                    F.crc32(t.cast("binary")).alias("text_crc32"), *([F.col(text).cast("string").alias("text")]
                                                                     if keep_text else []))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = mix64(b.column("k").fill_null(0).to_numpy(zero_copy_only=False))
            out = {n: b.column(n) for n in ("k", "size", "text_crc32")}
            out |= {"shard": pa.array(jump_hash(ids, shards), pa.int32()),
                    "grown_shard": pa.array(jump_hash(ids, shards + 1), pa.int32())}
            if keep_text:
                out["text"] = b.column("text")
            yield pa.RecordBatch.from_pydict(out)

    schema = "k long, size long, text_crc32 long, shard int, grown_shard int"
    return src.mapInArrow(assign, schema + (", text string" if keep_text else "")) \
        .withColumnRenamed("k", key)


def with_slots(sharded: DataFrame, key: str = "doc_id", rows_per_bucket: int = 50_000) -> DataFrame:
    """Add ``slot``: gapless from 0 within each shard, in bucket order.  The
    rows are checkpointed first, so texts are read once and a lost executor
    cannot change the numbers; leave the text out of what is numbered."""
    d = durable(sharded)
    buckets = max(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                  d.count() // rows_per_bucket + 1)
    # a repeated key may be hot: rows are dealt by all their columns and a salt
    d = d.withColumn("_b", F.pmod(F.xxhash64(key, "text_crc32", "size",
                                                   F.monotonically_increasing_id() % 64),
                                        F.lit(buckets)))
    return number_rows(d, ["shard"], "_b", "slot", [key, "text_crc32", "size"]).drop("_b")


def number_rows(d: DataFrame, within: list[str], bucket: str, out: str, order: list[str]) -> DataFrame:
    """Gapless numbers per ``within`` group: the first number of (group, bucket),
    a running sum over one row per bucket, plus the row's number there."""
    counts = d.groupBy(bucket, *within).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*within).orderBy(bucket)
    base = counts.withColumn("_base", F.sum("_n").over(w) - F.col("_n")).drop("_n")
    own = Window.partitionBy(bucket, *within).orderBy(*order)
    ranked = d.withColumn("_r", F.row_number().over(own) - 1)
    return ranked.join(base, [bucket, *within]) \
        .withColumn(out, (F.col("_base") + F.col("_r")).cast("long")).drop("_base", "_r")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard under ``path`` (Parquet), rows in slot order within
    each file."""
    sharded.write.partitionBy("shard").mode("errorifexists").parquet(path)
