"""Sinks (S3 and the alert sink).

The reference rewrites its whole JSON file for every event; here logs are
appended as files partitioned by date and batch, so a day can be pruned and an
append never rewrites history.

A *commit log* (``_commits``, one small row per append) says which batches count:

* a batch is written under its own name and committed last, so one that died
  half way is not read, and its retry replaces what it left;
* a batch that is committed already is not appended again, so a repeated call
  leaves its rows once;
* :func:`compact_log` rewrites a day's small batches as one and commits that in
  their place; their names stay in the log, so they remain known.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logvigil.functions import files

COMMITS = "_commits"
COMMIT_SCHEMA = "batch string, replaces array<string>"
MISSING_PATH = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


# ------------------------------------------------------------- commit log
def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(COMMIT_SCHEMA).parquet(f"{path}/{COMMITS}")
    except AnalysisException as e:
        if e.getCondition() not in MISSING_PATH:
            raise
        return None


def _commit(spark: SparkSession, path: str, batch: str, replaces: list[str] | None = None) -> None:
    """One more file in the commit log: it is there or not."""
    spark.createDataFrame([(batch, replaces or [])], COMMIT_SCHEMA).coalesce(1) \
        .write.mode("append").parquet(f"{path}/{COMMITS}")


def committed(spark: SparkSession, path: str, batch: str) -> bool:
    log = _commits(spark, path)
    return log is not None and bool(log.where(F.col("batch") == batch).limit(1).count())


def live_batches(spark: SparkSession, path: str) -> DataFrame:
    """(batch) rows that count: committed, and not replaced by a compaction."""
    log = _commits(spark, path)
    if log is None:
        return spark.createDataFrame([], "batch string")
    gone = log.select(F.explode("replaces").alias("batch"))
    return log.select("batch").distinct().join(gone, "batch", "left_anti")


# ------------------------------------------------------------------ the log
def _leftovers(spark: SparkSession, path: str, batch: str) -> list[str]:
    return [f"{path}/{day}/batch={batch}" for day in files.names(spark, path) if day.startswith("date=")
            and f"batch={batch}" in files.names(spark, f"{path}/{day}")]


def _write(df: DataFrame, path: str, batch: str, ts: str) -> None:
    df.withColumns({"date": F.to_date(F.col(ts)), "batch": F.lit(batch)}).write.mode("append") \
        .partitionBy("date", "batch").parquet(path)


def append_log(df: DataFrame, path: str, batch_id: str | int | None = None, ts: str = "ts") -> bool:
    """S3: append records, partitioned by event date; with a ``batch_id`` once
    only.  Returns whether the rows were appended now."""
    spark = df.sparkSession
    batch = uuid.uuid4().hex if batch_id is None else str(batch_id)
    if not batch.replace("-", "").replace("_", "").replace(".", "").isalnum():
        raise ValueError(f"batch id {batch!r}: letters, digits, '-', '_' and '.' only")
    batch = f"b-{batch}"  # never read as a number
    if batch_id is not None:
        if committed(spark, path, batch):
            return False
        for folder in _leftovers(spark, path, batch):  # of an append that died
            files.remove(spark, folder)
    _write(df, path, batch, ts)
    _commit(spark, path, batch)
    return True


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The committed rows of a log (with their ``date``).  The batches' names
    are few next to the rows; adaptive execution broadcasts them if small."""
    rows = spark.read.option("mergeSchema", True).parquet(path)
    return rows.join(live_batches(spark, path), "batch", "left_semi").drop("batch")


def compact_log(spark: SparkSession, path: str, date: str, ts: str = "ts", files_out: int = 1,
                min_batches: int = 2, keep_old: bool = False) -> int:
    """Rewrite the live batches of one day as a single one of ``files_out``
    files; returns how many were replaced.  Readers see the old batches until
    the new one is committed.  Batches that also hold other days are left.  With
    ``keep_old`` the replaced files stay, unread, for readers under way."""
    days = [d for d in files.names(spark, path) if d.startswith("date=")]
    if f"date={date}" not in days:
        return 0
    here = [n.removeprefix("batch=") for n in files.names(spark, f"{path}/date={date}")
            if n.startswith("batch=")]
    elsewhere = {n for d in days if d != f"date={date}" for n in files.names(spark, f"{path}/{d}")}
    mine = [b for b in here if f"batch={b}" not in elsewhere]
    live = {r["batch"] for r in live_batches(spark, path).where(F.col("batch").isin(mine)).collect()} if mine else set()
    small = sorted(live)
    if len(small) < min_batches:
        return 0
    folders = [f"{path}/date={date}/batch={b}" for b in small]
    rows = spark.read.option("mergeSchema", True).parquet(*folders).repartition(files_out)
    name = f"c-{uuid.uuid4().hex}"
    _write(rows, path, name, ts)
    _commit(spark, path, name, small)
    for folder in [] if keep_old else folders:
        files.remove(spark, folder)
    return len(small)


def write_alerts(alerts: DataFrame, path: str, epoch: int | None = None) -> None:
    """Alert sink: JSON lines.  With ``epoch`` (streaming) the epoch's folder is
    overwritten, so a replayed micro-batch writes the same alerts once."""
    if epoch is None:
        alerts.write.mode("append").json(path)
    else:
        alerts.write.mode("overwrite").json(f"{path}/epoch={epoch}")
