"""Log sources (S1, S2, S6 helpers) and typed parsing of raw records.

The reference reads whole JSON files into memory; here a file is a Spark
source with an explicit schema (no inference), PERMISSIVE mode (a corrupt or
keyless file contributes no rows instead of failing the job) and the typed
columns the operators expect.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from logvigil.functions.exprs import parse_ts
from logvigil.schemas import API_LOG_RAW, WEB_LOG_RAW, envelope
from logvigil.sources.json_ranges import read_json_records

log = logging.getLogger(__name__)

CORRUPT = "_corrupt_record"


def _raw_envelopes(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    schema = T.StructType([*envelope(record).fields, T.StructField(CORRUPT, T.StringType(), True)])
    return (spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).json(path)
            .withColumn("file", F.input_file_name()))


def corrupt_files(spark: SparkSession, path: str, record: T.StructType = WEB_LOG_RAW) -> DataFrame:
    """S1 report: (file, head, rows_read) of the files that could not be parsed
    in full; ``head`` is the start of their text."""
    return _raw_envelopes(spark, path, record).where(F.col(CORRUPT).isNotNull()).select(
        "file", F.substring(CORRUPT, 1, 80).alias("head"),
        F.coalesce(F.size("logs"), F.lit(0)).alias("rows_read"))


def read_log_envelope(spark: SparkSession, path: str, record: T.StructType = WEB_LOG_RAW,
                      report: bool = True, range_bytes: int | None = None) -> DataFrame:
    """Rows of the ``logs`` array of ``{"logs": [...]}`` files.  A file is one
    task; with ``range_bytes`` a range of it is
    (:mod:`logvigil.sources.json_ranges`; plain files that Python can open).

    A file without the key, or unreadable, yields no rows, like the reference's
    empty list.  Unreadable files are counted and logged (``report``; one pass
    over the files, :func:`corrupt_files` names them all).  ``file_pos`` is the
    record's position in its file.
    """
    if range_bytes:
        return read_json_records(spark, path, record, "logs", range_bytes)
    try:
        raw = _raw_envelopes(spark, path, record)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        log.error("cannot read logs from %s: no such path", path)
        return spark.createDataFrame([], T.StructType(
            [T.StructField("file", T.StringType()), T.StructField("file_pos", T.IntegerType()),
             *record.fields]))
    if report:
        bad = corrupt_files(spark, path, record)
        n, first, rows = bad.agg(F.count("file"), F.min("file"), F.sum("rows_read")).first()
        if n:
            log.error("%d log file(s) under %s cannot be parsed, the first is %s; %s of their rows "
                      "could be read", n, path, first, max(rows, 0))
    return raw.select("file", F.posexplode("logs").alias("file_pos", "r")).select(
        "file", "file_pos", "r.*")


def read_log_array(spark: SparkSession, path: str, record: T.StructType = API_LOG_RAW,
                   range_bytes: int | None = None) -> DataFrame:
    """Files holding a bare JSON array of records (one row per element);
    with ``range_bytes`` a range of a file is a task, as in
    :func:`read_log_envelope`.

    Otherwise a multiLine JSON file is one unsplittable partition, so the increasing id
    follows file order and the per-file position window is bounded by the
    file's own size."""
    if range_bytes:
        return read_json_records(spark, path, record, None, range_bytes)
    from pyspark.sql import Window
    raw = (spark.read.schema(record).option("multiLine", True).option("mode", "PERMISSIVE")
           .json(path).withColumn("file", F.input_file_name())
           .withColumn("_mid", F.monotonically_increasing_id()))
    w = Window.partitionBy("file").orderBy("_mid")
    return raw.withColumn("file_pos", (F.row_number().over(w) - 1).cast("int")) \
              .select("file", "file_pos", *[f.name for f in record.fields])


def with_dense_seq(df: DataFrame, order_cols: list[str], name: str = "seq") -> DataFrame:
    """Dense arrival number 0..n-1 in ``order_cols`` order, without pulling
    all rows into one task: rows are range-partitioned into a fixed number of
    partitions and sorted there; a row's number is its place in its partition
    plus the rows of the partitions before (one row per partition).  A hash of
    the whole row breaks ties, so a recomputed partition numbers its rows the
    same way (only identical rows can still tie, and they are interchangeable)."""
    from pyspark.sql import Window
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*order_cols, F.xxhash64(*df.columns)]
    # a given partition count is not coalesced at run time, so the id's upper
    # bits name the same partitions wherever the frame is read
    d = df.repartitionByRange(n, *order).sortWithinPartitions(*order) \
        .withColumn("_id", F.monotonically_increasing_id())
    d = d.withColumn("_part", F.shiftright("_id", 33))
    per = d.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(F.lit(0)).orderBy("_part")  # over one row per partition
    per = per.select("_part", (F.sum("_n").over(w) - F.col("_n")).alias("_before"))
    place = F.col("_id") - F.shiftleft("_part", 33)
    return d.join(per, "_part").withColumn(name, F.col("_before") + place) \
        .drop("_id", "_part", "_before")


def parse_api_log(raw: DataFrame, seq: str | None = None) -> DataFrame:
    """Typed API log: timestamp -> TIMESTAMP_NTZ, status code -> BIGINT (bad
    text -> NULL), response time (ms) -> DOUBLE; other columns kept."""
    d = raw.withColumn("ts", parse_ts("timestamp")) \
           .withColumn("status_code", F.col("status_code").cast("string").try_cast("bigint")) \
           .withColumn("response_time", F.col("response_time").cast("double"))
    if seq and seq != "seq":
        d = d.withColumnRenamed(seq, "seq")
    return d


def parse_web_log(raw: DataFrame, seq: str | None = None) -> DataFrame:
    """Typed web log (response time in seconds)."""
    d = raw.withColumn("ts", parse_ts("timestamp"))
    if seq and seq != "seq":
        d = d.withColumnRenamed(seq, "seq")
    return d
