"""Structured Streaming forms of the live monitor.

The reference polls a growing JSON file by offset and keeps counters in
process memory.  Here a directory of log files is a checkpointed file source
(new files = new rows, processed exactly once), counters are stateful
aggregations, per-IP rate limiting is keyed state with a timeout, and the
count batches and alert sink run in ``foreachBatch`` with per-epoch outputs,
so a replayed micro-batch rewrites the same files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logvigil.functions.exprs import is_error
from logvigil.operators import features, iforest, metrics, rules
from logvigil.operators.response import MAX_RATE, MAX_WARNINGS, REASON_AUTH, REASON_RATE
from logvigil.sources.json_logs import parse_web_log, with_dense_seq
from logvigil.sources.sinks import write_alerts
from logvigil.streaming.state_log import StateLog

EPOCH_SEQ = 1 << 40  # arrival numbers of one poll


# ------------------------------------------------------------------ S4, S7
def tail_log(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
             max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming source over a folder of log files; each file is read
    once, tracked by the query's checkpoint."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "json":
        r = r.option("multiLine", False)
    return r.load(path)


def event_time(df: DataFrame, ts: str = "ts", out: str = "event_time") -> DataFrame:
    """Watermarks need TIMESTAMP (not _NTZ): reinterpret the naive time in the
    session time zone (UTC in our sessions)."""
    return df.withColumn(out, F.col(ts).cast("timestamp"))


# ---------------------------------------------------------------- Q3, Q6
def live_endpoint_counters(api_stream: DataFrame) -> DataFrame:
    """Q3: running requests / errors per endpoint (update or complete mode;
    state is one row per endpoint)."""
    return api_stream.groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(is_error()).alias("errors"))


def live_ip_activity(api_stream: DataFrame, ip: str = "ip_address") -> DataFrame:
    """Q3: running per-IP request / error counts and last seen."""
    return api_stream.groupBy(ip).agg(
        F.count(F.lit(1)).alias("request_count"), F.count_if(is_error()).alias("error_count"),
        F.max("ts").alias("last_seen"))


def live_login_attempts(web_stream: DataFrame, ip: str = "source_ip") -> DataFrame:
    """Q6: login attempts per IP and the time of the last one."""
    return web_stream.where(F.col("event_type") == "login").groupBy(ip).agg(
        F.count(F.lit(1)).alias("attempts"), F.max("ts").alias("last_attempt"))


# --------------------------------------------------------------------- Q5
def session_expiry(stream: DataFrame, key: str, gap: str = "30 minutes",
                   watermark: str = "30 minutes", ts: str = "ts") -> DataFrame:
    """Q5: sessions closed after ``gap`` of inactivity, emitted once the
    watermark passes their end (append mode; state stays bounded)."""
    d = event_time(stream, ts).withWatermark("event_time", watermark)
    w = F.session_window("event_time", gap)
    return d.groupBy(key, w.alias("s")).agg(F.count(F.lit(1)).alias("n_events")).select(
        key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
        "n_events")


# --------------------------------------------------------------------- Q4
RATE_STATE = T.StructType([
    T.StructField("count", T.LongType()), T.StructField("first_us", T.LongType()),
    T.StructField("warnings", T.LongType())])

RATE_OUT = T.StructType([
    T.StructField("ip_address", T.StringType()), T.StructField("seq", T.LongType()),
    T.StructField("request_count", T.LongType()), T.StructField("warnings", T.LongType()),
    T.StructField("request_rate", T.DoubleType()), T.StructField("is_blocked", T.BooleanType()),
    T.StructField("reason", T.StringType())])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
IDLE_TIMEOUT_MS = 24 * 3600 * 1000
HELD_ROWS = 65_536
_ROW = np.dtype([("seq", "<i8"), ("ts_us", "<i8"), ("fail", "?")])


class RateLimiter(StatefulProcessor):
    """Rate state of one IP: a value state with a time to live.

    A micro-batch's rows of an IP come as an iterator of frames, in no order.  Up
    to ``held_rows`` of them are held as packed numbers (17 bytes a row).  Beyond
    that they go to a map state on disk, by ranges of ``held_rows`` sequence
    numbers, and are taken back range by range: sequence numbers are unique, so
    no more than a range is ever in memory, however hot the IP."""

    def __init__(self, max_rate: float, max_warnings: int, idle_timeout_ms: int | None, held_rows: int):
        self.max_rate, self.max_warnings = max_rate, max_warnings
        self.ttl, self.held_rows = idle_timeout_ms, held_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rate = handle.getValueState("rate", RATE_STATE, self.ttl)
        self.waiting = handle.getMapState("waiting", "part long", "rows binary")

    def _put(self, rows: np.ndarray) -> None:
        part = rows["seq"] // self.held_rows
        for p in np.unique(part):
            more = rows[part == p].tobytes()
            have = self.waiting.getValue((int(p),)) if self.waiting.containsKey((int(p),)) else None
            self.waiting.updateValue((int(p),), ((bytes(have[0]) if have else b"") + more,))

    def _ordered(self, frames: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        """The rows in sequence order, in bounded pieces."""
        held, n, spilled = [], 0, False
        for f in frames:
            rows = np.empty(len(f), _ROW)
            rows["seq"], rows["ts_us"], rows["fail"] = f["seq"], f["ts_us"], f["auth_fail"]
            held.append(rows)
            n += len(rows)
            if n > self.held_rows:
                for part in held:
                    self._put(part)
                held, n, spilled = [], 0, True
        if not spilled:
            yield np.sort(np.concatenate(held), order="seq") if held else np.empty(0, _ROW)
            return
        for part in held:
            self._put(part)
        for p in sorted(k[0] for k in self.waiting.keys()):
            rows = np.frombuffer(bytes(self.waiting.getValue((p,))[0]), _ROW)
            self.waiting.removeKey((p,))
            yield np.sort(rows, order="seq")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        count, first_us, warnings = self.rate.get() if self.rate.exists() else (0, None, 0)
        for r in self._ordered(rows):
            if not len(r):
                continue
            first_us = int(r["ts_us"][0]) if first_us is None else first_us
            counts = count + np.arange(1, len(r) + 1)
            warns = warnings + np.cumsum(r["fail"])
            el = (r["ts_us"] - first_us).astype("float64")
            rate = np.where(el > 0, counts / (np.where(el > 0, el, 1.0) / 1e6), 0.0)
            auth_hit = r["fail"] & (warns >= self.max_warnings)
            rate_hit = rate > self.max_rate
            count, warnings = int(counts[-1]), int(warns[-1])
            yield pd.DataFrame({
                "ip_address": key[0], "seq": r["seq"], "request_count": counts, "warnings": warns,
                "request_rate": rate, "is_blocked": auth_hit | rate_hit,
                "reason": np.where(auth_hit, REASON_AUTH, np.where(rate_hit, REASON_RATE, None))})
        self.rate.update((count, first_us, warnings))

    def close(self) -> None:
        pass


def rate_limit_stream(api_stream: DataFrame, max_rate: float = MAX_RATE,
                      max_warnings: int = MAX_WARNINGS, idle_timeout_ms: int | None = IDLE_TIMEOUT_MS,
                      auth_endpoint: str = "/api/auth", ip: str = "ip_address",
                      held_rows: int = HELD_ROWS) -> DataFrame:
    """Q4: per-IP rate-limit state (count, first request, warnings) updated
    request by request, with each request's decision.

    State lives on disk (the session is set to the RocksDB state store) and goes
    after ``idle_timeout_ms`` without traffic, a day unless given, so an IP then
    starts anew and its lockout ends; None keeps it for good, as in the batch
    operator.  Memory is bounded by ``held_rows``, not by an IP's traffic."""
    api_stream.sparkSession.conf.set(PROVIDER, ROCKSDB)
    d = api_stream.select(
        F.col(ip).alias("ip_address"), "seq",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.coalesce((F.col("endpoint") == auth_endpoint) & (F.col("status_code") == 401),
                   F.lit(False)).alias("auth_fail"))
    limiter = RateLimiter(max_rate, max_warnings, idle_timeout_ms, held_rows)
    return d.groupBy("ip_address").transformWithStateInPandas(limiter, RATE_OUT, "append", "processingTime")


# --------------------------------------------------------------------- Q1
def count_batch_processor(size: int, state_path: str, order_cols: list[str],
                          process: Callable[..., None],
                          history_rows: int = 0) -> Callable[[DataFrame, int], None]:
    """Q1: ``foreachBatch`` function that cuts the stream into count batches
    of ``size`` rows by arrival order and hands complete batches to
    ``process(batches, epoch)``.  The open tail (< size rows) and, with
    ``history_rows``, the completed rows that a history of that length at the
    next batch's end can reach are carried to the next micro-batch in a
    snapshot (:class:`StateLog`); ``process`` then gets
    ``(batches, epoch, history)``.  A micro-batch is read once, a replayed one
    starts from the same snapshot."""
    back = -(-history_rows // size) * size
    state = StateLog(state_path)

    def fn(batch_df: DataFrame, epoch_id: int) -> None:
        carried, meta = state.before(batch_df.sparkSession, epoch_id)
        next_seq = meta.get("next_seq", 0)
        new = with_dense_seq(batch_df, order_cols, "seq")
        new = new.withColumn("seq", F.col("seq") + F.lit(next_seq)).persist()
        total = next_seq + new.count()
        rows = new if carried is None else carried.unionByName(new)
        rows = rows.withColumn("batch_id", F.floor(F.col("seq") / size).cast("long"))
        before, complete = next_seq // size, total // size
        batches = rows.where((F.col("batch_id") >= before) & (F.col("batch_id") < complete))
        if history_rows:
            process(batches, epoch_id, rows.where(F.col("batch_id") < before))
        else:
            process(batches, epoch_id)
        state.write(epoch_id, rows.where(F.col("seq") >= complete * size - back).drop("batch_id"),
                    {"next_seq": total})
        new.unpersist()

    return fn


def detect_batches_sink(out_path: str, feature_fn: Callable[[DataFrame], DataFrame],
                        feature_names: list[str], **forest_kw) -> Callable[..., None]:
    """Q1 process step: per count batch, fit + score + flag (M6); writes the
    scored rows (``scored/epoch=..``) and each batch's summary (A4,
    ``summary/epoch=..``).  Features are computed over history and new batches
    together, so look-back features see the rows of earlier micro-batches."""
    def process(batches: DataFrame, epoch_id: int, history: DataFrame | None = None) -> None:
        rows = batches if history is None else history.unionByName(batches)
        feats = feature_fn(rows)
        if history is not None:
            first = batches.agg(F.min("batch_id")).first()[0]
            if first is None:  # no batch is complete yet
                return
            feats = feats.where(F.col("batch_id") >= first)
        at = f"{out_path}/scored/epoch={epoch_id}"
        iforest.fit_score_batches(feats, feature_names, **forest_kw).write.mode("overwrite").parquet(at)
        scored = batches.sparkSession.read.parquet(at)
        metrics.batch_summary(scored, score="score").write.mode("overwrite").parquet(
            f"{out_path}/summary/epoch={epoch_id}")
    return process


# --------------------------------------------------------------------- Q2
RAW = ("seq", "ts", "event_type", "user", "source_ip", "traffic_type", "status")


def monitor_batch(model: iforest.ForestModel | None, sink_path: str | None,
                  attempts: int = 3, known_users: list[str] | None = None
                  ) -> Callable[[DataFrame, int], DataFrame]:
    """Q2: one poll of the monitor: web features over the new rows only (the
    counts restart each poll, as in the reference), forest OR rules, reasons,
    alert records to the sink (per-epoch folder, idempotent).  Raw records, as
    ``tail_log`` gives them, are parsed and numbered here: epoch times
    ``EPOCH_SEQ`` plus the arrival number within the poll."""
    def fn(batch_df: DataFrame, epoch_id: int) -> DataFrame:
        if "ts" not in batch_df.columns:  # raw records of a tailed log
            batch_df = parse_web_log(batch_df)
        if "seq" not in batch_df.columns:  # arrival order, unique over all polls
            batch_df = with_dense_seq(batch_df, ["ts"], "seq") \
                .withColumn("seq", F.col("seq") + F.lit(epoch_id * EPOCH_SEQ))
        # numbering and the per-poll counts read the rows more than once
        rows = batch_df.persist()
        feats = features.web_features(rows, known_users=known_users, batch=None, keep=RAW)
        if model is not None:
            feats = iforest.predict(feats, model, out="forest_anomaly")
        else:
            feats = feats.withColumn("forest_anomaly", F.lit(False))
        flagged = rules.hybrid_anomalies(feats, attempts=attempts).where("is_anomaly")
        alerts = rules.alert_records(rules.alert_reasons(flagged, attempts=attempts),
                                     detail_cols=["event_type", "user", "source_ip", "status"])
        if sink_path:
            write_alerts(alerts, sink_path, epoch_id)
        rows.unpersist()
        return alerts
    return fn


def monitor(web_stream: DataFrame, model: iforest.ForestModel | None, sink_path: str,
            checkpoint: str, interval: str = "5 seconds", available_now: bool = False):
    """Q2: start the monitor (processing-time trigger, default every 5 s)."""
    fn = monitor_batch(model, sink_path)
    w = web_stream.writeStream.foreachBatch(lambda d, e: fn(d, e) and None) \
        .option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()
