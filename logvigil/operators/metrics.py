"""Aggregations and top-N reports.

Every aggregate is a ``groupBy().agg()`` whose partial (map-side) aggregation
runs before the shuffle, so a hot key costs one small partial row per task.
Dimension tables are the caller's; adaptive execution broadcasts the small ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logvigil.functions.exprs import exact_avg, is_error, pct_1dp, round6, round_dp
from logvigil.operators import arrival, history
from logvigil.schemas import (ENDPOINT_INITIAL_RT, ENDPOINT_INITIAL_STATUS,
                              ENDPOINT_METHODS, ENDPOINT_PATHS)


def endpoint_dimension(spark: SparkSession) -> DataFrame:
    """The monitored endpoints: path, methods, initial last status / response time."""
    rows = [(p, list(ENDPOINT_METHODS), ENDPOINT_INITIAL_STATUS, ENDPOINT_INITIAL_RT)
            for p in ENDPOINT_PATHS]
    return spark.createDataFrame(
        rows, "path string, methods array<string>, initial_status bigint, initial_rt double")


def endpoint_counters(api: DataFrame, endpoints: DataFrame | None = None) -> DataFrame:
    """A5: requests and errors (status >= 400) per endpoint.

    With ``endpoints`` given, events on unknown endpoints are ignored (semi join
    against the dimension, which AQE broadcasts if it is small) as the live counters do.
    """
    df = api
    if endpoints is not None:
        df = df.join(endpoints.select(F.col("path").alias("endpoint")), "endpoint", "left_semi")
    return df.groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(is_error()).alias("errors"))


def success_rate(requests="requests", errors="errors") -> F.Column:
    """Success share in percent, one decimal, 100 when there are no requests."""
    return F.when(F.coalesce(F.col(requests), F.lit(0)) == 0, F.lit(100.0)) \
            .otherwise(pct_1dp(F.col(requests) - F.col(errors), F.col(requests)))


def endpoint_status(api: DataFrame, endpoints: DataFrame) -> DataFrame:
    """J2 + A6 + T2: one row per known endpoint with counters, success rate and
    the last status / response time (initial values when never called)."""
    known = endpoints.select(F.col("path").alias("endpoint"))
    agg = (api.join(known, "endpoint", "left_semi")
           .groupBy("endpoint").agg(
               F.count(F.lit(1)).alias("requests"),
               F.count_if(is_error()).alias("errors"),
               F.max_by(F.struct("status_code", "response_time"),
                        F.struct("ts", "seq")).alias("last")))
    dim = endpoints.select(F.col("path").alias("endpoint"), "initial_status", "initial_rt")
    return (dim.join(agg, "endpoint", "left")
            .select("endpoint",
                    F.coalesce("requests", F.lit(0)).cast("long").alias("requests"),
                    F.coalesce("errors", F.lit(0)).cast("long").alias("errors"),
                    success_rate().alias("success_rate"),
                    F.coalesce(F.col("last.status_code"), "initial_status").alias("last_status"),
                    F.coalesce(round_dp("last.response_time", 2), "initial_rt")
                     .alias("last_response_time")))


def traffic_totals(api: DataFrame, endpoints: DataFrame | None = None) -> DataFrame:
    """Total requests, errors and error rate in percent (0 when empty)."""
    c = endpoint_counters(api, endpoints)
    return c.agg(F.coalesce(F.sum("requests"), F.lit(0)).cast("long").alias("total_requests"),
                 F.coalesce(F.sum("errors"), F.lit(0)).cast("long").alias("total_errors")) \
            .withColumn("error_rate", F.coalesce(pct_1dp("total_errors", "total_requests"),
                                                 F.lit(0.0)))


def status_class_counts(api: DataFrame) -> DataFrame:
    """Requests per status class (200, 300, 400, 500)."""
    return (api.select((F.floor(F.col("status_code") / 100) * 100).cast("long")
                       .alias("status_class"))
            .groupBy("status_class").agg(F.count(F.lit(1)).alias("requests")))


def endpoint_analysis(scored: DataFrame) -> DataFrame:
    """A1: response-time mean / sample std / max, error rate and anomaly rate
    per endpoint.  ``scored`` carries ``is_anomaly``."""
    return scored.groupBy("endpoint").agg(
        round6(exact_avg("response_time")).alias("rt_mean"),
        round6(F.coalesce(F.stddev_samp("response_time"), F.lit(None))).alias("rt_std"),
        F.max("response_time").alias("rt_max"),
        round6(F.avg(is_error().cast("double"))).alias("error_rate"),
        round6(F.avg(F.col("is_anomaly").cast("double"))).alias("anomaly_rate"))


def hourly_patterns(scored: DataFrame) -> DataFrame:
    """A2: per hour of day, mean response time, anomaly rate and error rate."""
    return scored.groupBy(F.hour("ts").cast("long").alias("hour")).agg(
        round6(exact_avg("response_time")).alias("rt_mean"),
        round6(F.avg(F.col("is_anomaly").cast("double"))).alias("anomaly_rate"),
        round6(F.avg(is_error().cast("double"))).alias("error_rate"))


def anomaly_patterns(scored: DataFrame, slow_ms: float = 1000.0,
                     auth_endpoint: str = "/api/auth") -> DataFrame:
    """A3: among anomalies, slow responses, error bursts and auth failures."""
    a = F.col("is_anomaly")
    return scored.agg(
        F.count_if(a & (F.col("response_time") > slow_ms)).alias("slow_response"),
        F.count_if(a & is_error()).alias("error_burst"),
        F.count_if(a & (F.col("endpoint") == auth_endpoint)
                   & (F.col("status_code") == 401)).alias("auth_failures"))


def batch_summary(scored: DataFrame, batch: str = "batch_id",
                  score: str = "anomaly_score") -> DataFrame:
    """A4 + A11: per batch, totals, anomaly count and score mean / min / max."""
    return scored.groupBy(batch).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_anomaly").alias("anomalies"),
        F.count_if(~F.col("is_anomaly")).alias("normal"),
        round6(exact_avg(score)).alias("score_mean"),
        F.min(score).alias("score_min"),
        F.max(score).alias("score_max"))


def ip_activity(api: DataFrame, patterns: DataFrame | None = None,
                ip: str = "ip_address") -> DataFrame:
    """A8 + J7: per IP, request and error counts, last seen and the pattern
    type the IP was first seen with (``unknown`` without a pattern source).

    The pattern comes from a ``pattern_type`` column of ``api`` or, failing
    that, from ``patterns(seq, pattern_type)`` joined on seq."""
    df = api
    if "pattern_type" in df.columns or patterns is not None:
        if "pattern_type" not in df.columns:
            df = df.join(patterns, "seq", "left")
        pattern = F.min_by("pattern_type", F.struct("ts", "seq"))
    else:
        pattern = F.lit(None).cast("string")
    return df.groupBy(ip).agg(
        F.count(F.lit(1)).alias("request_count"),
        F.count_if(is_error()).alias("error_count"),
        F.max("ts").alias("last_seen"),
        pattern.alias("pattern_type")) \
        .withColumn("pattern_type", F.coalesce("pattern_type", F.lit("unknown")))


def recent_requests(api: DataFrame, n: int = 100) -> DataFrame:
    """The newest ``n`` requests, newest first (TakeOrderedAndProject:
    each task keeps its own top n, the driver merges n per task)."""
    return api.orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(n)


def history_tail(api: DataFrame, n: int = 1000, seq: str = "seq") -> DataFrame:
    """The history after appending every batch and keeping the last ``n``."""
    return api.orderBy(F.col(seq).desc()).limit(n)


def _batched(api: DataFrame, batch: str, size: int, seq: str, index) -> DataFrame:
    """The log with count batches: those it has (as :func:`windows.count_batches`
    numbers them), or, without that column or with an ``index`` given, by the
    arrival index."""
    if index is None and batch in api.columns:
        return api
    return arrival.with_batches(api, size, index, seq, batch)


def endpoint_baseline(api: DataFrame, window_rows: int = 1000, batch_size: int = 30,
                      seq: str = "seq", rounded: bool = True, batch: str = "batch_id",
                      index: arrival.ArrivalIndex | None = None) -> DataFrame:
    """A10: per (batch, endpoint in that batch) response-time mean and sample
    std over the last ``window_rows`` rows at the batch's end.

    Rows are first summed per (batch, endpoint); the sums of a history are the
    difference of two prefix sums (:mod:`logvigil.operators.history`)."""
    if index is None and batch in api.columns:
        d = api.withColumn("_pos", F.row_number().over(Window.partitionBy(batch).orderBy(seq)) - 1)
    else:
        d = arrival.with_batches(api, batch_size, index, seq, batch, "_pos")
    r = round6 if rounded else (lambda c: c)
    base = history.per_batch(d, "endpoint", "response_time", batch, seq, window_rows, batch_size,
                             F.col("_pos"))
    return base.select(batch, "endpoint", r("baseline_mean").alias("baseline_mean"),
                       r("baseline_std").alias("baseline_std"), "baseline_rows")


def with_endpoint_rt_zscore(d: DataFrame, batch: str = "batch_id", window_rows: int = 1000,
                            batch_size: int = 30, seq: str = "seq") -> DataFrame:
    """Attach J1's z-score to the rows of a chunked log
    (:func:`history.chunked`), in place: windows only, no join.  Rows without
    an endpoint have no baseline and score 0."""
    h = history.with_history(d, "endpoint", "response_time", batch, seq, window_rows, batch_size)
    z = F.try_divide(F.col("response_time") - F.col("baseline_mean"), F.col("baseline_std"))
    return h.withColumn("endpoint_rt_zscore", F.coalesce(
        F.when(F.col("endpoint").isNotNull(), z), F.lit(0.0))) \
        .drop("baseline_mean", "baseline_std", "baseline_rows")


def endpoint_rt_zscore(api: DataFrame, window_rows: int = 1000, batch_size: int = 30,
                       batch: str = "batch_id", seq: str = "seq",
                       index: arrival.ArrivalIndex | None = None) -> DataFrame:
    """Z-score of each request against its endpoint's baseline at the end
    of its batch; no baseline, or a zero / undefined std, gives 0."""
    rows = _batched(api, batch, batch_size, seq, index).select(seq, batch, "endpoint", "response_time")
    d = with_endpoint_rt_zscore(history.chunked(rows, batch, window_rows, batch_size), batch, window_rows,
                                batch_size, seq)
    return d.where(~F.col(history.HALO)).select(
        seq, batch, "endpoint", round6("endpoint_rt_zscore").alias("endpoint_rt_zscore"))


def collapse_pairs(api: DataFrame, seq: str = "seq") -> DataFrame:
    """§2.13 row 21 option: the variant logs each request twice (handler and
    feed callback), so rows with the same second, endpoint, method and status
    are one request.  The handler's copy has no payload, so the payload is not
    a key: the non-null one is kept.  Keeps the first seq, the server (min) and
    client (max) response time and how many rows were merged; a plain
    group-by with map-side partial aggregation."""
    keys = ["ts", "endpoint", "method", "status_code"]
    extra = [F.max("payload").alias("payload")] if "payload" in api.columns else []
    return api.groupBy(*keys).agg(
        F.min(seq).alias(seq),
        F.min("response_time").alias("server_response_time"),
        F.max("response_time").alias("response_time"),
        F.count(F.lit(1)).alias("logged_rows"), *extra)
