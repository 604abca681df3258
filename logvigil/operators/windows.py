"""Window operators W1-W13.

Batch-scoped windows (the detector sees one batch at a time) partition by
``batch_id``: groups are bounded by the batch size, and every window keyed by
(batch_id, x) is satisfied by one hash exchange on batch_id, so W1-W8 share a
single shuffle.  Unbatched per-IP / per-user windows go through
:mod:`logvigil.operators.keyed`, which splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logvigil.functions.exprs import epoch_us, flag, is_error, minute
from logvigil.functions.partitioning import groups_partitions
from logvigil.operators import arrival, keyed

US = 1_000_000


def _cols(batch: str | list[str]) -> list[str]:
    """Batch-wise windows take the batch's column, or several that start with
    what the frame is already partitioned by, such as (chunk, batch)."""
    return [batch] if isinstance(batch, str) else list(batch)


def attempt_counts(web: DataFrame, batch: str | None = "batch_id",
                   ip: str = "source_ip", user: str = "user") -> DataFrame:
    """W1 + W2: rows per IP / per user, and failed rows per IP / per user, the
    failed counts only on failed rows (0 elsewhere)."""
    failed = F.col("status") == "failed"
    if batch:
        # failed rows are summed over the same windows: one sort per key
        wi, wu = Window.partitionBy(batch, ip), Window.partitionBy(batch, user)
        # a given partition count: CPU-heavy scoring downstream keeps its tasks
        d = web.repartition(groups_partitions(web), batch) \
               .withColumn("_failed", F.coalesce(failed, F.lit(False)))
        n = F.col("_failed").cast("long")
        d = d.withColumns({"ip_attempts": F.count(F.lit(1)).over(wi), "_ipf": F.sum(n).over(wi)})
        d = d.withColumns({"user_attempts": F.count(F.lit(1)).over(wu), "_uf": F.sum(n).over(wu)})
        return (d.withColumn("ip_failed_attempts", F.when(F.col("_failed"), F.col("_ipf")).otherwise(0))
                 .withColumn("user_failed_attempts", F.when(F.col("_failed"), F.col("_uf")).otherwise(0))
                 .drop("_failed", "_ipf", "_uf"))
    d = web.withColumn("_failed", F.coalesce(failed, F.lit(False)))
    one = F.lit(1).cast("long")
    d = keyed.key_totals(d, ip, {"ip_attempts": one, "_ipf": F.col("_failed").cast("long")})
    d = keyed.key_totals(d, user, {"user_attempts": one, "_uf": F.col("_failed").cast("long")})
    return (d.withColumn("ip_failed_attempts", F.when(F.col("_failed"), F.col("_ipf")).otherwise(0))
             .withColumn("user_failed_attempts", F.when(F.col("_failed"), F.col("_uf")).otherwise(0))
             .drop("_failed", "_ipf", "_uf"))


def rapid_requests(web: DataFrame, batch: str | None = None, ip: str = "source_ip",
                   gap_s: float = 1.0, seq: str = "seq",
                   chunk_rows: int = keyed.DEFAULT_CHUNK_ROWS) -> DataFrame:
    """1 when the gap to the same IP's previous row (arrival order) is
    below ``gap_s`` seconds; a negative gap counts, the first row is 0."""
    us = epoch_us(F.col("ts"))
    if batch:
        w = Window.partitionBy(batch, ip).orderBy(seq)
        d = web.withColumn("_prev_us", F.lag(us).over(w))
    else:
        d = keyed.previous_value(web, ip, "_prev_us", us, seq=seq, chunk_rows=chunk_rows)
    return (d.withColumn("rapid_requests", flag((us - F.col("_prev_us")) < F.lit(gap_s * US)))
             .drop("_prev_us"))


def minute_rates(api: DataFrame, batch: str | list[str] = "batch_id", align: str = "value",
                 seq: str = "seq", calendar: bool = False) -> DataFrame:
    """W3 + W4: requests and error share per minute-of-hour within the batch;
    with ``calendar`` per minute of time, so that one hour's 12:05 and the
    next one's 13:05 are apart.

    ``align="value"`` gives each row its own minute's numbers.  ``"positional"``
    reproduces the reference, which assigns minute m's numbers to the m-th row
    of the batch (0 when no row has that minute).
    """
    if align == "value":
        at = F.date_trunc("minute", "ts") if calendar else minute("ts")
        w = Window.partitionBy(*_cols(batch), at)
        return (api.withColumn("request_rate", F.count(F.lit(1)).over(w))
                   .withColumn("error_rate", F.avg(is_error().cast("double")).over(w)))
    per_min = api.groupBy(*_cols(batch), minute("ts").alias("_pos")).agg(
        F.count(F.lit(1)).alias("request_rate"),
        F.avg(is_error().cast("double")).alias("error_rate"))
    d = api.withColumn("_pos", F.row_number().over(Window.partitionBy(*_cols(batch)).orderBy(seq)) - 1)
    return (d.join(per_min, [*_cols(batch), "_pos"], "left")
             .withColumn("request_rate", F.coalesce("request_rate", F.lit(0)))
             .withColumn("error_rate", F.coalesce("error_rate", F.lit(0.0)))
             .drop("_pos"))


def rolling_response_time(api: DataFrame, batch: str | list[str] = "batch_id", rows: int = 10,
                          seq: str = "seq") -> DataFrame:
    """W5 + W6: rolling mean / sample std of response time over the last
    ``rows`` rows of the batch (0 until the window is full) and the z-score of
    the row against them (0 when undefined)."""
    w = Window.partitionBy(*_cols(batch)).orderBy(seq).rowsBetween(-(rows - 1), 0)
    full = F.count(F.lit(1)).over(w) == rows
    d = (api.withColumn("_avg", F.when(full, F.avg("response_time").over(w)))
            .withColumn("_std", F.when(full, F.stddev_samp("response_time").over(w))))
    return (d.withColumn("rt_moving_avg", F.coalesce("_avg", F.lit(0.0)))
             .withColumn("rt_moving_std", F.coalesce("_std", F.lit(0.0)))
             .withColumn("rt_zscore", F.coalesce(
                 F.try_divide(F.col("response_time") - F.col("_avg"), F.col("_std")), F.lit(0.0)))
             .drop("_avg", "_std"))


def consecutive_errors(api: DataFrame, batch: str | list[str] = "batch_id", rows: int = 3,
                       seq: str = "seq") -> DataFrame:
    """Errors among the last ``rows`` rows of the batch (0 until full)."""
    w = Window.partitionBy(*_cols(batch)).orderBy(seq).rowsBetween(-(rows - 1), 0)
    return api.withColumn("consecutive_errors", F.when(
        F.count(F.lit(1)).over(w) == rows, F.sum(flag(is_error())).over(w)).otherwise(0))


def running_request_rate(api: DataFrame, ip: str = "ip_address", seq: str = "seq",
                         chunk_rows: int = keyed.DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Running request count per IP and the mean rate since the IP's first
    request (count / elapsed seconds; 0 when no time has passed)."""
    d = keyed.running_sums(api, ip, {"request_count": F.lit(1).cast("long")}, seq=seq,
                           chunk_rows=chunk_rows, firsts={"first_request": F.col("ts")})
    elapsed_us = epoch_us(F.col("ts")) - epoch_us(F.col("first_request"))
    return d.withColumn("request_rate", F.when(
        elapsed_us > 0, F.col("request_count") / (elapsed_us.cast("double") / 1e6)).otherwise(0.0))


def auth_warnings(api: DataFrame, ip: str = "ip_address", auth_endpoint: str = "/api/auth",
                  seq: str = "seq", chunk_rows: int = keyed.DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Running count of 401 answers on the auth endpoint per IP."""
    hit = flag((F.col("endpoint") == auth_endpoint) & (F.col("status_code") == 401))
    return keyed.running_sums(api, ip, {"warnings": hit}, seq=seq, chunk_rows=chunk_rows)


def login_attempts(web: DataFrame, ip: str = "source_ip", seq: str = "seq",
                   chunk_rows: int = keyed.DEFAULT_CHUNK_ROWS) -> DataFrame:
    """W11 + W13: running login count per IP and the time of the IP's latest
    login so far; ``attempts`` is that count, or 1 when the IP has none yet."""
    is_login = F.col("event_type") == "login"
    d = keyed.running_sums(web, ip, {"login_count": flag(is_login)}, seq=seq, chunk_rows=chunk_rows,
                           maxes={"last_attempt": F.when(is_login, F.col("ts"))})
    return d.withColumn("attempts", F.when(F.col("login_count") > 0, F.col("login_count"))
                        .otherwise(F.lit(1).cast("long")))


def count_batches(df: DataFrame, size: int = 30, seq: str = "seq",
                  chunk_rows: int = arrival.CHUNK_ROWS,
                  index: arrival.ArrivalIndex | None = None) -> DataFrame:
    """Tumbling count batches of ``size`` rows by arrival order; rows of
    an incomplete (still open) batch are not emitted.

    Rows are counted, not read off ``seq``, which may have gaps: a row's rank
    comes from the arrival index (built here unless given)."""
    index = arrival.build(df, seq, chunk_rows) if index is None else index
    d = arrival.number(df, index, seq, "_r")
    return (d.where(F.col("_r") < index.rows // size * size)
             .withColumn("batch_id", F.floor(F.col("_r") / size).cast("long"))
             .withColumn("pos_in_batch", (F.col("_r") % size).cast("long"))
             .drop("_r"))
