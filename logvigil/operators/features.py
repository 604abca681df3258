"""Feature operators: stateless projections (P2-P15) and the two feature
vectors the detectors consume.

All columns are built from ``pyspark.sql.functions`` so a feature query is one
whole-stage-codegen projection over the scan plus the windows it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvigil.functions.exprs import (day_of_week, flag, hour, ip_last_octet, is_peak_hour,
                                      is_weekend, minute, round6)
from logvigil.operators import arrival, history, windows
from logvigil.operators.sparse import Layout
from logvigil.schemas import DETECTOR_KNOWN_USERS

# Web feature vector, in the detector's fixed order.
WEB_FEATURES = [
    "hour", "minute",
    "ip_attempts", "ip_failed_attempts",
    "user_attempts", "user_failed_attempts",
    "response_time", "high_response_time",
    "is_admin_action", "is_failed_login",
    "is_unknown_user", "rapid_requests",
    "status_failed", "status_unauthorized",
]

# API feature vector, in the detector's fixed order (always all 13 columns;
# columns without history are 0).
API_FEATURES = [
    "response_time", "status_code", "hour", "minute", "is_peak_hour", "is_weekend",
    "request_rate", "error_rate", "rt_moving_avg", "rt_moving_std", "rt_zscore",
    "endpoint_rt_zscore", "consecutive_errors",
]


def calendar_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Hour, minute, day_of_week (Mon=0), is_peak_hour (9-17), is_weekend."""
    return df.withColumns({
        "hour": hour(ts), "minute": minute(ts), "day_of_week": day_of_week(ts),
        "is_peak_hour": is_peak_hour(ts), "is_weekend": is_weekend(ts)})


def with_ip_last_octet(df: DataFrame, ip: str = "source_ip") -> DataFrame:
    """P5."""
    return df.withColumn("ip_last_octet", ip_last_octet(ip))


def categories(df: DataFrame, column: str) -> list[str]:
    """Distinct non-null values of ``column``, sorted (the columns of a wide
    one-hot; for a column of unbounded values use the long form)."""
    return categories_many(df, [column])[column]


def categories_many(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Category lists of several columns from one distinct job."""
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns
    ])).alias("p")).select("p.c", "p.v").where(F.col("v").isNotNull()).distinct()
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in pairs.collect():
        out[r["c"]].append(r["v"])
    return {c: sorted(v) for c, v in out.items()}


def one_hot(df: DataFrame, column: str, prefix: str, values: list[str] | None = None) -> DataFrame:
    """P6, wide form: one 0/1 column ``{prefix}_{value}`` per category (NULL:
    all 0).  ``values`` fixes the category list (required for a stable schema
    in streaming); otherwise it is read with one ``distinct``."""
    if values is None:
        values = categories(df, column)
    named = [flag(F.col(column) == v).alias(f"{prefix}_{v}") for v in values]
    return df.select("*", *named)


def one_hot_long(df: DataFrame, column: str, prefix: str,
                 id_cols: tuple[str, ...] = ("seq",)) -> DataFrame:
    """P6, long form, for a column of any number of values: one row (id
    columns, prefix, category, value = 1) per non-null value."""
    return df.where(F.col(column).isNotNull()).select(
        *id_cols, F.lit(prefix).alias("prefix"), F.col(column).cast("string").alias("category"),
        F.lit(1).cast("long").alias("value"))


RAW_WEB_COLUMNS = ["ts", "event_type", "user", "source_ip", "status"]


def base_features(web: DataFrame, event_types: list[str] | None = None,
                  statuses: list[str] | None = None, users: list[str] | None = None,
                  id_cols: tuple[str, ...] = ("seq",), one_hot_columns: bool = True) -> DataFrame:
    """P7/P8 (generic detector preprocessing): calendar, one-hot event type,
    status and user, last IP octet; raw text columns dropped, the numeric
    columns kept (after the id columns); NULL/NaN -> 0.  Without
    ``one_hot_columns`` only the plain numbers are features, as where 0/1 flags
    do not count as numeric."""
    d = web.withColumns({"hour": hour("ts"), "minute": minute("ts"),
                         "day_of_week": day_of_week("ts")})
    if not one_hot_columns:
        event_types, statuses, users = [], [], []
    missing = [c for c, v in (("event_type", event_types), ("status", statuses), ("user", users))
               if v is None]
    if missing:
        found = categories_many(web, missing)
        event_types = event_types if event_types is not None else found.get("event_type")
        statuses = statuses if statuses is not None else found.get("status")
        users = users if users is not None else found.get("user")
    d = one_hot(d, "event_type", "event", event_types)
    d = one_hot(d, "status", "status", statuses)
    d = with_ip_last_octet(d)
    d = one_hot(d, "user", "user", users)
    numeric = [f.name for f in d.schema.fields
               if f.name not in RAW_WEB_COLUMNS and f.name not in id_cols
               and f.dataType.typeName() in ("long", "integer", "double", "float", "short", "byte")]
    return d.select(*id_cols, *numeric).na.fill(0, subset=numeric)


#: the slots of the generic detector's sparse vector, in the wide frame's order
BASE_LAYOUT = Layout((("response_time", False), ("hour", False), ("minute", False), ("day_of_week", False),
                      ("event", True), ("status", True), ("ip_last_octet", False), ("user", True)))


def sparse_base_features(web: DataFrame, id_cols: tuple[str, ...] = ("seq",)) -> DataFrame:
    """P6-P8, sparse form: (id columns, ``features``), the same numbers as
    :func:`base_features` for any number of users, event types and statuses --
    one projection, no list of categories anywhere."""
    numbers = {"response_time": F.col("response_time"), "hour": hour("ts"), "minute": minute("ts"),
               "day_of_week": day_of_week("ts"), "ip_last_octet": ip_last_octet("source_ip")}
    groups = {"event": F.col("event_type"), "status": F.col("status"), "user": F.col("user")}
    return web.select(*id_cols, BASE_LAYOUT.vector(numbers, groups).alias("features"))


def web_flags(web: DataFrame, known_users: list[str] | None = None,
              slow_s: float = 1.0) -> DataFrame:
    """high_response_time, is_admin_action, is_failed_login,
    is_unknown_user (NULL user counts as unknown), status_failed,
    status_unauthorized -- all 0/1."""
    known = known_users or DETECTOR_KNOWN_USERS
    rt = F.coalesce(F.col("response_time"), F.lit(0.0))
    return web.withColumns({
        "high_response_time": flag(rt > slow_s),
        "is_admin_action": flag(F.col("event_type") == "admin_action"),
        "is_failed_login": flag((F.col("event_type") == "login") & (F.col("status") == "failed")),
        "is_unknown_user": flag(~F.coalesce(F.col("user").isin(*known), F.lit(False))),
        "status_failed": flag(F.col("status") == "failed"),
        "status_unauthorized": flag(F.col("status") == "unauthorized"),
    })


def web_features(web: DataFrame, known_users: list[str] | None = None, slow_s: float = 1.0,
                 rapid_s: float = 1.0, batch: str | None = "batch_id",
                 keep: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The 14-column web feature vector (fixed order) per row.

    Group features (attempt counts, rapid requests) are computed per batch as
    the monitor sees them; ``batch=None`` computes them over the whole log.
    """
    d = web.withColumn("response_time", F.coalesce(F.col("response_time"), F.lit(0.0)))
    d = d.withColumns({"hour": hour("ts"), "minute": minute("ts")})
    d = windows.attempt_counts(d, batch=batch)
    d = windows.rapid_requests(d, batch=batch, gap_s=rapid_s)
    d = web_flags(d, known_users, slow_s)
    cols = [c for c in keep if c not in WEB_FEATURES]
    if batch and batch not in cols:
        cols.append(batch)
    return d.select(*cols, *[F.col(c).cast("long") if c != "response_time" else F.col(c)
                             for c in WEB_FEATURES])


def api_features(api: DataFrame, batch: str = "batch_id", roll: int = 10, err_roll: int = 3,
                 history_rows: int = 1000, batch_size: int = 30, align: str = "value",
                 keep: tuple[str, ...] = ("seq",), index: arrival.ArrivalIndex | None = None) -> DataFrame:
    """The 13-column API feature vector per row.

    Calendar columns, per-minute request / error rates within the batch, the
    rolling response-time window of the batch, the z-score against the
    endpoint's history baseline at batch end, and errors among the last
    ``err_roll`` rows.  Missing values are 0.

    The log is shuffled once, by chunk of batches; all windows lie within.
    Without a batch column, or with an ``index``, batches are numbered by the
    arrival index."""
    from logvigil.operators import metrics

    api = metrics._batched(api, batch, batch_size, "seq", index)
    d = api.withColumn("status_code", F.col("status_code").cast("long"))
    d = d.withColumns({"hour": hour("ts"), "minute": minute("ts"),
                       "is_peak_hour": is_peak_hour("ts"), "is_weekend": is_weekend("ts")})
    d = history.chunked(d, batch, history_rows, batch_size)
    by = [history.CHUNK, batch]
    d = windows.minute_rates(d, batch=by, align=align)
    d = windows.rolling_response_time(d, batch=by, rows=roll)
    d = windows.consecutive_errors(d, batch=by, rows=err_roll)
    d = metrics.with_endpoint_rt_zscore(d, batch, history_rows, batch_size)
    cols = [c for c in keep if c not in API_FEATURES]
    if batch not in cols:
        cols.append(batch)
    out = d.where(~F.col(history.HALO)).select(*cols, *[F.col(c) for c in API_FEATURES])
    return out.na.fill(0)


def round_features(df: DataFrame, names: list[str]) -> DataFrame:
    """Round double features to 6 places (report form)."""
    return df.withColumns({n: round6(n) for n in names
                           if dict(df.dtypes).get(n) == "double"})
