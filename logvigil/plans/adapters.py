"""Views of the driver's ``events`` table in the two log forms.

The driver's ``events(event_id, ts, user_id, event_type, value, props)`` has no
request logs, so these adapters derive them with integer arithmetic (no RNG):
every derived column is a pure function of one events row, so the same row
always maps to the same log record, on any executor, after any retry.

``seq`` is ``event_id`` (arrival order; equal to ``ts`` order in the data) and
``batch_id = seq div 30`` is the detector's count batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Fixed values of the adapter mapping.
BATCH_SIZE = 30
SCALE_ORIGIN = "2024-01-01 00:00:00"
SCALE_ORIGIN_US = 1704067200000000
API_ENDPOINT_BY_EVENT = {"view": "/api/products", "click": "/api/cart",
                         "purchase": "/api/orders", "signup": "/api/users",
                         "error": "/api/auth"}
WEB_EVENT_BY_EVENT = {"signup": "login", "error": "login", "purchase": "admin_action",
                      "view": "data_access", "click": "file_access"}
WEB_USER_BY_MOD5 = ["user1", "user2", "admin", "system", "unknown_user"]
PATTERN_BY_MOD10 = {8: "bot", 9: "attacker"}  # others: normal_user


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


def _mapped(col: str, mapping: dict) -> F.Column:
    expr = None
    for key, val in mapping.items():
        expr = (F.when(F.col(col) == key, val) if expr is None
                else expr.when(F.col(col) == key, val))
    return expr


def scaled_ts(ts: str, time_scale: int) -> F.Column:
    """Compress time around 2024-01-01 by ``time_scale`` (1 = unchanged)."""
    if time_scale == 1:
        return F.col(ts)
    origin = f"TIMESTAMP_NTZ'{SCALE_ORIGIN}'"
    return F.expr(f"timestampadd(MICROSECOND, timestampdiff(MICROSECOND, {origin}, {ts}) "
                  f"div {int(time_scale)}, {origin})")


def _base(events: DataFrame, time_scale: int) -> DataFrame:
    return (events
            .select(F.col("event_id").alias("seq"),
                    F.expr(f"event_id div {BATCH_SIZE}").alias("batch_id"),
                    "user_id", "event_type", "value", "props",
                    F.col("ts").alias("raw_ts"),
                    scaled_ts("ts", time_scale).alias("ts"))
            .withColumn("k", _k())
            .withColumn("ip", F.concat(F.lit("10.0.0."), (F.col("user_id") % 32).cast("string"))))


def _api_cols() -> dict[str, F.Column]:
    # two addresses apart from the rest: one mostly refused, one nearly free of errors
    host = F.col("user_id") % 32
    bad_login = (F.col("event_type") == "error") & (F.col("k") < 50)
    status = (F.when((host == 7) & (F.col("k") >= 40), 403)
              .when((host == 5) & ~bad_login, 200)
              .when(F.col("event_type") == "error",
                     F.when(F.col("k") < 50, 401).when(F.col("k") < 75, 403).otherwise(500))
              .when(F.col("k") >= 98, 503).when(F.col("k") >= 95, 404).otherwise(200))
    return {
        "endpoint": _mapped("event_type", API_ENDPOINT_BY_EVENT),
        "method": F.when(F.col("event_type").isin("view", "click"), "GET").otherwise("POST"),
        "status_code": status.cast("long"),
        "response_time": F.col("value") * 10,
        "payload": F.col("props"),
        "ip_address": F.col("ip"),
    }


def _web_cols() -> dict[str, F.Column]:
    user = F.element_at(F.array(*[F.lit(u) for u in WEB_USER_BY_MOD5]),
                        (F.col("user_id") % 5 + 1).cast("int"))
    status = (F.when(F.col("event_type") == "error", "failed")
              .when((F.col("event_type") == "purchase") & (user != "admin"), "unauthorized")
              .otherwise("success"))
    return {
        "event_type": _mapped("event_type", WEB_EVENT_BY_EVENT),
        "user": user,
        "source_ip": F.col("ip"),
        "traffic_type": F.when(F.col("k") < 50, "test").otherwise("real"),
        "status": status,
        "response_time": F.col("value") / 100,
    }


def api_log(events: DataFrame, time_scale: int = 1) -> DataFrame:
    """API request log: seq, batch_id, ts, endpoint, method, status_code,
    response_time (ms), payload, ip_address, user_id, k."""
    b = _base(events, time_scale)
    return b.select("seq", "batch_id", "ts", *[c.alias(n) for n, c in _api_cols().items()],
                    "user_id", "k")


def with_gaps(log: DataFrame) -> DataFrame:
    """The same rows under a sequence with gaps, as a log has them after lost or
    late files: it starts at 1000, and after every 4500 rows 37 numbers are
    missing.  Batch numbers are gone with it."""
    n = F.col("seq")
    return log.withColumn("seq", n + 1000 + 37 * F.floor(n / 4500)).drop("batch_id")


def web_log(events: DataFrame, time_scale: int = 60) -> DataFrame:
    """Website event log: seq, batch_id, ts, event_type, user, source_ip,
    traffic_type, status, response_time (s), user_id, k.

    ``time_scale=60`` turns the 30 days of the table into 12 hours so that the
    per-second rules (rapid requests, request rates) see realistic traffic.
    """
    b = _base(events, time_scale)
    return b.select("seq", "batch_id", "ts", *[c.alias(n) for n, c in _web_cols().items()],
                    "user_id", "k")


API_SIDE = ["api_ts", "endpoint", "status_code", "api_response_time"]


def web_with_api(events: DataFrame, time_scale: int = 60) -> DataFrame:
    """The web log plus the API view of the same events row (``api_ts``
    unscaled, ``endpoint``, ``status_code``, ``api_response_time`` in ms), from
    one scan: rules computed on the web form and metrics on the API form then
    need no self-join on seq."""
    b = _base(events, time_scale)
    api = _api_cols()
    return b.select("seq", "batch_id", "ts", *[c.alias(n) for n, c in _web_cols().items()],
                    "user_id", "k", F.col("raw_ts").alias("api_ts"), api["endpoint"].alias("endpoint"),
                    api["status_code"].alias("status_code"),
                    api["response_time"].alias("api_response_time"))


def events_where(events: DataFrame, mapping: dict, value: str) -> DataFrame:
    """Restrict events to those whose mapped column equals ``value``, stated on
    the raw ``event_type`` so the predicate reaches the parquet scan."""
    raw = [k for k, v in mapping.items() if v == value]
    return events.where(F.col("event_type").isin(*raw))


def pattern_type() -> F.Column:
    """The traffic generator's user pattern of an events row."""
    m = F.col("user_id") % 10
    return F.when(m == 8, "bot").when(m == 9, "attacker").otherwise("normal_user")
