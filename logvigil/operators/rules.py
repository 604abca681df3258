"""Rule detection (M8) and alerts (L1-L4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed alert texts of the monitor.
REASON_FAILED_LOGINS = "Multiple failed login attempts"
REASON_SLOW = "Unusual response time"
REASON_ADMIN = "Unauthorized admin action attempt"
REASON_UNKNOWN_USER = "Unknown user attempt"
REASON_STATISTICAL = "Statistical anomaly detected"
UNKNOWN_USER_MARK = "unknown_user"

RULES = ["rule_ip_failed", "rule_user_failed", "rule_slow", "rule_admin_unauthorized",
         "rule_unknown_user", "rule_rapid"]


def rule_flags(feats: DataFrame, attempts: int = 3) -> DataFrame:
    """M8 rules on the web feature vector, each a boolean column, plus their OR."""
    d = feats.withColumns({
        "rule_ip_failed": F.col("ip_failed_attempts") >= attempts,
        "rule_user_failed": F.col("user_failed_attempts") >= attempts,
        "rule_slow": F.col("high_response_time") == 1,
        "rule_admin_unauthorized": (F.col("is_admin_action") == 1) & (F.col("status_unauthorized") == 1),
        "rule_unknown_user": F.col("is_unknown_user") == 1,
        "rule_rapid": F.col("rapid_requests") == 1,
    })
    any_rule = None
    for r in RULES:
        any_rule = F.col(r) if any_rule is None else any_rule | F.col(r)
    return d.withColumn("rule_anomaly", any_rule)


def rule_anomalies(feats: DataFrame, attempts: int = 3) -> DataFrame:
    return rule_flags(feats, attempts).withColumn("is_anomaly", F.col("rule_anomaly"))


def hybrid_anomalies(feats: DataFrame, forest_flag: str = "forest_anomaly",
                     attempts: int = 3) -> DataFrame:
    """M8: forest prediction OR any rule."""
    d = rule_flags(feats, attempts)
    return d.withColumn("is_anomaly", F.coalesce(F.col(forest_flag), F.lit(False)) | F.col("rule_anomaly"))


def alert_reasons(df: DataFrame, attempts: int = 3, slow_s: float = 1.0,
                  raw_parity: bool = False) -> DataFrame:
    """L1: ordered list of reasons for each (anomalous) row.

    Rows must be enriched (web features joined to the raw row) unless
    ``raw_parity``: then, as in the reference, the derived flags are absent so
    the failed-login and admin reasons never fire.
    """
    rt = F.coalesce(F.col("response_time"), F.lit(0.0))
    unknown = F.coalesce(F.col("user").contains(UNKNOWN_USER_MARK), F.lit(False))
    if raw_parity:
        failed = F.lit(False)
        admin = F.lit(False)
    else:
        failed = (F.col("is_failed_login") == 1) & (F.col("user_attempts") > attempts)
        admin = (F.col("is_admin_action") == 1) & ~F.coalesce(F.col("status") == "success", F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(failed, F.lit(REASON_FAILED_LOGINS)),
        F.when(rt > slow_s, F.lit(REASON_SLOW)),
        F.when(admin, F.lit(REASON_ADMIN)),
        F.when(unknown, F.lit(REASON_UNKNOWN_USER))))
    return df.withColumn("reasons", F.when(F.size(reasons) == 0, F.array(F.lit(REASON_STATISTICAL)))
                         .otherwise(reasons))


def alert_records(df: DataFrame, detail_cols: list[str] | None = None) -> DataFrame:
    """L2: alert row -- joined reasons, traffic type ('unknown' when absent)
    and the row's details as JSON text."""
    details = detail_cols or [c for c in df.columns if c != "reasons"]
    tt = F.col("traffic_type") if "traffic_type" in df.columns else F.lit(None).cast("string")
    return df.select(*[c for c in ("seq", "ts") if c in df.columns],
                     F.array_join("reasons", ", ").alias("reasons"),
                     F.coalesce(tt, F.lit("unknown")).alias("traffic_type"),
                     F.to_json(F.struct(*details)).alias("details"))


def alert_reason_counts(df: DataFrame) -> DataFrame:
    """L3: alerts per reason."""
    return (df.select(F.explode("reasons").alias("reason"))
              .groupBy("reason").agg(F.count(F.lit(1)).alias("alerts")))
