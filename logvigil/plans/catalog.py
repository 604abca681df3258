"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of SURVEY §2, each over the whole ``events`` table.

Query parameters that are not the reference's defaults are chosen so that the
rule actually selects some rows of the test table (see adapters): the rate
limit is 0.05 requests/s instead of 100.  The "now" of the as-of views is the
end of the (time-compressed) log, so they cover every row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logvigil.functions.exprs import parse_ts, round6
from logvigil.operators import (arrival, features, iforest, metrics, response, rules, sparse,
                                validation, windows)
from logvigil.plans import adapters as A
from logvigil.schemas import API_CREDENTIALS, DETECTOR_KNOWN_USERS, WEBSITE_USERS
from logvigil.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Fixed query parameters.
TIME_SCALE = 60
NOW = "2024-01-01 12:00:00"
TEST_MAX_RATE = 0.05
TEST_MEAN_RATE = 0.0072
ANOMALY_SCORE_DIVISOR = 10000.0
GAPPED_CHUNK = 10_000


def query(fn):
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


# ----------------------------------------------------------------- inputs
def _events(spark, sf):
    return A.read_events(spark, sf)


def _api(spark, sf, scale=1):
    return A.api_log(_events(spark, sf), time_scale=scale)


def _web(spark, sf, scale=TIME_SCALE):
    return A.web_log(_events(spark, sf), time_scale=scale)


def _web_feats(spark, sf):
    return features.web_features(_web(spark, sf), batch="batch_id")


RAW_WEB = ("seq", "ts", "event_type", "user", "source_ip", "traffic_type", "status")


def _rule_scored_api(spark, sf):
    """API rows with is_anomaly from the web rules of the same event and a
    score derived from the response time (oracle-checkable stand-in).  Both
    forms come from one scan, carried through the feature windows."""
    both = A.web_with_api(_events(spark, sf), TIME_SCALE)
    feats = features.web_features(both, keep=("seq", *A.API_SIDE))
    return rules.rule_anomalies(feats).select(
        "seq", "batch_id", F.col("api_ts").alias("ts"), "endpoint", "status_code",
        F.col("api_response_time").alias("response_time"), "is_anomaly",
        (-F.col("api_response_time") / ANOMALY_SCORE_DIVISOR).alias("anomaly_score"))


def _decisions(spark, sf, max_rate=TEST_MAX_RATE):
    return response.block_decisions(_api(spark, sf, TIME_SCALE), max_rate=max_rate)


def _limits(spark, sf):
    return response.rate_limit_view(_api(spark, sf, TIME_SCALE), NOW)


def _risk(spark, sf):
    api = _api(spark, sf, TIME_SCALE).withColumn("pattern_type", A.pattern_type())
    blocks = response.block_list(response.block_decisions(api, max_rate=TEST_MAX_RATE))
    act = metrics.ip_activity(api)
    return response.blocked_ip_risk(blocks, act)


# ----------------------------------------------------- projections (§2.2)
@query
def q_parse_timestamp(spark, sf):
    """P1 on the producers' text form; every 17th text is malformed."""
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    raw = _events(spark, sf).select(F.col("event_id").alias("seq"), F.when(
        F.col("event_id") % 17 == 0, F.concat(F.lit("x"), text)).otherwise(text).alias("timestamp"))
    return raw.select("seq", parse_ts("timestamp").alias("ts"))


@query
def q_calendar_features(spark, sf):
    return features.calendar_features(_api(spark, sf)).select(
        "seq", "hour", "minute", "day_of_week", "is_peak_hour", "is_weekend")


@query
def q_ip_last_octet(spark, sf):
    return features.with_ip_last_octet(_web(spark, sf)).select("seq", "source_ip", "ip_last_octet")


def _one_hot(spark, sf, column, prefix):
    web = _web(spark, sf)
    values = features.categories(web, column)
    d = features.one_hot(web, column, prefix, values)
    return d.select("seq", *[f"{prefix}_{v}" for v in values])


@query
def q_one_hot_event_type(spark, sf):
    return _one_hot(spark, sf, "event_type", "event")


@query
def q_one_hot_status(spark, sf):
    return _one_hot(spark, sf, "status", "status")


@query
def q_one_hot_user(spark, sf):
    return _one_hot(spark, sf, "user", "user")


@query
def q_base_features(spark, sf):
    web = _web(spark, sf).select("seq", "ts", "event_type", "user", "source_ip", "traffic_type",
                                 "status", "response_time")
    return features.base_features(web)


def _many_users(web):
    """The web log with every user of the table by their own name."""
    return web.withColumn("user", F.concat(F.lit("u"), F.col("user_id").cast("string")))


@query
def q_sparse_base_features(spark, sf):
    """P6-P8, sparse form, for all users of the table: one row per non-zero
    feature of each event."""
    vectors = features.sparse_base_features(_many_users(_web(spark, sf)))
    return sparse.long_form(vectors, features.BASE_LAYOUT)


@query
def q_web_flags(spark, sf):
    return features.web_flags(_web(spark, sf)).select(
        "seq", "high_response_time", "is_admin_action", "is_failed_login", "is_unknown_user",
        "status_failed", "status_unauthorized")


@query
def q_web_features(spark, sf):
    return _web_feats(spark, sf)


@query
def q_api_features(spark, sf):
    f = features.api_features(_api(spark, sf))
    return features.round_features(f, features.API_FEATURES[1:])


@query
def q_client_ip_traffic(spark, sf):
    web = _web(spark, sf).withColumns({
        "is_test_traffic": F.col("k") < 50,
        "forwarded_for": F.when(F.col("k") % 10 == 9, F.lit(None).cast("string"))
                          .otherwise(F.concat(F.lit("10.1.0."), F.col("k").cast("string"))),
        "remote_addr": F.col("source_ip")})
    both = validation.client_ip_header(validation.client_ip_traffic(web), header="forwarded_for")
    return both.select("seq", "client_ip", "traffic_type", "api_client_ip")


@query
def q_admin_authorization(spark, sf):
    ev = A.events_where(_events(spark, sf), A.WEB_EVENT_BY_EVENT, "admin_action")
    web = A.web_log(ev, TIME_SCALE).where(F.col("event_type") == "admin_action")
    return validation.admin_authorization(web).select("seq", "user", "auth_status", "http_status")


def product_payload(k: F.Column) -> F.Column:
    name = F.concat(F.lit('{"name": "item'), k.cast("string"), F.lit('", "price": '),
                    (k - 10).cast("string"))
    unnamed = F.concat(F.lit('{"name": null, "price": '), k.cast("string"), F.lit(', "stock": 1}'))
    return F.when(k % 11 == 0, F.concat(name, F.lit("}"))).when(k % 13 == 0, unnamed).otherwise(
        F.concat(name, F.lit(', "stock": '), (k % 7 - 1).cast("string"), F.lit("}")))


def auth_payload(k: F.Column) -> F.Column:
    user = F.element_at(F.array(F.lit("user1"), F.lit("admin"), F.lit("nonexistent")),
                        (k % 3 + 1).cast("int"))
    pw = F.when(k % 2 == 0, "pass123").otherwise("wrong_pass")
    head = F.concat(F.lit('{"username": "'), user, F.lit('"'))
    return F.when(k % 11 == 0, F.concat(head, F.lit("}"))).otherwise(
        F.concat(head, F.lit(', "password": "'), pw, F.lit('"}')))


@query
def q_payload_validation(spark, sf):
    ev = A.events_where(_events(spark, sf), A.API_ENDPOINT_BY_EVENT, "/api/products")
    api = (A.api_log(ev).where(F.col("endpoint") == "/api/products")
           .withColumns({"method": F.when(F.col("k") % 4 == 0, "GET").otherwise("POST"),
                         "payload": product_payload(F.col("k")),
                         "authenticated": F.col("k") % 5 != 0}))
    return validation.payload_validation(api).select("seq", "method", "validated_status")


@query
def q_auth_validation(spark, sf):
    ev = A.events_where(_events(spark, sf), A.API_ENDPOINT_BY_EVENT, "/api/auth")
    api = A.api_log(ev).where(F.col("endpoint") == "/api/auth") \
        .withColumn("payload", auth_payload(F.col("k")))
    creds = spark.createDataFrame(API_CREDENTIALS, "username string, password string")
    return validation.auth_validation(api, creds).select("seq", "username", "auth_status_code")


@query
def q_anomalous_rows(spark, sf):
    feats = features.web_features(_web(spark, sf), keep=RAW_WEB)
    return rules.rule_anomalies(feats).where("is_anomaly").select(
        "seq", "ts", "event_type", "user", "source_ip", "status", "response_time")


@query
def q_status_class_counts(spark, sf):
    return metrics.status_class_counts(_api(spark, sf))


# -------------------------------------------------------- lookups (§2.3)
@query
def q_endpoint_rt_zscore(spark, sf):
    return metrics.endpoint_rt_zscore(_api(spark, sf))


@query
def q_endpoint_status(spark, sf):
    return metrics.endpoint_status(_api(spark, sf), metrics.endpoint_dimension(spark))


@query
def q_known_user_flag(spark, sf):
    known = spark.createDataFrame([(u,) for u in WEBSITE_USERS], "user string")
    return validation.known_user_flag(_web(spark, sf), known).select("seq", "user", "is_known_user")


@query
def q_unknown_user_events(spark, sf):
    known = spark.createDataFrame([(u,) for u in DETECTOR_KNOWN_USERS], "user string")
    return validation.unknown_user_events(_web(spark, sf), known).select("seq", "user", "event_type")


@query
def q_session_ip(spark, sf):
    """Sessions of two users in three; every tenth request has none."""
    api = _api(spark, sf)
    user = F.concat(F.lit("s"), F.col("user_id").cast("string"))
    sessions = api.where(F.col("user_id") % 3 != 0).select(user.alias("session_id"), "ip_address")
    requests = api.select("seq", F.when(F.col("k") % 10 != 0, user).alias("session_id"))
    return validation.session_ip(requests, sessions)


@query
def q_blocked_ip_risk(spark, sf):
    return _risk(spark, sf)


# --------------------------------------------------- aggregations (§2.4)
@query
def q_endpoint_analysis(spark, sf):
    return metrics.endpoint_analysis(_rule_scored_api(spark, sf))


@query
def q_hourly_patterns(spark, sf):
    return metrics.hourly_patterns(_rule_scored_api(spark, sf))


@query
def q_anomaly_patterns(spark, sf):
    return metrics.anomaly_patterns(_rule_scored_api(spark, sf))


@query
def q_batch_summary(spark, sf):
    return metrics.batch_summary(_rule_scored_api(spark, sf))


@query
def q_endpoint_counters(spark, sf):
    return metrics.endpoint_counters(_api(spark, sf), metrics.endpoint_dimension(spark))


@query
def q_traffic_totals(spark, sf):
    return metrics.traffic_totals(_api(spark, sf), metrics.endpoint_dimension(spark))


@query
def q_ip_activity(spark, sf):
    return metrics.ip_activity(_api(spark, sf, TIME_SCALE).withColumn("pattern_type",
                                                                      A.pattern_type()))


@query
def q_security_summary(spark, sf):
    return response.security_summary(_risk(spark, sf), _limits(spark, sf))


@query
def q_endpoint_baseline(spark, sf):
    return metrics.endpoint_baseline(_api(spark, sf))


@query
def q_rate_over_threshold(spark, sf):
    return response.rate_over_threshold(_limits(spark, sf), NOW, threshold=TEST_MEAN_RATE)


# -------------------------------------------------------- windows (§2.5)
@query
def q_attempt_counts(spark, sf):
    return windows.attempt_counts(_web(spark, sf)).select(
        "seq", "batch_id", "ip_attempts", "ip_failed_attempts", "user_attempts",
        "user_failed_attempts")


@query
def q_minute_rates(spark, sf):
    return windows.minute_rates(_api(spark, sf)).select(
        "seq", "batch_id", "request_rate", round6("error_rate").alias("error_rate"))


@query
def q_rolling_response_time(spark, sf):
    return windows.rolling_response_time(_api(spark, sf)).select(
        "seq", "batch_id", round6("rt_moving_avg").alias("rt_moving_avg"),
        round6("rt_moving_std").alias("rt_moving_std"), round6("rt_zscore").alias("rt_zscore"))


@query
def q_consecutive_errors(spark, sf):
    return windows.consecutive_errors(_api(spark, sf)).select("seq", "batch_id", "consecutive_errors")


@query
def q_rapid_requests(spark, sf):
    return windows.rapid_requests(_web(spark, sf), batch=None).select(
        "seq", "source_ip", "rapid_requests")


@query
def q_running_request_rate(spark, sf):
    return windows.running_request_rate(_api(spark, sf, TIME_SCALE)).select(
        "seq", "ip_address", "request_count", round6("request_rate").alias("request_rate"))


@query
def q_auth_warnings(spark, sf):
    return windows.auth_warnings(_api(spark, sf, TIME_SCALE)).select("seq", "ip_address", "warnings")


@query
def q_login_attempts(spark, sf):
    return windows.login_attempts(_web(spark, sf)).select(
        "seq", "source_ip", "attempts", "last_attempt")


@query
def q_count_batches(spark, sf):
    return windows.count_batches(_api(spark, sf).drop("batch_id")).select(
        "seq", "batch_id", "pos_in_batch")


@query
def q_gapped_count_batches(spark, sf):
    """W12 on a log whose sequence has gaps."""
    return windows.count_batches(A.with_gaps(_api(spark, sf)), chunk_rows=GAPPED_CHUNK).select(
        "seq", "batch_id", "pos_in_batch")


@query
def q_gapped_endpoint_baseline(spark, sf):
    """A10 on the same log: all batches are numbered by one arrival index."""
    api = A.with_gaps(_api(spark, sf))
    return metrics.endpoint_baseline(api, index=arrival.build(api, chunk_rows=GAPPED_CHUNK))


@query
def q_gapped_api_features(spark, sf):
    """P15 + J1 on the same log."""
    api = A.with_gaps(_api(spark, sf))
    f = features.api_features(api, index=arrival.build(api, chunk_rows=GAPPED_CHUNK))
    return features.round_features(f, features.API_FEATURES[1:])


# ---------------------------------------------------- sort / limit (§2.6)
@query
def q_recent_requests(spark, sf):
    return metrics.recent_requests(_api(spark, sf)).select(
        "seq", "ts", "endpoint", "method", "status_code", "response_time")


@query
def q_history_tail(spark, sf):
    return metrics.history_tail(_api(spark, sf)).select("seq", "endpoint", "response_time")


# ----------------------------------------------------- rules, alerts (§2.7-8)
@query
def q_rule_anomalies(spark, sf):
    return rules.rule_anomalies(_web_feats(spark, sf)).select("seq", *rules.RULES, "is_anomaly")


def _alerts(spark, sf):
    feats = features.web_features(_web(spark, sf), keep=RAW_WEB)
    return rules.alert_reasons(rules.rule_anomalies(feats).where("is_anomaly"))


@query
def q_alert_reasons(spark, sf):
    return _alerts(spark, sf).select("seq", F.array_join("reasons", ", ").alias("reasons"))


@query
def q_alert_records(spark, sf):
    return rules.alert_records(_alerts(spark, sf),
                               detail_cols=["event_type", "user", "source_ip", "status"])


@query
def q_alert_reason_counts(spark, sf):
    return rules.alert_reason_counts(_alerts(spark, sf))


@query
def q_security_events(spark, sf):
    return response.security_events(_decisions(spark, sf))


# ------------------------------------------------- rate limits (§2.9)
@query
def q_rate_breaches(spark, sf):
    return response.rate_breaches(_api(spark, sf, TIME_SCALE), max_rate=TEST_MAX_RATE).select(
        "seq", "ip_address", "request_count", round6("request_rate").alias("request_rate"))


@query
def q_auth_lockouts(spark, sf):
    return response.auth_lockouts(_api(spark, sf, TIME_SCALE)).select("seq", "ip_address", "warnings")


@query
def q_block_decisions(spark, sf):
    return _decisions(spark, sf).select("seq", "ip_address", "is_blocked", "reason")


@query
def q_block_list(spark, sf):
    return response.block_list(_decisions(spark, sf)).select(
        "ip_address", "blocked_at", "reason", round6("request_rate").alias("request_rate"),
        "warning_count")


@query
def q_rate_limit_view(spark, sf):
    return _limits(spark, sf).select("ip_address", "count", "warnings", "request_rate",
                                     "last_activity_ago_s")


@query
def q_block_reason_variant(spark, sf):
    blocks = response.block_list(_decisions(spark, sf))
    return response.block_reason_variant(blocks, _limits(spark, sf), NOW)


def session_tables(web: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions start at successful logins (id = seq); one in ten logs out
    600 s later."""
    starts = web.where((F.col("event_type") == "login") & (F.col("status") == "success")) \
        .select(F.col("seq").alias("session_id"), F.col("ts").alias("start_ts"), "k")
    ends = starts.where(F.col("k") % 10 == 0).select(
        "session_id", F.timestamp_add("SECOND", F.lit(600), F.col("start_ts")).alias("end_ts"))
    return starts.drop("k"), ends


@query
def q_active_sessions(spark, sf):
    starts, ends = session_tables(_web(spark, sf))
    return response.active_sessions(starts, ends, NOW)


@query
def q_idle_sessions(spark, sf):
    return response.idle_sessions(_events(spark, sf), "user_id", order="event_id")


# -------------------------------------------------- anomaly detection (§2.7)
FOREST_TREES = 100
FOREST_PSI = 100
BASE_PSI = 256
FOREST_SEED = 42
WEB_CONTAMINATION = 0.1
API_CONTAMINATION = 0.15
BASE_CONTAMINATION = 0.2


def _web_source(spark, sf, keep=("seq",)):
    """The web log and its features; a batch's features need its rows only."""
    return iforest.LogSource(_web(spark, sf), lambda log: features.web_features(
        log, batch="batch_id", keep=keep), "batch_id")


def _web_forest(spark, sf, contamination=None):
    src = _web_source(spark, sf)
    model = iforest.fit(src, features.WEB_FEATURES, trees=FOREST_TREES, psi=FOREST_PSI,
                        seed=FOREST_SEED, contamination=contamination)
    return src.features(), model


@query
def q_scaled_features(spark, sf):
    scaled = iforest.scale(_web_feats(spark, sf), features.WEB_FEATURES)
    return scaled.select("seq", *[round6(c).alias(c) for c in features.WEB_FEATURES])


@query
def q_iforest_scores(spark, sf):
    feats, model = _web_forest(spark, sf)
    return iforest.score(feats, model).select("seq", "score")


@query
def q_contamination_threshold(spark, sf):
    scores = _web(spark, sf).select((-F.col("response_time") / 10.0).alias("score"))
    thr = iforest.exact_quantile(scores, "score", WEB_CONTAMINATION)
    return spark.createDataFrame([(thr,)], "threshold double")


@query
def q_iforest_flags(spark, sf):
    _, flagged = iforest.fit_predict(_web_source(spark, sf), features.WEB_FEATURES,
                                     WEB_CONTAMINATION, trees=FOREST_TREES, psi=FOREST_PSI,
                                     seed=FOREST_SEED)
    return flagged.select("seq", "score", "is_anomaly")


@query
def q_stored_model(spark, sf):
    """M7 + S5: a saved and reloaded forest scores the log."""
    feats, model = _web_forest(spark, sf, WEB_CONTAMINATION)
    path = f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    iforest.save_model(spark, model, path)
    return iforest.predict(feats, iforest.load_model(spark, path)).select("seq", "score", "is_anomaly")


@query
def q_batch_iforest(spark, sf):
    """M6 on the report form of the features (6 places), as any engine prints
    them, so equal features give equal splits everywhere."""
    api = windows.count_batches(_api(spark, sf).drop("batch_id"))
    feats = features.round_features(features.api_features(api), features.API_FEATURES[1:])
    return iforest.fit_score_batches(feats, features.API_FEATURES, trees=100, psi=256,
                                     contamination=API_CONTAMINATION, seed=FOREST_SEED)


def _hybrid(spark, sf, keep=("seq",)):
    _, flagged = iforest.fit_predict(_web_source(spark, sf, keep), features.WEB_FEATURES, WEB_CONTAMINATION,
                                     trees=FOREST_TREES, psi=FOREST_PSI, seed=FOREST_SEED,
                                     out="forest_anomaly")
    return rules.hybrid_anomalies(flagged)


@query
def q_hybrid_anomalies(spark, sf):
    return _hybrid(spark, sf).select("seq", "forest_anomaly", F.col("rule_anomaly"), "is_anomaly")


def _base_source(web):
    return iforest.LogSource(web, features.sparse_base_features)


@query
def q_base_detector(spark, sf):
    """M9 on the sparse form of P6-P8."""
    _, flagged = iforest.fit_predict(_base_source(_web(spark, sf)), "features", BASE_CONTAMINATION,
                                     trees=FOREST_TREES, psi=BASE_PSI, seed=FOREST_SEED,
                                     layout=features.BASE_LAYOUT)
    return flagged.select("seq", "score", "is_anomaly")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid detection (forest OR rules) with explained alerts."""
    flagged = _hybrid(spark, sf, keep=RAW_WEB).where("is_anomaly")
    return rules.alert_records(rules.alert_reasons(flagged),
                               detail_cols=["event_type", "user", "source_ip", "status"])
