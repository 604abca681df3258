"""Decisions on the reference's quirks and edge inputs:
empty frames, a single row, NULL keys."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fixtures import api_df
from logvigil.operators import features, metrics, response, rules, windows

T0 = datetime(2024, 1, 1, 10, 5, 0)


def _api(spark, rows):
    return spark.createDataFrame(
        [(i, T0 + timedelta(seconds=s), e, st, rt, ip, i // 30) for i, (s, e, st, rt, ip) in enumerate(rows)],
        "seq long, ts timestamp_ntz, endpoint string, status_code long, response_time double, "
        "ip_address string, batch_id long")


def test_minute_rates_value_vs_positional(spark):
    # minutes 5,5,6: value alignment gives each row its own minute's count;
    # positional gives row i the count of minute i (rows 0-2 -> minutes 0-2: none)
    df = _api(spark, [(0, "/a", 200, 1.0, "x"), (10, "/a", 500, 1.0, "x"), (70, "/a", 200, 1.0, "x")])
    v = [r.request_rate for r in windows.minute_rates(df).orderBy("seq").collect()]
    assert v == [2, 2, 1]
    p = [r.request_rate for r in windows.minute_rates(df, align="positional").orderBy("seq").collect()]
    assert p == [0, 0, 0]


def test_rolling_needs_full_window_and_zero_std(spark):
    rows = [(i, "/a", 200, 100.0, "x") for i in range(12)]
    out = windows.rolling_response_time(_api(spark, rows)).orderBy("seq").collect()
    assert [r.rt_moving_avg for r in out[:9]] == [0.0] * 9
    assert out[9].rt_moving_avg == 100.0 and out[9].rt_moving_std == 0.0
    assert out[9].rt_zscore == 0.0  # zero std: 0, not inf/NaN


def test_consecutive_errors_is_a_count_of_last_three(spark):
    st = [500, 200, 500, 500, 200]
    out = windows.consecutive_errors(_api(spark, [(i, "/a", s, 1.0, "x") for i, s in enumerate(st)]))
    assert [r.consecutive_errors for r in out.orderBy("seq").collect()] == [0, 0, 2, 2, 2]


def test_failed_attempts_zero_on_non_failed_rows(spark):
    web = spark.createDataFrame(
        [(0, T0, "login", "u", "1.1.1.1", "failed", 0.1, 0),
         (1, T0, "login", "u", "1.1.1.1", "success", 0.1, 0)],
        "seq long, ts timestamp_ntz, event_type string, user string, source_ip string, "
        "status string, response_time double, batch_id long")
    out = windows.attempt_counts(web).orderBy("seq").collect()
    assert [r.ip_failed_attempts for r in out] == [1, 0]
    assert [r.ip_attempts for r in out] == [2, 2]


def test_rapid_negative_gap_counts(spark):
    web = spark.createDataFrame(
        [(0, T0, "ip"), (1, T0 - timedelta(seconds=5), "ip"), (2, T0 + timedelta(seconds=30), "ip")],
        "seq long, ts timestamp_ntz, source_ip string")
    out = windows.rapid_requests(web, batch=None).orderBy("seq").collect()
    assert [r.rapid_requests for r in out] == [0, 1, 0]


def test_alert_reasons_raw_parity_and_status_rule(spark):
    rows = spark.createDataFrame(
        [(0, "admin_action", "bob", "unauthorized", 2.0, 1, 1, 0),
         (1, "login", "unknown_user", "failed", 0.1, 0, 5, 1)],
        "seq long, event_type string, user string, status string, response_time double, "
        "is_admin_action long, user_attempts long, is_failed_login long")
    fixed = {r.seq: list(r.reasons) for r in rules.alert_reasons(rows).collect()}
    assert fixed[0] == ["Unusual response time", "Unauthorized admin action attempt"]
    assert fixed[1] == ["Multiple failed login attempts", "Unknown user attempt"]
    raw = {r.seq: list(r.reasons) for r in rules.alert_reasons(rows, raw_parity=True).collect()}
    assert raw[0] == ["Unusual response time"]
    assert raw[1] == ["Unknown user attempt"]


def test_block_reason_auth_overwrites_rate(spark):
    rows = [(i, "/api/auth", 401, 1.0, "ip") for i in range(6)]  # 1 request/s
    out = response.block_decisions(_api(spark, rows), max_rate=0.5).orderBy("seq").collect()
    assert out[-1].rate_blocked and out[-1].auth_blocked
    assert out[-1].reason == "Multiple failed auth attempts"
    assert out[0].request_rate == 0.0  # no time elapsed: rate 0, not a division error


def test_risk_thresholds_are_strict(spark):
    blocks = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "ip_address string")
    act = spark.createDataFrame(
        [("a", 10, 5, "bot"), ("b", 10, 2, "normal_user"), ("c", 0, 0, "attacker")],
        "ip_address string, request_count long, error_count long, pattern_type string")
    r = {x.ip_address: x for x in response.blocked_ip_risk(
        blocks.withColumn("blocked_at", F.lit(None).cast("timestamp_ntz"))
              .withColumn("reason", F.lit("r")), act).collect()}
    assert r["a"].risk_level == "medium" and r["a"].error_rate == 50.0   # exactly 50: not high
    assert r["b"].risk_level == "low" and r["b"].error_rate == 20.0      # exactly 20: not medium
    assert r["c"].request_count == 0 and r["c"].error_rate == 0.0
    assert (r["d"].request_count, r["d"].pattern_type) == (0, "unknown")


def test_session_expiry_is_strict(spark):
    now = T0 + timedelta(seconds=1800)
    starts = spark.createDataFrame(
        [("a", T0), ("b", T0 - timedelta(seconds=1)), ("c", T0 + timedelta(seconds=60))],
        "session_id string, start_ts timestamp_ntz")
    ends = spark.createDataFrame([("c", T0 + timedelta(seconds=120))], "session_id string, end_ts timestamp_ntz")
    assert response.active_sessions(starts, None, now).first()[0] == 2   # 1800 s stays, 1801 s goes
    assert response.active_sessions(starts, ends, now).first()[0] == 1   # logout removes c


def test_empty_and_single_row_inputs(spark):
    empty = _api(spark, [(0, "/a", 200, 1.0, "x")]).limit(0)
    assert metrics.endpoint_counters(empty).count() == 0
    tot = metrics.traffic_totals(empty).first()
    assert (tot.total_requests, tot.total_errors, tot.error_rate) == (0, 0, 0.0)
    st = metrics.endpoint_status(empty, metrics.endpoint_dimension(spark)).collect()
    assert len(st) == 5 and all(r.success_rate == 100.0 for r in st)
    one = _api(spark, [(0, "/api/cart", 500, 7.0, "x")])
    ea = metrics.endpoint_analysis(one.withColumn("is_anomaly", F.lit(True))).first()
    assert ea.rt_std is None and ea.error_rate == 1.0
    assert response.rate_state(one).first().request_rate == 0.0


def test_null_keys(spark):
    web = spark.createDataFrame(
        [(0, T0, "login", None, None, "failed", None, 0),
         (1, T0, "login", None, None, "failed", None, 0)],
        "seq long, ts timestamp_ntz, event_type string, user string, source_ip string, "
        "status string, response_time double, batch_id long")
    f = features.web_features(web, batch=None).orderBy("seq").collect()
    assert [r.ip_attempts for r in f] == [2, 2]          # NULL IP is one group
    assert [r.is_unknown_user for r in f] == [1, 1]       # NULL user is unknown
    assert [r.response_time for r in f] == [0.0, 0.0]     # missing response time -> 0
    assert features.with_ip_last_octet(web).first().ip_last_octet == 0


def test_fixture_pairs_match_doubling(spark):
    # the variant logs each request twice: counters count what is in the log
    c = {r.endpoint: r.requests for r in metrics.endpoint_counters(api_df(spark)).collect()}
    assert all(v % 2 == 0 for v in c.values())
