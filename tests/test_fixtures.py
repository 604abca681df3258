"""Values worked out by hand on the small log of fixtures.py."""

import json
import os

import pytest
from pyspark.sql import functions as F

from fixtures import API_ROWS, FULL_WEB_LOG, SPARSE_OCTETS, SPARSE_WEB_LOG, api_df
from logvigil.operators import features, metrics, rules, windows
from logvigil.sources.json_logs import parse_web_log, read_log_envelope


def _write(tmpdir_path, name, obj):
    p = os.path.join(tmpdir_path, name)
    with open(p, "w") as f:
        json.dump(obj, f, indent=2)
    return p


def test_sparse_web_log_envelope(spark, tmpdir_path):
    p = _write(tmpdir_path, "sample_logs.json", SPARSE_WEB_LOG)
    df = parse_web_log(read_log_envelope(spark, p), seq="file_pos")
    assert df.count() == 5
    counts = {r[0]: r[1] for r in df.groupBy("event_type").count().collect()}
    assert counts == {"login": 3, "data_access": 1, "backup": 1}
    octets = [r[0] for r in features.with_ip_last_octet(df).orderBy("seq")
              .select("ip_last_octet").collect()]
    assert octets == SPARSE_OCTETS
    flags = features.web_flags(df).orderBy("seq")
    assert sum(r[0] for r in flags.select("is_unknown_user").collect()) == 0
    assert sum(r[0] for r in flags.select("is_failed_login").collect()) == 1
    assert df.where(F.col("file_path").isNotNull()).count() == 1
    assert df.where(F.col("source_ip").isNull()).count() == 1


def test_full_web_log_features_rules_reasons(spark, tmpdir_path):
    p = _write(tmpdir_path, "website_logs.json", FULL_WEB_LOG)
    df = parse_web_log(read_log_envelope(spark, p), seq="file_pos")
    f = features.web_features(df, batch=None).orderBy("seq").collect()
    assert [r.ip_attempts for r in f] == [2, 2]
    assert [r.ip_failed_attempts for r in f] == [0, 1]
    assert [r.user_attempts for r in f] == [1, 1]
    assert [r.is_failed_login for r in f] == [0, 1]
    assert [r.is_unknown_user for r in f] == [0, 1]
    assert [r.rapid_requests for r in f] == [0, 0]
    flagged = rules.rule_anomalies(features.web_features(df, batch=None)).orderBy("seq")
    assert [r.is_anomaly for r in flagged.select("is_anomaly").collect()] == [False, True]
    enriched = df.join(flagged.where("is_anomaly").select(
        "seq", "is_failed_login", "user_attempts", "is_admin_action"), "seq")
    reasons = rules.alert_reasons(enriched).select(F.array_join("reasons", ", ")).collect()
    assert [r[0] for r in reasons] == ["Unknown user attempt"]


def test_api_fixture_endpoint_status(spark):
    api = api_df(spark)
    st = {r.endpoint: r for r in metrics.endpoint_status(
        api, metrics.endpoint_dimension(spark)).collect()}
    assert (st["/api/auth"].requests, st["/api/auth"].errors, st["/api/auth"].success_rate) == (6, 6, 0.0)
    assert (st["/api/cart"].requests, st["/api/cart"].errors, st["/api/cart"].success_rate) == (14, 8, 42.9)
    assert st["/api/orders"].success_rate == 100.0 and st["/api/products"].requests == 8
    u = st["/api/users"]
    assert (u.requests, u.success_rate, u.last_status, u.last_response_time) == (0, 100.0, 200, 0.0)
    assert (st["/api/auth"].last_status, st["/api/auth"].last_response_time) == (401, 3400.0)
    assert (st["/api/cart"].last_status, st["/api/cart"].last_response_time) == (500, 3500.0)
    tot = metrics.traffic_totals(api, metrics.endpoint_dimension(spark)).first()
    assert (tot.total_requests, tot.total_errors, tot.error_rate) == (36, 14, 38.9)


def test_api_fixture_analysis(spark):
    api = api_df(spark).withColumn("is_anomaly", F.col("response_time") > 3450)
    ea = {r.endpoint: r for r in metrics.endpoint_analysis(api).collect()}
    times = {e: [r[4] for r in API_ROWS if r[1] == e] for e in ea}
    for e, r in ea.items():
        assert r.rt_mean == pytest.approx(sum(times[e]) / len(times[e]), abs=1e-6)
        assert r.rt_max == max(times[e])
    assert ea["/api/auth"].error_rate == 1.0
    assert ea["/api/cart"].anomaly_rate == pytest.approx(1 / 14, abs=1e-6)


def test_api_fixture_count_batches(spark):
    out = windows.count_batches(api_df(spark).drop("batch_id"), size=30)
    assert out.count() == 30  # the tail of 6 rows stays open
    assert out.select(F.countDistinct("batch_id")).first()[0] == 1


def test_count_batches_with_gaps_in_seq(spark):
    df = api_df(spark).drop("batch_id").where("seq <> 4").withColumn("seq", F.col("seq") * 7 + 3)
    out = windows.count_batches(df, size=5, chunk_rows=40).orderBy("seq").collect()
    assert [(r.batch_id, r.pos_in_batch) for r in out] == [(i // 5, i % 5) for i in range(35)]


def test_null_endpoint_has_no_baseline(spark):
    from logvigil.operators import features
    api = api_df(spark).withColumn("endpoint", F.when(F.col("seq") != 3, F.col("endpoint")))
    z = {r.seq: r.endpoint_rt_zscore for r in metrics.endpoint_rt_zscore(api).collect()}
    assert len(z) == 36 and z[3] == 0.0 and any(z.values())
    named = features.api_features(api.withColumnRenamed("batch_id", "b"), batch="b")
    assert named.count() == 36


def test_one_hot_of_many_values(spark):
    from logvigil.operators import features
    web = spark.range(1500).select(
        F.col("id").alias("seq"), F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts"),
        F.lit("login").alias("event_type"), F.lit("success").alias("status"),
        F.concat(F.lit("u"), (F.col("id") % 1200).cast("string")).alias("user"),
        F.lit("10.0.0.1").alias("source_ip"), F.lit(0.5).alias("response_time"))
    base = features.base_features(web)
    assert len([c for c in base.columns if c.startswith("user_")]) == 1200 and "seq" in base.columns
    long = features.one_hot_long(web, "user", "user")
    assert long.columns == ["seq", "prefix", "category", "value"] and long.count() == 1500


def test_session_ip_and_validation(spark):
    from logvigil.operators import validation
    req = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "seq long, session_id string")
    ses = spark.createDataFrame([("a", "58.1.2.3")], "session_id string, ip_address string")
    got = {r.seq: r.session_ip for r in validation.session_ip(req, ses).collect()}
    assert got == {1: "58.1.2.3", 2: "127.0.0.1", 3: "127.0.0.1"}
    body = spark.createDataFrame(
        [(1, "POST", True, '{"name": "x", "price": 3, "stock": 1}'),
         (2, "POST", True, '{"name": "x", "price": -3, "stock": 1}'),
         (3, "POST", True, '{"name": "x", "price": 3}'),
         (4, "POST", False, '{"name": "x", "price": 3, "stock": 1}'),
         (5, "POST", True, "{not json"), (6, "GET", False, None),
         (7, "POST", True, '{"name": null, "price": 3, "stock": 1}'),
         (8, "POST", True, '{"name": "x", "price": "a", "stock": 1}'), (9, "POST", True, None)],
        "seq long, method string, authenticated boolean, payload string")
    st = {r.seq: r.validated_status for r in validation.payload_validation(body).collect()}
    assert st == {1: 201, 2: 400, 3: 400, 4: 401, 5: 400, 6: 200, 7: 201, 8: 400, 9: 400}


def test_header_rule_and_duplicate_credentials(spark):
    from logvigil.operators import validation
    df = spark.createDataFrame([(1, "9.9.9.9", "1.1.1.1"), (2, None, "1.1.1.2")],
                               "seq long, simulated_ip string, remote_addr string")
    got = {r.seq: r.api_client_ip for r in validation.client_ip_header(df).collect()}
    assert got == {1: "9.9.9.9", 2: "1.1.1.2"}
    body = spark.createDataFrame([('{"username": "a", "password": "b"}',)], "payload string")
    creds = spark.createDataFrame([("a", "b"), ("a", "b")], "username string, password string")
    assert [r.auth_status_code for r in validation.auth_validation(body, creds).collect()] == [200]


def test_collapse_double_logged_pairs(spark):
    c = metrics.collapse_pairs(api_df(spark))
    assert c.count() == 18 and c.agg(F.min("logged_rows")).first()[0] == 2
    auth = c.where("endpoint = '/api/auth'").orderBy("seq").first()
    assert (auth.server_response_time, auth.response_time, auth.payload) == (140.0, 2400.0, '{"n": 4}')
    assert c.where("method = 'GET' AND payload IS NOT NULL").count() == 0


def test_calendar_minutes_and_plain_numbers(spark):
    from logvigil.operators import features
    api = spark.sql("""SELECT id AS seq, 0L AS batch_id, 200L AS status_code,
        timestamp_ntz'2031-05-04 08:05:00' + make_interval(0, 0, 0, 0, CAST(id % 2 AS INT), 0, 0) AS ts
        FROM range(6)""")
    assert {r.request_rate for r in windows.minute_rates(api).collect()} == {6}
    assert {r.request_rate for r in windows.minute_rates(api, calendar=True).collect()} == {3}
    web = parse_web_log(spark.createDataFrame([(0, "2031-05-04 08:00:00", "login", "u", "10.0.0.9", "ok")],
                        "seq long, timestamp string, event_type string, user string, source_ip string, "
                        "status string")).drop("timestamp")
    plain = features.base_features(web, one_hot_columns=False)
    assert plain.columns == ["seq", "hour", "minute", "day_of_week", "ip_last_octet"]
