"""DuckDB oracle SQL for the registered queries.

Independent formulations over the raw ``events`` view: plain window functions
over whole partitions, range joins and GROUP BY -- no chunking, no broadcast,
none of the Spark-side plan shapes.  Integer results are BIGINT and every
computed double is rounded exactly as the Spark query rounds it.
"""

from __future__ import annotations

from logvigil.operators.features import API_FEATURES, WEB_FEATURES
from logvigil.plans.adapters import BATCH_SIZE
from logvigil.plans.catalog import (API_CONTAMINATION, BASE_CONTAMINATION, BASE_PSI, FOREST_PSI,
                                    FOREST_SEED, FOREST_TREES, NOW, TEST_MAX_RATE, TEST_MEAN_RATE,
                                    TIME_SCALE, WEB_CONTAMINATION)
from logvigil.plans.forest_sql import (batch_forest_ctes, depth_for, forest_ctes, quantile_cte)

ORACLE: dict[str, str] = {}

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
EPOCH_ORIGIN_US = 1704067200000000


def _ts(scale: int) -> str:
    if scale == 1:
        return "ts"
    return (f"make_timestamp({EPOCH_ORIGIN_US} + (epoch_us(ts) - {EPOCH_ORIGIN_US}) // {scale})")


def api_cte(scale: int = 1, name: str = "api") -> str:
    return f"""{name} AS (
  SELECT event_id AS seq, event_id // 30 AS batch_id, {_ts(scale)} AS ts,
    CASE event_type WHEN 'view' THEN '/api/products' WHEN 'click' THEN '/api/cart'
      WHEN 'purchase' THEN '/api/orders' WHEN 'signup' THEN '/api/users'
      WHEN 'error' THEN '/api/auth' END AS endpoint,
    CASE WHEN event_type IN ('view', 'click') THEN 'GET' ELSE 'POST' END AS method,
    CAST(CASE WHEN user_id % 32 = 7 AND k >= 40 THEN 403
         WHEN user_id % 32 = 5 AND NOT (event_type = 'error' AND k < 50) THEN 200
         WHEN event_type = 'error' THEN
           CASE WHEN k < 50 THEN 401 WHEN k < 75 THEN 403 ELSE 500 END
         WHEN k >= 98 THEN 503 WHEN k >= 95 THEN 404 ELSE 200 END AS BIGINT) AS status_code,
    value * 10 AS response_time, props AS payload,
    '10.0.0.' || CAST(user_id % 32 AS VARCHAR) AS ip_address, user_id, k
  FROM (SELECT *, {K} AS k FROM events) e)"""


def web_cte(scale: int = TIME_SCALE, name: str = "web") -> str:
    return f"""{name} AS (
  SELECT event_id AS seq, event_id // 30 AS batch_id, {_ts(scale)} AS ts,
    CASE event_type WHEN 'signup' THEN 'login' WHEN 'error' THEN 'login'
      WHEN 'purchase' THEN 'admin_action' WHEN 'view' THEN 'data_access'
      WHEN 'click' THEN 'file_access' END AS event_type,
    u AS "user", '10.0.0.' || CAST(user_id % 32 AS VARCHAR) AS source_ip,
    CASE WHEN k < 50 THEN 'test' ELSE 'real' END AS traffic_type,
    CASE WHEN event_type = 'error' THEN 'failed'
         WHEN event_type = 'purchase' AND u <> 'admin' THEN 'unauthorized'
         ELSE 'success' END AS status,
    value / 100 AS response_time, user_id, k
  FROM (SELECT *, {K} AS k,
          ['user1', 'user2', 'admin', 'system', 'unknown_user'][user_id % 5 + 1] AS u
        FROM events) e)"""


WEB_FEATS = """web_feats AS (
  SELECT seq, batch_id, hour(ts) AS hour, minute(ts) AS minute,
    COUNT(*) OVER (PARTITION BY batch_id, source_ip) AS ip_attempts,
    CASE WHEN status = 'failed'
         THEN COUNT(*) OVER (PARTITION BY batch_id, source_ip, status = 'failed') ELSE 0 END
      AS ip_failed_attempts,
    COUNT(*) OVER (PARTITION BY batch_id, "user") AS user_attempts,
    CASE WHEN status = 'failed'
         THEN COUNT(*) OVER (PARTITION BY batch_id, "user", status = 'failed') ELSE 0 END
      AS user_failed_attempts,
    COALESCE(response_time, 0) AS response_time,
    CAST(COALESCE(response_time, 0) > 1.0 AS BIGINT) AS high_response_time,
    CAST(event_type = 'admin_action' AS BIGINT) AS is_admin_action,
    CAST(event_type = 'login' AND status = 'failed' AS BIGINT) AS is_failed_login,
    CAST(NOT COALESCE("user" IN ('user1', 'user2', 'admin', 'system'), false) AS BIGINT)
      AS is_unknown_user,
    CAST(COALESCE(epoch_us(ts) - LAG(epoch_us(ts)) OVER (PARTITION BY batch_id, source_ip
           ORDER BY seq) < 1000000, false) AS BIGINT) AS rapid_requests,
    CAST(status = 'failed' AS BIGINT) AS status_failed,
    CAST(status = 'unauthorized' AS BIGINT) AS status_unauthorized
  FROM web)"""

RULES = """rules AS (
  SELECT *, ip_failed_attempts >= 3 AS rule_ip_failed,
    user_failed_attempts >= 3 AS rule_user_failed,
    high_response_time = 1 AS rule_slow,
    is_admin_action = 1 AND status_unauthorized = 1 AS rule_admin_unauthorized,
    is_unknown_user = 1 AS rule_unknown_user,
    rapid_requests = 1 AS rule_rapid,
    (ip_failed_attempts >= 3 OR user_failed_attempts >= 3 OR high_response_time = 1
     OR (is_admin_action = 1 AND status_unauthorized = 1) OR is_unknown_user = 1
     OR rapid_requests = 1) AS is_anomaly
  FROM web_feats)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def scaled_round(sql: str) -> str:
    """Rewrite ``round(x, p)`` (p > 0) as ``round(x * 10^p) / 10^p``, the same
    half-away-from-zero rule on the scaled double that the Spark side uses."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, comma = 0, j + 6, None
        while True:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                if depth == 0:
                    break
                depth -= 1
            elif ch == "," and depth == 0:
                comma = k
            k += 1
        inner = sql[j + 6:k]
        if comma is None:
            out.append(sql[i:j] + "round(" + scaled_round(inner) + ")")
        else:
            expr, places = scaled_round(sql[j + 6:comma]), sql[comma + 1:k].strip()
            f = f"1e{int(places)}"
            out.append(sql[i:j] + f"(round(({expr}) * {f}) / {f})")
        i = k + 1


def reg(name: str, sql: str) -> None:
    ORACLE[name] = scaled_round(sql.strip())


WEB = web_cte()
API = api_cte()
API60 = api_cte(TIME_SCALE)

# ------------------------------------------------------------------ §2.2
reg("calendar_features", with_(API) + """
SELECT seq, hour(ts) AS hour, minute(ts) AS minute, isodow(ts) - 1 AS day_of_week,
  CAST(hour(ts) BETWEEN 9 AND 17 AS BIGINT) AS is_peak_hour,
  CAST(isodow(ts) >= 6 AS BIGINT) AS is_weekend
FROM api""")

reg("ip_last_octet", with_(WEB) + """
SELECT seq, source_ip,
  COALESCE(TRY_CAST(string_split(source_ip, '.')[-1] AS BIGINT), 0) AS ip_last_octet
FROM web""")


def _onehot(col: str, prefix: str, values: list[str]) -> str:
    cols = ", ".join(f"CAST(COALESCE({col} = '{v}', false) AS BIGINT) AS {prefix}_{v}"
                     for v in values)
    return with_(WEB) + f"SELECT seq, {cols} FROM web"


EVENT_TYPES = ["admin_action", "data_access", "file_access", "login"]
STATUSES = ["failed", "success", "unauthorized"]
USERS = ["admin", "system", "unknown_user", "user1", "user2"]
reg("one_hot_event_type", _onehot("event_type", "event", EVENT_TYPES))
reg("one_hot_status", _onehot("status", "status", STATUSES))
reg("one_hot_user", _onehot('"user"', "user", USERS))

BASE_FEATURES = ["response_time", "hour", "minute", "day_of_week",
                 *[f"event_{v}" for v in EVENT_TYPES], *[f"status_{v}" for v in STATUSES],
                 "ip_last_octet", *[f"user_{v}" for v in USERS]]
BASE_SELECT = ("SELECT seq, COALESCE(response_time, 0) AS response_time, "
    "hour(ts) AS hour, minute(ts) AS minute, isodow(ts) - 1 AS day_of_week, "
    + ", ".join(f"CAST(COALESCE(event_type = '{v}', false) AS BIGINT) AS event_{v}"
                for v in EVENT_TYPES) + ", "
    + ", ".join(f"CAST(COALESCE(status = '{v}', false) AS BIGINT) AS status_{v}"
                for v in STATUSES) + ", "
    + "COALESCE(TRY_CAST(string_split(source_ip, '.')[-1] AS BIGINT), 0) AS ip_last_octet, "
    + ", ".join(f"CAST(COALESCE(\"user\" = '{v}', false) AS BIGINT) AS user_{v}"
                for v in USERS) + " FROM web")
reg("base_features", with_(WEB) + BASE_SELECT)

reg("sparse_base_features", with_(WEB) + """, f AS (
  SELECT seq, unnest([
    {'feature': 'response_time', 'value': COALESCE(response_time, 0.0)::DOUBLE},
    {'feature': 'hour', 'value': hour(ts)::DOUBLE}, {'feature': 'minute', 'value': minute(ts)::DOUBLE},
    {'feature': 'day_of_week', 'value': (isodow(ts) - 1)::DOUBLE},
    {'feature': 'event_' || event_type, 'value': 1.0::DOUBLE},
    {'feature': 'status_' || status, 'value': 1.0::DOUBLE},
    {'feature': 'ip_last_octet',
     'value': COALESCE(TRY_CAST(string_split(source_ip, '.')[-1] AS BIGINT), 0)::DOUBLE},
    {'feature': 'user_u' || CAST(user_id AS VARCHAR), 'value': 1.0::DOUBLE}]) AS e FROM web)
SELECT seq, e.feature AS feature, e.value AS value FROM f WHERE e.value <> 0""")

reg("web_flags", with_(WEB) + """
SELECT seq, CAST(COALESCE(response_time, 0) > 1.0 AS BIGINT) AS high_response_time,
  CAST(event_type = 'admin_action' AS BIGINT) AS is_admin_action,
  CAST(event_type = 'login' AND status = 'failed' AS BIGINT) AS is_failed_login,
  CAST(NOT COALESCE("user" IN ('user1', 'user2', 'admin', 'system'), false) AS BIGINT)
    AS is_unknown_user,
  CAST(status = 'failed' AS BIGINT) AS status_failed,
  CAST(status = 'unauthorized' AS BIGINT) AS status_unauthorized
FROM web""")

reg("web_features", with_(WEB, WEB_FEATS) + "SELECT * FROM web_feats")

API_BASELINE = """pairs AS (SELECT DISTINCT batch_id, endpoint FROM api),
baseline AS (
  SELECT p.batch_id, p.endpoint, CAST(SUM(CAST(round(a.response_time * 1e6) AS BIGINT)) AS DOUBLE) / COUNT(a.response_time) / 1e6 AS baseline_mean,
    stddev_samp(a.response_time) AS baseline_std, COUNT(*) AS baseline_rows
  FROM pairs p JOIN api a ON a.endpoint = p.endpoint
    AND a.seq > p.batch_id * 30 + 29 - 1000 AND a.seq <= p.batch_id * 30 + 29
  GROUP BY p.batch_id, p.endpoint)"""

API_FEATS = """api_feats AS (
  SELECT a.seq, a.batch_id, a.response_time, a.status_code, hour(a.ts) AS hour,
    minute(a.ts) AS minute, CAST(hour(a.ts) BETWEEN 9 AND 17 AS BIGINT) AS is_peak_hour,
    CAST(isodow(a.ts) >= 6 AS BIGINT) AS is_weekend,
    COUNT(*) OVER (PARTITION BY a.batch_id, minute(a.ts)) AS request_rate,
    avg(CAST(a.status_code >= 400 AS DOUBLE)) OVER (PARTITION BY a.batch_id, minute(a.ts))
      AS error_rate,
    CASE WHEN COUNT(*) OVER w10 = 10 THEN avg(a.response_time) OVER w10 END AS ma,
    CASE WHEN COUNT(*) OVER w10 = 10 THEN stddev_samp(a.response_time) OVER w10 END AS ms,
    CASE WHEN COUNT(*) OVER w3 = 3
         THEN CAST(SUM(CAST(a.status_code >= 400 AS BIGINT)) OVER w3 AS BIGINT) ELSE 0 END
      AS consecutive_errors,
    (a.response_time - b.baseline_mean) / NULLIF(b.baseline_std, 0) AS ez
  FROM api a LEFT JOIN baseline b ON a.batch_id = b.batch_id AND a.endpoint = b.endpoint
  WINDOW w10 AS (PARTITION BY a.batch_id ORDER BY a.seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
         w3 AS (PARTITION BY a.batch_id ORDER BY a.seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""

API_SELECT = """
SELECT seq, batch_id, response_time, status_code, hour, minute, is_peak_hour, is_weekend,
  request_rate, round(error_rate, 6) AS error_rate, round(COALESCE(ma, 0), 6) AS rt_moving_avg,
  round(COALESCE(ms, 0), 6) AS rt_moving_std,
  round(COALESCE((response_time - ma) / NULLIF(ms, 0), 0), 6) AS rt_zscore,
  round(COALESCE(ez, 0), 6) AS endpoint_rt_zscore, consecutive_errors
FROM api_feats"""
reg("api_features", with_(API, API_BASELINE, API_FEATS) + API_SELECT)

reg("client_ip_traffic", with_(WEB) + """
SELECT seq,
  CASE WHEN k < 50 THEN COALESCE(CASE WHEN k % 10 = 9 THEN NULL
                                      ELSE '10.1.0.' || CAST(k AS VARCHAR) END, 'unknown')
       ELSE source_ip END AS client_ip,
  CASE WHEN k < 50 THEN 'test' ELSE 'real' END AS traffic_type,
  COALESCE(CASE WHEN k % 10 = 9 THEN NULL ELSE '10.1.0.' || CAST(k AS VARCHAR) END, source_ip)
    AS api_client_ip
FROM web""")

reg("admin_authorization", with_(WEB) + """
SELECT seq, "user",
  CASE WHEN "user" = 'admin' THEN 'success' ELSE 'unauthorized' END AS auth_status,
  CAST(CASE WHEN "user" = 'admin' THEN 200 ELSE 403 END AS BIGINT) AS http_status
FROM web WHERE event_type = 'admin_action'""")

reg("payload_validation", with_(API) + """, body AS (
  SELECT seq, CASE WHEN k % 4 = 0 THEN 'GET' ELSE 'POST' END AS method, k % 5 <> 0 AS authenticated,
    CASE WHEN k % 11 = 0
      THEN '{"name": "item' || k || '", "price": ' || (k - 10) || '}'
      WHEN k % 13 = 0 THEN '{"name": null, "price": ' || k || ', "stock": 1}'
      ELSE '{"name": "item' || k || '", "price": ' || (k - 10) || ', "stock": '
           || (k % 7 - 1) || '}' END AS p
  FROM api WHERE endpoint = '/api/products')
SELECT seq, method, CAST(CASE WHEN method <> 'POST' THEN 200
    WHEN NOT authenticated THEN 401
    WHEN NOT json_exists(p, '$.name') OR NOT json_exists(p, '$.price')
      OR NOT json_exists(p, '$.stock') THEN 400
    WHEN TRY_CAST(json_extract_string(p, '$.price') AS DOUBLE) IS NULL
      OR TRY_CAST(json_extract_string(p, '$.stock') AS DOUBLE) IS NULL THEN 400
    WHEN TRY_CAST(json_extract_string(p, '$.price') AS DOUBLE) < 0
      OR TRY_CAST(json_extract_string(p, '$.stock') AS DOUBLE) < 0 THEN 400
    ELSE 201 END AS BIGINT) AS validated_status
FROM body""")

reg("auth_validation", with_(API) + """, body AS (
  SELECT seq, ['user1', 'admin', 'nonexistent'][k % 3 + 1] AS un,
    CASE WHEN k % 2 = 0 THEN 'pass123' ELSE 'wrong_pass' END AS pw, k
  FROM api WHERE endpoint = '/api/auth'),
j AS (SELECT seq, un AS username,
        CASE WHEN k % 11 = 0 THEN NULL ELSE pw END AS password FROM body)
SELECT seq, username, CAST(CASE WHEN username IS NULL OR password IS NULL THEN 400
    WHEN username = 'user1' AND password = 'pass123' THEN 200 ELSE 401 END AS BIGINT)
  AS auth_status_code
FROM j""")

reg("anomalous_rows", with_(WEB, WEB_FEATS, RULES) + """
SELECT w.seq, w.ts, w.event_type, w."user", w.source_ip, w.status, w.response_time
FROM web w JOIN rules r ON w.seq = r.seq WHERE r.is_anomaly""")

reg("status_class_counts", with_(API) + """
SELECT CAST(floor(status_code / 100) * 100 AS BIGINT) AS status_class, COUNT(*) AS requests
FROM api GROUP BY 1""")

# ------------------------------------------------------------------ §2.3
reg("endpoint_rt_zscore", with_(API, API_BASELINE) + """
SELECT a.seq, a.batch_id, a.endpoint,
  COALESCE(round((a.response_time - b.baseline_mean) / NULLIF(b.baseline_std, 0), 6), 0)
    AS endpoint_rt_zscore
FROM api a LEFT JOIN baseline b ON a.batch_id = b.batch_id AND a.endpoint = b.endpoint""")

DIM = """dim(endpoint, initial_status, initial_rt) AS (VALUES
  ('/api/users', 200::BIGINT, 0.0::DOUBLE), ('/api/products', 200::BIGINT, 0.0::DOUBLE),
  ('/api/orders', 200::BIGINT, 0.0::DOUBLE), ('/api/auth', 200::BIGINT, 0.0::DOUBLE),
  ('/api/cart', 200::BIGINT, 0.0::DOUBLE))"""

reg("endpoint_status", with_(API, DIM) + """, agg AS (
  SELECT endpoint, COUNT(*) AS requests, COUNT(*) FILTER (WHERE status_code >= 400) AS errors,
    arg_max(status_code, seq) AS last_status, arg_max(response_time, seq) AS last_rt
  FROM api WHERE endpoint IN (SELECT endpoint FROM dim) GROUP BY endpoint)
SELECT d.endpoint, COALESCE(a.requests, 0) AS requests, COALESCE(a.errors, 0) AS errors,
  CASE WHEN COALESCE(a.requests, 0) = 0 THEN 100.0::DOUBLE
       ELSE round(CAST(a.requests - a.errors AS DOUBLE) * 1000.0::DOUBLE / a.requests) / 10.0::DOUBLE
  END AS success_rate,
  COALESCE(a.last_status, d.initial_status) AS last_status,
  COALESCE(round(a.last_rt, 2), d.initial_rt) AS last_response_time
FROM dim d LEFT JOIN agg a ON d.endpoint = a.endpoint""")

reg("known_user_flag", with_(WEB) + """
SELECT seq, "user", COALESCE("user" IN ('user1', 'user2', 'admin'), false) AS is_known_user
FROM web""")

reg("unknown_user_events", with_(WEB) + """
SELECT seq, "user", event_type FROM web
WHERE "user" IS NULL OR "user" NOT IN ('user1', 'user2', 'admin', 'system')""")

RATE = f"""rate AS (
  SELECT *, CASE WHEN el > 0 THEN request_count / (CAST(el AS DOUBLE) / 1e6) ELSE 0 END
      AS request_rate
  FROM (SELECT *, COUNT(*) OVER wip AS request_count,
          CAST(SUM(CAST(is_auth_failure AS BIGINT)) OVER wip AS BIGINT) AS warnings,
          epoch_us(ts) - epoch_us(FIRST_VALUE(ts) OVER wip) AS el
        FROM (SELECT *, COALESCE(endpoint = '/api/auth' AND status_code = 401, false)
                AS is_auth_failure FROM api) x
        WINDOW wip AS (PARTITION BY ip_address ORDER BY seq
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) y),
decisions AS (
  SELECT *, request_rate > {TEST_MAX_RATE} AS rate_blocked,
    is_auth_failure AND warnings >= 5 AS auth_blocked,
    request_rate > {TEST_MAX_RATE} OR (is_auth_failure AND warnings >= 5) AS is_blocked,
    CASE WHEN is_auth_failure AND warnings >= 5 THEN 'Multiple failed auth attempts'
         WHEN request_rate > {TEST_MAX_RATE} THEN 'Rate limit exceeded' END AS reason
  FROM rate)"""

BLOCKS = """blocks AS (
  SELECT ip_address, ts AS blocked_at, reason,
    CASE WHEN NOT auth_blocked THEN request_rate END AS request_rate,
    CASE WHEN auth_blocked THEN warnings END AS warning_count
  FROM decisions WHERE is_blocked
  QUALIFY row_number() OVER (PARTITION BY ip_address ORDER BY seq DESC) = 1)"""

ACTIVITY = """activity AS (
  SELECT ip_address, COUNT(*) AS request_count,
    COUNT(*) FILTER (WHERE status_code >= 400) AS error_count, max(ts) AS last_seen,
    COALESCE(arg_min(CASE WHEN user_id % 10 = 8 THEN 'bot' WHEN user_id % 10 = 9 THEN 'attacker'
                          ELSE 'normal_user' END, seq), 'unknown') AS pattern_type
  FROM api GROUP BY ip_address)"""

RISK = """risk AS (
  SELECT b.ip_address, b.blocked_at, b.reason,
    CASE WHEN COALESCE(a.error_count, 0) * 2 > COALESCE(a.request_count, 1) THEN 'high'
         WHEN COALESCE(a.error_count, 0) * 5 > COALESCE(a.request_count, 1) THEN 'medium'
         ELSE 'low' END AS risk_level,
    COALESCE(a.request_count, 0) AS request_count,
    COALESCE(round(CAST(COALESCE(a.error_count, 0) AS DOUBLE) * 1000.0::DOUBLE
                   / COALESCE(a.request_count, 1)) / 10.0::DOUBLE, 0) AS error_rate,
    COALESCE(a.pattern_type, 'unknown') AS pattern_type
  FROM blocks b LEFT JOIN activity a ON b.ip_address = a.ip_address)"""

reg("blocked_ip_risk", with_(API60, RATE, BLOCKS, ACTIVITY, RISK) + "SELECT * FROM risk")

# ------------------------------------------------------------------ §2.4
SCORED = """scored AS (
  SELECT a.*, r.is_anomaly, -a.response_time / 10000.0::DOUBLE AS anomaly_score
  FROM api a JOIN rules r ON a.seq = r.seq)"""
SCORED_CTES = (WEB, WEB_FEATS, RULES, API, SCORED)

reg("endpoint_analysis", with_(*SCORED_CTES) + """
SELECT endpoint, round(CAST(SUM(CAST(response_time AS DECIMAL(38,9))) AS DOUBLE) / COUNT(response_time), 6) AS rt_mean,
  round(stddev_samp(response_time), 6) AS rt_std, max(response_time) AS rt_max,
  round(avg(CAST(status_code >= 400 AS DOUBLE)), 6) AS error_rate,
  round(avg(CAST(is_anomaly AS DOUBLE)), 6) AS anomaly_rate
FROM scored GROUP BY endpoint""")

reg("hourly_patterns", with_(*SCORED_CTES) + """
SELECT hour(ts) AS hour, round(CAST(SUM(CAST(response_time AS DECIMAL(38,9))) AS DOUBLE) / COUNT(response_time), 6) AS rt_mean,
  round(avg(CAST(is_anomaly AS DOUBLE)), 6) AS anomaly_rate,
  round(avg(CAST(status_code >= 400 AS DOUBLE)), 6) AS error_rate
FROM scored GROUP BY 1""")

reg("anomaly_patterns", with_(*SCORED_CTES) + """
SELECT COUNT(*) FILTER (WHERE is_anomaly AND response_time > 1000) AS slow_response,
  COUNT(*) FILTER (WHERE is_anomaly AND status_code >= 400) AS error_burst,
  COUNT(*) FILTER (WHERE is_anomaly AND endpoint = '/api/auth' AND status_code = 401)
    AS auth_failures
FROM scored""")

reg("batch_summary", with_(*SCORED_CTES) + """
SELECT batch_id, COUNT(*) AS total, COUNT(*) FILTER (WHERE is_anomaly) AS anomalies,
  COUNT(*) FILTER (WHERE NOT is_anomaly) AS normal, round(CAST(SUM(CAST(anomaly_score AS DECIMAL(38,9))) AS DOUBLE) / COUNT(anomaly_score), 6) AS score_mean,
  min(anomaly_score) AS score_min, max(anomaly_score) AS score_max
FROM scored GROUP BY batch_id""")

reg("endpoint_counters", with_(API, DIM) + """
SELECT endpoint, COUNT(*) AS requests, COUNT(*) FILTER (WHERE status_code >= 400) AS errors
FROM api WHERE endpoint IN (SELECT endpoint FROM dim) GROUP BY endpoint""")

reg("traffic_totals", with_(API, DIM) + """, t AS (
  SELECT COUNT(*) AS total_requests, COUNT(*) FILTER (WHERE status_code >= 400) AS total_errors
  FROM api WHERE endpoint IN (SELECT endpoint FROM dim))
SELECT total_requests, total_errors,
  COALESCE(round(CAST(total_errors AS DOUBLE) * 1000.0::DOUBLE / NULLIF(total_requests, 0))
           / 10.0::DOUBLE, 0.0::DOUBLE) AS error_rate
FROM t""")

reg("ip_activity", with_(API60, ACTIVITY) + "SELECT * FROM activity")

LIMITS = f"""limits AS (
  SELECT ip_address, COUNT(*) AS count,
    COUNT(*) FILTER (WHERE endpoint = '/api/auth' AND status_code = 401) AS warnings,
    min(ts) AS first_request, max(ts) AS last_activity
  FROM api WHERE ts <= TIMESTAMP '{NOW}' GROUP BY ip_address),
view AS (
  SELECT ip_address, count, warnings,
    round(CASE WHEN epoch_us(TIMESTAMP '{NOW}') - epoch_us(first_request) > 0
      THEN count / (CAST(epoch_us(TIMESTAMP '{NOW}') - epoch_us(first_request) AS DOUBLE) / 1e6)
      ELSE 0 END, 6) AS request_rate,
    CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_activity)) / 1000000) AS BIGINT)
      AS last_activity_ago_s,
    first_request, last_activity
  FROM limits)"""

reg("security_summary", with_(API60, RATE, BLOCKS, ACTIVITY, RISK, LIMITS) + """
SELECT (SELECT COUNT(*) FILTER (WHERE risk_level = 'high') FROM risk) AS high_risk_count,
  (SELECT COUNT(*) FILTER (WHERE risk_level = 'medium') FROM risk) AS medium_risk_count,
  COUNT(*) AS tracked_ips,
  COUNT(*) FILTER (WHERE last_activity_ago_s < 300) AS recent_active_ips,
  CAST(COALESCE(SUM(warnings), 0) AS BIGINT) AS suspicious_auth_count,
  COUNT(*) FILTER (WHERE warnings > 0) AS failed_login_ips
FROM view""")

reg("endpoint_baseline", with_(API, API_BASELINE) + """
SELECT batch_id, endpoint, round(baseline_mean, 6) AS baseline_mean,
  round(baseline_std, 6) AS baseline_std, baseline_rows
FROM baseline""")

reg("rate_over_threshold", with_(API60, LIMITS) + f"""
SELECT COUNT(*) FILTER (WHERE count / (CAST(epoch_us(TIMESTAMP '{NOW}') - epoch_us(first_request)
    AS DOUBLE) / 1e6) > {TEST_MEAN_RATE}
  AND epoch_us(TIMESTAMP '{NOW}') - epoch_us(first_request) <> 0) AS ips_over_threshold
FROM view""")

# ------------------------------------------------------------------ §2.5
reg("attempt_counts", with_(WEB, WEB_FEATS) + """
SELECT seq, batch_id, ip_attempts, ip_failed_attempts, user_attempts, user_failed_attempts
FROM web_feats""")

reg("minute_rates", with_(API) + """
SELECT seq, batch_id, COUNT(*) OVER w AS request_rate,
  round(avg(CAST(status_code >= 400 AS DOUBLE)) OVER w, 6) AS error_rate
FROM api WINDOW w AS (PARTITION BY batch_id, minute(ts))""")

reg("rolling_response_time", with_(API) + """, r AS (
  SELECT seq, batch_id, response_time,
    CASE WHEN COUNT(*) OVER w = 10 THEN avg(response_time) OVER w END AS ma,
    CASE WHEN COUNT(*) OVER w = 10 THEN stddev_samp(response_time) OVER w END AS ms
  FROM api WINDOW w AS (PARTITION BY batch_id ORDER BY seq
                        ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT seq, batch_id, round(COALESCE(ma, 0), 6) AS rt_moving_avg,
  round(COALESCE(ms, 0), 6) AS rt_moving_std,
  round(COALESCE((response_time - ma) / NULLIF(ms, 0), 0), 6) AS rt_zscore
FROM r""")

reg("consecutive_errors", with_(API) + """
SELECT seq, batch_id, CASE WHEN COUNT(*) OVER w = 3
    THEN CAST(SUM(CAST(status_code >= 400 AS BIGINT)) OVER w AS BIGINT) ELSE 0 END
  AS consecutive_errors
FROM api WINDOW w AS (PARTITION BY batch_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")

reg("rapid_requests", with_(WEB) + """
SELECT seq, source_ip, CAST(COALESCE(epoch_us(ts) - LAG(epoch_us(ts))
    OVER (PARTITION BY source_ip ORDER BY seq) < 1000000, false) AS BIGINT) AS rapid_requests
FROM web""")

reg("running_request_rate", with_(API60, RATE) + """
SELECT seq, ip_address, request_count, round(request_rate, 6) AS request_rate FROM rate""")

reg("auth_warnings", with_(API60, RATE) + "SELECT seq, ip_address, warnings FROM rate")

reg("login_attempts", with_(WEB) + """, l AS (
  SELECT seq, source_ip,
    SUM(CAST(event_type = 'login' AS BIGINT)) OVER w AS n,
    max(CASE WHEN event_type = 'login' THEN ts END) OVER w AS last_attempt
  FROM web WINDOW w AS (PARTITION BY source_ip ORDER BY seq
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT seq, source_ip, CAST(CASE WHEN n > 0 THEN n ELSE 1 END AS BIGINT) AS attempts, last_attempt
FROM l""")

reg("count_batches", with_(API) + """, ranked AS (
  SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS r, COUNT(*) OVER () AS n FROM api)
SELECT seq, r // 30 AS batch_id, r % 30 AS pos_in_batch FROM ranked WHERE r < n // 30 * 30""")

# the same log under a sequence with gaps: numbered by rank, joined back by place
GAPS = """gaps AS (SELECT *, event_id + 1000 + 37 * (event_id // 4500) AS late_seq FROM events),
renumbered AS (SELECT late_seq, row_number() OVER (ORDER BY late_seq) - 1 AS r, COUNT(*) OVER () AS n FROM gaps)"""
reg("gapped_count_batches", with_(GAPS) + """
SELECT late_seq AS seq, r // 30 AS batch_id, r % 30 AS pos_in_batch FROM renumbered WHERE r < n // 30 * 30""")
reg("gapped_endpoint_baseline", with_(GAPS, "dense AS (SELECT g.* REPLACE (r AS event_id) FROM gaps g "
    "JOIN renumbered USING (late_seq))", API.replace("FROM events", "FROM dense"), API_BASELINE) + """
SELECT batch_id, endpoint, round(baseline_mean, 6) AS baseline_mean,
  round(baseline_std, 6) AS baseline_std, baseline_rows
FROM baseline""")
reg("gapped_api_features", with_(GAPS, API, API_BASELINE, API_FEATS) + API_SELECT.replace(
    "SELECT seq,", "SELECT late_seq AS seq,").replace("FROM api_feats", "FROM api_feats JOIN renumbered ON r = seq"))

# ------------------------------------------------------------------ §2.6
reg("recent_requests", with_(API) + """
SELECT seq, ts, endpoint, method, status_code, response_time FROM api
ORDER BY ts DESC, seq DESC LIMIT 100""")

reg("history_tail", with_(API) + """
SELECT seq, endpoint, response_time FROM api ORDER BY seq DESC LIMIT 1000""")

# ------------------------------------------------------------------ §2.7-8
reg("rule_anomalies", with_(WEB, WEB_FEATS, RULES) + """
SELECT seq, rule_ip_failed, rule_user_failed, rule_slow, rule_admin_unauthorized,
  rule_unknown_user, rule_rapid, is_anomaly FROM rules""")

ALERTS = """alerts AS (
  SELECT w.seq, w.ts, w.event_type, w."user", w.source_ip, w.traffic_type, w.status,
    list_filter([
      CASE WHEN r.is_failed_login = 1 AND r.user_attempts > 3
           THEN 'Multiple failed login attempts' END,
      CASE WHEN COALESCE(r.response_time, 0) > 1.0 THEN 'Unusual response time' END,
      CASE WHEN r.is_admin_action = 1 AND NOT COALESCE(w.status = 'success', false)
           THEN 'Unauthorized admin action attempt' END,
      CASE WHEN COALESCE(contains(w."user", 'unknown_user'), false)
           THEN 'Unknown user attempt' END], lambda x: x IS NOT NULL) AS rs
  FROM web w JOIN rules r ON w.seq = r.seq WHERE r.is_anomaly),
alerts2 AS (
  SELECT *, CASE WHEN len(rs) = 0 THEN ['Statistical anomaly detected'] ELSE rs END AS reasons
  FROM alerts)"""
ALERT_CTES = (WEB, WEB_FEATS, RULES, ALERTS)

reg("alert_reasons", with_(*ALERT_CTES) + """
SELECT seq, array_to_string(reasons, ', ') AS reasons FROM alerts2""")

reg("alert_records", with_(*ALERT_CTES) + """
SELECT seq, ts, array_to_string(reasons, ', ') AS reasons,
  COALESCE(traffic_type, 'unknown') AS traffic_type,
  CAST(to_json({'event_type': event_type, 'user': "user", 'source_ip': source_ip,
                'status': status}) AS VARCHAR) AS details
FROM alerts2""")

reg("alert_reason_counts", with_(*ALERT_CTES) + """
SELECT reason, COUNT(*) AS alerts FROM (SELECT unnest(reasons) AS reason FROM alerts2) t
GROUP BY reason""")

reg("security_events", with_(API60, RATE) + """
SELECT 'ratelimit' AS event_type, ts AS "timestamp", 'Rate limit exceeded' AS description,
  ip_address AS ip, seq FROM decisions WHERE rate_blocked
UNION ALL
SELECT 'auth', ts, 'Failed auth attempt, warning ' || CAST(warnings AS VARCHAR), ip_address, seq
FROM decisions WHERE is_auth_failure
UNION ALL
SELECT 'block', ts, reason, ip_address, seq FROM decisions WHERE is_blocked""")

# ------------------------------------------------------------------ §2.9
reg("rate_breaches", with_(API60, RATE) + """
SELECT seq, ip_address, request_count, round(request_rate, 6) AS request_rate
FROM decisions WHERE rate_blocked""")

reg("auth_lockouts", with_(API60, RATE) + """
SELECT seq, ip_address, warnings FROM decisions WHERE auth_blocked""")

reg("block_decisions", with_(API60, RATE) + """
SELECT seq, ip_address, is_blocked, reason FROM decisions""")

reg("block_list", with_(API60, RATE, BLOCKS) + """
SELECT ip_address, blocked_at, reason, round(request_rate, 6) AS request_rate, warning_count
FROM blocks""")

reg("rate_limit_view", with_(API60, LIMITS) + """
SELECT ip_address, count, warnings, request_rate, last_activity_ago_s FROM view""")

reg("block_reason_variant", with_(API60, RATE, BLOCKS, LIMITS) + f"""
SELECT b.ip_address, TIMESTAMP '{NOW}' AS blocked_at,
  CASE WHEN COALESCE(v.count, 0) > 100 THEN 'Rate limit exceeded'
       ELSE 'Suspicious auth attempts' END AS reason
FROM blocks b LEFT JOIN view v ON b.ip_address = v.ip_address""")

reg("active_sessions", with_(WEB) + f""", starts AS (
  SELECT seq AS session_id, ts AS start_ts, k FROM web
  WHERE event_type = 'login' AND status = 'success'),
ends AS (SELECT session_id, start_ts + INTERVAL 600 SECOND AS end_ts FROM starts
         WHERE k % 10 = 0)
SELECT COUNT(*) AS active_sessions FROM starts s
WHERE s.start_ts <= TIMESTAMP '{NOW}'
  AND epoch_us(TIMESTAMP '{NOW}') - epoch_us(s.start_ts) <= 1800 * 1000000
  AND s.session_id NOT IN (SELECT session_id FROM ends WHERE end_ts <= TIMESTAMP '{NOW}')""")

reg("idle_sessions", """
WITH g AS (
  SELECT user_id, ts, CASE WHEN LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
      OR epoch_us(ts) - epoch_us(LAG(ts) OVER (PARTITION BY user_id ORDER BY ts))
         >= 1800 * 1000000 THEN 1 ELSE 0 END AS new_session
  FROM events),
s AS (SELECT user_id, ts, SUM(new_session) OVER (PARTITION BY user_id ORDER BY ts
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end,
  COUNT(*) AS n_events
FROM s GROUP BY user_id, sid""")

# ------------------------------------------------------------------ §2.7
_SCALED = ", ".join(
    f"round(({f} - avg({f}) OVER ()) / CASE WHEN stddev_pop({f}) OVER () = 0 THEN 1.0::DOUBLE "
    f"ELSE stddev_pop({f}) OVER () END, 6) AS {f}" for f in WEB_FEATURES)
reg("scaled_features", with_(WEB, WEB_FEATS) + f"SELECT seq, {_SCALED} FROM web_feats")

FOREST = forest_ctes("web_feats", WEB_FEATURES, FOREST_TREES,
                     (FOREST_PSI, depth_for(FOREST_PSI)), FOREST_SEED)
reg("iforest_scores", with_(WEB, WEB_FEATS, *FOREST) + "SELECT row_id AS seq, score FROM fscore")

reg("contamination_threshold", with_(
    WEB, "cs AS (SELECT -response_time / 10.0::DOUBLE AS score FROM web)",
    quantile_cte("thr", "cs", "score", WEB_CONTAMINATION)) + "SELECT threshold FROM thr")

reg("iforest_flags", with_(WEB, WEB_FEATS, *FOREST,
                           quantile_cte("thr", "fscore", "score", WEB_CONTAMINATION)) + """
SELECT f.row_id AS seq, f.score, f.score < t.threshold AS is_anomaly FROM fscore f, thr t""")

reg("hybrid_anomalies", with_(WEB, WEB_FEATS, RULES, *FOREST,
                              quantile_cte("thr", "fscore", "score", WEB_CONTAMINATION)) + """
SELECT r.seq, f.score < t.threshold AS forest_anomaly, r.is_anomaly AS rule_anomaly,
  (f.score < t.threshold) OR r.is_anomaly AS is_anomaly
FROM rules r JOIN fscore f ON r.seq = f.row_id, thr t""")

# base features: n is at least BASE_PSI, so the depth is fixed
reg("base_detector", with_(WEB, f"base_feats AS ({BASE_SELECT})", *forest_ctes(
    "base_feats", BASE_FEATURES, FOREST_TREES, (BASE_PSI, depth_for(BASE_PSI)), FOREST_SEED),
    quantile_cte("thr", "fscore", "score", BASE_CONTAMINATION)) + """
SELECT f.row_id AS seq, f.score, f.score < t.threshold AS is_anomaly FROM fscore f, thr t""")

reg("batch_iforest", with_(
    API, API_BASELINE, API_FEATS, f"whole AS (SELECT * FROM ({API_SELECT}) x WHERE batch_id < "
    f"(SELECT COUNT(*) // {BATCH_SIZE} FROM api))",
    *batch_forest_ctes("whole", API_FEATURES, 100, BATCH_SIZE, FOREST_SEED, API_CONTAMINATION)) + """
SELECT row_id AS seq, batch AS batch_id, score, is_anomaly FROM bflag""")

reg("stored_model", ORACLE["iforest_flags"])

reg("parse_timestamp", """
SELECT event_id AS seq, CASE WHEN event_id % 17 <> 0 THEN date_trunc('second', ts) END AS ts
FROM events""")

reg("session_ip", with_(API) + """
SELECT seq, CASE WHEN k % 10 <> 0 THEN 's' || user_id END AS session_id,
  CASE WHEN k % 10 <> 0 AND user_id % 3 <> 0 THEN ip_address ELSE '127.0.0.1' END AS session_ip
FROM api""")
