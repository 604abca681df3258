"""A small invented log with the cases the operators must handle.

Values are made up from simple rules: times step by a few seconds, response
times are whole numbers.
"""

from datetime import datetime, timedelta

START = datetime(2031, 5, 4, 8, 0, 0)


def _at(seconds: int) -> str:
    return (START + timedelta(seconds=seconds)).strftime("%Y-%m-%d %H:%M:%S")


def _web(i, kind, user, status, **more):
    return {"timestamp": _at(75 * i), "event_type": kind, "user": user, "status": status, **more}


# Envelope form: record 3 has no source_ip, record 1 an extra field, none has a
# response time.
SPARSE_WEB_LOG = {"logs": [
    _web(0, "login", "user2", "success", source_ip="172.16.5.10"),
    _web(1, "data_access", "user2", "success", source_ip="172.16.5.10", file_path="/a/b.csv"),
    _web(2, "login", "user1", "failed", source_ip="172.16.5.77"),
    _web(3, "backup", "system", "running"),
    _web(4, "login", "admin", "success", source_ip="172.16.9.255"),
]}
SPARSE_OCTETS = [10, 10, 77, 0, 255]

# Two full records of one address, ten seconds apart; the second is an unknown
# user's failed login.
FULL_WEB_LOG = {"logs": [
    {"timestamp": _at(s), "event_type": "login", "user": user, "source_ip": "172.16.8.20",
     "traffic_type": "test", "status": status, "response_time": rt, "attempts": n,
     "is_known_user": known}
    for s, user, status, rt, n, known in (
        (0, "user1", "success", 0.5, 1, True), (10, "unknown_user", "failed", 0.25, 2, False))]}

# API requests, each logged twice: by the handler (short time, no payload) and
# by the client (long time, with its payload).  /api/users is never called.
_CALLS = [(e, m, s) for e, m, s in (
    ("/api/products", "GET", 200), ("/api/cart", "POST", 200), ("/api/cart", "GET", 404),
    ("/api/orders", "POST", 200), ("/api/auth", "POST", 401))] * 3 + [
    ("/api/cart", "GET", 500), ("/api/orders", "GET", 200), ("/api/products", "GET", 200)]
API_ROWS = []  # (timestamp, endpoint, method, status_code, response_time ms, payload)
for _i, (_e, _m, _s) in enumerate(_CALLS):
    _body = '{"n": %d}' % _i if _m == "POST" else None
    API_ROWS += [(_at(3 * _i), _e, _m, _s, 100.0 + 10 * _i, None),
                 (_at(3 * _i), _e, _m, _s, 2000.0 + 100 * _i, _body)]


def api_df(spark):
    rows = [(i, datetime.strptime(t, "%Y-%m-%d %H:%M:%S"), e, m, s, rt, p, i // 30)
            for i, (t, e, m, s, rt, p) in enumerate(API_ROWS)]
    return spark.createDataFrame(
        rows, "seq long, ts timestamp_ntz, endpoint string, method string, status_code long, "
              "response_time double, payload string, batch_id long")
