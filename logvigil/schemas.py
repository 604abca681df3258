"""Explicit schemas of the two log kinds (no inference at run time).

Units: ``api_log.response_time`` is milliseconds, ``web_log.response_time``
is seconds.  Timestamps are naive (TIMESTAMP_NTZ), second precision as written
by the producers (``yyyy-MM-dd HH:mm:ss``).
"""

from pyspark.sql import types as T

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Raw API-log record as written by the request logger.  ``payload`` is kept as
# raw JSON text so that any body shape survives; parse it with from_json.
API_LOG_RAW = T.StructType([
    T.StructField("timestamp", T.StringType(), True),
    T.StructField("endpoint", T.StringType(), True),
    T.StructField("method", T.StringType(), True),
    T.StructField("status_code", T.LongType(), True),
    T.StructField("response_time", T.DoubleType(), True),
    T.StructField("payload", T.StringType(), True),
    T.StructField("ip_address", T.StringType(), True),
    T.StructField("user_agent", T.StringType(), True),
])

# Raw web-log record (website event logger).  Extras merged into some events
# (is_known_user, action, file_path) are nullable columns.
WEB_LOG_RAW = T.StructType([
    T.StructField("timestamp", T.StringType(), True),
    T.StructField("event_type", T.StringType(), True),
    T.StructField("user", T.StringType(), True),
    T.StructField("source_ip", T.StringType(), True),
    T.StructField("traffic_type", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("response_time", T.DoubleType(), True),
    T.StructField("attempts", T.LongType(), True),
    T.StructField("is_known_user", T.BooleanType(), True),
    T.StructField("action", T.StringType(), True),
    T.StructField("file_path", T.StringType(), True),
])

# Envelope ``{"logs": [ ... ]}`` used by the web-log file.
def envelope(record: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("logs", T.ArrayType(record), True)])


# Fixed values of the monitored application.
# Endpoint dimension: the five API paths, their methods, initial last status
# 200 and initial last response time 0.
ENDPOINT_PATHS = ["/api/users", "/api/products", "/api/orders", "/api/auth", "/api/cart"]
ENDPOINT_METHODS = ["GET", "POST"]
ENDPOINT_INITIAL_STATUS = 200
ENDPOINT_INITIAL_RT = 0.0
# Users the website knows (login database) and the detector's known-user list.
WEBSITE_USERS = ["user1", "user2", "admin"]
DETECTOR_KNOWN_USERS = ["user1", "user2", "admin", "system"]
# Credentials accepted by the API auth endpoint.
API_CREDENTIALS = [("user1", "pass123")]
