"""Request enrichment and validation (P16-P20) and known-user lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logvigil.schemas import WEBSITE_USERS

PRODUCT_BODY = T.StructType([T.StructField("name", T.StringType()),
                             T.StructField("price", T.StringType()),
                             T.StructField("stock", T.StringType())])
AUTH_BODY = T.StructType([T.StructField("username", T.StringType()),
                          T.StructField("password", T.StringType())])


def client_ip_traffic(df: DataFrame, test_flag: str = "is_test_traffic",
                      forwarded_for: str = "forwarded_for", remote: str = "remote_addr") -> DataFrame:
    """P16 + P17: the client IP (forwarded header for test traffic, 'unknown'
    when that header is missing; remote address otherwise) and traffic type."""
    test = F.coalesce(F.col(test_flag), F.lit(False))
    return df.withColumns({
        "client_ip": F.when(test, F.coalesce(F.col(forwarded_for), F.lit("unknown")))
                      .otherwise(F.col(remote)),
        "traffic_type": F.when(test, "test").otherwise("real")})


def client_ip_header(df: DataFrame, header: str = "simulated_ip", remote: str = "remote_addr",
                     out: str = "api_client_ip") -> DataFrame:
    """P16, the API application's rule: the header's address if there is one,
    else the remote address, for any traffic."""
    return df.withColumn(out, F.coalesce(F.col(header), F.col(remote)))


def admin_authorization(df: DataFrame, user: str = "user", admin: str = "admin") -> DataFrame:
    """An admin action by anyone but the admin is 'unauthorized' (HTTP 403),
    otherwise 'success' (200)."""
    ok = F.coalesce(F.col(user) == admin, F.lit(False))
    return df.withColumns({
        "auth_status": F.when(ok, "success").otherwise("unauthorized"),
        "http_status": F.when(ok, 200).otherwise(403).cast("long")})


def payload_validation(df: DataFrame, payload: str = "payload", method: str = "method",
                       authenticated: str = "authenticated") -> DataFrame:
    """Product request status -- GET 200; POST: 401 when not
    authenticated, 400 when a field is absent or price or stock is negative,
    else 201.  A field is absent only if its key is: ``{"name": null, ...}``
    has one.  No or malformed JSON, or a price or stock that is no number, is
    400."""
    body = F.from_json(F.col(payload), PRODUCT_BODY)
    keys = F.json_object_keys(F.col(payload))
    price = body["price"].try_cast("double")
    stock = body["stock"].try_cast("double")
    absent = F.lit(False)
    for name in PRODUCT_BODY.names:
        absent = absent | ~F.coalesce(F.array_contains(keys, name), F.lit(False))
    bad = absent | body.isNull() | price.isNull() | stock.isNull()
    status = (F.when(F.col(method) != "POST", 200)
              .when(~F.coalesce(F.col(authenticated), F.lit(False)), 401)
              .when(bad, 400)
              .when((price < 0) | (stock < 0), 400)
              .otherwise(201))
    return df.withColumn("validated_status", status.cast("long"))


def auth_validation(df: DataFrame, credentials: DataFrame, payload: str = "payload") -> DataFrame:
    """P20: login body check -- 400 when username or password is missing, 200
    when the pair is in ``credentials(username, password)``, else 401.

    The credential table is joined (AQE broadcasts it when it is small)."""
    body = F.from_json(F.col(payload), AUTH_BODY)
    d = df.withColumns({"username": body["username"], "_pw": body["password"]})
    creds = credentials.select(F.col("username").alias("_cu"), F.col("password").alias("_cp")) \
                       .distinct().withColumn("_match", F.lit(True))
    j = d.join(creds, (d["username"] == creds["_cu"]) & (d["_pw"] == creds["_cp"]), "left")
    status = (F.when(F.col("username").isNull() | F.col("_pw").isNull(), 400)
              .when(F.col("_match"), 200).otherwise(401))
    return j.withColumn("auth_status_code", status.cast("long")).drop("_pw", "_cu", "_cp", "_match")


def known_user_flag(df: DataFrame, known: DataFrame | list[str] | None = None,
                    user: str = "user") -> DataFrame:
    """``is_known_user`` (NULL user -> false)."""
    if known is None or isinstance(known, list):
        names = known or WEBSITE_USERS
        return df.withColumn("is_known_user", F.coalesce(F.col(user).isin(*names), F.lit(False)))
    k = known.select(F.col(known.columns[0]).alias("_ku")).distinct() \
             .withColumn("_hit", F.lit(True))
    return (df.join(k, df[user] == k["_ku"], "left")
              .withColumn("is_known_user", F.coalesce("_hit", F.lit(False)))
              .drop("_ku", "_hit"))


def unknown_user_events(df: DataFrame, known: DataFrame, user: str = "user") -> DataFrame:
    """J3 (anti join): events whose user is not in ``known`` (NULL user kept)."""
    k = known.select(F.col(known.columns[0]).alias("_ku"))
    return df.join(k, df[user] == k["_ku"], "left_anti")


def session_ip(requests: DataFrame, sessions: DataFrame, session_id: str = "session_id",
               default_ip: str = "127.0.0.1") -> DataFrame:
    """The IP of each request's session (left join on the session id);
    requests without a known session get ``default_ip``.  A session listed more
    than once counts once, with its smallest address, so requests stay as many."""
    s = sessions.groupBy(F.col(session_id).alias("_sid")).agg(F.min("ip_address").alias("_sip"))
    known = requests[session_id].isNotNull()
    # requests without a session id match nothing and do not meet in one task
    j = requests.where(known).join(s, requests[session_id] == s["_sid"], "left")
    j = j.withColumn("session_ip", F.coalesce(F.col("_sip"), F.lit(default_ip))).drop("_sid", "_sip")
    return j.unionByName(requests.where(~known).withColumn("session_ip", F.lit(default_ip)))
