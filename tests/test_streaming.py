"""Streaming = batch: the same events fed as several files through
Structured Streaming give the batch operators' answers."""

import os

import numpy as np
import pytest

from pyspark.sql import functions as F

from conftest import SF0001
from logvigil.operators import metrics, response, windows
from logvigil.plans import adapters as A
from logvigil.streaming import monitor as M


def _split_events(spark, out_dir, parts=4):
    ev = A.read_events(spark, SF0001)
    ev = ev.withColumn("_part", (F.col("event_id") * parts / 1000).cast("int"))
    for p in range(parts):
        ev.where(F.col("_part") == p).drop("_part").coalesce(1).write.parquet(f"{out_dir}/p{p}")
    return ev.drop("_part").schema


def _stream(spark, tmp, parts=3):
    src = os.path.join(tmp, "src")
    schema = _split_events(spark, src, parts)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src + "/*")


def test_live_counters_equal_batch(spark, tmpdir_path):
    api = A.api_log(_stream(spark, tmpdir_path))
    q = (M.live_endpoint_counters(api).writeStream.outputMode("complete").format("memory")
         .queryName("ep_counts").option("checkpointLocation", tmpdir_path + "/ck1").start())
    q.processAllAvailable()
    q.stop()
    got = sorted(spark.sql("select * from ep_counts").collect())
    exp = sorted(metrics.endpoint_counters(A.api_log(A.read_events(spark, SF0001))).collect())
    assert got == exp


def test_login_attempts_stream(spark, tmpdir_path):
    web = A.web_log(_stream(spark, tmpdir_path))
    q = (M.live_login_attempts(web).writeStream.outputMode("complete").format("memory")
         .queryName("logins").option("checkpointLocation", tmpdir_path + "/ck2").start())
    q.processAllAvailable()
    q.stop()
    got = {r.source_ip: r.attempts for r in spark.sql("select * from logins").collect()}
    bw = windows.login_attempts(A.web_log(A.read_events(spark, SF0001)))
    exp = {r[0]: r[1] for r in bw.where("event_type = 'login'").groupBy("source_ip")
           .agg(F.max("login_count")).collect()}
    assert got == exp


def test_rate_limit_state_equals_batch(spark, tmpdir_path):
    api = A.api_log(_stream(spark, tmpdir_path), time_scale=60)
    out = M.rate_limit_stream(api, max_rate=0.05, max_warnings=5)
    # keyed state with a timeout keeps running no-data batches to expire
    # state; for a finite test input only data batches are needed
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        q = (out.writeStream.outputMode("append").format("memory").queryName("rl")
             .trigger(availableNow=True).option("checkpointLocation", tmpdir_path + "/ck3")
             .start())
        q.awaitTermination(300)
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    got = spark.sql("select seq, request_count, warnings, is_blocked, reason from rl")
    exp = response.block_decisions(A.api_log(A.read_events(spark, SF0001), time_scale=60),
                                   max_rate=0.05).select(
        "seq", "request_count", "warnings", "is_blocked", "reason")
    assert sorted(got.collect()) == sorted(exp.collect())


def test_count_batches_across_microbatches(spark, tmpdir_path):
    api = A.api_log(_stream(spark, tmpdir_path)).drop("seq", "batch_id")
    out_dir = tmpdir_path + "/batches"

    def process(df, epoch):
        df.select("seq", "batch_id").write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")

    fn = M.count_batch_processor(30, tmpdir_path + "/state", ["ts", "user_id"], process)
    q = (api.writeStream.foreachBatch(fn).option("checkpointLocation", tmpdir_path + "/ck4")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(out_dir).select("seq", "batch_id")
    assert got.count() == 990  # 33 complete batches of 30; the 10-row tail stays open
    exp = windows.count_batches(A.api_log(A.read_events(spark, SF0001)).drop("batch_id"))
    assert sorted(got.collect()) == sorted(exp.select("seq", "batch_id").collect())


def test_monitor_alerts_and_session_expiry(spark, tmpdir_path):
    web = A.web_log(_stream(spark, tmpdir_path))
    q = M.monitor(web, None, tmpdir_path + "/alerts", tmpdir_path + "/ck5", available_now=True)
    q.awaitTermination()
    alerts = spark.read.json(tmpdir_path + "/alerts")
    assert alerts.count() > 0 and "reasons" in alerts.columns
    ev = _stream(spark, tmpdir_path + "/s2")
    s = (M.session_expiry(ev, "user_id").writeStream.outputMode("append").format("memory")
         .queryName("sess").option("checkpointLocation", tmpdir_path + "/ck6").start())
    s.processAllAvailable()
    s.stop()
    n = spark.sql("select count(*) from sess").first()[0]
    total = response.idle_sessions(A.read_events(spark, SF0001), "user_id",
                                   order="event_id").count()
    # sessions whose end the watermark has passed: all but those still open
    assert total - 15 <= n <= total and n > 0


def test_monitor_with_stored_model(spark, tmpdir_path):
    """M7 inside Q2: the monitor scores each micro-batch with a saved forest."""
    from logvigil.operators import features as feat
    from logvigil.operators import iforest
    train = feat.web_features(A.web_log(A.read_events(spark, SF0001)))
    model = iforest.fit(train, feat.WEB_FEATURES, trees=10, psi=64, seed=42, contamination=0.1)
    iforest.save_model(spark, model, tmpdir_path + "/model")
    loaded = iforest.load_model(spark, tmpdir_path + "/model")
    web = A.web_log(_stream(spark, tmpdir_path))
    q = M.monitor(web, loaded, tmpdir_path + "/alerts", tmpdir_path + "/ck7", available_now=True)
    q.awaitTermination(300)
    alerts = spark.read.json(tmpdir_path + "/alerts")
    assert alerts.count() > 0
    # replaying an epoch rewrites its folder: no duplicate alerts per seq
    assert alerts.groupBy("seq").count().where("count > 1").count() == 0


def test_tail_log_reads_new_files_once(spark, tmpdir_path):
    """A folder of JSON-lines logs as a checkpointed stream; a second run
    of the same query over the same checkpoint reads only the new file."""
    import json

    from logvigil.schemas import WEB_LOG_RAW
    src = os.path.join(tmpdir_path, "logs")
    os.makedirs(src)

    def drop(name, n):
        with open(os.path.join(src, name), "w") as f:
            for i in range(n):
                f.write(json.dumps({"timestamp": "2025-02-05 15:20:0%d" % (i % 10),
                                    "event_type": "login", "user": "u", "status": "failed"}) + "\n")

    out = os.path.join(tmpdir_path, "out")

    def run():
        q = (M.tail_log(spark, src, WEB_LOG_RAW, fmt="json").writeStream.format("parquet")
             .option("path", out).option("checkpointLocation", tmpdir_path + "/ck8")
             .trigger(availableNow=True).start())
        q.awaitTermination(120)
        return spark.read.parquet(out).count()

    drop("a.json", 5)
    assert run() == 5
    drop("b.json", 3)
    assert run() == 8  # only the new file was read on the second run


def test_ip_activity_stream_equals_batch(spark, tmpdir_path):
    api = A.api_log(_stream(spark, tmpdir_path))
    q = (M.live_ip_activity(api).writeStream.outputMode("complete").format("memory")
         .queryName("ip_act").option("checkpointLocation", tmpdir_path + "/ck").start())
    q.processAllAvailable()
    q.stop()
    cols = ["ip_address", "request_count", "error_count"]
    exp = metrics.ip_activity(A.api_log(A.read_events(spark, SF0001)))
    assert sorted(spark.sql("select * from ip_act").select(*cols).collect()) == sorted(
        exp.select(*cols).collect())


def test_tail_feeds_the_monitor(spark, tmpdir_path):
    """Raw JSON lines -> tail_log -> monitor: records are parsed and numbered,
    over several files and polls, and every failed login of an unknown user
    raises an alert."""
    import json

    from logvigil.schemas import WEB_LOG_RAW
    src = os.path.join(tmpdir_path, "logs")
    os.makedirs(src)
    for f in range(3):
        with open(os.path.join(src, f"{f}.json"), "w") as out:
            for i in range(6):
                out.write(json.dumps({
                    "timestamp": f"2031-05-04 08:{f:02d}:{9 * i:02d}", "event_type": "login",
                    "user": "user1" if i % 2 else "stranger", "source_ip": f"10.0.{f}.{i}",
                    "status": "success" if i % 2 else "failed", "response_time": 0.1}) + "\n")
    web = M.tail_log(spark, src, WEB_LOG_RAW, fmt="json", max_files_per_trigger=1)
    q = M.monitor(web, None, tmpdir_path + "/alerts", tmpdir_path + "/ck", available_now=True)
    q.awaitTermination(300)
    alerts = spark.read.json(tmpdir_path + "/alerts")
    assert alerts.count() == 9 and all('"stranger"' in r.details for r in alerts.collect())
    assert alerts.select("seq").distinct().count() == 9


def test_batches_sink_keeps_history_and_writes_summaries(spark, tmpdir_path):
    """Q1 with carried history: z-scores and summaries equal the batch query's
    although the log arrives in pieces."""
    from logvigil.operators import features, iforest
    api = A.api_log(_stream(spark, tmpdir_path)).drop("seq", "batch_id")
    out = tmpdir_path + "/q1"
    seen = []

    def feature_fn(rows):
        feats = features.api_features(rows)
        seen.append(feats.select("seq", "endpoint_rt_zscore").collect())
        return feats

    names = ["response_time", "status_code"]
    sink = M.detect_batches_sink(out, feature_fn, names, trees=10)
    fn = M.count_batch_processor(30, tmpdir_path + "/state", ["ts", "user_id"], sink, history_rows=1000)
    q = (api.writeStream.foreachBatch(fn).option("checkpointLocation", tmpdir_path + "/ck")
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    whole = windows.count_batches(A.api_log(A.read_events(spark, SF0001)).drop("batch_id"))
    feats = features.api_features(whole).cache()
    last = {}
    for rows in seen:  # a row's score is the one of the poll that completed its batch
        for r in rows:
            last.setdefault(r.seq, r.endpoint_rt_zscore)
    want = {r.seq: r.endpoint_rt_zscore for r in feats.select("seq", "endpoint_rt_zscore").collect()}
    assert len(want) == 990 and all(abs(last[k] - v) < 1e-9 for k, v in want.items())
    exp = iforest.fit_score_batches(feats, names, trees=10)
    got = spark.read.parquet(out + "/scored").drop("epoch")
    assert sorted(got.collect()) == sorted(exp.select(*got.columns).collect())
    summary = spark.read.parquet(out + "/summary").drop("epoch")
    expected = metrics.batch_summary(exp, score="score")
    assert sorted(summary.collect()) == sorted(expected.select(*summary.columns).collect())


def _run_limiter(spark, src, path, **kw):
    out = M.rate_limit_stream(A.api_log(src, time_scale=60), max_rate=0.05, max_warnings=5, **kw)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        q = (out.writeStream.outputMode("append").format("parquet").trigger(availableNow=True)
             .option("checkpointLocation", path + "/ck").start(path + "/out"))
        q.awaitTermination(300)
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    return spark.read.parquet(path + "/out")


def test_hot_ip_is_taken_range_by_range(spark, tmpdir_path):
    """Far more rows of an IP in a micro-batch than are held: they go through the
    state store and come back in order; results equal the batch operator's."""
    got = _run_limiter(spark, _stream(spark, tmpdir_path), tmpdir_path, held_rows=6, idle_timeout_ms=None)
    cols = ["seq", "request_count", "warnings", "is_blocked", "reason"]
    exp = response.block_decisions(A.api_log(A.read_events(spark, SF0001), time_scale=60), max_rate=0.05)
    assert sorted(got.select(*cols).collect()) == sorted(exp.select(*cols).collect())


def test_limiter_holds_no_more_than_a_range():
    """The bound itself, on a state held in dicts."""
    import pandas as pd

    class Held(dict):
        largest = 0

        def containsKey(self, k):
            return k in self

        def getValue(self, k):
            return (self[k],)

        def updateValue(self, k, v):
            self[k] = v[0]
            Held.largest = max(Held.largest, len(v[0]))

        def removeKey(self, k):
            del self[k]

    class One:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, v):
            self.value = v

    r = M.RateLimiter(1e9, 5, None, held_rows=100)
    r.rate, r.waiting = One(), Held()
    rng = np.random.default_rng(1)
    seq = rng.permutation(5000)
    frames = (pd.DataFrame({"seq": s, "ts_us": s * 1000, "auth_fail": s % 9 == 0}) for s in np.array_split(seq, 90))
    out = list(r.handleInputRows(("ip",), frames, None))
    assert max(map(len, out)) == 100 and Held.largest == 100 * 17 and not r.waiting
    whole = pd.concat(out)
    assert whole["seq"].tolist() == list(range(5000)) and whole["request_count"].tolist() == list(range(1, 5001))
    assert r.rate.value == (5000, 0, 556)


def test_idle_state_expires(spark, tmpdir_path):
    """With a short time to live an IP starts anew in a later run."""
    import time
    src = os.path.join(tmpdir_path, "in")
    events = A.read_events(spark, SF0001).where("user_id % 32 = 3")
    events.coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    first = _run_limiter(spark, spark.readStream.schema(schema).parquet(src), tmpdir_path, idle_timeout_ms=2000)
    n = events.count()
    assert first.agg(F.max("request_count")).first()[0] == n
    time.sleep(4)
    events.coalesce(1).write.mode("append").parquet(src)
    both = _run_limiter(spark, spark.readStream.schema(schema).parquet(src), tmpdir_path, idle_timeout_ms=2000)
    assert both.count() == 2 * n and both.agg(F.max("request_count")).first()[0] == n


def test_state_files_do_not_grow_and_replays_repeat(spark, tmpdir_path):
    from logvigil.functions import files
    state, seen = tmpdir_path + "/state", {}

    def process(batches, epoch, history):
        rows = sorted(map(tuple, batches.select("seq", "batch_id", "k").collect()))
        seen.setdefault(epoch, []).append((rows, history.count()))

    fn = M.count_batch_processor(10, state, ["k"], process, history_rows=25)
    sizes = []
    for epoch in range(8):
        df = spark.range(epoch * 17, (epoch + 1) * 17).select(F.col("id").alias("k"))
        fn(df, epoch)
        if epoch in (3, 7):
            fn(df, epoch)  # the epoch is replayed before the next one starts
        count = 0
        for root, _, names in os.walk(state):
            count += sum(n.endswith(".parquet") for n in names)
        sizes.append(count)
        assert len(files.names(spark, state)) <= 2
    assert max(sizes[2:]) <= max(sizes[:3])
    assert seen[3][0] == seen[3][1] and seen[7][0] == seen[7][1]
    flat = [r for e in sorted(seen) for r in seen[e][-1][0]]
    assert [r[0] for r in flat] == list(range(130)) and all(r[1] == r[0] // 10 and r[2] == r[0] for r in flat)


def test_a_snapshot_without_its_mark_does_not_count(spark, tmpdir_path):
    from logvigil.streaming.state_log import StateLog
    log = StateLog(tmpdir_path + "/s")
    assert log.before(spark, 0) == (None, {})
    log.write(0, spark.range(3).toDF("k"), {"next_seq": 3})
    spark.range(9).toDF("k").write.parquet(log._at(1) + "/rows")  # the writer died here
    rows, meta = log.before(spark, 2)
    assert rows.count() == 3 and meta == {"next_seq": 3}
    with pytest.raises(ValueError):
        StateLog("x", keep=1)
