import json
import os

from pyspark.sql import functions as F

from fixtures import API_ROWS
from logvigil.sources.json_logs import (corrupt_files, parse_api_log, read_log_array,
                                         read_log_envelope, with_dense_seq)
from logvigil.sources.sinks import append_log


def test_envelope_missing_key_and_corrupt(spark, tmpdir_path, caplog):
    with open(os.path.join(tmpdir_path, "a.json"), "w") as f:
        json.dump({"other": []}, f)
    with open(os.path.join(tmpdir_path, "b.json"), "w") as f:
        f.write("{not json")
    with open(os.path.join(tmpdir_path, "c.json"), "w") as f:
        f.write('{"logs": [{"timestamp": "2031-05-04 08:00:00", "event_type": "login"},\n {"time')
    with caplog.at_level("ERROR"):
        assert read_log_envelope(spark, tmpdir_path).where("event_type is null").count() == 0
    assert "2 log file(s)" in caplog.text
    bad = corrupt_files(spark, tmpdir_path).collect()
    assert sorted(os.path.basename(r.file) for r in bad) == ["b.json", "c.json"]
    assert read_log_envelope(spark, os.path.join(tmpdir_path, "nope.json")).count() == 0


def test_array_reader_and_append(spark, tmpdir_path):
    recs = [{"timestamp": t, "endpoint": e, "method": m, "status_code": s,
             "response_time": rt, "payload": b} for t, e, m, s, rt, b in API_ROWS]
    p = os.path.join(tmpdir_path, "api_logs.json")
    with open(p, "w") as f:
        json.dump(recs, f, indent=2)
    df = parse_api_log(read_log_array(spark, p), seq="file_pos")
    assert df.count() == 36
    assert df.where(F.col("status_code") >= 400).count() == 14
    out = os.path.join(tmpdir_path, "log")
    append_log(df, out)
    append_log(df, out)
    back = spark.read.parquet(out)
    assert back.count() == 72 and "date" in back.columns


def test_dense_seq(spark):
    df = spark.createDataFrame([(i * 7 % 50, str(i)) for i in range(50)], "t long, v string")
    s = with_dense_seq(df.repartition(5), ["t"])
    assert sorted(r.seq for r in s.collect()) == list(range(50))
    assert [r.t for r in s.orderBy("seq").collect()] == sorted(r.t for r in df.collect())


def test_append_is_idempotent(spark, tmpdir_path):
    from logvigil.functions import files
    from logvigil.sources import sinks
    path = os.path.join(tmpdir_path, "log")
    day = lambda d, n: spark.range(n).select(F.col("id").alias("seq"), F.expr(
        f"timestamp_ntz'2031-05-0{d} 08:00:00'").alias("ts"))
    assert sinks.append_log(day(1, 5).unionByName(day(2, 4)), path, batch_id="001")
    assert not sinks.append_log(day(1, 5).unionByName(day(2, 4)), path, batch_id="001")
    assert sinks.read_log(spark, path).count() == 9
    # an append that died after writing: not read, and replaced by its retry
    sinks._write(day(1, 7), path, "b-2", "ts")
    assert sinks.read_log(spark, path).count() == 9
    assert sinks.append_log(day(1, 3), path, batch_id=2) and sinks.read_log(spark, path).count() == 12
    for i in range(3, 9):
        assert sinks.append_log(day(1, 2), path, batch_id=i)
    before = sorted(map(tuple, sinks.read_log(spark, path).collect()))
    assert sinks.compact_log(spark, path, "2031-05-01") == 7  # batch 001 holds another day, too
    assert sorted(map(tuple, sinks.read_log(spark, path).collect())) == before
    assert len(files.names(spark, f"{path}/date=2031-05-01")) == 2
    assert not sinks.append_log(day(1, 2), path, batch_id=5)  # compacted, still known
    assert sinks.compact_log(spark, path, "2031-05-01") == 0
    assert sinks.compact_log(spark, path, "1999-01-01") == 0
    try:
        sinks.append_log(day(1, 1), path, batch_id="a/b")
        raise AssertionError("accepted")
    except ValueError:
        pass


def test_a_session_listed_twice_keeps_requests_single(spark):
    from logvigil.operators import validation
    sessions = spark.createDataFrame([("a", "1.1.1.2"), ("a", "1.1.1.1"), ("a", "1.1.1.1"), ("b", None)],
                                     "session_id string, ip_address string")
    requests = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, None)],
                                     "seq long, session_id string")
    got = {r["seq"]: r["session_ip"] for r in validation.session_ip(requests, sessions).collect()}
    assert got == {1: "1.1.1.1", 2: "1.1.1.1", 3: "127.0.0.1", 4: "127.0.0.1", 5: "127.0.0.1"}
