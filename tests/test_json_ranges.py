"""JSON arrays read in byte ranges: the records and positions of a whole read,
wherever the ranges cut."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logvigil.schemas import API_LOG_RAW
from logvigil.sources import json_ranges as J
from logvigil.sources.json_logs import read_log_array, read_log_envelope


def records(n, seed=1):
    rng = random.Random(seed)
    odd = ['q"uo', "back\\", 'b\\"', "{[", "]}", "é日", "a,b", "\\\\", "\n", "u\u0007", ""]
    return [{"timestamp": f"2031-05-04 08:00:{i % 60:02d}", "endpoint": "/" + "".join(rng.choices(odd, k=rng.randrange(4))),
             "method": rng.choice(["GET", "POST"]), "status_code": rng.choice([200, 404]), "response_time": i / 8,
             "ip_address": rng.choice(odd), "user_agent": None} for i in range(n)]


def test_starts_by_every_cut():
    text = json.dumps(records(6), indent=1, ensure_ascii=False).encode()
    want = [i for i in J.record_starts(text, b"", False, 0, 1).tolist()]
    assert len(want) == 6
    for cut in range(len(text) + 1):
        a, b = text[:cut], text[cut:]
        s = J.summarize(a, b"")
        got = J.record_starts(a, b"", False, 0, 1).tolist() + [
            cut + i for i in J.record_starts(b, a, s.ends[0], s.change[0], 1).tolist()]
        assert got == want, cut
        t = J.summarize(b, a)
        assert s.change[0] + t.change[int(s.ends[0])] == 0 and not t.ends[int(s.ends[0])]


def test_quotes_and_backslashes():
    for text in (rb'"a\"b"', rb'"\\"', rb'"\\\""', rb'\\\\"', b'""""'):
        for cut in range(len(text)):
            whole = J.quotes_of(np.frombuffer(text, np.uint8), b"").tolist()
            left = J.quotes_of(np.frombuffer(text[:cut], np.uint8), b"").tolist()
            right = J.quotes_of(np.frombuffer(text[cut:], np.uint8), text[:cut]).tolist()
            assert left + [cut + i for i in right] == whole


@pytest.mark.parametrize("range_bytes", [64, 333, 5000, 1 << 20])
def test_equals_the_one_task_reader(spark, tmp_path, range_bytes):
    for f in range(2):
        (tmp_path / f"{f}.json").write_text(json.dumps(records(40, f), indent=f * 2, ensure_ascii=f == 0))
    got = read_log_array(spark, str(tmp_path), range_bytes=range_bytes)
    want = read_log_array(spark, str(tmp_path), API_LOG_RAW)

    def rows(df):
        cols = [c for c in df.columns if c != "file"]
        return sorted(((os.path.basename(r["file"]), *[r[c] for c in cols]) for r in df.collect()), key=str)
    assert rows(got) == rows(want)
    if range_bytes == 64:
        assert got.rdd.getNumPartitions() > 50


@pytest.mark.parametrize("range_bytes", [50, 700, 1 << 20])
def test_envelope(spark, tmp_path, range_bytes):
    deep = {"meta": {"logs": [{"endpoint": "no"}]}, "other": [{"endpoint": "no"}, [1]], "a\"logs": [],
            "logs": records(30), "tail": [{"endpoint": "no"}]}
    (tmp_path / "a.json").write_text(json.dumps(deep, indent=2))
    (tmp_path / "b.json").write_text('{"other": [{"endpoint": "no"}]}')
    (tmp_path / "c.json").write_text("")
    got = read_log_envelope(spark, str(tmp_path), API_LOG_RAW, range_bytes=range_bytes)
    want = read_log_envelope(spark, str(tmp_path), API_LOG_RAW, report=False)
    cols = ["file_pos", "timestamp", "endpoint", "ip_address", "response_time"]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(
        map(str, want.select(F.col("file_pos").cast("long").alias("file_pos"), *cols[1:]).collect()))
    assert got.count() == 30


def test_broken_and_missing_files(spark, tmp_path):
    assert J.read_json_records(spark, str(tmp_path / "none"), API_LOG_RAW).count() == 0
    text = json.dumps(records(10))
    (tmp_path / "cut.json").write_text(text[:len(text) // 2])  # breaks off in a record
    (tmp_path / "no.json").write_text('"just text with { and ["')
    got = J.read_json_records(spark, str(tmp_path), API_LOG_RAW, range_bytes=100)
    assert 3 <= got.count() <= 6 and got.where("timestamp is null").count() == 0
