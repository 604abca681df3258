"""The arrival index and the sliding histories: a log with gaps gives the
results of the dense log."""

import statistics

import pytest
from pyspark.sql import functions as F

from logvigil.operators import arrival, features, history, iforest, metrics, windows
from logvigil.plans import adapters as A
from tests.conftest import SF0001


@pytest.fixture(scope="module")
def log(spark):
    return A.api_log(A.read_events(spark, SF0001)).where("seq < 300").drop("batch_id").cache()


def gapped(log):
    """One gap after 150 rows; the sequence starts at 17."""
    return log.withColumn("seq", F.col("seq") + 17 + F.when(F.col("seq") >= 150, 1013).otherwise(0))


def dense_of(seq):
    return seq - 17 - (1013 if seq >= 167 + 1013 else 0)


def test_index_forms(spark, log):
    dense = arrival.build(log)
    assert (dense.rows, dense.first, dense.chunks) == (300, 0, None)
    g = gapped(log)
    index = arrival.build(g, chunk_rows=100)
    assert index.rows == 300 and index.first == 17
    assert sum(r["_rows"] for r in index.chunks.collect()) == 300
    ranks = {r["seq"]: r["rank"] for r in arrival.number(g, index).collect()}
    assert all(rank == dense_of(seq) for seq, rank in ranks.items()) and len(ranks) == 300
    assert arrival.build(log.limit(0)).rows == 0
    assert arrival.number(log.limit(0)).count() == 0


def test_index_is_persistent(spark, log, tmp_path):
    for name, df in (("dense", log), ("gapped", gapped(log))):
        arrival.build(df, chunk_rows=64).save(str(tmp_path / name))
        again = arrival.load(spark, str(tmp_path / name))
        assert sorted(r["rank"] for r in arrival.number(df, again).collect()) == list(range(300))


def test_rows_without_a_sequence_have_no_rank(spark):
    df = spark.createDataFrame([(4,), (None,), (9,)], "seq long")
    assert sorted((r["seq"], r["rank"]) for r in arrival.number(df).collect()) == [(4, 0), (9, 1)]


@pytest.mark.parametrize("fn", [
    lambda d: windows.count_batches(d).select("seq", "batch_id", "pos_in_batch"),
    lambda d: metrics.endpoint_rt_zscore(d),
    lambda d: metrics.endpoint_rt_zscore(windows.count_batches(d)),
    lambda d: features.api_features(d),
    lambda d: iforest.fit_score_batches(features.api_features(windows.count_batches(d)),
                                        features.API_FEATURES, trees=5).select("batch_id", "score"),
], ids=["count_batches", "zscore", "zscore_of_batches", "api_features", "batch_forest"])
def test_gaps_change_nothing(log, fn):
    def rows(df):
        out = fn(df)
        plain = [c for c in out.columns if c != "seq"]
        return sorted(tuple(r[c] for c in plain) for r in out.collect())
    want, got = rows(log), rows(gapped(log))
    assert want == got and len(want) == 300


def test_baseline_on_gaps(log):
    def rows(df):
        return sorted(map(tuple, metrics.endpoint_baseline(df, window_rows=100).collect()))
    assert rows(log) == rows(gapped(log))


@pytest.mark.parametrize("window_rows,size,chunk", [(100, 30, 4), (90, 30, 5), (7, 30, 3), (25, 10, 2), (1000, 30, 256)])
def test_history_by_hand(log, window_rows, size, chunk):
    """Prefix sums against every history written out, chunks and halos included."""
    rows = sorted((r["seq"], r["endpoint"], r["response_time"]) for r in log.collect())
    d = arrival.with_batches(log, size, position="pos")
    got = {(r["batch_id"], r["endpoint"]): r for r in history.per_batch(
        d, "endpoint", "response_time", "batch_id", "seq", window_rows, size, F.col("pos"), chunk).collect()}
    assert set(got) == {(s // size, e) for s, e, _ in rows}
    for (b, e), r in got.items():
        end = size * b + size - 1
        x = [v for s, k, v in rows if k == e and end - window_rows < s <= end]
        assert r["baseline_rows"] == len(x)
        assert r["baseline_mean"] == pytest.approx(statistics.fmean(x), rel=1e-6) if x else True
        if len(x) > 1:
            assert r["baseline_std"] == pytest.approx(statistics.stdev(x), rel=1e-5, abs=1e-5)


def test_no_row_is_copied_per_batch(log):
    """The halo is all that is copied: fewer than window / chunk of the rows."""
    d = arrival.with_batches(log, 10)
    c = history.chunked(d, "batch_id", 20, 10, chunk_batches=10)
    assert c.where("_halo").count() == 60 and c.count() == 360  # 2 of 10 batches, 3 chunks


def test_huge_and_missing_values_keep_their_rows(spark, log):
    odd = log.withColumn("response_time", F.when(F.col("seq") == 3, F.lit(1e13)).when(
        F.col("seq") == 4, F.lit(float("nan"))).when(F.col("seq") == 5, F.lit(None)).otherwise(F.col("response_time")))
    base = metrics.endpoint_baseline(odd)
    assert base.agg(F.sum("baseline_rows")).first()[0] == metrics.endpoint_baseline(log).agg(
        F.sum("baseline_rows")).first()[0]
    assert metrics.endpoint_rt_zscore(odd).count() == 300


def test_one_exchange_for_all_api_windows(log):
    plan = features.api_features(windows.count_batches(log))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
