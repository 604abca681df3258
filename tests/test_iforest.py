"""Isolation-forest properties (score range, contamination share, planted
outlier, determinism, partition independence, persistence, edge sizes)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from logvigil.operators import iforest


def _frame(spark, n=200, outlier=True, seed=0):
    rng = np.random.default_rng(seed)
    X = rng.normal(0, 1, size=(n, 3))
    if outlier:
        X[17] = [12.0, -11.0, 9.0]
    pdf = pd.DataFrame(X, columns=["a", "b", "c"]).assign(const=5.0)
    pdf.insert(0, "seq", np.arange(n))
    return spark.createDataFrame(pdf)


FEATS = ["a", "b", "c", "const"]


def test_scores_range_outlier_and_contamination(spark):
    df = _frame(spark)
    m = iforest.fit(df, FEATS, trees=50, psi=64, seed=7, contamination=0.1)
    s = iforest.predict(df, m).toPandas().sort_values("seq")
    assert (s.score >= -1).all() and (s.score < 0).all()
    assert s.score.idxmin() == s.index[s.seq == 17][0]
    share = s.is_anomaly.mean()
    assert 0.08 <= share <= 0.12


def test_deterministic_and_partition_independent(spark):
    df = _frame(spark)
    m1 = iforest.fit(df, FEATS, trees=20, psi=32, seed=3)
    m2 = iforest.fit(df.repartition(7), FEATS, trees=20, psi=32, seed=3)
    a = iforest.score(df, m1).orderBy("seq").select("score").toPandas().score.to_numpy()
    b = iforest.score(df.repartition(5), m2).orderBy("seq").select("score").toPandas().score.to_numpy()
    assert np.array_equal(a, b)
    m3 = iforest.fit(df, FEATS, trees=20, psi=32, seed=4)
    c = iforest.score(df, m3).orderBy("seq").select("score").toPandas().score.to_numpy()
    assert not np.array_equal(a, c)


def test_scaling_leaves_scores_close(spark):
    df = _frame(spark)
    m = iforest.fit(df, FEATS, trees=30, psi=64, seed=1, scale_features=True, contamination=0.05)
    s = iforest.predict(df, m).toPandas()
    assert s.sort_values("score").seq.iloc[0] == 17


def test_save_load_roundtrip(spark, tmpdir_path):
    df = _frame(spark)
    m = iforest.fit(df, FEATS, trees=10, psi=32, seed=2, contamination=0.1)
    iforest.save_model(spark, m, tmpdir_path + "/model")
    m2 = iforest.load_model(spark, tmpdir_path + "/model")
    assert m2 is not None and m2.offset == m.offset
    a = iforest.score(df, m).orderBy("seq").toPandas().score
    b = iforest.score(df, m2).orderBy("seq").toPandas().score
    assert a.equals(b)
    assert iforest.load_model(spark, tmpdir_path + "/missing") is None


def test_tiny_inputs(spark):
    one = _frame(spark, n=1, outlier=False)
    m = iforest.fit(one, FEATS, trees=5, psi=256, seed=1)
    assert iforest.score(one, m).count() == 1
    # two-row bootstrap frame (the monitor's initial model)
    pdf = pd.DataFrame({f: [0.0, 1.0] for f in FEATS})
    m2 = iforest.fit_local_frame(spark, pdf, FEATS, trees=100, psi=100, seed=42,
                                 contamination=0.1)
    assert m2.forest.psi == 2 and m2.offset is not None
    # all rows equal: no split anywhere, every score identical
    same = spark.createDataFrame(pd.DataFrame({"seq": range(20), **{f: [1.0] * 20 for f in FEATS}}))
    ms = iforest.fit(same, FEATS, trees=5, psi=16, seed=1)
    assert iforest.score(same, ms).select(F.countDistinct("score")).first()[0] == 1


def test_exact_quantile_matches_numpy(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=5000), 3)
    df = spark.createDataFrame(pd.DataFrame({"x": v}))
    for q in (0.0, 0.1, 0.15, 0.5, 0.999, 1.0):
        got = iforest.exact_quantile(df, "x", q, bins=7)  # several narrowing rounds
        assert got == pytest.approx(float(np.quantile(v, q)), abs=1e-12)
    ties = spark.createDataFrame(pd.DataFrame({"x": np.repeat([1.0, 2.0, 3.0], 700)}))
    assert iforest.exact_quantile(ties, "x", 0.5, bins=4) == 2.0
    # two heavy values on either side of the rank: bins come back, never rows
    two = spark.createDataFrame(pd.DataFrame({"x": np.repeat([0.0, 1.0], 500)}))
    assert iforest.exact_quantile(two, "x", 0.5, bins=4) == 0.5
    wild = [-1.7e308, -1.0, 0.0, 5e-324, 1e-300, 2.0, 1.7e308, float("nan")]
    df = spark.createDataFrame([(x,) for x in wild] + [(None,)], "x double")
    assert [iforest.exact_quantile(df, "x", i / 6, bins=3) for i in range(7)] == wild[:-1]
    assert iforest.exact_quantile(df.where("false"), "x", 0.5) is None


def test_sample_is_the_smallest_draws_whatever_the_bound(spark):
    df = _frame(spark)
    n = df.count()
    for bound in (iforest.DRAW_RANGE, iforest.DRAW_RANGE // 3):
        got = {}
        for r in iforest.sample_for_trees(df, FEATS, [0, 3, 4], 20, bound, 9).collect():
            got.setdefault(r.tree, set()).add(r.row_id)
        for t, rows in got.items():
            draws = sorted((iforest.tree_draw_py(9, t, i), i) for i in range(n))
            assert rows == {i for _, i in draws[:20]}
    plan = iforest.sample_for_trees(df, FEATS, [0, 1], 20, 1 << 30, 9)._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "SinglePartition" not in plan
    # a bound too narrow is widened until every tree has its sample
    small = iforest.fit(df, FEATS, trees=12, psi=1, seed=3)
    assert (small.forest.size[:, 1] == 1).all()


def test_stacked_batches_equal_single_fits(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(5, 30, 4)).round(1)
    got = iforest.score_stacked(X, 20, 42)
    for x, s in zip(X, got):
        fo = iforest.build_forest(np.repeat(x[None], 20, axis=0), 42, tuple(range(20)),
                                  iforest.max_depth_for(30), 30)
        assert np.array_equal(iforest.score_matrix(fo, x), s)


def test_batch_forests(spark):
    df = _frame(spark, n=90).withColumn("batch_id", (F.col("seq") / 30).cast("long"))
    out = iforest.fit_score_batches(df, FEATS, trees=20, psi=256, contamination=0.15).toPandas()
    assert len(out) == 90
    per = out.groupby("batch_id").is_anomaly.sum()
    assert (per == 5).all()  # 0.15 quantile of 30 distinct scores flags 5 rows
    assert out.loc[out.seq == 17, "is_anomaly"].item()


def test_fit_predict_equals_fit_then_predict(spark):
    df = _frame(spark)
    m1 = iforest.fit(df, FEATS, trees=20, psi=64, seed=9, contamination=0.1)
    a = iforest.predict(df, m1).orderBy("seq").select("score", "is_anomaly").collect()
    m2, flagged = iforest.fit_predict(df, FEATS, 0.1, trees=20, psi=64, seed=9)
    b = flagged.orderBy("seq").select("score", "is_anomaly").collect()
    assert m1.offset == m2.offset and a == b


def test_exact_quantile_reads_the_column_twice(spark):
    """Whatever the data: a sketch, then one counting pass; refinement works on
    the bracket's table."""
    rng = np.random.default_rng(8)
    v = np.r_[rng.normal(size=3000), np.repeat([0.25], 2000), rng.exponential(size=1000) * 1e9, -np.inf, np.inf]
    reads = spark.sparkContext.accumulator(0)

    def counted(it):
        for pdf in it:
            reads.add(len(pdf))
            yield pdf

    df = spark.createDataFrame(pd.DataFrame({"x": v})).mapInPandas(counted, "x double")
    for q in (0.0, 0.003, 0.5, 0.6, 0.97, 1.0):
        reads.value = 0
        got = iforest.exact_quantile(df, "x", q, accuracy=50)
        want = iforest.linear_quantile(v, q)
        assert got == pytest.approx(want) and reads.value == 2 * len(v)
    # a bracket of many values is searched in bins, not collected
    old, iforest.BRACKET_ROWS = iforest.BRACKET_ROWS, 5
    try:
        finite = v[np.isfinite(v)]
        f = spark.createDataFrame(pd.DataFrame({"x": finite}))
        for q in (0.1, 0.42, 0.9):
            assert iforest.exact_quantile(f, "x", q, bins=3, accuracy=20) == pytest.approx(
                iforest.linear_quantile(finite, q))
    finally:
        iforest.BRACKET_ROWS = old


def test_model_versions_switch_whole(spark, tmpdir_path):
    """A reader during a save has the old version until the pointer is there,
    then the new one; a save that dies leaves the old one."""
    path = tmpdir_path + "/model"
    df = _frame(spark)
    models = [iforest.fit(df, FEATS, trees=4, psi=16, seed=s, contamination=0.1) for s in range(4)]
    assert iforest.load_model(spark, path) is None
    names = [iforest.save_model(spark, m, path, keep=2) for m in models[:3]]
    assert [v for _, v in iforest.model_versions(spark, path)] == names[::-1]
    assert iforest.load_model(spark, path).seed == 2
    assert iforest.load_model(spark, path, names[1]).seed == 1  # kept
    from logvigil.functions import files
    assert [n for n in files.names(spark, path) if n.startswith("v-")] == sorted(names[1:])
    # a torn save: the new version's nodes are there, its parameters and pointer are not
    spark.createDataFrame([(0, 1, -1, 0.0, 9)], iforest.NODE_SCHEMA).write.parquet(path + "/v-torn/nodes")
    again = iforest.load_model(spark, path)
    assert again.seed == 2 and again.offset == models[2].offset
    iforest.save_model(spark, models[3], path)
    assert iforest.load_model(spark, path).offset == models[3].offset


def _stacked_by_rows(X, trees, seed):
    """score_stacked on trees that the row-wise builder grows."""
    batches, n, _ = X.shape
    depth = iforest.max_depth_for(n)
    fo, node = iforest.build_forest(np.repeat(X, trees, axis=0), seed, tuple(range(trees)), depth, n,
                                    with_nodes=True)
    level = np.floor(np.log2(node)).astype(np.int64)
    units = iforest.leaf_units(n, depth)[level, fo.size[np.arange(batches * trees)[:, None], node]]
    total = units.reshape(batches, trees, n).sum(axis=1)
    return iforest.scores_from_units(total.reshape(-1), trees, n).reshape(batches, n)


def test_stacked_scores_equal_the_row_wise_builder():
    rng = np.random.default_rng(7)
    for n in (1, 2, 3, 29, 30, 31, 54, 61, 62, 63):
        X = rng.normal(size=(5, n, 6))
        X[1:, :, 0] = np.round(X[1:, :, 0])
        X[:, :, 1] = 3.0
        X[2] = -0.0
        X[3][rng.random((n, 6)) < .1] = np.nan
        X[4][rng.random((n, 6)) < .1] = np.inf
        X[4][rng.random((n, 6)) < .1] = -1e308
        with np.errstate(all="ignore"):
            assert np.array_equal(iforest.score_stacked(X, 9, 42), _stacked_by_rows(X, 9, 42)), n


def test_small_batches_are_not_copied_per_tree():
    import tracemalloc
    X = np.random.default_rng(8).normal(size=(64, 30, 13))
    iforest.score_stacked(X[:1], 100, 42)  # the draws are kept
    tracemalloc.start()
    iforest.score_stacked(X, 100, 42)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * X.nbytes / 2  # one copy of the rows per tree is twice that
