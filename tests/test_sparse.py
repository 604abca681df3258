"""Sparse one-hot vectors and forests on them: equal to the wide frame, and
unmoved by the number of categories."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from logvigil.operators import features, iforest, sparse
from logvigil.plans import adapters as A
from tests.conftest import SF0001


@pytest.fixture(scope="module")
def web(spark):
    return A.web_log(A.read_events(spark, SF0001)).select(
        "seq", "ts", "event_type", "user", "source_ip", "traffic_type", "status", "response_time").cache()


def many(spark, users, rows):
    return spark.range(rows).select(
        F.col("id").alias("seq"), F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts"),
        F.lit("login").alias("event_type"), F.lit("success").alias("status"),
        F.concat(F.lit("u"), (F.col("id") * 7919 % users).cast("string")).alias("user"),
        F.concat(F.lit("10.0.0."), (F.col("id") % 250).cast("string")).alias("source_ip"),
        (F.col("id") % 13 / 10).alias("response_time"))


def test_long_form_equals_the_wide_frame(web):
    wide = features.base_features(web)
    names = [c for c in wide.columns if c != "seq"]
    want = {(r["seq"], n, float(r[n])) for r in wide.collect() for n in names if r[n]}
    got = sparse.long_form(features.sparse_base_features(web), features.BASE_LAYOUT).collect()
    assert {(r["seq"], r["feature"], r["value"]) for r in got} == want and len(got) == len(want)


def test_forest_equals_the_wide_forest(web):
    wide = features.base_features(web)
    names = [c for c in wide.columns if c != "seq"]
    a, fa = iforest.fit_predict(wide, names, 0.2, trees=30, psi=64)
    b, fb = iforest.fit_predict(iforest.LogSource(web, features.sparse_base_features), "features", 0.2,
                                trees=30, psi=64, layout=features.BASE_LAYOUT)
    cols = ("seq", "score", "is_anomaly")
    assert a.offset == b.offset
    assert sorted(fa.select(*cols).collect()) == sorted(fb.select(*cols).collect())
    assert set(b.features) <= set(names)


def test_hundred_thousand_users_in_seconds(spark):
    log = many(spark, 100_000, 200_000)
    started = time.time()
    src = iforest.LogSource(log, features.sparse_base_features)
    model = iforest.fit(src, "features", trees=20, psi=64, layout=features.BASE_LAYOUT)
    planned = time.time() - started
    scored = iforest.score(src.features(), model)
    assert len(scored.columns) == 3  # no column per user
    assert scored.where("score between -1 and 0").count() == 200_000
    users = sum(n.startswith("user_") for n in model.features)
    assert users <= 20 * 64 and planned < 60


def test_as_many_users_as_the_wide_frame_can_hold(spark):
    log = many(spark, 150, 300)
    names = [c for c in features.base_features(log).columns if c != "seq"]
    a = iforest.fit(features.base_features(log), names, trees=25, psi=50, contamination=0.1)
    b = iforest.fit(iforest.LogSource(log, features.sparse_base_features), "features", trees=25, psi=50,
                    contamination=0.1, layout=features.BASE_LAYOUT)
    wide = iforest.score(features.base_features(log), a).select("seq", "score")
    thin = iforest.score(features.sparse_base_features(log), b).select("seq", "score")
    assert a.offset == b.offset and sorted(wide.collect()) == sorted(thin.collect())


def test_nulls_new_categories_and_empty_vectors(spark, tmp_path):
    log = many(spark, 9, 60)
    odd = log.withColumn("user", F.when(F.col("seq") % 5 != 0, F.col("user"))) \
        .withColumn("response_time", F.when(F.col("seq") % 3 != 0, F.lit(float("nan"))).otherwise(F.col("response_time")))
    vectors = features.sparse_base_features(odd)
    assert not [r for r in sparse.long_form(vectors, features.BASE_LAYOUT).collect() if r["value"] != r["value"]]
    model = iforest.fit(iforest.LogSource(odd, features.sparse_base_features), "features", trees=10, psi=16,
                        contamination=0.1, layout=features.BASE_LAYOUT)
    iforest.save_model(spark, model, str(tmp_path / "m"))
    again = iforest.load_model(spark, str(tmp_path / "m"))
    fresh = odd.withColumn("user", F.lit("never seen")).withColumn("seq", F.col("seq") + 1000)
    for m in (model, again):
        assert iforest.predict(features.sparse_base_features(fresh), m).count() == 60
    empty = spark.createDataFrame([(1, []), (2, None)], f"seq long, features {sparse.VECTOR}")
    assert iforest.score(empty, again).where("score < 0").count() == 2
    with pytest.raises(ValueError):
        iforest.fit(vectors, "features", layout=features.BASE_LAYOUT, scale_features=True)


def test_many_used_indices_are_scored_in_blocks(spark, monkeypatch):
    log = many(spark, 40, 120)
    model = iforest.fit(iforest.LogSource(log, features.sparse_base_features), "features", trees=8, psi=32,
                        layout=features.BASE_LAYOUT)
    used = {i: j for j, i in enumerate(model.indices)}
    import pyarrow as pa
    table = pa.Table.from_batches(features.sparse_base_features(log).toArrow().to_batches())
    column = table.column("features").combine_chunks()
    whole = np.vstack([m for _, m in sparse.filled(column, used)])
    monkeypatch.setattr(sparse, "MATRIX_CELLS", 3 * len(used))
    parts = list(sparse.filled(column, used))
    assert len(parts) == 40 and np.array_equal(np.vstack([m for _, m in parts]), whole)


def test_only_the_sampled_batches_are_built(web, spark):
    built = []

    def build(log):
        built.append(log)
        return features.web_features(log, batch="batch_id")

    log = A.web_log(A.read_events(spark, SF0001))
    src = iforest.LogSource(log, build, "batch_id")
    iforest.fit(src, features.WEB_FEATURES, trees=2, psi=3)
    assert len(built) == 1 and built[0].select("batch_id").distinct().count() <= 6
    want = iforest.fit(src.features(), features.WEB_FEATURES, trees=5, psi=40, contamination=0.1)
    got = iforest.fit(src, features.WEB_FEATURES, trees=5, psi=40, contamination=0.1)
    assert want.offset == got.offset and np.array_equal(want.forest.threshold, got.forest.threshold)
