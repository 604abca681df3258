"""op12: whitened embeddings against numpy's covariance and eigenvectors."""

import numpy as np
import pytest

from logvigil.llm.queries import QUERIES
from logvigil.llm.whitening import (ORIGIN, Centre, decode_rows, encode_rows, fit, fit_list,
                                    solve_rows, whiten)

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, key string, v int, code binary, n long"


def table(spark, rows):
    return spark.createDataFrame([(k, v, 0, "x", 1, None, 2) for k, v in rows], VECTORS).repartition(3)


def check(rows, got, most=16):
    """``rows`` (key, vector) of usable vectors; ``got`` the result's rows."""
    x = {k: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) + ORIGIN for k, v in rows}
    uniq = sorted({tuple(v) for v in x.values()})
    n, sums = len(uniq), [sum(c) for c in zip(*uniq)]
    y = np.array([[(n * a - s) / n for a, s in zip(u, sums)] for u in uniq])
    cov = y.T @ y / n
    e, vec = np.linalg.eigh(cov)
    e, vec = e[::-1], vec[:, ::-1]
    k = min(most, int((e > 1e-18 * e[0]).sum()) if e[0] > 0 else 0, np.linalg.matrix_rank(y))
    assert len(got) == k * len(rows)
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert len(by) == len(got)
    for i in range(k):
        want = np.array([sum((v - s / n) * w for v, s, w in zip(x[key], sums, vec[:, i])) for key, _ in rows])
        have = np.array([by[key, i + 1]["whitened"] for key, _ in rows])
        want = want / np.sqrt(e[i])
        assert min(np.abs(want - have).max(), np.abs(want + have).max()) < 1e-6
        assert by[rows[0][0], i + 1]["explained"] == pytest.approx(e[i] / np.trace(cov), rel=1e-9)
    for key, _ in rows[:40]:
        assert {by[key, i + 1]["deviation"] for i in range(k)} == {
            sum((n * int(a) - s) ** 2 for a, s in zip(x[key], sums))} if k else True
    assert all(r["n"] == n and r["identity_error"] < 1e-6 for r in got)


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(rows, QUERIES["op12_embedding_whitening"](spark, SF).collect())


def test_codes_round_trip():
    z = np.array([[0, 1, -1], [127, -128, 3], [128, 0, 0], [-32769, 5, 5], [2 ** 40, -1, 2]])
    codes = encode_rows(z)
    assert [c[0] for c in codes] == [1, 1, 2, 4, 8]
    back = sorted(tuple(r) for part in decode_rows(codes) for r in part.tolist())
    assert back == sorted(map(tuple, z.tolist()))


def test_triangular_solve():
    rng = np.random.default_rng(1)
    r, y = np.triu(rng.normal(size=(7, 7))) + 4 * np.eye(7), rng.normal(size=(7, 20))
    assert np.allclose(solve_rows(y, r).T @ r, y.T)


def test_odd_rows_copies_and_ragged(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(c) for c in rng.normal(size=5) * [9, 4, 2, 1, .5]]) for i in range(60)]
    good += [(100 + i, good[0][1]) for i in range(200)]  # one vector holds most rows
    odd = [(300, None), (301, []), (302, [1.0, None, 1.0, 1.0, 1.0]), (303, [float("nan")] * 5),
           (304, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (305, [1.0, 2.0]), (306, [1e30] * 5)]
    check(good, whiten(table(spark, good + odd)).collect())


def test_null_and_repeated_keys(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -1.0]), (2, [0.0, 0.5])]
    got = whiten(table(spark, rows)).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [
        (0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2)]
    assert {r["n"] for r in got} == {3}


def test_dependent_and_constant_dimensions(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(-4000, 4000, (80, 2)) / 64
    rows = [(i, [float(x), float(y), float(x), 7.0, float(x + 64 * y)]) for i, (x, y) in enumerate(a)]
    check(rows, whiten(table(spark, rows)).collect())


def test_far_mean_and_small_spread(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(100_000 + c) for c in rng.integers(0, 9, 3)]) for i in range(50)]
    check(rows, whiten(table(spark, rows)).collect())


def test_scales_far_apart(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(size=4) * [4e4, 3e2, 2, .1]]) for i in range(300)]
    model = fit(fit_list(table(spark, rows)))
    assert 3 <= model.passes <= 6 and model.identity_error < 1e-9


def test_no_variance_and_empty(spark):
    assert whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whiten(table(spark, [(1, None)])).count() == 0
    assert whiten(table(spark, [(1, None)]).limit(0)).columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_beyond_64_bits():
    c = Centre(3, [3 * 10 ** 12, 0])
    z = np.array([[10 ** 12 + 7, 5], [2 * 10 ** 12, 0]])
    assert c.deviation(z).to_pylist() == [21 ** 2 + 15 ** 2, None]
