"""Whitening against numpy's eigenvectors of the covariance, and odd rows."""

import math

import numpy as np
import pytest

from sagebrush.llm import whitening
from sagebrush.llm.queries import op11_whitening

SF = "/root/testdata/sf0.001"


def brute(vectors):
    """(n, sums, eigenvalues falling, vectors as rows) of the distinct whole vectors."""
    fit = np.array(sorted({tuple(math.floor(256 * float(c)) for c in v) for v in vectors}))
    centred = fit - fit.sum(axis=0) / len(fit)
    e, u = np.linalg.eigh(centred.T @ centred / len(fit))
    return fit, e[::-1], u[:, ::-1].T


def test_query_against_eigenvectors(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    good = {r["vec_id"]: r["embedding"] for r in table if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])}
    fit, e, u = brute(good.values())
    n, sums = len(fit), fit.sum(axis=0)
    got = op11_whitening(spark, SF).collect()
    assert len(got) == 4 * len(good)
    by_component = {k: [r for r in got if r["component"] == k] for k in (1, 2, 3, 4)}
    for k, rows in by_component.items():
        assert {r["vec_id"] for r in rows} == set(good)
        mine, theirs = [], []
        for r in rows:
            x = np.array([math.floor(256 * float(c)) for c in good[r["vec_id"]]])
            assert r["n"] == n and r["deviation"] == int(((n * x - sums).astype(object) ** 2).sum())
            assert abs(r["explained"] / (e[k - 1] / e.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9
            mine.append(r["whitened"])
            theirs.append((x - sums / n) @ u[k - 1] / math.sqrt(e[k - 1]))
        sign = np.sign(np.dot(mine, theirs))
        assert np.allclose(mine, sign * np.array(theirs), atol=1e-6)


def test_tree_of_triangles(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(300, 6)) * [90, 50, 20, 9, 4, 1] + 1000).astype(int)
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>").repartition(13)
    fitted = whitening.fit(rows, components=6)
    assert fitted.n == len({tuple(v) for v in x.tolist()}) and fitted.identity_error < 1e-9
    _, e, u = brute(x / 256)
    deep = whitening.tsqr(rows.distinct().repartition(13), fitted.mean, fan=2)
    assert np.allclose(np.linalg.svd(deep)[1] ** 2 / fitted.n, e) and np.allclose(deep, np.triu(deep))
    assert np.allclose(fitted.eigenvalues, e) and np.allclose(np.abs((fitted.components * u).sum(axis=1)), 1)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (None, [0.0, 1.0], "b"), (3, None, "c"), (4, [nan, 0.0], "d"), (5, [inf, 0.0], "e"), (6, [None, 1.0], "f"), (7, [1.0], "g"), (8, [], "h"), (9, [-0.001, 2.0], "i")]
    df = spark.createDataFrame(rows, "id long, v array<double>, component string")
    got = whitening.whiten(df, "v").collect()
    assert sorted((r["id"] or 0) for r in got) == [0, 0, 1, 1, 1, 1, 7, 7, 8, 8, 9, 9]
    assert {r["component"] for r in got} == {"a", "b", "g", "h", "i"}  # df's own
    for r in got:
        assert r["_component"] in (1, 2) and r["n"] == 3
        assert (r["whitened"] is None) == (r["deviation"] is None) == (r["id"] in (7, 8))
    fit = np.array([[256, 0], [0, 256], [-1, 512]])
    assert {r["deviation"] for r in got if r["id"] == 9} == {int(((3 * fit[2] - fit.sum(axis=0)) ** 2).sum())}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])]])
def test_nothing_to_fit(spark, rows):
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert out.collect() == [] and {"vec_id", "component", "whitened", "n"} <= set(out.columns)


def test_no_variance_and_wide_numbers(spark):
    same = whitening.whiten(spark.createDataFrame([(1, [0.1, 0.7]), (2, [0.1, 0.7])], "vec_id long, embedding array<float>")).collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["deviation"] == 0 and r["n"] == 1 for r in same)
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 0.3]) for i in range(5)], "vec_id long, embedding array<float>")).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line)
    wide = whitening.whiten(spark.createDataFrame([(1, [1e17, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert all(r["deviation"] is None and r["identity_error"] < 1e-6 for r in wide)
