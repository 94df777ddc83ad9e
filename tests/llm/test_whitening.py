"""FEAST against a full eigendecomposition, and the whole operator against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from civicmill.llm import queries, whitening
from tests.conftest import DATA


def spectra():
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 64, 150):
        x = rng.normal(size=(2000, d)) * 0.85 ** np.arange(d)
        yield np.cov(x.T, bias=True).reshape(d, d)
    low = rng.normal(size=(500, 3)) @ rng.normal(size=(3, 40))
    yield np.cov(low.T, bias=True)  # most eigenvalues are zero
    turn, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    yield turn @ np.diag([5.0] * 3 + [4.0] * 10 + [1.0] * 17) @ turn.T  # repeated eigenvalues across the cut


@pytest.mark.parametrize("matrix", list(spectra()), ids=lambda m: str(len(m)))
def test_components_equal_a_full_decomposition(spark, matrix):
    values, vectors = np.linalg.eigh(matrix)
    scale = np.abs(matrix).max()
    diagonal, off = whitening.tridiagonal(matrix)
    shifts = np.random.default_rng(2).uniform(-0.1, 1.1, 50) * values[-1]
    assert whitening.inertia(diagonal, off, shifts).tolist() == [(values > s).sum() for s in shifts]
    most = min(8, len(matrix))
    got, axes = whitening.leading_components(spark, matrix, most)
    assert np.allclose(got, values[::-1][:most], rtol=0, atol=1e-12 * scale)
    assert np.allclose(matrix @ axes.T, axes.T * got, atol=1e-12 * scale)
    assert np.allclose(axes @ axes.T, np.eye(most), atol=1e-10)


def test_a_contour_that_misses_one_is_refused():
    matrix = np.diag([4.0, 3.0, 2.0, 1.0])
    with pytest.raises(RuntimeError, match="1 of 2"):
        whitening.feast(matrix, 2.5, 3.5, 2)


def brute(rows, k):
    x = np.array([[int(np.floor(1024 * float(c))) + 100000 for c in v] for _, v in rows])
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    return deviation, centred @ vectors / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def test_query_equals_numpy_on_the_given_vectors(spark):
    rows = [tuple(r) for r in queries.table(spark, DATA, "embeddings").select("vec_id", "embedding").collect()]
    deviation, white, explained = brute(rows, 8)
    out = queries.op11_whitening(spark, DATA).toPandas()
    assert len(out) == 8 * len(rows) and out["n"].eq(len(rows)).all() and out["identity_error"].nunique() == 1 and out["identity_error"][0] < 1e-9
    by_id = {i: at for at, (i, _) in enumerate(rows)}
    at, component = out["vec_id"].map(by_id).to_numpy(), out["component"].to_numpy() - 1
    assert out["deviation"].tolist() == [deviation[i] for i in at]
    assert np.allclose(out["explained"], explained[component], rtol=1e-9)
    signs = np.array([np.sign(out["whitened"][component == c] @ white[at[component == c], c]) for c in range(8)])
    assert np.allclose(out["whitened"] * signs[component], white[at, component], atol=1e-7)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.0, -1.0]), (4, [3.5, 0.25]), (5, [-2.0, 7.0])]
    bad = [(6, None), (7, []), (8, [nan, 1.0]), (9, [1.0, -inf]), (10, [None, 1.0]), (11, [1.0]), (12, [1e9, 0.0])]
    schema = "vec_id bigint, embedding array<double>, n string, w int, row_id date"
    df = spark.createDataFrame([(*r, "x", 1, None) for r in good + bad], schema)
    out = whitening.whiten(df, 8).toPandas()
    deviation, white, _ = brute(good, 2)
    assert len(out) == 10 and out["n"].eq(5).all() and sorted(set(out["component"])) == [1, 2]
    assert sorted(map(int, out["deviation"])) == sorted(deviation * 2)
    assert out["identity_error"].max() < 1e-9 and out["row_id"].isna().sum() == 2
    assert np.allclose(sorted(out["whitened"].abs()), sorted(np.abs(white).ravel()))
    assert whitening.whiten(df.filter("false"), 8).collect() == []
    same = whitening.whiten(df.filter("vec_id = 1"), 8).collect()  # copies of one vector: no variance
    assert len(same) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in same)
    line = whitening.whiten(df.filter("vec_id = 1 OR vec_id = 4"), 8).collect()  # one direction varies
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True)} and line[0]["identity_error"] < 1e-9


def test_large_counts_keep_exact_deviations(spark):
    """With many rows the squares pass a long inside; the decimal stays exact."""
    df = spark.range(200_000).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 9000).cast("double"), F.lit(1.0)).alias("embedding"))
    out = whitening.whiten(df, 1).filter("row_id = 8999").first()
    x = [1024 * (i % 9000) + 100000 for i in range(200_000)]
    assert int(out["deviation"]) == (200_000 * x[8999] - sum(x)) ** 2 > 2**63
