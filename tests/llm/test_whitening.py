"""Whitening against numpy's eigenvectors on whole covariances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slideloom.llm.queries import QUERIES
from slideloom.llm.whitening import fit, vectors_of, whiten


def truth(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    return n, deviation, e[:k], v[:, :k], c, e.sum()


def check(rows, ids, vectors, k=8, close=1e-7):
    n, deviation, e, v, c, trace = truth(vectors, k)
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(got) == sorted(ids)
    w = np.array([[got[i][j + 1].whitened for j in range(len(e))] for i in ids])
    want = c @ v / np.sqrt(e)
    want *= np.sign((w * want).sum(0))
    assert np.abs(w - want).max() < close
    for i, d in zip(ids, deviation):
        for j, r in got[i].items():
            assert (r.n, r.deviation) == (n, d) and abs(r.explained - e[j - 1] / trace) < 1e-9 * r.explained + 1e-12
    assert all(0 <= r.identity_error < 1e-9 for r in rows) and len({r.identity_error for r in rows}) == 1


def test_query_is_the_whole_table(spark, sf_dir):
    rows = QUERIES["op11_chebyshev_whitening"](spark, sf_dir).collect()
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    good = [r for r in table if r.embedding and all(c is not None and np.isfinite(c) for c in r.embedding)]
    check(rows, [r.vec_id for r in good], [r.embedding for r in good])


@pytest.mark.parametrize("width,rank,n", [(3, 3, 40), (8, 8, 300), (40, 40, 900), (120, 10, 400)])
def test_shapes(spark, width, rank, n):
    rng = np.random.default_rng(width)
    x = rng.standard_normal((n, rank)) @ rng.standard_normal((rank, width)) + rng.standard_normal((n, width)) * 0.05
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    out = whiten(df).select("_row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
    check(out.collect(), list(range(n)), x)


def test_passes_stay_few_and_pairs_are_certified(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 60)) * np.linspace(1.2, 1.0, 60)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    found = fit(vectors_of(df, "embedding"))
    assert found.residual < 1e-10 and found.passes < 120
    e, v = truth(x)[2:4]
    assert np.allclose(found.values, e, rtol=1e-11) and np.allclose(np.abs((found.vectors * v).sum(0)), 1, atol=1e-12)


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, component string, n long, x string, _row int"
    row = lambda i, v: (i, v, "c", None, None, 3)
    nan, inf = float("nan"), float("inf")
    good = [row(1, [0.5, 2.0]), row(1, [0.5, 2.0]), row(None, [-0.25, 1.0]), row(4, [0.0, 0.1])]
    bad = [row(5, None), row(6, [nan, 1.0]), row(7, [inf, 1.0]), row(8, [-inf, 1.0]), row(9, [None, 1.0]), row(10, [])]
    df = spark.createDataFrame(good + bad, schema)
    out = whiten(df).collect()
    assert sorted((r._row.vec_id or 0, r.component) for r in out) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (4, 1), (4, 2)]
    assert all(r.n == 4 and r._row.component == "c" and r._row._row == 3 for r in out)
    one = whiten(spark.createDataFrame(good[:2], schema)).collect()
    assert len(one) == 4 and all(r.whitened is None and r.deviation == 0 and r.explained is None and r.identity_error is None for r in one)
    flat = whiten(spark.createDataFrame([row(i, [float(i), 1.0]) for i in range(5)], schema)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and all(r.identity_error < 1e-9 for r in flat)
    assert whiten(spark.createDataFrame(bad, schema)).count() == 0 and whiten(df.limit(0)).count() == 0
    huge = whiten(spark.createDataFrame([row(1, [3e9, 0.0]), row(2, [-3e9, 0.0]), row(3, [1e30, 0.0])], schema)).collect()
    assert len(huge) == 6 and all(r.deviation is None or r.deviation > 0 for r in huge)
