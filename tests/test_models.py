"""Models against numpy, for the queries that SQL cannot repeat."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from slideloom.operators import ml as M


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6)) + rng.normal(size=6) * 5
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, feat array<double>")


def test_pca_axes(cloud):
    x, df = cloud
    c = x - x.mean(0)
    axes = np.linalg.svd(c, full_matrices=False)[2][:3].T
    axes *= np.sign(axes[np.abs(axes).argmax(0), range(3)])
    got = np.array([r.pc for r in M.pca(df, 3).orderBy("id").collect()])
    assert np.allclose(got, c @ axes, atol=1e-8)


def test_regression_equals_least_squares(spark, cloud):
    x, _ = cloud
    rng = np.random.default_rng(9)
    y = x @ rng.normal(size=(6, 2)) + rng.normal(size=(400, 2))
    df = spark.createDataFrame([(i, v.tolist(), *t) for i, (v, t) in enumerate(zip(x, y.tolist()))], "id long, feat array<double>, y1 double, y2 double")
    odd = spark.createDataFrame([(900, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0], 0.0, 0.0)], df.schema)
    got = {r.id: (r.y1, r.y2) for r in M.regress_impute(df, df.unionByName(odd), ["y1", "y2"]).collect()}
    a = np.concatenate([np.ones((400, 1)), x], 1)
    want = np.clip(a @ np.linalg.lstsq(a, y, rcond=None)[0], y.min(0), y.max(0))
    assert np.allclose([got[i] for i in range(400)], want, atol=1e-6) and got[900] == (None, None)
    from pyspark.ml.regression import LinearRegression

    other = {r.id: (r.y1, r.y2) for r in M.regress_impute(df, df, ["y1", "y2"], regressor=lambda: LinearRegression(solver="normal")).collect()}
    assert np.allclose([other[i] for i in range(400)], want, atol=1e-5)


def blobs(n=80):
    rng = np.random.default_rng(10)
    centres = np.array([[0, 0, 0], [6, 0, 0], [0, 6, 0], [0, 0, 6]], float)
    return np.repeat(np.arange(4), n), np.repeat(centres, n, 0) + rng.normal(size=(4 * n, 3)) * 0.4


def same_split(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_kmeans_finds_blobs(spark):
    truth, x = blobs()
    df = spark.createDataFrame([("s", i, 0, v.tolist()) for i, v in enumerate(x)], "sample string, row long, col long, feat array<double>")
    rows = M.kmeans_sweep(df, ks=(2, 4)).collect()
    assert len(rows) == 2 * len(x)
    # the fit for 4 may stop in a local optimum: its labels are those of the nearest of its own means
    lab = np.array([r.cluster for r in sorted((r for r in rows if r.k == 4), key=lambda r: r.row)])
    means = np.stack([x[lab == c].mean(0) for c in sorted(set(lab))])
    near = ((x[:, None] - means) ** 2).sum(-1).argmin(1)
    assert (near == np.searchsorted(sorted(set(lab)), lab)).mean() > 0.98


def test_kmeans_stops_where_numpy_would(spark):
    """Every K ends at a fixed point of Lloyd's step, with an inertia like that of numpy's own loop."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((600, 5)) + 4 * rng.integers(0, 3, (600, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [float("nan")] * 5)], "id long, feat array<double>").repartition(5)
    ks = (1, 3, 7, 12)
    rows = M.kmeans_sweep(df, ks=ks, keys=("id",), iters=200).collect()
    assert len(rows) == len(ks) * len(x)
    for k in ks:
        lab = np.array([r.cluster for r in sorted((r for r in rows if r.k == k), key=lambda r: r.id)])
        means = np.stack([x[lab == c].mean(0) for c in range(k)])
        dist = ((x[:, None] - means) ** 2).sum(-1)
        assert (dist.argmin(1) == lab).all()
        best = np.inf
        for seed in range(3):
            own = np.random.default_rng(seed)
            c = x[own.choice(len(x), k, False)]
            for _ in range(100):
                at = ((x[:, None] - c) ** 2).sum(-1).argmin(1)
                c = np.stack([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(k)])
            best = min(best, ((x - c[at]) ** 2).sum())
        assert dist.min(1).sum() <= 1.15 * best
    assert M.kmeans_sweep(df.limit(0), keys=("id",)).count() == 0


def test_mixture_finds_blobs_of_each_sample(spark):
    truth, x = blobs()
    # the first feature orders the blobs, as quantile starts need
    x = x + np.array([0, 3, 9, 0])[truth][:, None] * np.array([0.5, 0, 0])
    rows = [(s, i, 0, *(v + k).tolist()) for k, s in ((0, "a"), (50, "b")) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "sample string, row long, col long, homogeneity double, energy double, entropy double")
    got = M.gmm(df, k=4).collect()
    for s in "ab":
        lab = np.array([r.cluster for r in sorted((r for r in got if r["sample"] == s), key=lambda r: r.row)])
        best = max(np.mean([p[c] for c in lab] == truth) for p in itertools.permutations(range(4)))
        assert best > 0.7
    one, two = ([r.cluster for r in sorted((r for r in got if r["sample"] == s), key=lambda r: r.row)] for s in "ab")
    assert same_split(one, two)


def test_soft_labels_learn_the_classes(spark):
    truth, x = blobs(40)
    df = spark.createDataFrame([(i, v.tolist(), np.eye(4)[t].tolist(), 1) for i, (v, t) in enumerate(zip(x, truth))], "id long, feat array<double>, y array<double>, resolution int")
    rows = M.fit_soft_labels(df, replicas=3).collect()
    for rep in range(3):
        own = sorted((r for r in rows if r.replica == rep), key=lambda r: r.cls)
        score = x @ np.array([r.coef for r in own]).T + np.array([r.intercept for r in own])
        assert (score.argmax(1) == truth).mean() > 0.97


def test_batches_come_together(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 4)) + np.array([4.0, 0, 0, 0])
    b = np.arange(300) % 3
    df = spark.createDataFrame([(i, f"b{k}", (v + 3 * k * np.array([0, 1, 0, 0])).tolist()) for i, (v, k) in enumerate(zip(x, b))], "id long, sample string, pc array<double>")
    got = M.harmonise_batches(df, clusters=2, rounds=3, ridge=1e-3).orderBy("id").collect()
    z = np.array([r.pc for r in got])
    means = np.array([z[b == k].mean(0) for k in range(3)])
    assert np.abs(means - means.mean(0)).max() < 0.3  # 3 before
    assert got[0]["sample"] == "b0" and df.select(F.count("*")).first()[0] == 300
