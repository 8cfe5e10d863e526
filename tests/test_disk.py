"""Tables written on the way grow with the input, not with the pairs that are compared."""

import os

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

from slideloom.operators import cells as C, ml as M, near as N
from slideloom.plans.scale import work_folder


def written(spark, run):
    """Result of ``run`` and the rows of each table that it wrote on the way."""
    there = lambda: set(os.listdir(work_folder(spark))) if os.path.isdir(work_folder(spark)) else set()
    before = there()
    rows = run().collect()
    return rows, [spark.read.parquet(f"{work_folder(spark)}/{t}").count() for t in there() - before]


def knn(spark, weights):
    """No bound rules a group out: every query visits all of them."""
    rng = np.random.default_rng(5)
    t, q, y = rng.normal(size=(1200, 16)), rng.normal(size=(300, 16)), rng.normal(size=1200)
    train = spark.createDataFrame([(i, v.tolist(), float(y[i])) for i, v in enumerate(t)], "train_id long, feat array<double>, y double")
    query = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, feat array<double>")
    rows, tables = written(spark, lambda: M.knn_impute(train, query, ["y"], 3, weights, block_rows=40, query_rows=50))
    d = np.sqrt(((q[:, None] - t[None]) ** 2).sum(-1))
    for r in rows:
        near = np.lexsort((np.arange(1200), d[r.query_id]))[:3]
        w = np.ones(3) if weights == "uniform" else 1 / (d[r.query_id][near] + 1e-12)
        mean = (w * y[near]).sum() / w.sum()
        assert np.isclose(r.mean, mean) and np.isclose(r.variance, (w * (y[near] - mean) ** 2).sum() / w.sum())
    assert len(rows) == 300
    return tables


def test_knn_writes_no_query_for_each_group(spark):
    assert max(knn(spark, "uniform")) <= 3 * 300


def test_knn_by_distance_writes_no_query_for_each_group(spark):
    assert max(knn(spark, "distance")) <= 3 * 300


def test_order_tokens_shuffles_few_copies_of_a_bin(spark, monkeypatch):
    """Bins all over a plane of 60 x 60 buckets: wide tiles share most of their border."""
    place = lambda n, name, step: spark.range(n).select(
        F.lit("s").alias("sample"), F.col("id").alias(name), (F.col("id") * step % 600).alias("x"), (F.col("id") * 7 % 599).alias("y"))
    cells, bins = place(5_000, "cell_id", 13), place(20_000, "bin_id", 31)
    sent, run = [], PandasGroupedOpsMixin.applyInArrow
    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInArrow", lambda self, *a: sent.append(self._df.count()) or run(self, *a))
    got = C.order_near_tokens(cells, bins, 10)
    assert len(sent) == 1 and sent[0] <= 3 * 25_000
    c, b = ([tuple(r) for r in d.select(name, "x", "y").collect()] for d, name in ((cells, "cell_id"), (bins, "bin_id")))
    bi, bx, by = np.array(sorted(b)).T
    want = [(i, int(j), p) for i, x, y in c for p, j in enumerate(bi[(bx - x) ** 2 + (by - y) ** 2 <= 100])]
    assert sorted((r.cell_id, r.bin_id, r.pos) for r in got.collect()) == sorted(want)


def test_near_lists_are_the_same_for_all_tiles(spark, monkeypatch):
    place = lambda n, name: spark.range(n).select(
        F.lit("s").alias("sample"), F.col("id").alias(name), (F.col("id") * 31 % 97 - 40.5).alias("x"), (F.col("id") * 7 % 89 - 50.25).alias("y"))
    cells, bins = place(150, "cell_id"), place(900, "bin_id")
    for make in (lambda: C.order_near_tokens(cells, bins, 6.5), lambda: C.nearest_bins(cells, bins, 6.5, 4), lambda: C.pad_or_sample_near(cells, bins, 6.5, 5, seed=2)):
        found = []
        for sides, most in (((1,), 500_000), ((1, 3), 500_000), ((1, 8), 500_000), ((1, 8), 10)):
            monkeypatch.setattr(N, "SIDES", sides)
            monkeypatch.setattr(N, "BINS", most)
            found.append(sorted(map(tuple, make().collect())))
        assert found[0] and all(f == found[0] for f in found)
