"""Results that must not depend on size, partitions or other samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slideloom.operators import cells as C, counts as N, ml as M, tiles as T
from slideloom.plans.scale import hash32


def test_arithmetic_hash_of_any_id(spark):
    ids = [0, 1, 50_307, 2**31, 2**32 - 1, 2**40 + 12345, 2**62, -7]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    got = [r.h for r in df.select(hash32("id", 3, "mul").alias("h")).collect()]
    assert got == [(i * 2654435761 + 3) % 2**32 for i in ids]


@pytest.mark.parametrize("rows,k", [(200, 5), (4097, 3)])
def test_equal_neighbours_do_not_depend_on_partitions(spark, rows, k):
    train = spark.createDataFrame([(i, [1.0, 2.0], float(i)) for i in range(rows)] + [(-1, [float("nan"), 0.0], 9.0)], "train_id long, feat array<double>, y double")
    query = spark.createDataFrame([(0, [1.0, 2.0]), (1, [9.0, 9.0]), (2, [float("nan"), 1.0])], "query_id long, feat array<double>")
    for parts in (1, 7):
        got = {r.query_id: r.mean for r in M.knn_impute(train.repartition(parts), query.repartition(parts), ["y"], k).collect()}
        assert got == {0: (k - 1) / 2, 1: (k - 1) / 2, 2: None}


def test_density_of_a_sample_ignores_the_others(spark):
    rng = np.random.default_rng(3)
    make = lambda s, n: [(s, i, 0, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(n, 2)))]
    schema = "sample string, row int, col int, z double, sd double"
    small, large = make("a", 300), make("b", 6000)
    flags = lambda rows: {r.row: (r.density, r.low_density) for r in T.density_flag(spark.createDataFrame(rows, schema), thresh=2.0, bins_per_tile=0.02).where("sample = 'a'").collect()}
    alone, beside = flags(small), flags(small + large)
    assert alone.keys() == beside.keys() and all(abs(alone[i][0] - beside[i][0]) < 1e-9 and alone[i][1] == beside[i][1] for i in alone)


def test_batch_offsets_by_elimination_solve_the_whole_system():
    rng = np.random.default_rng(0)
    o, sx, ridge = rng.random((4, 6)) * 30, rng.normal(size=(4, 6, 3)), 1.0
    o[0, 2] = 0
    sx[0, 2] = 0
    keep = o / (o + ridge)
    base = (sx * (1 - keep)[:, :, None]).sum(axis=1) / (o * ridge / (o + ridge)).sum(axis=1)[:, None]
    w = (sx - o[:, :, None] * base[:, None]) / (o + ridge)[:, :, None]
    for c in range(4):
        a = np.diag(np.concatenate([[o[c].sum()], o[c] + ridge]))
        a[0, 1:] = a[1:, 0] = o[c]
        full = np.linalg.solve(a, np.vstack([sx[c].sum(axis=0), sx[c]]))
        assert np.allclose(full[0], base[c]) and np.allclose(full[1:], w[c])


def test_samples_that_share_ids_stay_apart(spark):
    cells = spark.createDataFrame([("a", 1), ("b", 1)], "sample string, cell_id long")
    ann = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "sample string, cell_id long, cell_state string")
    m = spark.createDataFrame([("x", "X"), ("y", "Y")], "fine string, coarse string")
    assert sorted((r["sample"], r.cell_type) for r in C.annotate_cells(cells, ann, m).collect()) == [("a", "X"), ("b", "Y")]
    counts = spark.createDataFrame([("a", 1, g, 30.0) for g in range(3)] + [("b", 1, 9, 30.0)], "sample string, cell long, gene int, cnt double")
    assert {r["sample"] for r in C.qc_cells(counts, 50, 3).collect()} == {"a"}
    assert {r["sample"] for r in N.min_umi_reference(counts, 50).collect()} == {"a"}


def test_profiles_of_samples_in_deconvolution(spark):
    mu = {"a": [[9.0, 1.0], [1.0, 9.0]], "b": [[1.0, 9.0], [9.0, 1.0]]}
    prof = [(s, f"t{k}", g, mu[s][k][g]) for s in mu for k in range(2) for g in range(2)] + [("b", "only", 0, 0.0)]
    prof = spark.createDataFrame(prof, "sample string, ctype string, gene int, mu double")
    cnt = spark.createDataFrame([(s, 5, g, 100.0 * (0.8 * mu[s][0][g] + 0.2 * mu[s][1][g])) for s in mu for g in range(2)], "sample string, spot long, gene int, cnt double")
    got = {(r["sample"], r.ctype): r.p for r in N.deconvolve(cnt, prof, 2000, per="sample").collect()}
    for s in mu:
        assert abs(got[s, "t0"] - 0.8) < 1e-4 and abs(got[s, "t1"] - 0.2) < 1e-4 and got[s, "only"] == 0
