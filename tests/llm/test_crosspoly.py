"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from slideloom.llm.crosspoly import CrossPolytope, hadamard, nearest
from pyspark.sql import functions as F


def test_hadamard_keeps_lengths_and_inverts():
    x = np.random.default_rng(0).normal(size=(5, 32))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(hadamard(hadamard(x)), x)


@pytest.mark.parametrize("hashes", [1, 2])
def test_first_probe_is_the_bucket_and_near_vectors_meet(hashes):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 20))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x + 0.02 * rng.normal(size=x.shape)
    y /= np.linalg.norm(y, axis=1)[:, None]
    h = CrossPolytope(20, 4, hashes)
    codes, probes = h.codes(x), h.probes(x, 6)
    assert (probes[:, ::6] == codes).all()
    assert all(len(set(p)) == len(p) for p in probes.tolist())
    assert ((h.codes(y)[:, :, None] == h.probes(x, 6).reshape(400, 4, 6)).any(2)).mean() > 0.9


def brute(rows, k, step):
    x = {i: np.array(v, float) for i, v in rows}
    out = {}
    for q in (i for i in x if i % step == 0):
        scored = sorted((-float(np.sum(x[q] * x[i])), i) for i in x if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def recall(got, want):
    hit = total = 0
    for q, best in want.items():
        own = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [o[0] for o in own] == list(range(1, len(own) + 1)) and len(own) == len(best)
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        hit += len({i for i, _ in best} & {o[1] for o in own})
        total += len(best)
    return hit / total


@pytest.mark.parametrize("block", [4096, 50])
def test_recall_with_lengths_copies_and_clusters(spark, block):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(5000, 24)) * rng.uniform(0.5, 2, (5000, 1))
    base[1000:1400] = base[1000]  # copies
    base[2000:2600] = base[2000] + 0.01 * rng.normal(size=(600, 24))  # a tight group
    rows = [(i, v.astype("f4").tolist()) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exact = {i: np.array(v, "f4").astype(float) for i, v in rows}
    got = nearest(df, F.col("vec_id") % 20 == 0, pilot=300, block=block).collect()
    assert recall(got, brute(rows, 20, 20)) >= 0.9
    for r in got[:500]:
        assert abs(r.score - float(exact[r.query_id] @ exact[r.vec_id])) < 1e-9
    copies = [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 1200]
    if np.linalg.norm(base[1000]) > np.linalg.norm(base, axis=1).mean():
        assert set(copies[:5]) <= {*range(1000, 1400)} or max(base @ base[1000]) > base[1000] @ base[1000]


def test_recall_on_the_table(spark):
    from slideloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert recall(QUERIES["op6_cross_polytope"](spark, sf).collect(), brute(rows, 20, 20)) >= 0.9
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert recall(nearest(table, F.col("vec_id") % 20 == 0, pilot=50).collect(), brute(rows, 20, 20)) >= 0.9


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (20, [0.0, 2.0, 0.0]), (1, [1.0, 1.0, 0.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 0.0]), (5, [1.0, float("nan"), 0.0]), (6, [float("inf"), 0.0, 0.0]), (7, [1.0]), (None, [1.0, 1.0, 1.0]), (1, [1.0, 1.0, 0.0]), (40, []), (8, [1.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("raw", F.lit(1)).withColumn("rank", F.lit(2))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 8, 1.0), (0, 3, 20, 0.0), (20, 1, 1, 2.0), (20, 2, 8, 2.0), (20, 3, 0, 0.0)]
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
