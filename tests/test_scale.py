"""Skew and size: the plans that must hold when one key dominates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slideloom.operators import cells as C, coreset as K, ml as M
from slideloom.plans.quadtree import plant
from slideloom.plans.scale import attach, exact_quantiles, flag_smallest, global_index, hash32, rank_within, salted_pair, spread_cells, take_smallest


def test_hot_bucket_pairs(spark):
    left = spark.range(300).select(F.lit("s").alias("k"), F.col("id").alias("l")).unionByName(
        spark.range(5).select(F.lit("t").alias("k"), (F.col("id") + 1000).alias("l")))
    right = spark.range(70).select(F.lit("s").alias("k"), F.col("id").alias("r")).unionByName(
        spark.range(3).select(F.lit("t").alias("k"), (F.col("id") + 1000).alias("r")))
    out = salted_pair(left, right, ["k"], "l", "r", hot_rows=50, broadcast_rows=0)
    assert out.count() == out.distinct().count() == 300 * 70 + 5 * 3


def test_radius_join_dense_bucket_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    b = np.vstack([rng.uniform(0, 2, (400, 2)), rng.uniform(-50, 50, (100, 2))])
    c = np.vstack([rng.uniform(-1, 3, (60, 2)), rng.uniform(-50, 50, (40, 2))])
    bins = spark.createDataFrame([("s", i, float(x), float(y)) for i, (x, y) in enumerate(b)], "sample string, bin_id long, x double, y double")
    cells = spark.createDataFrame([("s", i, float(x), float(y)) for i, (x, y) in enumerate(c)], "sample string, cell_id long, x double, y double")
    want = {(i, j) for i in range(len(c)) for j in range(len(b)) if ((c[i] - b[j]) ** 2).sum() <= 9}
    for hot, small in ((20, 0), (10 ** 6, 0), (20, 10 ** 6)):
        got = C.radius_join(cells, bins, 3.0, hot_rows=hot, broadcast_rows=small).collect()
        assert len(got) == len(want) and {(r.cell_id, r.bin_id) for r in got} == want


def test_nearest_neighbour_uneven_density(spark):
    rng = np.random.default_rng(1)
    p = np.vstack([rng.uniform(0, 1, (500, 2)), rng.uniform(-1000, 1000, (40, 2)), [[5, 5], [5, 5]]])
    df = spark.createDataFrame([("s", i, float(x), float(y)) for i, (x, y) in enumerate(p)] + [("alone", 9999, 0.0, 0.0)], "sample string, id long, x double, y double")
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    got = {r.id: r.nn_dist for r in C.nearest_neighbour(df, occupancy=8).collect()}
    assert got.pop(9999) is None
    assert len(got) == len(p) and np.allclose([got[i] for i in range(len(p))], d.min(1))


def test_nearest_neighbour_dense_cluster_and_far_points(spark):
    """Clusters in clusters, far lone points, a line and a grid of ties: as brute force, and no leaf above its bound."""
    rng = np.random.default_rng(5)
    sets = {
        "far": np.vstack([rng.normal(0, 1e-3, (700, 2)), rng.uniform(-1e3, 1e3, (30, 2)), [[9e3, 9e3]]]),
        "nested": np.vstack([rng.normal(0, 10.0 ** -k, (60, 2)) for k in range(4)]),
        "line": np.column_stack([np.arange(300.0), np.zeros(300)]),
        "grid": np.array([(i % 20, i // 20) for i in range(400)], float),
        "two": np.array([[1.0, 1.0], [4.0, 5.0]]),
    }
    rows = [(s, i, float(x), float(y)) for s, p in sets.items() for i, (x, y) in enumerate(p)]
    schema = "sample string, id long, x double, y double"
    odd = [("two", 90, None, 1.0), ("two", 91, float("nan"), 1.0), ("two", 92, 1.0, float("inf")), (None, 93, 1.0, 1.0)]
    got = {(r.sample, r.id): r.nn_dist for r in C.nearest_neighbour(spark.createDataFrame(rows + odd, schema), occupancy=16).collect()}
    assert len(got) == len(rows)
    for s, p in sets.items():
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
        np.fill_diagonal(d, np.inf)
        assert np.allclose([got[s, i] for i in range(len(p))], d.min(1), rtol=1e-12), s
    planted = plant(spark.createDataFrame(rows, schema).select("sample", F.col("x").alias("_x"), F.col("y").alias("_y")), "sample", 16)
    assert planted.count() == len(rows)
    assert planted.groupBy("sample", "_leaf").count().agg(F.max("count")).first()[0] <= 16
    assert C.nearest_neighbour(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("n_want,small", [(0, 0), (1, 0), (777, 0), (5000, 0), (9000, 0), (777, 10 ** 6), (0, 10 ** 6)])
def test_flag_smallest_is_exact(spark, n_want, small):
    d = spark.range(5000).select(F.lit("hot").alias("g"), F.col("id"), hash32("id", 3).alias("h")).unionByName(
        spark.range(10).select(F.lit("cold").alias("g"), F.col("id"), hash32("id", 4).alias("h")))
    budget = spark.createDataFrame([("hot", n_want), ("cold", 4)], "g string, n long")
    rows = flag_smallest(d, ["g"], "h", ["id"], budget, small_rows=small).collect()
    assert len(rows) == 5010
    hot = sorted((r.h, r.id) for r in rows if r.g == "hot")
    assert {r.id for r in rows if r.g == "hot" and r.chosen} == {i for _, i in hot[:n_want]}
    assert sum(r.chosen for r in rows if r.g == "cold") == 4


def test_take_smallest_equal_hashes(spark):
    d = spark.range(100).select("id", F.lit(7).cast("long").alias("h"))
    budget = spark.createDataFrame([(30,)], "n long")
    assert sorted(r.id for r in take_smallest(d, [], "h", ["id"], budget).collect()) == list(range(30))
    two_level = flag_smallest(d, [], "h", ["id"], budget, small_rows=0).where("chosen")
    assert sorted(r.id for r in two_level.collect()) == list(range(30))


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles_match_numpy(spark, accuracy):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25), rng.exponential(50, 1000)])
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("b", 1.0), ("b", 4.0)], "g string, v double")
    probs = [0.0, 0.05, 1 / 3, 0.5, 0.9, 1.0]
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", probs, accuracy=accuracy).collect()}
    assert np.allclose([got["a"][f"q{i}"] for i in range(len(probs))], np.quantile(v, probs))
    assert np.allclose([got["b"][f"q{i}"] for i in range(len(probs))], np.quantile([1.0, 4.0], probs))


def test_global_index_is_dense(spark):
    d = global_index(spark.range(1000).select((F.col("id") * 37 % 1000).alias("v")).repartition(7), ["v"])
    assert sorted((r.v, r.pos) for r in d.collect()) == [(i, i) for i in range(1000)]


@pytest.mark.parametrize("hot", [50, 10 ** 6])
def test_rank_within_hot_key(spark, hot):
    d = spark.range(500).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), (F.col("id") * 7 % 500).alias("v"))
    want = {}
    for k, v in sorted((r.k, r.v) for r in d.collect()):
        want.setdefault(k, []).append(v)
    got = {(r.k, r.v): r.pos for r in rank_within(d, ["k"], ["v"], hot_rows=hot).collect()}
    assert got == {(k, v): i for k, vs in want.items() for i, v in enumerate(vs)}


def test_limited_ranks_shrink_before_the_shuffle(spark):
    p = spark.range(1000).select(F.lit("s").alias("sample"), (F.col("id") % 3).alias("cell_id"), F.col("id").alias("bin_id"), F.col("id").alias("dist2"))
    for d in (C.pad_or_sample_tokens(p, 4), C.k_nearest(p, 4)):
        assert "WindowGroupLimit" in d._jdf.queryExecution().executedPlan().toString()


def test_attach_broadcasts_only_small_tables(spark):
    big, small = spark.range(1000).withColumnRenamed("id", "k"), spark.range(10).withColumnRenamed("id", "k")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString() and d._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(attach(big, small, "k"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
        assert "SortMergeJoin" in plan(attach(big, small, "k"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_knn_many_blocks_equals_brute_force(spark, weights):
    rng = np.random.default_rng(3)
    t = np.vstack([rng.normal(size=(200, 3)), rng.normal(size=(200, 3)) + 8])
    q = np.vstack([rng.normal(size=(60, 3)), rng.normal(size=(60, 3)) + 8, [[np.nan, 0, 0]]])
    y = rng.normal(size=400)
    train = spark.createDataFrame([(i, v.tolist(), float(y[i])) for i, v in enumerate(t)], "train_id long, feat array<double>, y double")
    query = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, feat array<double>")
    got = {r.query_id: r for r in M.knn_impute(train, query, ["y"], 4, weights, block_rows=25, query_rows=16).collect()}
    assert got.pop(120).mean is None and len(got) == 120
    d = np.sqrt(((q[:120, None] - t[None]) ** 2).sum(-1))
    for i in range(120):
        near = np.lexsort((np.arange(400), d[i]))[:4]
        w = np.ones(4) if weights == "uniform" else 1 / (d[i][near] + 1e-12)
        w /= w.sum()
        m = (w * y[near]).sum()
        assert np.isclose(got[i].mean, m) and np.isclose(got[i].variance, (w * (y[near] - m) ** 2).sum())


def test_kcenter_net_covers(spark):
    rng = np.random.default_rng(4)
    y = rng.dirichlet([0.3] * 4, 2000)
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(y)], "spot long, domain_id int, y array<double>")
    keep = [r.spot for r in K.coreset_kcenter(df, 0.05).collect()]
    reach = lambda k: np.sqrt(((y[:, None] - y[k][None]) ** 2).sum(-1)).min(1).max()
    far = [0]
    near = ((y - y[0]) ** 2).sum(1)
    while len(far) < 100:
        far.append(int(near.argmax()))
        near = np.minimum(near, ((y - y[far[-1]]) ** 2).sum(1))
    level = max(lv for lv in range(13) if len({tuple(c) for c in np.floor(y * 2 ** lv).astype(int).tolist()}) <= 100)
    assert len(set(keep)) == 100 and reach(keep) <= 2 * 2.0 ** -level
    assert reach(keep) <= 4 * reach(far)


def test_weighted_resample_balances_domains(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") < 1800, 0).otherwise(1).alias("domain_id"))
    n = {r.domain_id: r["count"] for r in K.weighted_resample(df, 4000, seed=1).groupBy("domain_id").count().collect()}
    assert sum(n.values()) == 4000 and abs(n[0] - 2000) < 200


def test_resample_single_domain_is_uniform(spark):
    df = spark.range(50).select("id", F.lit(0).alias("domain_id"))
    assert K.weighted_resample(df, 500).count() == 500


def test_cells_of_one_row_are_made_by_many_tasks(spark):
    df = spark.createDataFrame([("a", 1000), ("b", 0), ("c", 7), ("d", None), ("e", 50)], "name string, n long")
    out = spread_cells(df, "n", piece=50)
    assert out.columns == ["name", "n", "cell"]
    got = out.groupBy("name").agg(F.count(F.lit(1)).alias("c"), F.min("cell").alias("lo"), F.max("cell").alias("hi"), F.countDistinct("cell").alias("d")).collect()
    assert {(r.name, r.c, r.lo, r.hi, r.d) for r in got} == {("a", 1000, 0, 999, 1000), ("c", 7, 0, 6, 7), ("e", 50, 0, 49, 50)}
    per_task = [r.c for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("c")).collect()]
    assert len(per_task) > 8 and max(per_task) < 400
    assert spread_cells(df.limit(0), "n").count() == 0


def test_constant_crop_is_padding_and_cut(spark):
    """Against numpy, for extents that overlap the raster on any side or miss it."""
    from slideloom.operators.slides import crop_pixels

    raster = np.arange(20).reshape(4, 5)
    pixels = spark.createDataFrame([("s", y, x, int(raster[y, x])) for y in range(4) for x in range(5)], "sample string, y long, x long, v int")
    slides = spark.createDataFrame([("s", 4, 5)], "sample string, height long, width long")
    big = np.full((44, 45), 9)
    big[20:24, 20:25] = raster
    for top, bottom, left, right in [(-3, 8, -2, 9), (1, 3, 1, 4), (-5, -1, -5, 9), (6, 9, 0, 5), (2, 7, -6, -2), (0, 4, 7, 9), (-2, 2, 3, 8)]:
        out = crop_pixels(pixels, slides, (top, bottom, left, right), "constant", 9, ("v",)).collect()
        got = {(r.y, r.x): r.v for r in out}
        assert len(out) == len(got) == (bottom - top) * (right - left)
        assert all(got[y, x] == big[20 + top + y, 20 + left + x] for y, x in got)


def test_counts_are_dealt_into_bounded_tasks(spark, monkeypatch):
    from bindings import fixtures as fx
    from slideloom.plans import scale

    sf = "/root/testdata/sf0.001"
    for make, keys in ((fx.ref_counts, ["sample", "cell", "gene"]), (fx.counts, ["sample", "spot", "gene"])):
        whole = sorted(map(tuple, make(spark, sf).select(*keys, "cnt").collect()))
        with monkeypatch.context() as m:
            m.setattr(fx, "dealt", lambda df, k, rows: scale.dealt(df, k, rows, 500))
            parts = make(spark, sf)
            assert sorted(map(tuple, parts.select(*keys, "cnt").collect())) == whole
            # adaptive execution may not merge the parts: no task groups much more than its share
            sizes = [r["count"] for r in parts.groupBy(F.spark_partition_id().alias("part")).count().collect()]
            assert len(sizes) > 8 and max(sizes) <= 1000


def test_profile_of_many_rows_broadcasts_neither_labels_nor_counts(spark, monkeypatch):
    """An exploded side looks small to Spark; broadcast, every task holds it whole (F13 to F15)."""
    from bindings import fixtures as fx
    from slideloom.operators.counts import reference_profile
    from slideloom.plans import scale

    sf = "/root/testdata/sf0.001"
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    whole = sorted(fx.ref_counts(spark, sf).collect())
    with monkeypatch.context() as m:
        m.setattr(fx, "beside", lambda *a: scale.beside(*a, broadcast_rows=50))
        cut = fx.ref_counts(spark, sf)
        assert "SortMergeJoin" in plan(cut) and "BroadcastHashJoin" not in plan(cut) and sorted(cut.collect()) == whole
    a, b = fx.ref_counts(spark, sf), fx.ref_labels(spark, sf)
    for group in (None, "grp", "sample"):
        cut = reference_profile(a, b, group, broadcast_rows=50)
        assert plan(cut).count("SortMergeJoin") == 2
        assert sorted(cut.collect()) == sorted(reference_profile(a, b, group).collect()) != []
