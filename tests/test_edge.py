"""Hand-made tables with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from slideloom.functions import arrays as A
from slideloom.operators import cells as C, coreset as K, counts as N, grid as G, predict as P, samples as S, slides as L, spots as O, tiles as T
from slideloom.plans.pipelines import soft_examples, tissue_mask


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_radius_boundary_is_inclusive(spark):
    cells = spark.createDataFrame([("s", 1, 0.0, 0.0), ("s", 2, -7.5, -7.5), ("empty", 3, 0.0, 0.0)], "sample string, cell_id long, x double, y double")
    bins = spark.createDataFrame([("s", 10, 3.0, 4.0), ("s", 11, 3.0, 4.001), ("s", 12, -10.0, -5.0)], "sample string, bin_id long, x double, y double")
    assert rows(C.radius_join(cells, bins, 5.0), "cell_id", "bin_id", "dist2") == [(1, 10, 25.0), (2, 12, 12.5)]
    assert C.radius_join(cells.limit(0), bins, 5.0).count() == 0


def test_nearest_single_and_duplicates(spark):
    d = spark.createDataFrame([("a", 1, 2, 2), ("a", 2, 2, 2), ("a", 3, 2, 5), ("b", 4, 0, 0)], "sample string, id long, x long, y long")
    assert {r.id: r.nn_dist for r in C.nearest_neighbour(d).collect()} == {1: 0.0, 2: 0.0, 3: 3.0, 4: None}


def test_disk_border_spot_dropped_sample_kept(spark):
    tokens = spark.createDataFrame([("s", r, c, [float(r * 3 + c)]) for r in range(3) for c in range(3)], "sample string, row long, col long, feat array<double>")
    spots = spark.createDataFrame([("s", 1, 1, 1), ("s", 2, 0, 0)], "sample string, spot long, row long, col long")
    d = G.disk_tokens(spots, tokens, 1)
    got = d.collect()
    assert [r.spot for r in got] == [1] and [t[0] for t in got[0].tokens] == [1, 3, 4, 5, 7]
    assert rows(G.disk_report(spots, d), "n_spots", "n_dropped") == [(2, 1)]


@pytest.mark.parametrize("k", [1, 3, 4, 5])
def test_pad_or_sample(spark, k):
    p = spark.range(k).select(F.lit("s").alias("sample"), F.lit(1).alias("cell_id"), (F.col("id") * 10).alias("bin_id"))
    got = [r.bin_id for r in C.pad_or_sample_tokens(p, 4).orderBy("pos").collect()]
    if k < 4:
        assert got == [(i % k) * 10 for i in range(4)]
    else:
        assert len(set(got)) == 4 and set(got) <= {i * 10 for i in range(k)}


def test_coreset_equal_labels_and_unknown_domain(spark):
    d = spark.range(40).select(F.col("id").alias("spot"), F.when(F.col("id") < 8, -1).otherwise(0).alias("domain_id"), F.array(F.lit(0.5), F.lit(0.5)).alias("y"))
    assert rows(K.coreset_budget(d), "domain_id", "budget") == [(0, 8)]
    got = K.coreset_stratified(d).collect()
    assert len(got) == 8 and all(r.domain_id == 0 for r in got)


def test_more_strata_than_budget(spark):
    d = spark.range(12).select(F.col("id").alias("spot"), F.lit(0).alias("domain_id"), A.one_hot(F.col("id").cast("int"), 12).alias("y"))
    got = K.coreset_stratified(d, 0.1, bins=1).collect()
    assert len(got) == 12  # every stratum keeps one row


def test_allocation_sums_to_budget(spark):
    sizes = [50, 30, 11, 5, 2, 1, 1]
    s = spark.createDataFrame([(0, i, 0, n, sum(sizes), b) for b in (9,) for i, n in enumerate(sizes)], "domain_id int, cls int, ebin int, n_s long, n_domain long, budget long")
    got = [r.alloc for r in K.stratum_allocation(s).orderBy("cls").collect()]
    assert sum(got) == 9 and min(got) == 1


def test_stratified_cells_edges(spark):
    d = spark.createDataFrame([("few", i, "a") for i in range(3)] + [("odd", i, "a") for i in range(9)] + [("odd", 9, "lonely")], "sample string, cell_id long, cell_type string")
    got = C.stratified_cells(d, 4).groupBy("sample").count()
    assert dict(rows(got, "sample", "count")) == {"few": 3, "odd": 4}


def test_finite_and_fill(spark):
    d = spark.createDataFrame([(1, [[1.0, 2.0]]), (2, [[float("nan"), 2.0]]), (3, [[float("-inf"), 2.0]]), (4, [[None, 1.0]])], "id int, tokens array<array<double>>")
    assert rows(G.finite_examples(d), "id") == [(1,)]
    v = G.nan_to_num(d.select("id", F.flatten("tokens").alias("v")), "v")
    assert [r.v[0] for r in v.orderBy("id").collect()] == [1.0, 0.0, -A.FLOAT32_MAX, 0.0]


def test_zero_range_minmax(spark):
    d = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 1.0), ("b", 3.0), ("b", None)], "sample string, v double")
    assert rows(T.minmax_normalise(d.where("sample='a'"), "v").fillna(-9), "v") == [(-9.0,), (-9.0,)]
    assert rows(T.minmax_normalise(d, "v").where("sample='b'").fillna(-9), "v") == [(-9.0,), (0.0,), (1.0,)]


def _mask(spark, cells):
    return spark.createDataFrame([("s", r, c) for r, c in cells], "sample string, row long, col long")


def test_components_sizes_and_diagonals(spark):
    diagonal = [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (2, 3), (3, 2), (3, 3), (4, 4), (4, 5)]  # 10 cells, touching diagonally
    nine = [(20, c) for c in range(9)]
    ten = [(40, c) for c in range(250, 260)]  # crosses a block border
    got = G.remove_small_components(_mask(spark, diagonal + nine + ten), 10, block=256)
    assert rows(got, "row", "col") == sorted(diagonal + ten)


def flood(cells, least):
    left, want = set(cells), set()
    while left:
        todo = [left.pop()]
        comp = set(todo)
        while todo:
            r, c = todo.pop()
            for n in [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if n in left:
                    left.discard(n)
                    comp.add(n)
                    todo.append(n)
        if len(comp) >= least:
            want |= comp
    return want


def test_components_match_flood_fill(spark):
    rng = np.random.default_rng(5)
    on = rng.random((60, 60)) < 0.3
    cells = {tuple(p) for p in np.argwhere(on).tolist()}
    got = G.remove_small_components(_mask(spark, sorted(cells)), 6, block=24)
    assert rows(got, "row", "col") == sorted(flood(cells, 6))


@pytest.mark.parametrize("least,block", [(40, 16), (40, 160), (5000, 16)])
def test_components_larger_than_blocks(spark, least, block):
    # 0.38 is close to where 8-connected groups span the grid; a snake of 6,100 cells and one of 4,900 cross many blocks
    rng = np.random.default_rng(8)
    cells = {(r - 50, c - 50) for r, c in np.argwhere(rng.random((160, 160)) < 0.38).tolist()}

    def snake(top, length):
        path, r, c, way = [], top, 0, 1
        while len(path) < length:
            path.append((r, c))
            if 0 <= c + way < 97:
                c += way
            else:
                path.append((r + 1, c))
                r, way = r + 2, -way
        return set(path[:length])

    cells |= snake(1000, 6100) | snake(2000, 4900)
    other = {(r, c) for r, c in cells if r % 3}
    both = [("s", r, c) for r, c in cells] + [("t", r, c) for r, c in other] + [("t", 1000, 5), ("t", None, 5), ("t", 5, None)]
    got = G.remove_small_components(spark.createDataFrame(both, "sample string, row int, col int"), least, block=block)
    want = [("s", *p) for p in flood(cells, least)] + [("t", *p) for p in flood(other, least)]
    assert rows(got, "sample", "row", "col") == sorted(want)
    assert G.remove_small_components(_mask(spark, [(0, 0)]).limit(0), least).count() == 0


def test_connected_against_union_find(spark):
    from slideloom.plans.scale import connected

    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(300)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1400, (260, 2))] + [(7000, 7000), (9, 9)]
    top = {n: n for e in edges for n in e}
    find = lambda n: n if top[n] == n else find(top[n])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    assert rows(connected(spark.createDataFrame(edges, "a long, b long")), "node", "root") == sorted((n, find(n)) for n in top)
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_texture_by_hand(spark):
    # two grey levels in a 4 x 4 patch: columns 0 0 1 1
    px = spark.createDataFrame([("s", y, x, *(3 * [0 if x < 2 else 255])) for y in range(4) for x in range(4)], "sample string, y long, x long, r int, g int, b int")
    t = T.glcm_texture(px, tile=4, levels=2).first()
    # pairs per row: (0,0), (0,1), (1,1) -> p = 1/3, 1/6 + 1/6, 1/3
    assert math.isclose(t.energy, math.sqrt(2 / 9 + 2 / 36))
    assert math.isclose(t.homogeneity, 2 / 3 + 1 / 6)
    assert math.isclose(t.entropy, -(2 / 3 * math.log2(1 / 3) + 1 / 3 * math.log2(1 / 6)))


def test_median_modes(spark):
    d = spark.createDataFrame([("s", 0, 0, [v], [1.0, 0.0]) for v in (1.0, 2.0, 10.0, 3.0)], "sample string, row int, col int, z array<double>, p array<double>")
    raw = d.groupBy("sample").agg(F.collect_list("z").alias("z"))
    assert raw.select(A.median_across("z").alias("m")).first().m == [2.5]
    assert raw.select(A.median_across("z", lower=True).alias("m")).first().m == [2.0]
    r = P.ensemble_combine(d).first()
    assert r.z == [1.0] and r.p == [1.0, 0.0]


@pytest.mark.parametrize("median", ["average", "lower"])
def test_scoring_combined_in_the_task(spark, median):
    rng = np.random.default_rng(8)
    states = [{"layers": [(rng.normal(size=(3, 4)), rng.normal(size=4))], "head": (rng.normal(size=(4, 2)), rng.normal(size=2))} for _ in range(4)]
    t = spark.createDataFrame([("s", i, 0, rng.normal(size=3).tolist()) for i in range(20)], "sample string, row int, col int, feat array<double>")
    a = P.score_tokens(t, states, combine=median).orderBy("row").collect()
    b = P.ensemble_combine(P.score_tokens(t, states), median).orderBy("row").collect()
    assert np.allclose([r.z for r in a], [r.z for r in b]) and np.allclose([r.p for r in a], [r.p for r in b])


def test_ties(spark):
    d = spark.createDataFrame([([0.4, 0.4, 0.2],)], "p array<double>")
    assert P.dominant_class(d).first().class_idx == 0
    m = spark.createDataFrame([(5,), (3,), (3,), (5,), (9,)], "v int")
    assert C.most_frequent(m, "v").first().v == 3
    lab = spark.createDataFrame([(7,), (7,), (4,), (-2,)], "label int")
    assert rows(C.relabel_by_size(lab), "label", "new_label") == [(-2, -2), (4, 1), (7, 0), (7, 0)]


def test_align_columns_order(spark):
    d = spark.createDataFrame([("a", 1.0, 2.0)], "spot string, extra double, b double")
    out = O.align_columns(d, ["a", "b"])
    assert out.columns == ["spot", "a", "b", "extra"] and out.first().a == 0.0


def test_groups_none_one_two(spark):
    d = spark.createDataFrame([("P1_LUAD",), ("P2",), ("LUAD_MIA",)], "sample string")
    got = {r.sample: (r.group, r.n_hits) for r in S.infer_group(d, ["LUAD", "MIA", "Normal"]).collect()}
    assert got == {"P1_LUAD": ("LUAD", 1), "P2": (None, 0), "LUAD_MIA": (None, 2)}


def test_include_beats_pattern(spark):
    d = spark.createDataFrame([("P1",), ("P2",), ("X1",), ("X1",)], "sample string")
    assert rows(S.discover_samples(d, "P*", include=["X1", "P2"], exclude=["P2"]), "sample") == [("X1",)]
    assert rows(S.discover_samples(d, ["P*", "?1"]), "sample") == [("P1",), ("P2",), ("X1",)]


def test_domain_offset_empty_base(spark):
    base = spark.createDataFrame([], "domain_id int")
    d = spark.createDataFrame([("b",), ("a",)], "sample string")
    assert rows(S.domain_offset(d, base), "sample", "domain_id") == [("a", 0), ("b", 1)]


def test_merge_features_rejects_mismatch(spark):
    a = spark.createDataFrame([("s", 1, 0.0), ("s", 2, 0.0)], "sample string, bin_id long, x double")
    b = spark.createDataFrame([("s", 1, 5.0)], "sample string, bin_id long, f double")
    with pytest.raises(Exception, match="one to one"):
        C.merge_features(a, b).collect()
    with pytest.raises(Exception, match="one to one"):
        C.merge_features(a.where("bin_id=1"), b.union(b)).collect()


def test_rounding_half_even_and_truncation(spark):
    pos = spark.createDataFrame([("s", 1, 5), ("s", 3, 7)], "sample string, x long, y long")
    sl = spark.createDataFrame([("s", 0.25, 0.5, 101.0)], "sample string, mpp_raw double, mpp_target double, spot_diameter double")
    assert rows(L.rescale_coords(pos, sl), "x", "y") == [(0, 2), (2, 4)]
    r = L.spot_radius(sl).first()
    assert (r.radius_raw, r.radius, r.grid_radius) == (50.5, 25, 1)


def test_camera_default_resolution(spark):
    h = spark.createDataFrame([(72.0, "inch"), (25400.0, "inch"), (20000.0, "cm"), (10.0, "furlong")], "dpi double, unit string")
    assert [r.mpp for r in L.dpi_to_mpp(h).collect()] == [None, 1.0, 0.5, None]
    assert math.isclose(L.dpi_to_mpp(h, reject_defaults=False).first().mpp, 25400 / 72)


def test_deconvolve_recovers_mixture(spark):
    mu = np.array([[10.0, 0.5, 1.0, 0.0], [0.2, 8.0, 0.0, 3.0]])
    prof = spark.createDataFrame([(f"t{k}", g, float(mu[k, g])) for k in range(2) for g in range(4)], "ctype string, gene int, mu double")
    y = 0.3 * 100 * mu[0] + 0.7 * 100 * mu[1]
    cnt = spark.createDataFrame([("a", g, float(y[g])) for g in range(4)], "spot string, gene int, cnt double")
    for limit in (0, 1_000):
        got = {r.ctype: r.p for r in N.deconvolve(cnt, prof, 500, spot="spot", carried_bytes=limit).collect()}
        assert math.isclose(got["t0"], 0.3, abs_tol=1e-6) and math.isclose(got["t1"], 0.7, abs_tol=1e-6)


def test_losses_without_hard_rows(spark):
    d = spark.createDataFrame([([0.5, 0.5], [1.0, 0.0], 0)], "p array<double>, y array<double>, resolution int")
    r = P.eval_losses(d, 2.0).first()
    assert (r.mse, r.nll, r.loss, r.n_hard) == (0.25, 0.0, 0.25, 0)


def test_tissue_mask_flat_slide_is_dropped(spark):
    rng = np.random.default_rng(6)
    img = np.full((64, 64, 3), 240)
    img[:32, :32] = rng.integers(60, 220, (32, 32, 3))
    px = spark.createDataFrame([("s", y, x, *map(int, img[y, x])) for y in range(64) for x in range(64)], "sample string, y long, x long, r int, g int, b int")
    sl = spark.createDataFrame([("s", 64, 64)], "sample string, height long, width long")
    got = {(r.row, r.col): r.keep for r in tissue_mask(px, sl, tile=8, bins=4, density=0.0).collect()}
    assert len(got) == 64
    assert sum(v for k, v in got.items() if k[0] < 4 and k[1] < 4) >= 12
    assert not any(v for k, v in got.items() if k[0] >= 4 or k[1] >= 4)


def test_soft_examples_path(spark):
    tokens = spark.createDataFrame([("s", r, c, [float(r), float(c)]) for r in range(9) for c in range(9)], "sample string, row long, col long, feat array<double>")
    spots = spark.createDataFrame([("s", i, 1 + i % 7, 1 + i // 7) for i in range(40)], "sample string, spot long, row long, col long")
    props = spark.createDataFrame([("s", i, "ab"[i % 2], 0.8) for i in range(40)] + [("s", i, "ba"[i % 2], 0.2) for i in range(40)], "sample string, spot long, ctype string, p double")
    vocab = spark.createDataFrame([(0, "a"), (1, "b")], "class_idx int, ctype string")
    dom = spark.createDataFrame([("s", 0)], "sample string, domain_id int")
    for strategy in ("stratified", "kcenter"):
        got = soft_examples(props, vocab, spots, tokens, dom, 1, 0.25, strategy).collect()
        assert len(got) == 10 and all(len(r.tokens) == 5 and math.isclose(sum(r.y), 1) for r in got)
