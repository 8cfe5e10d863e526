"""Lists of near bins against pairs: same rows, no pair shuffled, groups cut where they are large."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bindings import QUERIES
from slideloom.operators import cells as C, grid as G, near as N

SCHEMA = "sample string, {} long, x {}, y {}"


def frames(spark, kind="double"):
    """Dense and sparse places, cells and bins on one place, odd coordinates, a sample without bins."""
    rng = np.random.default_rng(2)
    b = np.vstack([rng.integers(0, 4, (300, 2)), rng.integers(-40, 40, (200, 2)), np.full((30, 2), 2)]).tolist()
    c = np.vstack([rng.integers(-2, 6, (40, 2)), rng.integers(-40, 40, (60, 2)), np.full((5, 2), 2)]).tolist()
    if kind == "double":
        b, c = ([[x + 0.25 * (i % 3), y - 0.5 * (i % 2)] for i, (x, y) in enumerate(p)] for p in (b, c))
    odd = [(None, 9001, *c[0]), ("s", 9002, None, c[0][1])] + ([("s", 9003, float("nan"), 0.0), ("s", 9004, 0.0, float("inf"))] if kind == "double" else [])
    make = lambda p, name, more: spark.createDataFrame(
        [("s" if i % 4 else "t", (i * 37) % 1009, x, y) for i, (x, y) in enumerate(p)] + odd + more, SCHEMA.format(name, kind, kind))
    return make(c, "cell_id", [("empty", 1, *c[0])]), make(b, "bin_id", [])


def rows(d, *cols):
    return sorted(tuple(r[c] for c in cols) for r in d.collect())


def pairs(near, r):
    """(sample, cell, bin, dist2) of all pairs, by comparing everything."""
    ok = lambda v: v.sample is not None and all(x is not None and abs(x) < float("inf") for x in (v.x, v.y))
    c, b = ([v for v in d.collect() if ok(v)] for d in near)
    d2 = lambda u, v: (u.x - v.x) ** 2 + (u.y - v.y) ** 2
    return sorted((u.sample, u.cell_id, v.bin_id, d2(u, v)) for u in c for v in b if u.sample == v.sample and d2(u, v) <= r * r)


def by_cell(found):
    out = {}
    for s, c, b, d in found:
        out.setdefault((s, c), []).append((b, d))
    return out


@pytest.fixture(params=["double", "long"])
def near(spark, request):
    return frames(spark, request.param)


def test_ranks_equal_those_of_pairs(near, monkeypatch):
    cols = ("sample", "cell_id", "bin_id", "pos")
    want = sorted((*k, b, i) for k, v in by_cell(pairs(near, 3.0)).items() for i, (b, _) in enumerate(v))
    assert rows(C.order_near_tokens(*near, 3.0), *cols) == want
    for name, v in (("PAIRS", 500), ("PIECE", 7), ("BATCH", 20)):
        monkeypatch.setattr(N, name, v)
    assert rows(C.order_near_tokens(*near, 3.0), *cols) == want
    assert C.order_near_tokens(near[0].limit(0), near[1], 3.0).count() == 0


def test_order_tokens_shuffles_no_pairs(spark):
    plan = QUERIES["order_tokens"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("t", [1, 4, 40])
def test_samples_equal_those_of_pairs(spark, near, t):
    # the hash of the Spark side; the choice in plain Python
    ids = spark.range(1009).select("id", C.hash32("id", 3).alias("h"))
    h = {r.id: r.h for r in ids.collect()}
    want = []
    for k, v in by_cell(pairs(near, 3.0)).items():
        found = [b for b, _ in v] if len(v) < t else sorted((b for b, _ in v), key=lambda b: (h[b], b))
        want += [(*k, p, found[p % len(found)]) for p in range(t)]
    assert rows(C.pad_or_sample_near(*near, 3.0, t, seed=3), "sample", "cell_id", "pos", "bin_id") == sorted(want)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_nearest_equal_those_of_pairs(near, k):
    want = []
    for key, v in by_cell(pairs(near, 3.0)).items():
        want += [(*key, b, d, i + 1) for i, (d, b) in enumerate(sorted((d, b) for b, d in v)[:k])]
    assert rows(C.nearest_bins(*near, 3.0, k), "sample", "cell_id", "bin_id", "dist2", "rank") == sorted(want)


@pytest.mark.parametrize("name", ["pad_or_sample_tokens", "k_nearest"])
def test_choices_make_no_pairs(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan


def test_disks_of_many_spots_in_one_block(spark):
    tokens = spark.range(100).select(F.lit("s").alias("sample"), F.floor(F.col("id") / 10).alias("row"), (F.col("id") % 10).alias("col"), F.array_repeat(F.col("id").cast("double"), 2000).alias("feat"))
    spots = spark.range(1000).select(F.lit("s").alias("sample"), F.col("id").alias("spot"), (F.col("id") % 10).alias("row"), F.lit(5).cast("long").alias("col"))
    d = G.disk_tokens(spots, tokens, 1)
    assert "FlatMapCoGroups" not in d._jdf.queryExecution().executedPlan().toString()
    got = {r.spot: r.ids for r in d.select("spot", F.transform("tokens", lambda t: t[1999].cast("int")).alias("ids")).collect()}
    at = lambda i: i % 10 * 10 + 5
    assert got == {i: [at(i) - 10, at(i) - 1, at(i), at(i) + 1, at(i) + 10] for i in range(1000) if 0 < i % 10 < 9}


def test_hard_examples_make_no_pairs(spark, monkeypatch):
    def refuse(*args, **kwargs):
        raise AssertionError("all pairs")

    monkeypatch.setattr(C, "radius_join", refuse)
    assert QUERIES["hard_examples"](spark, "/root/testdata/sf0.1").count() == 1000
