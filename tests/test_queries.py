"""Every registered query against its SQL, or against invariants where there is none."""

import math
from collections import Counter

import pytest
from check import compare, oracle

from bindings import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, con, name):
    msg = compare(QUERIES[name](spark, sf_dir), con, SQL[name])
    assert msg == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_anchor_pairs(spark):
    d = QUERIES["radius_join"](spark, "/root/testdata/sf0.01")
    assert d.count() == 7018
    assert d.select("cell_id").distinct().count() == 1497


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert sum(r.n_pairs for r in rows) == 71 and sum(r.cells_with_bins for r in rows) == 44
    assert set(e.oracle_sql()) <= set(e.queries())


def test_kcenter_budget(spark, sf_dir):
    want = {r.domain_id: min(r.budget, r.n_domain) for r in QUERIES["coreset_budget"](spark, sf_dir).collect()}
    for name in ("coreset_kcenter",):
        got = QUERIES[name](spark, sf_dir).collect()
        assert Counter(r.domain_id for r in got) == Counter(want)
        assert len({r.spot for r in got}) == len(got)


def test_pca_components_uncorrelated(spark, sf_dir):
    import numpy as np

    x = np.array([r.pc for r in QUERIES["pca"](spark, sf_dir).collect()])
    c = np.cov(x.T)
    assert np.allclose(c, np.diag(np.diag(c)), atol=1e-8)
    assert (np.diff(np.diag(c)) <= 1e-9).all()


def test_harmonise_brings_batches_together(spark, sf_dir):
    import numpy as np

    from bindings.models import _batched

    def gap(rows):
        by = {}
        for r in rows:
            by.setdefault(r["sample"], []).append(r["pc"])
        m = np.array([np.mean(v, 0) for _, v in sorted(by.items())])
        return np.linalg.norm(m - m.mean(0), axis=1).sum()

    before = _batched(spark, sf_dir).selectExpr("cast(sample as string) sample", "pc").collect()
    after = QUERIES["harmonise_batches"](spark, sf_dir).collect()
    assert len(after) == len(before)
    assert gap(after) < 0.5 * gap(before)


def test_mixture_labels(spark, sf_dir):
    rows = QUERIES["gmm"](spark, sf_dir).collect()
    assert {r.cluster for r in rows} <= set(range(4))
    assert len(rows) == len({(r.row, r.col) for r in rows})


def test_soft_label_model_scores(spark, sf_dir):
    from bindings.models import _examples
    from slideloom.operators.ml import soft_label_states
    from slideloom.operators.predict import score_tokens

    rows = QUERIES["fit_soft_labels"](spark, sf_dir).collect()
    st = soft_label_states(rows)
    assert len(st) == 2
    out = score_tokens(_examples(spark, sf_dir), st, keys=("id",)).collect()
    assert all(math.isclose(sum(r.p), 1, abs_tol=1e-9) for r in out)


def test_regress_within_range(spark, sf_dir):
    rows = QUERIES["regress_impute"](spark, sf_dir).collect()
    assert all(-1e-9 <= r.y2 <= 16 + 1e-9 for r in rows)
