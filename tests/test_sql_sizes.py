"""Queries against their SQL on tables so large that rules for small data show."""

import glob

import duckdb
import numpy as np

from bindings import QUERIES, SQL, fixtures


def differences(spark, name, folder, tmp_path):
    """Rows that only one side has."""
    out = str(tmp_path / "out")
    df = QUERIES[name](spark, folder)
    df.write.parquet(out)
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{path}'")
    cols = ", ".join(f'"{c}"' for c in df.columns)
    con.execute(f"CREATE TABLE want AS SELECT {cols} FROM ({SQL[name]})")
    got = f"SELECT {cols} FROM '{out}/*.parquet'"
    assert con.execute("SELECT count(*) FROM want").fetchall()[0][0] > 0
    return con.execute(f"({got} EXCEPT ALL FROM want) UNION ALL (FROM want EXCEPT ALL {got})").fetchall()


def test_density_with_a_sigma_above_one(spark, tmp_path):
    # 2,500 tiles: over 100 bins
    folder = tmp_path / "in"
    folder.mkdir()
    rng = np.random.default_rng(4)
    v = rng.normal(0, 0.3, (10_000, 1)) + rng.normal(0, 0.1, (10_000, 64))
    con = duckdb.connect()
    con.register("t", {"v": v.ravel(), "vec_id": np.repeat(np.arange(len(v)), 64), "dim": np.tile(np.arange(64), len(v))})
    con.execute(f"COPY (SELECT vec_id::BIGINT AS vec_id, list(v::FLOAT ORDER BY dim) AS embedding, 0 AS label FROM t GROUP BY 1) TO '{folder}/embeddings.parquet'")
    assert differences(spark, "density_flag_default", str(folder), tmp_path) == []


def test_shares_add_the_sums_they_divide(spark):
    # the numerator and the total from two aggregations need not agree in the last bit; floor(p * 2**level) then moves a cell
    plan = fixtures.props(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("o_totalprice") and plan.count("Aggregate [o_custkey") == 1
