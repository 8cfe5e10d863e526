"""Readers and writers on files made by the test."""

import gzip
import json

from pyspark.sql import functions as F

from slideloom.sources import readers as R, writers as W


def test_positions_both_layouts(spark, tmp_path):
    a, b = tmp_path / "s1", tmp_path / "s2"
    a.mkdir(), b.mkdir()
    (a / "p.csv").write_text("AAA,1,0,1,100,200\nBBB,0,2,3,5,6\n")
    (b / "p.csv").write_text("barcode,in_tissue,array_row,array_col,pxl_row_in_fullres,pxl_col_in_fullres\nAAA,1,0,1,100,200\nBBB,0,2,3,5,6\n")
    x = R.read_positions(spark, str(a / "p.csv"), False)
    y = R.read_positions(spark, str(b / "p.csv"), True)
    assert x.columns == y.columns and sorted(x.collect()) == sorted(y.collect())
    both = R.with_sample(R.read_positions(spark, str(tmp_path / "s1" / "*.csv"), False))
    assert {r.sample for r in both.collect()} == {"s1"}


def test_sparse_counts(spark, tmp_path):
    with gzip.open(tmp_path / "m.mtx.gz", "wt") as f:
        f.write("%%MatrixMarket matrix coordinate integer general\n%c\n3 2 4\n1 1 5\n2 1 7\n3 2 9\n1 2 2\n")
    with gzip.open(tmp_path / "f.tsv.gz", "wt") as f:
        f.write("E1\tG1\tGene Expression\nE2\tP1\tAntibody Capture\nE3\tG1\tGene Expression\n")
    with gzip.open(tmp_path / "b.tsv.gz", "wt") as f:
        f.write("AAA\nBBB\n")
    args = [str(tmp_path / n) for n in ("m.mtx.gz", "f.tsv.gz", "b.tsv.gz")]
    got = sorted((r.spot, r.gene, r.cnt) for r in R.read_sparse_counts(spark, *args).collect())
    assert got == [("AAA", "G1", 5.0), ("BBB", "G1", 2.0), ("BBB", "G1", 9.0)]
    (tmp_path / "f2.tsv").write_text("E1\t\tGene Expression\nE2\t\tGene Expression\nE3\t\tGene Expression\n")
    got = R.read_sparse_counts(spark, args[0], str(tmp_path / "f2.tsv"), args[2])
    assert {r.gene for r in got.collect()} == {"E1", "E2", "E3"}


def test_small_files(spark, tmp_path):
    (tmp_path / "names.txt").write_text("T cell\nB cell \nAnt\n")
    assert [tuple(r) for r in R.read_vocab(spark, str(tmp_path / "names.txt")).orderBy("class_idx").collect()] == [(0, "T cell"), (1, "B cell"), (2, "Ant")]
    (tmp_path / "map.json").write_text(json.dumps({"a": "X", "b": "X"}, indent=1))
    assert {tuple(r) for r in R.read_label_map(spark, str(tmp_path / "map.json")).collect()} == {("a", "X"), ("b", "X")}
    (tmp_path / "c.json").write_text(json.dumps({"cmap_name": "n", "type_to_color": {"a": "#ff0000"}}))
    assert [tuple(r) for r in R.read_colour_map(spark, str(tmp_path / "c.json")).collect()] == [("a", "#ff0000")]
    (tmp_path / "d.tsv").write_text("# note\n\ns1\tlung\ns2\tliver\n")
    assert {tuple(r) for r in R.read_domain_map(spark, str(tmp_path / "d.tsv")).collect()} == {("s1", "lung"), ("s2", "liver")}
    (tmp_path / "scale.json").write_text('{"spot_diameter_fullres": 90.5,\n "other": 1}')
    assert R.read_scale_factors(spark, str(tmp_path / "scale.json")).first()[0] == 90.5
    (tmp_path / "ann.csv").write_text("cell_id;cell_state;z\n1;T;q\n")
    assert tuple(R.read_annotation(spark, str(tmp_path / "ann.csv"), ";").first()) == ("1", "T")


def test_cells_scan_reads_two_columns(spark, tmp_path):
    p = str(tmp_path / "cells")
    spark.range(5).select(F.col("id").alias("cell_id"), F.lit(1.5).alias("x_centroid"), F.lit(2.5).alias("y_centroid"), F.lit("big").alias("other")).write.parquet(p)
    d = R.read_cells(spark, p)
    assert d.columns == ["cell_id", "x", "y"] and "other" not in d._jdf.queryExecution().executedPlan().toString()


def test_inventory_skips_content(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1" / "he.jpg").write_bytes(b"12345")
    d = R.read_file_inventory(spark, str(tmp_path / "*" / "*"))
    assert tuple(d.select("sample", "name", "length").first()) == ("s1", "he.jpg", 5)


def test_examples_round_trip_and_pruning(spark, tmp_path):
    p = str(tmp_path / "ex")
    d = spark.range(100).select(
        F.col("id").alias("example_id"), F.when(F.col("id") % 2 == 0, "vis").otherwise("xen").alias("tech"),
        (F.col("id") % 5).cast("int").alias("domain_id"), F.array(F.array(F.col("id").cast("float"))).alias("tokens"))
    W.write_examples(d, p)
    back = R.read_examples(spark, p, "vis", [0, 1])
    assert sorted(r.example_id for r in back.collect()) == [i for i in range(100) if i % 2 == 0 and i % 5 in (0, 1)]
    assert "PartitionFilters: [isnotnull(tech" in back._jdf.queryExecution().executedPlan().toString()


def test_delimited_output(spark, tmp_path):
    d = spark.createDataFrame([("a", [0.25, 0.75])], "spot string, p array<double>")
    W.write_table(d, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).first().p == "0.25,0.75"
    W.write_summary(d.select("spot"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().spot == "a"
