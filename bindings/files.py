"""Sources and sinks: tables written to files in the shared folder and read back."""

import uuid

from pyspark.sql import functions as F

from slideloom.plans.scale import work_folder
from slideloom.sources import readers as R, writers as W

from . import fixtures as fx
from .fixtures import r6, table
from .registry import query


def _path(spark, name):
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("read_positions", "SELECT l_orderkey::VARCHAR AS barcode, (l_quantity>25)::INT AS in_tissue, l_linenumber AS array_row, l_partkey::INT AS array_col, (l_partkey*31)::INT AS pxl_row, (l_partkey*17)::INT AS pxl_col FROM lineitem")
def _(spark, sf):
    i = lambda c: c.cast("int")
    p = _path(spark, "positions")
    table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("barcode"), i(F.col("l_quantity") > 25).alias("in_tissue"), "l_linenumber",
        "l_partkey", i(F.col("l_partkey") * 31).alias("r"), i(F.col("l_partkey") * 17).alias("c"),
    ).write.csv(p)
    return R.read_positions(spark, p, has_header=False)


@query("read_positions_headed", "SELECT l_orderkey::VARCHAR AS barcode, (l_quantity>25)::INT AS in_tissue, (l_partkey*31)::INT AS pxl_row, (l_partkey*17)::INT AS pxl_col FROM lineitem")
def _(spark, sf):
    i = lambda c: c.cast("int")
    p = _path(spark, "positions")
    table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("barcode"), i(F.col("l_quantity") > 25).alias("in_tissue"),
        F.col("l_linenumber").alias("array_row"), F.col("l_partkey").alias("array_col"),
        i(F.col("l_partkey") * 31).alias("pxl_row_in_fullres"), i(F.col("l_partkey") * 17).alias("pxl_col_in_fullres"),
    ).write.csv(p, header=True)
    return R.read_positions(spark, p, has_header=True).select("barcode", "in_tissue", "pxl_row", "pxl_col")


@query("read_cells", "SELECT cell_id, x::DOUBLE AS x, y::DOUBLE AS y FROM cells", ["cells"])
def _(spark, sf):
    p = _path(spark, "cells")
    fx.cells(spark, sf).select(
        "cell_id", F.col("x").cast("double").alias("x_centroid"), F.col("y").cast("double").alias("y_centroid"), "cell_state"
    ).write.parquet(p)
    return R.read_cells(spark, p)


@query("read_annotation", "SELECT cell_id::VARCHAR AS cell_id, cell_state FROM cells", ["cells"])
def _(spark, sf):
    p = _path(spark, "annotation")
    fx.cells(spark, sf).select("cell_id", "cell_state", "x").write.csv(p, sep=";", header=True)
    return R.read_annotation(spark, p, ";")


@query("read_domain_map", "SELECT c_name AS sample, c_mktsegment AS domain FROM customer")
def _(spark, sf):
    p = _path(spark, "domains")
    c = table(spark, sf, "customer")
    c.select("c_name", "c_mktsegment").write.csv(p, sep="\t")
    return R.read_domain_map(spark, p)


@query("read_sparse_counts", "SELECT 's'||(l_linenumber%3) AS sample, l_suppkey::VARCHAR AS spot, 'g'||(l_partkey%64) AS gene, sum(l_quantity) AS cnt FROM lineitem WHERE l_partkey%64 <> 5 GROUP BY ALL")
def _(spark, sf):
    from slideloom.operators.counts import collapse_duplicates
    from slideloom.plans.scale import rank_within

    # three samples with the same barcodes; gene 5 is of another type; triplets keep duplicates, as files may
    c = table(spark, sf, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_linenumber") % 3).alias("sample"), F.col("l_suppkey").cast("string").alias("spot"),
        (F.col("l_partkey") % 64).alias("gene"), F.col("l_quantity").alias("cnt"),
    )
    spots = rank_within(c.select("sample", "spot").distinct(), ["sample"], ["spot"], "i")
    p = {n: _path(spark, n) for n in ("mtx", "features", "barcodes")}
    # several files a sample, whose names follow the order
    put = lambda d, order, name: d.repartitionByRange(4, "sample", order).sortWithinPartitions("sample", order).select("sample", "value").write.partitionBy("sample").text(p[name])
    put(spots.withColumn("value", F.col("spot")), "i", "barcodes")
    g = F.col("id").cast("string")
    line = F.concat_ws("\t", F.concat(F.lit("E"), g), F.concat(F.lit("g"), g), F.when(F.col("id") == 5, "Other").otherwise("Gene Expression"))
    put(c.select("sample").distinct().crossJoin(F.broadcast(spark.range(64))).withColumn("value", line), "id", "features")
    c.join(spots, ["sample", "spot"]).select(
        "sample", F.concat_ws(" ", F.col("gene") + 1, F.col("i") + 1, F.col("cnt").cast("long")).alias("value")
    ).write.partitionBy("sample").text(p["mtx"])
    counts = R.read_sparse_counts(spark, p["mtx"], p["features"], p["barcodes"], size_line=False, depth=1)
    return collapse_duplicates(counts).select("sample", "spot", "gene", "cnt")


@query("read_examples", "SELECT id AS example_id, CASE resolution WHEN 0 THEN 'vis' ELSE 'xen' END AS tech, domain_id::INT AS domain_id, t::INT AS n_tokens FROM examples WHERE resolution=0 AND domain_id IN (1,2,3)", ["examples"])
def _(spark, sf):
    p = _path(spark, "examples")
    e = fx.examples(spark, sf).select(
        F.col("id").alias("example_id"), F.when(F.col("resolution") == 0, "vis").otherwise("xen").alias("tech"),
        F.col("domain_id").cast("int").alias("domain_id"), "tokens", "y",
    )
    W.write_examples(e, p)
    return R.read_examples(spark, p, "vis", [1, 2, 3]).select("example_id", "tech", "domain_id", F.size("tokens").alias("n_tokens"))


@query("write_table", "SELECT spot::VARCHAR AS spot, domain_id::VARCHAR AS domain_id, ctype, round(p,6)::VARCHAR AS p FROM props WHERE round(p,6)>=0.001", ["props"])
def _(spark, sf):
    p = _path(spark, "table")
    W.write_table(fx.props(spark, sf).select("spot", "domain_id", "ctype", r6("p", "p")).where("p >= 0.001"), p)
    return spark.read.csv(p, sep="\t", header=True)


@query("read_vocab", "SELECT (row_number() OVER (ORDER BY c_name)-1)::INT AS class_idx, c_name AS ctype FROM customer")
def _(spark, sf):
    p = _path(spark, "vocab")
    table(spark, sf, "customer").select("c_name").orderBy("c_name").coalesce(1).write.text(p)
    return R.read_vocab(spark, p)


@query("read_label_map", "SELECT p_name AS fine, max(p_brand) AS coarse FROM part GROUP BY 1")
def _(spark, sf):
    p = _path(spark, "labels")
    pairs = table(spark, sf, "part").groupBy(F.col("p_name").alias("fine")).agg(F.max("p_brand").alias("coarse"))
    # one object a file, as the format has it
    one = pairs.groupBy(F.pmod(F.xxhash64("fine"), F.lit(4))).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("fine", "coarse")))).alias("value"))
    one.select("value").repartition(4, "value").write.option("maxRecordsPerFile", 1).text(p)
    return R.read_label_map(spark, p)


@query("read_scale_factors", "SELECT l_suppkey::VARCHAR AS sample, max(l_quantity)::DOUBLE AS spot_diameter_fullres FROM lineitem GROUP BY 1")
def _(spark, sf):
    p = _path(spark, "scales")
    d = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("sample")).agg(F.max("l_quantity").cast("double").alias("spot_diameter_fullres"))
    # one object a file, in its sample's folder
    d.withColumn("tissue_hires_scalef", F.lit(0.5)).repartition("sample").write.partitionBy("sample").json(p)
    return R.read_scale_factors(spark, p).select(F.col("sample").cast("string").alias("sample"), "spot_diameter_fullres")
