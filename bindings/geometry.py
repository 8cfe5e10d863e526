"""Slide geometry and resolution."""

from pyspark.sql import functions as F

from slideloom.functions.scalars import adversarial_ramp, auto_batch_size
from slideloom.operators import slides as G, spots as P

from . import fixtures as fx
from .fixtures import r6, table
from .registry import query


@query("rescale_coords", """SELECT p.sample, spot, line, round_even(x*(mpp_raw/mpp_target),0)::BIGINT AS x, round_even(y*(mpp_raw/mpp_target),0)::BIGINT AS y
FROM positions p JOIN slides USING (sample)""", ["positions", "slides"])
def _(spark, sf):
    return G.rescale_coords(fx.positions(spark, sf), fx.slides(spark, sf)).select("sample", "spot", "line", "x", "y")


@query("coords_to_grid", """SELECT p.sample, spot, line, round_even((y/(height//grid_h))::DECIMAL(18,6),0)::BIGINT AS row, round_even((x/(width//grid_w))::DECIMAL(18,6),0)::BIGINT AS col
FROM positions p JOIN slides USING (sample)""", ["positions", "slides"])
def _(spark, sf):
    return G.coords_to_grid(fx.positions(spark, sf), fx.slides(spark, sf)).select("sample", "spot", "line", "row", "col")


@query("in_tissue", "SELECT sample, spot, line, x, y FROM positions WHERE qty > 25", ["positions"])
def _(spark, sf):
    p = fx.positions(spark, sf).withColumn("in_tissue", F.when(F.col("qty") > 25, 1).otherwise(0))
    return P.in_tissue(p).select("sample", "spot", "line", "x", "y")


@query("um_to_px", "SELECT cell_id, round(x/0.2125::DOUBLE,6) AS x, round(y/0.2125::DOUBLE,6) AS y FROM cells", ["cells"])
def _(spark, sf):
    return G.um_to_px(fx.cells(spark, sf)).select("cell_id", r6("x", "x"), r6("y", "y"))


@query("spot_radius", """SELECT sample, spot_diameter/2 AS radius_raw, trunc(spot_diameter/2*(mpp_raw/mpp_target))::BIGINT AS radius,
 trunc(spot_diameter/2*(mpp_raw/mpp_target))::BIGINT//16 AS grid_radius FROM slides""", ["slides"])
def _(spark, sf):
    return G.spot_radius(fx.slides(spark, sf)).select("sample", "radius_raw", "radius", "grid_radius")


_MPP = "CASE WHEN p_size IN (72,96,150) THEN NULL WHEN p_partkey%2=0 THEN 25400.0::DOUBLE/p_size ELSE 10000.0::DOUBLE/p_size END"


def _headers(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("sample"), F.col("p_size").alias("size"), (F.col("p_size") * 1000).alias("dpi"), "p_brand", "p_type",
        F.when(F.col("p_partkey") % 2 == 0, "inch").otherwise("cm").alias("unit"),
    )


@query("dpi_to_mpp", f"""SELECT p_partkey AS sample, round(CASE WHEN dpi IN (72,96,150) THEN NULL WHEN p_partkey%2=0 THEN 25400.0::DOUBLE/dpi ELSE 10000.0::DOUBLE/dpi END,6) AS mpp,
 CASE WHEN dpi IN (72,96,150) THEN 'default resolution' END AS reason FROM (SELECT *, CASE WHEN p_size > 40 THEN 72 ELSE p_size*1000 END AS dpi FROM part)""")
def _(spark, sf):
    h = _headers(spark, sf).withColumn("dpi", F.when(F.col("size") > 40, 72).otherwise(F.col("dpi")))
    return G.dpi_to_mpp(h).select("sample", r6("mpp", "mpp"), "reason")


_RESOLVE = """SELECT p_partkey AS sample, coalesce(per_sample, override, header) AS mpp,
 CASE WHEN per_sample IS NOT NULL THEN 'per_sample' WHEN override IS NOT NULL THEN 'override' WHEN header IS NOT NULL THEN 'header' END AS method, p_type AS extension FROM (
 SELECT *, CASE WHEN p_brand='Brand#1' THEN 0.75::DOUBLE END AS per_sample, CASE WHEN p_brand IN ('Brand#1','Brand#2') THEN 0.5::DOUBLE END AS override,
 CASE WHEN p_size<=40 THEN CASE WHEN p_partkey%2=0 THEN 25400.0::DOUBLE ELSE 10000.0::DOUBLE END/(p_size*1000) END AS header FROM part)"""


def _resolved(spark, sf):
    h = G.dpi_to_mpp(_headers(spark, sf)).select("sample", F.when(F.col("size") <= 40, F.col("mpp")).alias("header"), "p_brand", F.col("p_type").alias("extension"))
    h = h.withColumn("per_sample", F.when(F.col("p_brand") == "Brand#1", 0.75)).withColumn(
        "override", F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), 0.5))
    return G.resolve_mpp(h, ("per_sample", "override", "header"))


@query("resolve_mpp", f"SELECT sample, round(mpp,6) AS mpp, method FROM ({_RESOLVE})")
def _(spark, sf):
    return _resolved(spark, sf).select("sample", r6("mpp", "mpp"), "method")


@query("audit_resolution", f"""WITH d AS ({_RESOLVE}), g AS (SELECT round(mpp,4) AS mpp4, count(*) AS n_same FROM d WHERE mpp IS NOT NULL GROUP BY 1)
SELECT sample, round(mpp/0.5,6) AS scale, CASE WHEN mpp IS NULL THEN 'failed' WHEN mpp/0.5>1 THEN 'upscale' ELSE 'ok' END AS status, n_same, (SELECT count(*) FROM g) AS n_resolutions
FROM d LEFT JOIN g ON round(d.mpp,4)=g.mpp4""")
def _(spark, sf):
    return G.audit_resolution(_resolved(spark, sf)).select("sample", r6("scale", "scale"), "status", "n_same", "n_resolutions")


@query("audit_failures", f"SELECT extension, count(*) AS n_failed FROM ({_RESOLVE}) WHERE mpp IS NULL GROUP BY 1")
def _(spark, sf):
    return G.audit_failures(G.audit_resolution(_resolved(spark, sf)))


@query("scale_for_display", """SELECT p.sample, spot, line, CASE WHEN s<1 THEN round_even(x*s,0) ELSE x END::BIGINT AS x, CASE WHEN s<1 THEN round_even(y*s,0) ELSE y END::BIGINT AS y,
 CASE WHEN s<1 THEN greatest(1, trunc(r*s)) ELSE r END::BIGINT AS radius, round(s,6) AS scale
FROM positions p JOIN (SELECT sample, least(1.0::DOUBLE, 500.0::DOUBLE/greatest(height,width)) AS s, s_suppkey%40 AS r FROM slides) USING (sample)""", ["positions", "slides"])
def _(spark, sf):
    s = fx.slides(spark, sf).withColumn("radius", F.col("s_suppkey") % 40)
    return G.scale_for_display(fx.positions(spark, sf), s, 500).select("sample", "spot", "line", "x", "y", "radius", r6("scale", "scale"))


@query("sliding_windows", """SELECT sample, top, unnest(generate_series(0, width, 112)) AS left FROM (SELECT *, unnest(generate_series(0, height, 112)) AS top FROM slides)""", ["slides"])
def _(spark, sf):
    return G.sliding_windows(fx.slides(spark, sf))


@query("region_grid", """SELECT sample, row, col, (col*tw)::BIGINT AS x, (row*th)::BIGINT AS y, (CASE WHEN col<3 THEN tw ELSE width-col*tw END)::BIGINT AS w, (CASE WHEN row<2 THEN th ELSE height-row*th END)::BIGINT AS h
FROM (SELECT sample, width, height, width//4 AS tw, height//3 AS th, r::INT AS row, c::INT AS col FROM slides, generate_series(0,2) a(r), generate_series(0,3) b(c))""", ["slides"])
def _(spark, sf):
    return G.region_grid(fx.slides(spark, sf), 3, 4)


@query("pad_extent", """SELECT sample, ceil(width/256.0)::BIGINT*256 AS padded_width, ceil(height/256.0)::BIGINT*256 AS padded_height,
 ceil(width/256.0)::BIGINT*256-width AS pad_x, ceil(height/256.0)::BIGINT*256-height AS pad_y FROM slides""", ["slides"])
def _(spark, sf):
    return G.pad_extent(fx.slides(spark, sf), 256).select("sample", "padded_width", "padded_height", "pad_x", "pad_y")


_CROP = """SELECT 's0' AS sample, yy+4 AS y, xx+4 AS x, {v} FROM (SELECT yy, xx FROM generate_series(-4,99) a(yy), generate_series(-4,209) b(xx)) e
 LEFT JOIN pixels p ON p.y={y} AND p.x={x}"""


@query("crop_edge", _CROP.format(v="r, g, b", y="greatest(yy,0)", x="least(greatest(xx,0),199)"), ["pixels"])
def _(spark, sf):
    return G.crop_pixels(fx.pixels(spark, sf), fx.pixel_slides(spark, sf), (-4, 100, -4, 210))


@query("crop_constant", _CROP.format(v="coalesce(r,255) AS r, coalesce(g,255) AS g, coalesce(b,255) AS b", y="yy", x="xx"), ["pixels"])
def _(spark, sf):
    return G.crop_pixels(fx.pixels(spark, sf), fx.pixel_slides(spark, sf), (-4, 100, -4, 210), "constant", 255)


@query("window_mask_join", """WITH win AS (SELECT t AS top, l AS "left" FROM pixel_slides, generate_series(0, height, 16) a(t), generate_series(0, width, 16) b(l))
SELECT DISTINCT 's0' AS sample, top, "left" FROM win JOIN pixels ON y+16 BETWEEN top AND top+31 AND x+16 BETWEEN "left" AND "left"+31 WHERE r > 200""", ["pixels", "pixel_slides"])
def _(spark, sf):
    w = G.sliding_windows(fx.pixel_slides(spark, sf), 32, 16)
    return G.window_mask_join(w, fx.pixels(spark, sf).where("r > 200"), 32, 16)


@query("adversarial_ramp", "SELECT o_orderkey, round(0.3*(2.0/(1.0+exp(-10.0::DOUBLE*((o_orderkey%101)/100.0::DOUBLE)))-1.0),6) AS lam FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", r6(adversarial_ramp(F.col("o_orderkey") % 101 / 100.0, 0.3), "lam"))


@query("auto_batch_size", "SELECT o_orderkey, least(128, greatest(1, 300000//greatest(1,o_orderkey)))::INT AS batch_size FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", auto_batch_size("o_orderkey").alias("batch_size"))
