"""Tile statistics and tissue filters."""

from pyspark.sql import functions as F

from slideloom.operators import tiles as T
from slideloom.plans.pipelines import tissue_mask
from slideloom.plans.scale import settle

from . import fixtures as fx
from .fixtures import cte, r6
from .registry import query

cte("tile16", """SELECT sample, y//16 AS row, x//16 AS col, sqrt(greatest(sum(n*(r*r+g*g+b*b))/(3.0*sum(n)) - pow(sum(n*(r+g+b))/(3.0*sum(n)),2),0)) AS sd,
 sum(n*r)/sum(n)::DOUBLE AS mr, sum(n*g)/sum(n)::DOUBLE AS mg, sum(n*b)/sum(n)::DOUBLE AS mb
 FROM (SELECT p.*, (CASE WHEN y=height-1 THEN 1+(16-height%16)%16 ELSE 1 END * CASE WHEN x=width-1 THEN 1+(16-width%16)%16 ELSE 1 END) AS n FROM pixels p, pixel_slides)
 GROUP BY 1,2,3""", ("pixels", "pixel_slides"))
cte("tile_z", """SELECT t.*, (mr*vr+mg*vg+mb*vb)/(vr+vg+vb) AS z FROM tile16 t, (SELECT var_pop(mr) AS vr, var_pop(mg) AS vg, var_pop(mb) AS vb FROM tile16)""", ("tile16",))
cte("tile_r0", """SELECT *, ((sd-min(sd) OVER ())/(max(sd) OVER ()-min(sd) OVER ())+1) AS sd_norm, ((z-min(z) OVER ())/(max(z) OVER ()-min(z) OVER ())+1) AS z_norm FROM tile_z""", ("tile_z",))
cte("tile_ratio", """SELECT *, (q-min(q) OVER ())/(max(q) OVER ()-min(q) OVER ()) AS ratio FROM (SELECT *, sd_norm/z_norm AS q FROM tile_r0)""", ("tile_r0",))


def tiles(spark, sf):
    return settle(T.tile_stats(fx.pixels(spark, sf), fx.pixel_slides(spark, sf)))


def ratios(spark, sf):
    return settle(T.contrast_ratio(settle(T.weighted_intensity(tiles(spark, sf)))))


def _r(d, *cols):
    return d.select("row", "col", *[r6(c, c) for c in cols])


@query("tile_stats", "SELECT row, col, round(sd,6) AS sd, round(mr,6) AS mr, round(mg,6) AS mg, round(mb,6) AS mb FROM tile16", ["tile16"])
def _(spark, sf):
    return _r(tiles(spark, sf), "sd", "mr", "mg", "mb")


@query("weighted_intensity", "SELECT row, col, round(z,6) AS z FROM tile_z", ["tile_z"])
def _(spark, sf):
    return _r(T.weighted_intensity(tiles(spark, sf)), "z")


@query("minmax_normalise", "SELECT row, col, round(sd_norm,6) AS sd FROM tile_r0", ["tile_r0"])
def _(spark, sf):
    return _r(T.minmax_normalise(tiles(spark, sf), "sd", plus_one=True), "sd")


@query("contrast_ratio", "SELECT row, col, round(sd_norm,6) AS sd_norm, round(z_norm,6) AS z_norm, round(ratio,6) AS ratio FROM tile_ratio", ["tile_ratio"])
def _(spark, sf):
    return _r(ratios(spark, sf), "sd_norm", "z_norm", "ratio")


_M10 = "CASE WHEN {0}<0 THEN -1-({0}) WHEN {0}>9 THEN 19-({0}) ELSE {0} END"
_DENSITY = f"""WITH u AS (SELECT row, col, (z-min(z) OVER ())/(max(z) OVER ()-min(z) OVER ())*10 AS ux, (sd-min(sd) OVER ())/(max(sd) OVER ()-min(sd) OVER ())*10 AS uy FROM tile_z),
h AS (SELECT least(floor(ux),9) AS bx, least(floor(uy),9) AS by, count(*)::DOUBLE AS n FROM u GROUP BY 1,2),
kw AS (SELECT d, exp(-d*d/2.0::DOUBLE)/sum(exp(-d*d/2.0::DOUBLE)) OVER () AS w FROM generate_series(-4,4) t(d)),
dn AS (SELECT cx, cy, sum(a.w*b.w*coalesce(n,0)) AS dens FROM generate_series(0,9) p(cx), generate_series(0,9) q(cy), kw a, kw b
 LEFT JOIN h ON h.bx={_M10.format('cx+a.d')} AND h.by={_M10.format('cy+b.d')} GROUP BY 1,2)
SELECT row, col, round(coalesce(dens,0),6) AS density, coalesce(dens,0)<3 AS low_density FROM u LEFT JOIN dn ON cx=ceil(ux)-1 AND cy=ceil(uy)-1"""


@query("density_flag", _DENSITY, ["tile_z"])
def _(spark, sf):
    d = T.density_flag(T.weighted_intensity(tiles(spark, sf)), bins=10, thresh=3.0)
    return d.select("row", "col", r6("density", "density"), "low_density")


# two samples, one with seven in eight tiles: each has as many bins as its own tiles give, and the sigma that its bins give;
# rf mirrors each place of a line over its edges, one axis after the other
_DEFAULT = f"""WITH t AS (SELECT *, CASE WHEN (row+col)%8=0 THEN 'small' ELSE 'large' END AS s FROM tile_z),
u0 AS (SELECT *, greatest(floor(count(*) OVER (PARTITION BY s)*0.05::DOUBLE),1)::BIGINT AS b FROM t),
u AS (SELECT *, (z-min(z) OVER p)/nullif(max(z) OVER p-min(z) OVER p,0)*b AS ux, (sd-min(sd) OVER p)/nullif(max(sd) OVER p-min(sd) OVER p,0)*b AS uy FROM u0 WINDOW p AS (PARTITION BY s)),
h AS (SELECT s, b, least(floor(ux),b-1)::BIGINT AS bx, least(floor(uy),b-1)::BIGINT AS by, count(*)::DOUBLE AS n FROM u GROUP BY ALL),
sg AS (SELECT s, b, greatest(1, floor(b*0.02::DOUBLE))::BIGINT AS g FROM (SELECT DISTINCT s, b FROM u)),
kd AS (SELECT s, b, g, unnest(generate_series(-floor(4.0::DOUBLE*g+0.5)::BIGINT, floor(4.0::DOUBLE*g+0.5)::BIGINT)) AS d FROM sg),
kw AS (SELECT s, b, d, exp(-(d*d)/(2.0::DOUBLE*g*g))/sum(exp(-(d*d)/(2.0::DOUBLE*g*g))) OVER (PARTITION BY s) AS w FROM kd),
rm AS (SELECT s, b, c, w, ((c+d)%(2*b)+2*b)%(2*b) AS m FROM (SELECT *, unnest(generate_series(0, b-1)) AS c FROM kw)),
rf AS (SELECT s, c, CASE WHEN m>=b THEN 2*b-1-m ELSE m END AS m, sum(w) AS w FROM rm GROUP BY ALL),
ly AS (SELECT h.s, bx, c AS cy, sum(w*n) AS v FROM h JOIN rf ON rf.s=h.s AND rf.m=h.by GROUP BY ALL),
cc AS (SELECT DISTINCT s, (ceil(ux)-1)::BIGINT AS cx, (ceil(uy)-1)::BIGINT AS cy FROM u WHERE ux>0 AND uy>0),
dn AS (SELECT cc.s, cx, cc.cy, sum(w*v) AS dens FROM cc JOIN rf ON rf.s=cc.s AND rf.c=cc.cx JOIN ly ON ly.s=cc.s AND ly.bx=rf.m AND ly.cy=cc.cy GROUP BY ALL)
SELECT u.s AS sample, row, col, round(coalesce(dens,0),6) AS density, coalesce(dens,0)<3 AS low_density FROM u LEFT JOIN dn ON dn.s=u.s AND cx=(ceil(ux)-1)::BIGINT AND cy=(ceil(uy)-1)::BIGINT"""


@query("density_flag_default", _DEFAULT, ["tile_z"])
def _(spark, sf):
    t = T.weighted_intensity(tiles(spark, sf)).withColumn("sample", F.when((F.col("row") + F.col("col")) % 8 == 0, "small").otherwise("large"))
    d = T.density_flag(t, thresh=3.0, bins_per_tile=0.05)
    return d.select("sample", "row", "col", r6("density", "density"), "low_density")


_HIST = """hist AS (SELECT bin, any_value(lo)+(bin+0.5)*any_value((hi-lo)/{b}) AS center, count(*) AS n FROM (
 SELECT least(floor((v-lo)/(hi-lo)*{b}),{b}-1)::INT AS bin, lo, hi FROM src, (SELECT min(v) AS lo, max(v) AS hi FROM src)) GROUP BY 1)"""
_CUM = """SELECT bin, round(center,6) AS center, n, sum(n) OVER (ORDER BY bin)::BIGINT AS below, sum(n) OVER (ORDER BY bin DESC)::BIGINT AS above FROM hist"""


@query("value_histogram", "WITH src AS (SELECT l_extendedprice AS v FROM lineitem), " + _HIST.format(b=64) + " SELECT bin, round(center,6) AS center, n FROM hist")
def _(spark, sf):
    d = fx.table(spark, sf, "lineitem").select(F.lit("s0").alias("sample"), "l_extendedprice")
    return T.value_histogram(d, "l_extendedprice", 64).select("bin", r6("center", "center"), "n")


@query("cumulative_histogram", "WITH src AS (SELECT l_extendedprice AS v FROM lineitem), " + _HIST.format(b=64) + " " + _CUM)
def _(spark, sf):
    d = fx.table(spark, sf, "lineitem").select(F.lit("s0").alias("sample"), "l_extendedprice")
    return T.cumulative_histogram(d, "l_extendedprice", 64).select("bin", r6("center", "center"), "n", "below", "above")


def _otsu(src, b):
    return f"""WITH src AS (SELECT v FROM ({src}) WHERE v < (SELECT quantile_cont(v,0.9) FROM ({src}))), {_HIST.format(b=b)},
c AS (SELECT *, sum(n) OVER (ORDER BY bin)::DOUBLE AS w1, sum(n*center) OVER (ORDER BY bin) AS m1, (sum(n) OVER ())::DOUBLE AS w, sum(n*center) OVER () AS m FROM hist)
SELECT 's0' AS sample, round(center,6) AS threshold FROM c ORDER BY CASE WHEN w=w1 THEN -1 ELSE round(w1*(w-w1)*pow(m1/w1-(m-m1)/nullif(w-w1,0),2),9) END DESC, bin LIMIT 1"""


@query("otsu_threshold", _otsu("SELECT ratio AS v FROM tile_ratio", 256), ["tile_ratio"])
def _(spark, sf):
    return T.otsu_threshold(ratios(spark, sf), "ratio").withColumn("threshold", r6("threshold"))


@query("otsu_threshold_prices", _otsu("SELECT o_totalprice AS v FROM orders", 64))
def _(spark, sf):
    return T.otsu_threshold(fx.table(spark, sf, "orders").select(F.lit("s0").alias("sample"), "o_totalprice"), "o_totalprice", 64).withColumn("threshold", r6("threshold"))


@query("colour_artefact", """SELECT row, col, g>r+20 AND g>b+20 AS is_green, sd3<10 AS is_grey, r>230 AND g>230 AND b>230 AS is_bright, (g>r+20 AND g>b+20) OR sd3<10 OR (r>230 AND g>230 AND b>230) AS artefact
FROM (SELECT row, col, mr AS r, mg AS g, mb AS b, sqrt((pow(mr-(mr+mg+mb)/3,2)+pow(mg-(mr+mg+mb)/3,2)+pow(mb-(mr+mg+mb)/3,2))/3) AS sd3 FROM tile16)""", ["tile16"])
def _(spark, sf):
    return T.colour_artefact(tiles(spark, sf)).select("row", "col", "is_green", "is_grey", "is_bright", "artefact")


_GREY = "SELECT y//8 AS row, x//8 AS col, y, x, floor(floor(r*0.2125::DOUBLE+g*0.7154::DOUBLE+b*0.0721::DOUBLE)/255.0::DOUBLE*63)::INT AS v FROM pixels"


@query("glcm_texture", f"""WITH g AS ({_GREY}), pr AS (SELECT a.row, a.col, a.v AS i, b.v AS j FROM g a JOIN g b ON b.row=a.row AND b.col=a.col AND b.y=a.y AND b.x=a.x+1),
s AS (SELECT row, col, i, j FROM pr UNION ALL SELECT row, col, j, i FROM pr), c AS (SELECT row, col, i, j, count(*)::DOUBLE AS n FROM s GROUP BY ALL),
p AS (SELECT row, col, i, j, n/sum(n) OVER (PARTITION BY row, col) AS p FROM c)
SELECT row, col, round(sqrt(sum(p*p)),6) AS energy, round(sum(p/(1+(i-j)*(i-j))),6) AS homogeneity, round(-sum(p*log2(p)),6) AS entropy FROM p GROUP BY 1,2""", ["pixels"])
def _(spark, sf):
    return _r(T.glcm_texture(fx.pixels(spark, sf), tile=8), "energy", "homogeneity", "entropy")


@query("tile_sharpness", f"""WITH g AS ({_GREY}), l AS (SELECT a.row, a.col, sum(b.v)-4*any_value(a.v) AS l FROM g a, (VALUES (0,1),(0,-1),(1,0),(-1,0)) d(dy,dx)
 JOIN g b ON b.y = CASE WHEN (a.y+dy)//8=a.row AND a.y+dy>=0 THEN a.y+dy ELSE a.y-dy END AND b.x = CASE WHEN (a.x+dx)//8=a.col AND a.x+dx>=0 THEN a.x+dx ELSE a.x-dx END GROUP BY a.row, a.col, a.y, a.x)
SELECT row, col, round(var_pop(l),6) AS sharpness FROM l GROUP BY 1,2""", ["pixels"])
def _(spark, sf):
    return _r(T.glcm_texture(fx.pixels(spark, sf), tile=8), "sharpness")


def _clustered(spark, sf):
    t = T.minmax_normalise(settle(T.glcm_texture(fx.pixels(spark, sf), tile=8)), "entropy")
    return t.join(fx.tokens(spark, sf).select("sample", "row", "col", F.col("label").alias("cluster")), ["sample", "row", "col"])


_CLU = f"""WITH g AS ({_GREY}), pr AS (SELECT a.row, a.col, a.v AS i, b.v AS j FROM g a JOIN g b ON b.row=a.row AND b.col=a.col AND b.y=a.y AND b.x=a.x+1),
s AS (SELECT row, col, i, j FROM pr UNION ALL SELECT row, col, j, i FROM pr), c AS (SELECT row, col, i, j, count(*)::DOUBLE AS n FROM s GROUP BY ALL),
p AS (SELECT row, col, i, j, n/sum(n) OVER (PARTITION BY row, col) AS p FROM c),
x AS (SELECT row, col, sqrt(sum(p*p)) AS energy, sum(p/(1+(i-j)*(i-j))) AS homogeneity, -sum(p*log2(p)) AS e0 FROM p GROUP BY 1,2),
y AS (SELECT *, (e0-min(e0) OVER ())/(max(e0) OVER ()-min(e0) OVER ()) AS entropy FROM x),
k AS (SELECT label AS cluster, avg(energy) AS energy, avg(homogeneity) AS homogeneity, avg(entropy) AS entropy, count(*) AS n, avg(energy)+avg(homogeneity)-avg(entropy) AS score FROM y JOIN tokens USING (row, col) GROUP BY 1)"""


@query("cluster_scores", _CLU + "SELECT cluster, round(energy,6) AS energy, round(homogeneity,6) AS homogeneity, round(entropy,6) AS entropy, n, round(score,6) AS score FROM k", ["pixels", "tokens"])
def _(spark, sf):
    d = T.cluster_scores(_clustered(spark, sf))
    return d.select("cluster", "n", *[r6(c, c) for c in ("energy", "homogeneity", "entropy", "score")])


@query("lowest_score_clusters", _CLU + "SELECT cluster, rank FROM (SELECT cluster, row_number() OVER (ORDER BY score, cluster)::INT AS rank FROM k) WHERE rank<=2", ["pixels", "tokens"])
def _(spark, sf):
    return T.lowest_score_clusters(T.cluster_scores(_clustered(spark, sf))).select("cluster", "rank")


@query("tissue_mask")
def _(spark, sf):
    return tissue_mask(fx.pixels(spark, sf), fx.pixel_slides(spark, sf), tile=8, bins=10, density=4.0, min_size=3)
