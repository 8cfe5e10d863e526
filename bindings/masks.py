"""Grid values, masks, patches."""

from pyspark.sql import functions as F

from slideloom.operators import grid as G

from . import fixtures as fx
from .fixtures import r6, table
from .registry import query


@query("densify_grid", """SELECT 's0' AS sample, r AS row, c AS col, round(coalesce(feat[1]::DOUBLE,0),6) AS first, round(coalesce(feat[64]::DOUBLE,0),6) AS last
FROM (SELECT r, c FROM grid, generate_series(0,grid_h-1) a(r), generate_series(0,24) b(c)) LEFT JOIN (SELECT * FROM tokens WHERE label<5) ON row=r AND col=c""", ["grid", "tokens"])
def _(spark, sf):
    d = G.densify_grid(fx.tokens(spark, sf).where("label < 5"), fx.grid(spark, sf), 64)
    at = lambda i: F.get("feat", F.lit(i)).cast("double")
    return d.select("sample", "row", "col", r6(at(0), "first"), r6(at(63), "last"))


@query("apply_mask", "SELECT row, col, CASE WHEN label<5 THEN label ELSE -1 END AS label FROM tokens", ["tokens"])
def _(spark, sf):
    return G.apply_mask(fx.tokens(spark, sf).select("sample", "row", "col", "label"), fx.mask(spark, sf), "label").select("row", "col", "label")


@query("apply_mask_filter", "SELECT row, col, label FROM tokens WHERE label<5", ["tokens"])
def _(spark, sf):
    return G.apply_mask(fx.tokens(spark, sf).select("sample", "row", "col", "label"), fx.mask(spark, sf)).select("row", "col", "label")


@query("binarise_mask", "SELECT y, x, greatest(r-120,g-250,0)>0 AS mask, greatest(r-120,0)>0 AS first_channel FROM pixels", ["pixels"])
def _(spark, sf):
    p = fx.pixels(spark, sf).select("y", "x", F.greatest(F.col("r") - 120, F.lit(0)).alias("r"), F.greatest(F.col("g") - 250, F.lit(0)).alias("g"), F.lit(0).alias("b"))
    return G.binarise_mask(G.binarise_mask(p), ("r",), "first_channel").select("y", "x", "mask", "first_channel")


@query("mask_reduce", "SELECT y//4 AS row, x//4 AS col, avg((r>120)::INT)>0.5 AS mask FROM pixels GROUP BY 1,2", ["pixels"])
def _(spark, sf):
    m = fx.pixels(spark, sf).select("sample", F.col("y").alias("row"), F.col("x").alias("col"), (F.col("r") > 120).cast("int").alias("mask"))
    return G.mask_reduce(m, 4).select("row", "col", "mask")


def _flag(t, cond):
    return t.select("sample", "row", "col", F.expr(cond).alias("flag"))


@query("mask_union", "SELECT row, col, NOT (label IN (1,2,3) OR vec_id%3=0) AS keep FROM tokens", ["tokens"])
def _(spark, sf):
    t = fx.tokens(spark, sf)
    return G.mask_union(_flag(t, "label in (1,2,3)"), _flag(t, "vec_id % 3 = 0")).select("row", "col", "keep")


@query("rescued_tiles", "SELECT row, col FROM tokens WHERE label IN (1,2,3) AND NOT label IN (3,4)", ["tokens"])
def _(spark, sf):
    t = fx.tokens(spark, sf)
    return G.rescued_tiles(_flag(t, "label in (1,2,3)"), _flag(t, "label in (3,4)")).select("row", "col")


@query("upsample_mask", "SELECT row*4+i AS y, col*4+j AS x, label FROM tokens, generate_series(0,3) a(i), generate_series(0,3) b(j)", ["tokens"])
def _(spark, sf):
    return G.upsample_mask(fx.tokens(spark, sf), 4, ["label"]).select("y", "x", "label")


@query("erode_mask", """SELECT m.row, m.col FROM (SELECT * FROM tokens WHERE label<9) m, grid g JOIN (SELECT * FROM tokens WHERE label<9) n
 ON n.row BETWEEN m.row-1 AND m.row+1 AND n.col BETWEEN m.col-1 AND m.col+1
GROUP BY m.row, m.col, grid_h, grid_w HAVING count(*) = (least(m.row+1,grid_h-1)-greatest(m.row-1,0)+1)*(least(m.col+1,grid_w-1)-greatest(m.col-1,0)+1)""", ["tokens", "grid"])
def _(spark, sf):
    return G.erode_mask(fx.tokens(spark, sf).where("label < 9"), fx.grid(spark, sf), 1).select("row", "col")


@query("remove_small_components", """WITH RECURSIVE m AS (SELECT * FROM tokens WHERE label<3), edge AS (SELECT a.vec_id AS u, b.vec_id AS v FROM m a JOIN m b ON abs(a.row-b.row)<=1 AND abs(a.col-b.col)<=1),
reach AS (SELECT vec_id AS u, vec_id AS v FROM m UNION SELECT r.u, e.v FROM reach r JOIN edge e ON e.u=r.v)
SELECT row, col FROM m WHERE vec_id IN (SELECT u FROM reach GROUP BY 1 HAVING count(*)>=6)""", ["tokens"])
def _(spark, sf):
    return G.remove_small_components(fx.tokens(spark, sf).where("label < 3"), 6).select("row", "col")


# blocks smaller than the groups: pieces are joined over block borders
@query("small_components_by_blocks", """WITH RECURSIVE m AS (SELECT * FROM tokens WHERE label<4), edge AS (SELECT a.vec_id AS u, b.vec_id AS v FROM m a JOIN m b ON abs(a.row-b.row)<=1 AND abs(a.col-b.col)<=1),
reach AS (SELECT vec_id AS u, vec_id AS v FROM m UNION SELECT r.u, e.v FROM reach r JOIN edge e ON e.u=r.v)
SELECT row, col FROM m WHERE vec_id IN (SELECT u FROM reach GROUP BY 1 HAVING count(*)>=12)""", ["tokens"])
def _(spark, sf):
    return G.remove_small_components(fx.tokens(spark, sf).where("label < 4"), 12, block=8).select("row", "col")


def _mirror(c, n):
    return f"CASE WHEN {c}<0 THEN -1-{c} WHEN {c}>={n} THEN 2*{n}-1-{c} ELSE {c} END"


def _focal_sql(half, weight):
    ri, ci = _mirror("(t.row+di)", "grid_h"), _mirror("(t.col+dj)", "grid_w")
    return f"""WITH k AS (SELECT di, dj, {weight} AS w FROM generate_series(-{half},{half}) a(di), generate_series(-{half},{half}) b(dj))
SELECT t.row, t.col, round(sum(w*n.label)/sum(w),6) AS label FROM tokens t, grid, k JOIN tokens n ON n.row={ri} AND n.col={ci}
WHERE t.label<8 AND n.label<8 GROUP BY 1,2"""


def _masked_grid(spark, sf):
    return fx.tokens(spark, sf).select("sample", "row", "col", F.when(F.col("label") < 8, F.col("label").cast("double")).alias("label"))


@query("focal_mean", _focal_sql(1, "1.0::DOUBLE"), ["tokens", "grid"])
def _(spark, sf):
    d = G.focal_mean(_masked_grid(spark, sf), fx.grid(spark, sf), 3, "label", block=8)
    return d.where("label is not null").select("row", "col", r6("label", "label"))


@query("focal_gaussian", _focal_sql(2, "exp(-(di*di+dj*dj)/0.5::DOUBLE)"), ["tokens", "grid"])
def _(spark, sf):
    d = G.focal_gaussian(_masked_grid(spark, sf), fx.grid(spark, sf), 2, "label", block=8)
    return d.where("label is not null").select("row", "col", r6("label", "label"))


# an even window reaches one cell further up and left
@query("focal_mean_even", f"""WITH k AS (SELECT di, dj FROM generate_series(-2,1) a(di), generate_series(-2,1) b(dj))
SELECT t.row, t.col, round(avg(n.label),6) AS label FROM tokens t, grid, k JOIN tokens n ON n.row={_mirror("(t.row+di)", "grid_h")} AND n.col={_mirror("(t.col+dj)", "grid_w")}
WHERE t.label<8 AND n.label<8 GROUP BY 1,2""", ["tokens", "grid"])
def _(spark, sf):
    d = G.focal_mean(_masked_grid(spark, sf), fx.grid(spark, sf), 4, "label", block=8)
    return d.where("label is not null").select("row", "col", r6("label", "label"))


# vectors, of which some are missing
@query("focal_max", f"""WITH k AS (SELECT di, dj FROM generate_series(-1,1) a(di), generate_series(-1,1) b(dj))
SELECT t.row, t.col, dim, round(max(n.v),6) AS v FROM tokens t, grid, k JOIN token_dims n ON n.row={_mirror("(t.row+di)", "grid_h")} AND n.col={_mirror("(t.col+dj)", "grid_w")}
WHERE t.label<8 AND n.vec_id IN (SELECT vec_id FROM tokens WHERE label<8) AND dim IN (0,63) GROUP BY ALL""", ["tokens", "grid", "token_dims"])
def _(spark, sf):
    t = fx.tokens(spark, sf).withColumn("feat", F.when(F.col("label") < 8, F.col("feat")))
    d = G.focal_max(t, fx.grid(spark, sf), 2, "feat", block=8).where("feat is not null")
    long = d.select("row", "col", F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("dim"), F.get("feat", F.lit(i)).alias("v")) for i in (0, 63)])).alias("_e"))
    return long.select("row", "col", "_e.dim", r6("_e.v", "v"))


@query("sample_at_points", f"""WITH k AS (SELECT di, dj, exp(-(di*di+dj*dj)/0.5::DOUBLE) AS w FROM generate_series(-2,2) a(di), generate_series(-2,2) b(dj)),
s AS (SELECT t.row, t.col, dim, sum(w*v)/sum(w) AS v FROM tokens t, grid, k JOIN token_dims n ON n.row={_mirror("(t.row+di)", "grid_h")} AND n.col={_mirror("(t.col+dj)", "grid_w")} WHERE dim IN (0,63) GROUP BY 1,2,3)
SELECT spot, round(max(v) FILTER (dim=0),6) AS first, round(max(v) FILTER (dim=63),6) AS last FROM grid_spots JOIN s USING (row, col) GROUP BY 1""", ["tokens", "grid", "token_dims", "grid_spots"])
def _(spark, sf):
    d = G.sample_at_points(fx.grid_spots(spark, sf), fx.tokens(spark, sf), fx.grid(spark, sf), 2, "feat", block=16)
    return d.select("spot", r6(F.get("feat", F.lit(0)), "first"), r6(F.get("feat", F.lit(63)), "last"))


@query("patch_expand_join", "SELECT patch_id, row, col, i::INT AS i, j::INT AS j, round(cls[64]::DOUBLE,6) AS g, round(loc[1]::DOUBLE,6) AS l0, round(loc[4]::DOUBLE,6) AS l3 FROM patch_tokens", ["patch_tokens"])
def _(spark, sf):
    d = G.patch_expand_join(fx.patches(spark, sf))
    at = lambda i: F.get("feat", F.lit(i)).cast("double")
    return d.select("patch_id", "row", "col", "i", "j", r6(at(63), "g"), r6(at(64), "l0"), r6(at(67), "l3"))


_W4 = "exp((2*(1.0::DOUBLE/3)*(1.0::DOUBLE/3) - (pow(i*2.0::DOUBLE/3-1,2)+pow(j*2.0::DOUBLE/3-1,2)))/0.5)"
_OVER = f"""SELECT row-1 AS row, col-1 AS col, round(sum({_W4}*cls[1]::DOUBLE)/sum({_W4}),6) AS g0, round(sum({_W4}*cls[64]::DOUBLE)/sum({_W4}),6) AS g63,
 round(sum({_W4}*loc[1]::DOUBLE)/sum({_W4}),6) AS l0, round(sum({_W4}*loc[4]::DOUBLE)/sum({_W4}),6) AS l3 FROM patch_tokens GROUP BY 1,2"""


def _fused(d):
    at = lambda i: F.get("feat", F.lit(i))
    return d.select("row", "col", r6(at(0), "g0"), r6(at(63), "g63"), r6(at(64), "l0"), r6(at(67), "l3"))


@query("overlap_average", _OVER, ["patch_tokens"])
def _(spark, sf):
    return _fused(G.overlap_average(G.patch_expand_join(fx.patches(spark, sf)), size=4, crop=1))


@query("fuse_patches", f"SELECT o.* FROM ({_OVER}) o JOIN mask USING (row, col)", ["patch_tokens", "mask"])
def _(spark, sf):
    return _fused(G.fuse_patches(fx.patches(spark, sf), fx.grid(spark, sf), fx.mask(spark, sf), size=4, crop=1, block=8))


@query("center_weights", f"SELECT patch_id, i::INT AS i, j::INT AS j, round({_W4},6) AS w FROM patch_tokens", ["patch_tokens"])
def _(spark, sf):
    from slideloom.functions.arrays import center_weight

    return G.patch_expand_join(fx.patches(spark, sf)).select("patch_id", "i", "j", r6(center_weight("i", "j", 4), "w"))


def _odd(spark, sf):
    """Vectors with NaN and infinities by event type."""
    bad = F.when(F.col("event_type") == "error", float("nan")).when(F.col("event_type") == "signup", float("inf")).otherwise(F.col("value"))
    return table(spark, sf, "events").select("event_id", F.array(F.array("value", bad), F.array("value", "value")).alias("tokens"), F.array(F.col("value"), bad, -bad).alias("v"))


@query("finite_examples", "SELECT event_id, value FROM events WHERE event_type NOT IN ('error','signup')")
def _(spark, sf):
    return G.finite_examples(_odd(spark, sf)).select("event_id", F.get(F.get("tokens", F.lit(0)), F.lit(0)).alias("value"))


@query("nan_to_num", """SELECT event_id, CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 3.4028234663852886e38 ELSE value END AS b, CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN -3.4028234663852886e38 ELSE -value END AS c FROM events""")
def _(spark, sf):
    d = G.nan_to_num(_odd(spark, sf), "v")
    return d.select("event_id", F.get("v", F.lit(1)).alias("b"), F.get("v", F.lit(2)).alias("c"))
