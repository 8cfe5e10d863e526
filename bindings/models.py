"""Statistics and models on vectors."""

from pyspark.sql import functions as F

from slideloom.operators import ml as M
from slideloom.operators.tiles import glcm_texture

from . import fixtures as fx
from .fixtures import r6
from .registry import query


@query("standardise", """SELECT vec_id, dim::INT AS dim, round((v-avg(v) OVER (PARTITION BY dim))/(stddev_pop(v) OVER (PARTITION BY dim)+1e-12),6)+0.0 AS v FROM token_dims""", ["token_dims"])
def _(spark, sf):
    d = M.standardise(fx.tokens(spark, sf))
    return d.select("vec_id", F.posexplode("feat").alias("dim", "v")).withColumn("v", r6("v"))


# total variance is kept by a full rotation: components of a narrow projection
@query("pca")
def _(spark, sf):
    return M.pca(fx.tokens(spark, sf), 8).select("sample", "row", "col", "pc")


@query("pca_total_variance", """SELECT round(sum(var_samp),4) AS total FROM (SELECT var_samp(v) AS var_samp FROM token_dims GROUP BY dim)""", ["token_dims"])
def _(spark, sf):
    d = M.pca(fx.tokens(spark, sf), 64).select(F.posexplode("pc").alias("dim", "v"))
    return d.groupBy("dim").agg(F.var_samp("v").alias("v")).agg((F.round(F.sum("v"), 4)).alias("total"))


@query("kmeans_sweep")
def _(spark, sf):
    return M.kmeans_sweep(M.pca(fx.tokens(spark, sf), 8), feat="pc")


# whatever the clusters are, the variance within and between them adds up to the whole, for every K
@query("kmeans_sweep_variance", """SELECT k::INT AS k, n, round(total,4) AS total FROM (SELECT count(*) AS n, (SELECT sum(v) FROM (SELECT var_pop(v)*count(*) AS v FROM token_dims GROUP BY dim)) AS total FROM tokens), (VALUES (5),(10),(15),(20),(25),(30)) t(k)""", ["token_dims", "tokens"])
def _(spark, sf):
    t = fx.tokens(spark, sf).select("vec_id", "feat")
    labels = M.kmeans_sweep(t, keys=("vec_id",))
    v = t.select("vec_id", F.posexplode("feat").alias("dim", "v")).withColumn("v", F.col("v").cast("double")).join(labels, "vec_id")
    own = v.groupBy("k", "cluster", "dim").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), (F.var_pop("v") * F.count(F.lit(1))).alias("within"))
    mean = own.groupBy("k", "dim").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("whole"))
    d = own.join(mean, ["k", "dim"]).groupBy("k").agg(
        F.sum(F.when(F.col("dim") == 0, F.col("n"))).alias("n"), F.sum(F.col("within") + F.col("n") * F.pow(F.col("m") - F.col("whole"), 2)).alias("total")
    )
    return d.select("k", "n", F.round("total", 4).alias("total"))


@query("gmm")
def _(spark, sf):
    return M.gmm(glcm_texture(fx.pixels(spark, sf), tile=8))


def _batched(spark, sf):
    """Vectors with an offset per batch (label // 4)."""
    t = fx.tokens(spark, sf)
    b = F.floor(F.col("label") / 4)
    return t.select("vec_id", b.alias("sample"), F.transform("feat", lambda x: x.cast("double") + b * 0.5).alias("pc"))


@query("harmonise_batches")
def _(spark, sf):
    return M.harmonise_batches(_batched(spark, sf), ids="vec_id", clusters=6, rounds=2)


def _examples(spark, sf):
    t = fx.tokens(spark, sf)
    k = F.col("label") % 4
    y = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(F.col("label") >= 5, (i == k).cast("double")).otherwise(
        F.when(i == k, 0.7).otherwise(0.1)))
    return t.select(F.col("vec_id").alias("id"), "feat", y.alias("y"), F.when(F.col("label") >= 5, 1).otherwise(0).alias("resolution"))


@query("fit_soft_labels")
def _(spark, sf):
    return M.fit_soft_labels(_examples(spark, sf), replicas=2, hard_weight=0.5)


@query("regress_impute")
def _(spark, sf):
    t = fx.tokens(spark, sf).select("vec_id", "feat", F.col("label").cast("double").alias("y1"), (F.col("vec_id") % 17).cast("double").alias("y2"))
    return M.regress_impute(t, t, ["y1", "y2"], ids="vec_id")
