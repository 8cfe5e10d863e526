"""Cells, bins, spots and tokens: joins and neighbourhoods."""

from pyspark.sql import functions as F

from slideloom.functions.arrays import disk_offsets
from slideloom.operators import cells as C, grid as G, ml as M, spots as S
from slideloom.operators.samples import rank_domains

from . import fixtures as fx
from .fixtures import r6, table
from .registry import query


def pairs(spark, sf):
    return C.radius_join(fx.cells(spark, sf), fx.bins(spark, sf), 10)


def labelled_pairs(spark, sf):
    """Flagship: bins near each labelled cell, counted per cell type."""
    cells = fx.cells(spark, sf)
    p = C.radius_join(cells, fx.bins(spark, sf), 10)
    per = p.groupBy("sample", "cell_id").agg(F.count(F.lit(1)).alias("k"))
    return cells.select("sample", "cell_id", "cell_state").join(per, ["sample", "cell_id"]).groupBy("sample", "cell_state").agg(
        F.count(F.lit(1)).alias("cells_with_bins"), F.sum("k").alias("n_pairs")
    )


query("labelled_pairs", """SELECT p.sample, cell_state, count(DISTINCT p.cell_id) AS cells_with_bins, count(*) AS n_pairs
FROM pairs p JOIN cells c ON p.cell_id=c.cell_id GROUP BY 1,2""", ["pairs"])(labelled_pairs)


@query("radius_join", "SELECT sample, cell_id, bin_id, dist2 FROM pairs", ["pairs"])
def _(spark, sf):
    return pairs(spark, sf)


@query("nearest_neighbour", """SELECT a.sample, a.bin_id AS id, round(sqrt(min((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))),6) AS nn_dist
FROM bins a JOIN bins b ON a.bin_id<>b.bin_id GROUP BY 1,2""", ["bins"])
def _(spark, sf):
    return C.nearest_neighbour(fx.bins(spark, sf).withColumnRenamed("bin_id", "id")).withColumn("nn_dist", r6("nn_dist"))


@query("mapping_stats", """WITH per AS (SELECT cell_id, count(*) AS k FROM pairs GROUP BY 1),
nn AS (SELECT a.bin_id, sqrt(min((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) AS d FROM bins a JOIN bins b ON a.bin_id<>b.bin_id GROUP BY 1)
SELECT 's0' AS sample, (SELECT count(*) FROM cells) AS total_cells, count(*) AS cells_with_bins, round(avg(k),6) AS mean_bins,
 round(quantile_cont(k,0.5)::DOUBLE,6) AS median_bins, (SELECT round(quantile_cont(d,0.5),6) FROM nn) AS median_spacing FROM per""", ["pairs", "bins"])
def _(spark, sf):
    nn = C.nearest_neighbour(fx.bins(spark, sf).withColumnRenamed("bin_id", "id"))
    s = C.mapping_stats(pairs(spark, sf), fx.cells(spark, sf), nn)
    return s.withColumns({c: r6(c) for c in ("mean_bins", "median_bins", "median_spacing")})


@query("key_intersect", "SELECT sample, cell_id FROM pairs INTERSECT SELECT sample, cell_id FROM cells WHERE cell_state IN ('HOUSEHOLD','MACHINERY')", ["pairs", "cells"])
def _(spark, sf):
    return S.key_intersect(pairs(spark, sf), fx.cells(spark, sf).where(F.col("cell_state").isin("HOUSEHOLD", "MACHINERY")), ["sample", "cell_id"])


@query("k_nearest", """SELECT sample, cell_id, bin_id, dist2, rank FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY dist2, bin_id)::INT AS rank FROM pairs) WHERE rank<=3""", ["pairs"])
def _(spark, sf):
    return C.nearest_bins(fx.cells(spark, sf), fx.bins(spark, sf), 10, 3)


@query("order_tokens", "SELECT sample, cell_id, bin_id, row_number() OVER (PARTITION BY cell_id ORDER BY bin_id)-1 AS pos FROM pairs", ["pairs"])
def _(spark, sf):
    return C.order_near_tokens(fx.cells(spark, sf), fx.bins(spark, sf), 10)


@query("pad_or_sample_tokens", """WITH r AS (SELECT sample, cell_id, bin_id, row_number() OVER (PARTITION BY cell_id ORDER BY (bin_id::HUGEINT*2654435761+7)%4294967296, bin_id) AS hr,
 row_number() OVER (PARTITION BY cell_id ORDER BY bin_id) AS br, count(*) OVER (PARTITION BY cell_id) AS k FROM pairs)
SELECT sample, cell_id, p::INT AS pos, bin_id FROM r, generate_series(0,5) t(p) WHERE CASE WHEN k>=6 THEN hr=p+1 ELSE br=p%k+1 END""", ["pairs"])
def _(spark, sf):
    return C.pad_or_sample_near(fx.cells(spark, sf), fx.bins(spark, sf), 10, 6, seed=7, scheme="mul")


@query("slim_bins", "SELECT sample, bin_id, x, y FROM bins", ["bins"])
def _(spark, sf):
    return C.slim_bins(fx.bins(spark, sf), ("sample", "bin_id", "x", "y"))


@query("merge_features", "SELECT sample, bin_id, x, y, o_totalprice AS feat FROM bins JOIN orders ON bin_id=o_orderkey", ["bins"])
def _(spark, sf):
    f = table(spark, sf, "orders").select(F.lit("s0").alias("sample"), F.col("o_orderkey").alias("bin_id"), F.col("o_totalprice").alias("feat"))
    return C.merge_features(fx.bins(spark, sf), f)


@query("annotate_cells", """SELECT 's'||k AS sample, c_custkey AS cell_id, CASE WHEN c_acctbal>k*1000 THEN n_name END AS cell_state, CASE WHEN c_acctbal>k*1000 AND n_regionkey<4 THEN r_name END AS cell_type
FROM customer, generate_series(0,2) t(k), nation, region WHERE (c_nationkey+k)%25=n_nationkey AND n_regionkey=r_regionkey""")
def _(spark, sf):
    # three samples with the same cell ids and other states
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))
    c = c.select("*", k.alias("k")).withColumn("sample", F.concat(F.lit("s"), F.col("k").cast("string"))).withColumnRenamed("c_custkey", "cell_id")
    ann = c.where(F.col("c_acctbal") > F.col("k") * 1000).join(n, (F.col("c_nationkey") + F.col("k")) % 25 == F.col("n_nationkey"))
    m = n.where("n_regionkey < 4").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("fine"), F.col("r_name").alias("coarse"))
    out = C.annotate_cells(c.select("sample", "cell_id"), ann.select("sample", "cell_id", F.col("n_name").alias("cell_state")), m)
    return out.select("sample", "cell_id", "cell_state", "cell_type")


@query("annotate_partial", "SELECT d.doc_id AS cell_id, l.quality::VARCHAR AS cell_state, CASE l.quality WHEN 1 THEN 'kept' END AS cell_type FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(spark, sf):
    ann = table(spark, sf, "labels").select(F.col("doc_id").alias("cell_id"), F.col("quality").cast("string").alias("cell_state"))
    m = spark.createDataFrame([("1", "kept")], "fine string, coarse string")
    return C.annotate_cells(table(spark, sf, "documents").select(F.col("doc_id").alias("cell_id")), ann, m, ["cell_id"]).select("cell_id", "cell_state", "cell_type")


_SEG = "SELECT (dense_rank() OVER (ORDER BY s)-1)::INT AS class_idx, s FROM (SELECT DISTINCT c_mktsegment AS s FROM customer WHERE c_mktsegment<>'MACHINERY')"


@query("label_matrix", f"""SELECT c_custkey AS cell_id, class_idx, class_idx IS NOT NULL AS valid, (coalesce(class_idx,-1)=0)::INT::DOUBLE AS y0, (coalesce(class_idx,-1)=1)::INT::DOUBLE AS y1,
 (coalesce(class_idx,-1)=2)::INT::DOUBLE AS y2, (coalesce(class_idx,-1)=3)::INT::DOUBLE AS y3 FROM customer LEFT JOIN ({_SEG}) ON c_mktsegment=s""")
def _(spark, sf):
    c = fx.cells(spark, sf).withColumnRenamed("cell_state", "cell_type")
    v = rank_domains(c.where("cell_type <> 'MACHINERY'"), "cell_type", "class_idx").withColumnRenamed("cell_type", "ctype")
    return C.label_matrix(c, v, 4).select("cell_id", "class_idx", "valid", *[F.get("onehot", F.lit(i)).alias(f"y{i}") for i in range(4)])


# --- spots ------------------------------------------------------------------
_POS = "SELECT c_custkey AS spot, c_nationkey AS pos FROM customer WHERE c_acctbal > 1000"


def _spot_pos(spark, sf):
    return table(spark, sf, "customer").where("c_acctbal > 1000").select(F.col("c_custkey").alias("spot"), F.col("c_nationkey").alias("pos"))


def _region_props(spark, sf):
    return fx.props(spark, sf).withColumnRenamed("domain_id", "sample")


@query("align_spots", f"SELECT domain_id AS sample, spot, ctype, round(p,6) AS p, pos FROM props JOIN ({_POS}) USING (spot)", ["props"])
def _(spark, sf):
    pr = _region_props(spark, sf)
    pos = _spot_pos(spark, sf).join(pr.select("spot", "sample").distinct(), "spot")
    return S.align_spots(pr, pos, ("sample", "spot"))[0].select("sample", "spot", "ctype", r6("p", "p"), "pos")


@query("align_spots_report", f"""SELECT 'all' AS sample, count(*) FILTER (a.spot IS NOT NULL AND b.spot IS NOT NULL) AS n_aligned, count(*) FILTER (b.spot IS NULL) AS props_only,
 count(*) FILTER (a.spot IS NULL) AS positions_only FROM (SELECT DISTINCT spot FROM props) a FULL JOIN ({_POS}) b USING (spot)""", ["props"])
def _(spark, sf):
    return S.align_spots(fx.props(spark, sf), _spot_pos(spark, sf), ("spot",))[1]


@query("shared_spots", f"SELECT spot, ctype FROM props WHERE spot IN (SELECT spot FROM ({_POS}))", ["props"])
def _(spark, sf):
    return S.shared_spots(fx.props(spark, sf), _spot_pos(spark, sf))[0].select("spot", "ctype")


@query("sort_shared", f"SELECT spot, pos FROM ({_POS}) WHERE spot IN (SELECT spot FROM props)", ["props"])
def _(spark, sf):
    return S.sort_shared(fx.props(spark, sf), _spot_pos(spark, sf))[1]


@query("key_except", f"SELECT DISTINCT spot FROM props WHERE spot NOT IN (SELECT spot FROM ({_POS}))", ["props"])
def _(spark, sf):
    return S.key_except(fx.props(spark, sf).select("spot").distinct(), _spot_pos(spark, sf), ["spot"])


@query("align_counts", "SELECT sample, spot, gene, cnt FROM counts WHERE spot IN (SELECT o_orderkey FROM orders WHERE o_orderstatus='F')", ["counts"])
def _(spark, sf):
    pos = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("spot"))
    return S.align_counts(fx.counts(spark, sf), pos, ["spot"]).select("sample", "spot", "gene", "cnt")


@query("align_columns", """SELECT spot, 0.0::DOUBLE AS extra_first, round(coalesce(max(CASE WHEN ctype='5-LOW' THEN p END),0),6) AS "5-LOW", 0.0::DOUBLE AS absent,
 round(coalesce(max(CASE WHEN ctype='1-URGENT' THEN p END),0),6) AS "1-URGENT" FROM props GROUP BY 1""", ["props"])
def _(spark, sf):
    wide = S.wide_proportions(fx.props(spark, sf), ["1-URGENT", "5-LOW"])
    wide = wide.select("spot", r6("1-URGENT", "1-URGENT"), r6("5-LOW", "5-LOW"))
    return S.align_columns(wide, ["extra_first", "5-LOW", "absent"])


_VAR = """SELECT ctype, (sum(p*p)-sum(p)*sum(p)/n)/(n-1) AS variance FROM props, (SELECT count(DISTINCT spot)::DOUBLE AS n FROM props) GROUP BY ctype, n"""


def _n_spots(spark, sf):
    return fx.props(spark, sf).select("spot").distinct().agg(F.count(F.lit(1)).alias("n"))


@query("variance_order", f"SELECT ctype, round(variance,6) AS variance, (row_number() OVER (ORDER BY variance DESC, ctype)-1)::INT AS class_idx FROM ({_VAR})", ["props"])
def _(spark, sf):
    return S.variance_order(fx.props(spark, sf), _n_spots(spark, sf)).withColumn("variance", r6("variance"))


@query("order_classes", f"SELECT ctype, (row_number() OVER (ORDER BY variance DESC, ctype)-1)::INT AS class_idx FROM ({_VAR})", ["props"])
def _(spark, sf):
    return S.order_classes(fx.props(spark, sf), _n_spots(spark, sf))


# --- tokens around spots ------------------------------------------------------
_DISK = """SELECT s.spot, di, dj, t.vec_id, t.feat, count(*) OVER (PARTITION BY s.spot) AS n, row_number() OVER (PARTITION BY s.spot ORDER BY di, dj) - 1 AS pos
 FROM grid_spots s, generate_series(-2,2) a(di), generate_series(-2,2) b(dj) JOIN tokens t ON t.row=s.row+di AND t.col=s.col+dj WHERE di*di+dj*dj<=4"""


@query("disk_tokens", f"SELECT spot, pos::INT AS pos, round(feat[1]::DOUBLE,6) AS first, round(feat[64]::DOUBLE,6) AS last FROM ({_DISK}) WHERE n=13", ["grid_spots", "tokens"])
def _(spark, sf):
    d = G.disk_tokens(fx.grid_spots(spark, sf), fx.tokens(spark, sf), 2)
    return d.select("spot", F.posexplode("tokens").alias("pos", "f")).select(
        "spot", "pos", r6(F.get("f", F.lit(0)).cast("double"), "first"), r6(F.get("f", F.lit(63)).cast("double"), "last"))


@query("disk_report", f"SELECT 's0' AS sample, (SELECT count(*) FROM customer) AS n_spots, (SELECT count(*) FROM customer) - count(*) FILTER (n=13 AND pos=0) AS n_dropped FROM ({_DISK})", ["grid_spots", "tokens"])
def _(spark, sf):
    s = fx.grid_spots(spark, sf)
    return G.disk_report(s, G.disk_tokens(s, fx.tokens(spark, sf), 2))


@query("disk_crop", """SELECT s.spot, di::INT AS di, dj::INT AS dj, round(CASE WHEN di*di+dj*dj<=4 THEN feat[1]::DOUBLE ELSE 0 END,6) AS first
FROM grid_spots s, generate_series(-2,2) a(di), generate_series(-2,2) b(dj) JOIN tokens t ON t.row=s.row+di AND t.col=s.col+dj""", ["grid_spots", "tokens"])
def _(spark, sf):
    d = G.disk_crop(fx.grid_spots(spark, sf), fx.tokens(spark, sf), 2, 64)
    return d.select("spot", "di", "dj", r6(F.get("feat", F.lit(0)).cast("double"), "first"))


@query("disk_offsets", "SELECT spot, count(*) AS n, count(*) FILTER (di*di+dj*dj>=1) AS ring FROM grid_spots, generate_series(-2,2) a(di), generate_series(-2,2) b(dj) WHERE di*di+dj*dj<=4 GROUP BY 1", ["grid_spots"])
def _(spark, sf):
    return fx.grid_spots(spark, sf).select("spot", F.size(disk_offsets(2)).cast("long").alias("n"), F.size(disk_offsets(2, 1)).cast("long").alias("ring"))


@query("concat_features", "SELECT sample, row, col, len(feat)+2 AS n, round(feat[1]::DOUBLE,6) AS first, label::DOUBLE AS mid, vec_id::DOUBLE AS last FROM tokens", ["tokens"])
def _(spark, sf):
    t = fx.tokens(spark, sf)
    one = lambda c: t.select("sample", "row", "col", F.array(F.col(c).cast("float")).alias("feat"))
    d = S.concat_features(t.select("sample", "row", "col", "feat"), one("label"), one("vec_id"))
    at = lambda i: F.get("feat", F.lit(i)).cast("double")
    return d.select("sample", "row", "col", F.size("feat").cast("long").alias("n"), r6(at(0), "first"), at(64).alias("mid"), at(65).alias("last"))


def _knn_sql(w):
    return f"""WITH d AS (SELECT a.vec_id AS q, b.vec_id AS t, sqrt(sum((a.v-b.v)*(a.v-b.v))) AS dist FROM (SELECT vec_id, dim, v*v+0.05 AS v FROM token_dims) a JOIN token_dims b USING (dim) GROUP BY 1,2),
n AS (SELECT q, label::DOUBLE AS y1, (t%17)::DOUBLE AS y2, {w} AS w FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, t) AS rk FROM d) JOIN tokens ON t=vec_id WHERE rk<=5),
m AS (SELECT q, sum(w*y1)/sum(w) AS m1, sum(w*y2)/sum(w) AS m2 FROM n GROUP BY 1),
v AS (SELECT q, any_value(m1) AS m1, any_value(m2) AS m2, sum(w*(y1-m1)*(y1-m1))/sum(w) AS v1, sum(w*(y2-m2)*(y2-m2))/sum(w) AS v2 FROM n JOIN m USING (q) GROUP BY 1)
SELECT q AS query_id, 'y1' AS target, round(m1,6) AS mean, round(v1,6) AS variance FROM v UNION ALL SELECT q, 'y2', round(m2,6), round(v2,6) FROM v"""


def _knn(spark, sf, weights):
    t = fx.tokens(spark, sf)
    train = t.select(F.col("vec_id").alias("train_id"), "feat", F.col("label").alias("y1"), (F.col("vec_id") % 17).alias("y2"))
    q = t.select(F.col("vec_id").alias("query_id"), F.transform("feat", lambda x: x.cast("double") * x.cast("double") + 0.05).alias("feat"))
    return M.knn_impute(train, q, ["y1", "y2"], 5, weights).select("query_id", "target", r6("mean", "mean"), r6("variance", "variance"))


@query("knn_impute", _knn_sql("1.0::DOUBLE"), ["token_dims"])
def _(spark, sf):
    return _knn(spark, sf, "uniform")


@query("knn_impute_distance", _knn_sql("1.0::DOUBLE/(dist+1e-12)"), ["token_dims"])
def _(spark, sf):
    return _knn(spark, sf, "distance")
