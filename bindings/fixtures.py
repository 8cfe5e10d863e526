"""Derived inputs: the same definitions as Spark frames and as SQL text."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from slideloom.functions.arrays import softmax
from slideloom.plans.scale import attach, beside, dealt, settle


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c, name=None):
    """Six decimals, without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c, 6) + F.lit(0.0)
    return out.alias(name) if name else out


CTES = {}


def cte(name, sql, deps=()):
    CTES[name] = (tuple(deps), sql)


# --- bins and cells -------------------------------------------------------
cte("bins", "SELECT 's0' AS sample, o_orderkey AS bin_id, (o_orderkey*7919)%1009 AS x, (o_orderkey*104729)%997 AS y FROM orders")
cte("cells", "SELECT 's0' AS sample, c_custkey AS cell_id, (c_custkey*611953)%1009 AS x, (c_custkey*15485863)%997 AS y, c_mktsegment AS cell_state FROM customer")
cte("pairs", "SELECT c.sample, cell_id, bin_id, (c.x-b.x)*(c.x-b.x)+(c.y-b.y)*(c.y-b.y) AS dist2 FROM cells c JOIN bins b ON b.x BETWEEN c.x-10 AND c.x+10 AND b.y BETWEEN c.y-10 AND c.y+10 WHERE (c.x-b.x)*(c.x-b.x)+(c.y-b.y)*(c.y-b.y) <= 100", ("cells", "bins"))


def bins(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.lit("s0").alias("sample"), k.alias("bin_id"), (k * 7919 % 1009).alias("x"), (k * 104729 % 997).alias("y")
    )


def cells(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.lit("s0").alias("sample"), k.alias("cell_id"), (k * 611953 % 1009).alias("x"),
        (k * 15485863 % 997).alias("y"), F.col("c_mktsegment").alias("cell_state"),
    )


# --- soft labels ----------------------------------------------------------
cte("props", """SELECT o_custkey AS spot, n_regionkey AS domain_id, o_orderpriority AS ctype,
 sum(o_totalprice)/sum(sum(o_totalprice)) OVER (PARTITION BY o_custkey) AS p
 FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY 1,2,3""")
# known fixed class order of the order priorities
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
cte("vocab", "SELECT (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INT AS class_idx, o_orderpriority AS ctype FROM (SELECT DISTINCT o_orderpriority FROM orders)")
# soft labels as one row per (spot, class), zeros included
cte("labels_full", """SELECT s.spot, s.domain_id, v.class_idx, coalesce(p.p, 0.0) AS p
 FROM (SELECT DISTINCT spot, domain_id FROM props) s CROSS JOIN vocab v
 LEFT JOIN props p ON p.spot=s.spot AND p.ctype=v.ctype""", ("props", "vocab"))


def props(spark, sf):
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    g = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
        F.col("o_custkey").alias("spot"), F.col("n_regionkey").alias("domain_id"), F.col("o_orderpriority").alias("ctype")
    ).agg(F.sum("o_totalprice").alias("_v"))
    # over the same sums: added up anew, in another order, a spot's only class can miss 1 by a rounding, and with it its cell
    tot = F.sum("_v").over(Window.partitionBy("spot"))
    return g.select("spot", "domain_id", "ctype", (F.col("_v") / tot).alias("p"))


def vocab(spark, sf):
    from slideloom.operators.samples import rank_domains

    return rank_domains(table(spark, sf, "orders"), "o_orderpriority", "class_idx").withColumnRenamed("o_orderpriority", "ctype")


def label_table(spark, sf):
    """(spot, domain_id, y)"""
    from slideloom.operators.spots import label_vectors

    return settle(label_vectors(props(spark, sf), vocab(spark, sf), ["spot", "domain_id"]))


# --- counts ---------------------------------------------------------------
# three samples whose barcodes and cells have the same names
cte("raw_counts", "SELECT 's'||(l_suppkey%3) AS sample, l_orderkey AS spot, l_partkey%64 AS gene, l_quantity AS cnt FROM lineitem")
cte("counts", "SELECT sample, spot, gene, sum(cnt) AS cnt FROM raw_counts GROUP BY ALL", ("raw_counts",))
cte("ref_counts", "SELECT 's'||(l_suppkey%3) AS sample, l_partkey AS cell, l_orderkey%64 AS gene, sum(l_quantity) AS cnt FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY ALL")
cte("ref_labels", "SELECT 's'||k AS sample, p_partkey AS cell, 'type'||((p_partkey+k)%5) AS ctype, p_type AS grp FROM part, generate_series(0,2) t(k)")


def _sample():
    return F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("sample")


def raw_counts(spark, sf):
    return table(spark, sf, "lineitem").select(
        _sample(), F.col("l_orderkey").alias("spot"), (F.col("l_partkey") % 64).alias("gene"), F.col("l_quantity").alias("cnt")
    )


def counts(spark, sf):
    raw = raw_counts(spark, sf)
    return dealt(raw, ["spot"], raw.count()).groupBy("sample", "spot", "gene").agg(F.sum("cnt").alias("cnt"))


def ref_counts(spark, sf):
    l, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    raw = l.select(_sample(), F.col("l_partkey").alias("cell"), (F.col("l_orderkey") % 64).alias("gene"), F.col("l_quantity").alias("cnt"))
    n = p.count()
    rows = max(l.count(), n)
    known = dealt(raw, ["cell"], rows).join(beside(p.select(F.col("p_partkey").alias("cell")), ["cell"], rows, n), "cell")
    return known.groupBy("sample", "cell", "gene").agg(F.sum("cnt").alias("cnt"))


def ref_labels(spark, sf):
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))
    return table(spark, sf, "part").select("*", k.alias("k")).select(
        F.concat(F.lit("s"), F.col("k").cast("string")).alias("sample"), F.col("p_partkey").alias("cell"),
        F.concat(F.lit("type"), ((F.col("p_partkey") + F.col("k")) % 5).cast("string")).alias("ctype"), F.col("p_type").alias("grp"),
    )


# --- grid tokens ----------------------------------------------------------
cte("tokens", "SELECT 's0' AS sample, vec_id//25 AS row, vec_id%25 AS col, embedding AS feat, label, vec_id FROM embeddings")
cte("grid", "SELECT 's0' AS sample, max(vec_id//25)+1 AS grid_h, 25 AS grid_w, 16*(max(vec_id//25)+1) AS height, 16*25 AS width FROM embeddings")
cte("mask", "SELECT sample, row, col FROM tokens WHERE label < 5", ("tokens",))
cte("token_dims", "SELECT sample, row, col, vec_id, label, unnest(feat)::DOUBLE AS v, unnest(generate_series(0,63)) AS dim FROM tokens", ("tokens",))
cte("grid_spots", "SELECT 's0' AS sample, c_custkey AS spot, (c_custkey*7)%(SELECT grid_h FROM grid) AS row, (c_custkey*11)%25 AS col FROM customer", ("grid",))


def tokens(spark, sf):
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        F.lit("s0").alias("sample"), F.floor(v / 25).alias("row"), (v % 25).alias("col"),
        F.col("embedding").alias("feat"), "label", "vec_id",
    )


def grid(spark, sf):
    return tokens(spark, sf).groupBy("sample").agg((F.max("row") + 1).alias("grid_h")).select(
        "sample", "grid_h", F.lit(25).cast("long").alias("grid_w"),
        (F.col("grid_h") * 16).alias("height"), F.lit(400).cast("long").alias("width"),
    )


def mask(spark, sf):
    return tokens(spark, sf).where("label < 5").select("sample", "row", "col")


def grid_spots(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("s0").alias("sample"), F.col("c_custkey").alias("spot"))
    return attach(c, grid(spark, sf).select("sample", "grid_h"), "sample").select(
        "sample", "spot", (F.col("spot") * 7 % F.col("grid_h")).alias("row"), (F.col("spot") * 11 % 25).alias("col")
    )


# --- pixels: each vector is one 8 x 8 tile ---------------------------------
cte("pixels", """SELECT 's0' AS sample, (vec_id//25)*8+i//8 AS y, (vec_id%25)*8+i%8 AS x,
 least(greatest(g0,0),255) AS r, (((g0*7+31)%256)+256)%256 AS g, (((g0*13+97)%256)+256)%256 AS b
 FROM (SELECT vec_id, i, CAST(floor((v::DOUBLE+0.6)*200) AS INT) AS g0 FROM
  (SELECT vec_id, unnest(embedding) AS v, unnest(generate_series(0,63)) AS i FROM embeddings))""")
cte("pixel_slides", "SELECT 's0' AS sample, 8*(max(vec_id//25)+1) AS height, 200 AS width FROM embeddings")


def pixels(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    g0 = F.floor((F.col("v").cast("double") + 0.6) * 200).cast("int")
    v, i = F.col("vec_id"), F.col("i")
    return e.select(
        F.lit("s0").alias("sample"), (F.floor(v / 25) * 8 + F.floor(i / 8)).alias("y"), (v % 25 * 8 + i % 8).alias("x"),
        F.least(F.greatest(g0, F.lit(0)), F.lit(255)).alias("r"),
        F.pmod(g0 * 7 + 31, F.lit(256)).alias("g"), F.pmod(g0 * 13 + 97, F.lit(256)).alias("b"),
    )


def pixel_slides(spark, sf):
    return table(spark, sf, "embeddings").agg((F.max(F.floor(F.col("vec_id") / 25)) * 8 + 8).alias("height")).select(
        F.lit("s0").alias("sample"), "height", F.lit(200).cast("long").alias("width")
    )


# --- overlapping patches: 4 x 4 local tokens of length 4 -------------------
cte("patch_tokens", """SELECT 's0' AS sample, vec_id AS patch_id, (vec_id//25)*2 + k//4 AS row, (vec_id%25)*2 + k%4 AS col,
 k//4 AS i, k%4 AS j, embedding AS cls, embedding[4*k+1:4*k+4] AS loc
 FROM (SELECT vec_id, embedding, unnest(generate_series(0,15)) AS k FROM embeddings)""")


def patches(spark, sf):
    v = F.col("vec_id")
    row = lambda a: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: F.slice("embedding", (a * 4 + b) * 4 + 1, 4))
    return table(spark, sf, "embeddings").select(
        F.lit("s0").alias("sample"), v.alias("patch_id"), (F.floor(v / 25) * 32).alias("top"), (v % 25 * 32).alias("left"),
        F.col("embedding").alias("cls"), F.transform(F.sequence(F.lit(0), F.lit(3)), row).alias("local"),
    )


# --- ensemble scores: four states, eight classes ---------------------------
cte("score_long", """SELECT sample, row, col, vec_id, label, state, k, exp(logit-m)/sum(exp(logit-m)) OVER (PARTITION BY vec_id, state) AS p FROM (
 SELECT *, max(logit) OVER (PARTITION BY vec_id, state) AS m FROM (
 SELECT sample, row, col, vec_id, label, s AS state, dim//8 AS k, s*sum(v) AS logit
 FROM token_dims, (VALUES (1),(2),(3),(4)) t(s) GROUP BY sample, row, col, vec_id, label, s, dim//8))""", ("token_dims",))
cte("latent_long", """SELECT sample, row, col, s AS state, dim,
 CASE s WHEN 1 THEN v WHEN 2 THEN 3*v*v WHEN 3 THEN -v ELSE 0.1 END AS z
 FROM token_dims, (VALUES (1),(2),(3),(4)) t(s)""", ("token_dims",))


def scores(spark, sf):
    t = tokens(spark, sf).withColumn("state", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])))
    s = F.col("state")
    logit = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda k: s * F.aggregate(F.slice("feat", k * 8 + 1, 8), F.lit(0.0), lambda a, x: a + x.cast("double")),
    )
    d = lambda x: x.cast("double")
    z = F.transform("feat", lambda x: F.when(s == 1, d(x)).when(s == 2, 3 * d(x) * d(x)).when(s == 3, -d(x)).otherwise(0.1))
    return t.select("sample", "row", "col", "vec_id", "label", "state", z.alias("z"), logit.alias("logits"), softmax(logit).alias("p"))


# --- slides: one per supplier; positions: one per line item -----------------
cte("slides", """SELECT s_name AS sample, 16*(20+s_nationkey) AS width, 16*(15+s_nationkey) AS height,
 0.25::DOUBLE+0.01::DOUBLE*s_nationkey AS mpp_raw, 0.5::DOUBLE AS mpp_target, (100+s_suppkey%37)::DOUBLE AS spot_diameter,
 20+s_nationkey AS grid_w, 15+s_nationkey AS grid_h, s_suppkey FROM supplier""")
cte("positions", """SELECT s_name AS sample, l_orderkey AS spot, l_linenumber AS line, l_partkey AS part, l_quantity AS qty, (l_partkey*31+l_orderkey)%700 AS x, (l_partkey*17+l_orderkey)%600 AS y
 FROM lineitem JOIN supplier ON l_suppkey=s_suppkey""")


def slides(spark, sf):
    n = F.col("s_nationkey").cast("long")
    return table(spark, sf, "supplier").select(
        F.col("s_name").alias("sample"), (16 * (20 + n)).alias("width"), (16 * (15 + n)).alias("height"),
        (F.lit(0.25) + F.lit(0.01) * n).alias("mpp_raw"), F.lit(0.5).alias("mpp_target"),
        (F.lit(100) + F.col("s_suppkey") % 37).cast("double").alias("spot_diameter"),
        (20 + n).alias("grid_w"), (15 + n).alias("grid_h"), "s_suppkey",
    )


def positions(spark, sf):
    l, s = table(spark, sf, "lineitem"), table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("sample"))
    return l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "sample", F.col("l_orderkey").alias("spot"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        F.col("l_quantity").alias("qty"),
        ((F.col("l_partkey") * 31 + F.col("l_orderkey")) % 700).alias("x"),
        ((F.col("l_partkey") * 17 + F.col("l_orderkey")) % 600).alias("y"),
    )


# --- examples from events ---------------------------------------------------
cte("examples", """SELECT event_id AS id, user_id, user_id%8-1 AS domain_id,
 CASE WHEN event_type IN ('view','click') THEN 0 ELSE 1 END AS resolution, event_type, value, 1+user_id%4 AS t FROM events""")


def examples(spark, sf):
    u = F.col("user_id")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), "user_id", (u % 8 - 1).alias("domain_id"),
        F.when(F.col("event_type").isin("view", "click"), 0).otherwise(1).alias("resolution"), "event_type", "value",
        F.array_repeat(F.array("value", "value", "value"), (1 + u % 4).cast("int")).alias("tokens"),
        F.array_repeat(F.lit(0.2), 5).alias("y"),
    )
