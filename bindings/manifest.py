"""Sample manifests, domains, checks."""

from pyspark.sql import functions as F

from slideloom.functions.scalars import safe_label
from slideloom.operators import samples as S
from slideloom.operators.predict import assign_colour

from . import fixtures as fx
from .fixtures import r6, table
from .registry import query


@query("discover_samples", """SELECT DISTINCT c_name AS sample FROM customer
WHERE (regexp_full_match(c_name, 'Customer#.*7') OR regexp_full_match(c_name, 'Customer#.*4.')) AND c_name NOT IN ('Customer#000000007','Customer#000000042')""")
def _(spark, sf):
    m = table(spark, sf, "customer").select(F.col("c_name").alias("sample"))
    return S.discover_samples(m, ["Customer#*7", "Customer#*4?"], exclude=["Customer#000000007", "Customer#000000042"])


_STEM = """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'batch_'||(o_orderkey%3)
 WHEN '5-LOW' THEN 'batch_a_b_'||o_orderkey
 ELSE 'batch_'||CASE o_orderstatus WHEN 'F' THEN 'vis' WHEN 'O' THEN 'xen' ELSE 'abc' END||'_'||o_orderkey END AS stem FROM orders"""
_RES = f"""SELECT o_orderkey, stem, CASE len(string_split(stem,'_')) WHEN 3 THEN CASE string_split(stem,'_')[2] WHEN 'xen' THEN 1 ELSE 0 END
 WHEN 2 THEN string_split(stem,'_')[2]::INT ELSE 0 END AS resolution,
 CASE len(string_split(stem,'_')) WHEN 3 THEN string_split(stem,'_')[2] NOT IN ('vis','xen') WHEN 2 THEN false ELSE true END AS defaulted FROM ({_STEM})"""


def _stems(spark, sf):
    k = F.col("o_orderkey").cast("string")
    tech = F.when(F.col("o_orderstatus") == "F", "vis").when(F.col("o_orderstatus") == "O", "xen").otherwise("abc")
    return table(spark, sf, "orders").select("o_orderkey", F.when(
        F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("batch_"), (F.col("o_orderkey") % 3).cast("string"))
    ).when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("batch_a_b_"), k)).otherwise(
        F.concat(F.lit("batch_"), tech, F.lit("_"), k)).alias("stem"))


@query("derive_resolution", _RES)
def _(spark, sf):
    return S.derive_resolution(_stems(spark, sf))


@query("filter_resolution", f"SELECT o_orderkey, resolution FROM ({_RES}) WHERE resolution = 1")
def _(spark, sf):
    return S.filter_resolution(S.derive_resolution(_stems(spark, sf)), 1).select("o_orderkey", "resolution")


@query("examples_profile", """SELECT resolution, count(*) AS n, max(t)::INT AS t, 3 AS c, 5 AS k,
 (SELECT max(domain_id)+1 FROM examples WHERE domain_id>=0)::INT AS n_domains FROM examples GROUP BY 1""", ["examples"])
def _(spark, sf):
    return S.examples_profile(fx.examples(spark, sf))


@query("concat_samples", """SELECT l_returnflag AS sample, l_partkey AS feature, sum(l_quantity) AS cnt FROM lineitem
WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag)=3) GROUP BY 1,2""")
def _(spark, sf):
    l = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("sample"), F.col("l_partkey").alias("feature")).agg(
        F.sum("l_quantity").alias("cnt"))
    return S.concat_samples(*[l.where(F.col("sample") == f) for f in ("A", "N", "R")], None).select("sample", "feature", "cnt")


@query("stack", """SELECT 'soft' AS tech, c_custkey AS id, c_acctbal AS v FROM customer UNION ALL SELECT 'hard', s_suppkey, s_acctbal FROM supplier""")
def _(spark, sf):
    return S.stack(
        table(spark, sf, "customer").select(F.lit("soft").alias("tech"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v")),
        table(spark, sf, "supplier").select(F.lit("hard").alias("tech"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v")),
    )


@query("batch_summary", """SELECT user_id AS sample, domain_id, count(*) AS n, round(avg(value),6) AS spacing, max(t) AS radius
FROM examples GROUP BY 1,2""", ["examples"])
def _(spark, sf):
    e = fx.examples(spark, sf).withColumn("sample", F.col("user_id"))
    return S.batch_summary(e, spacing=r6(F.avg("value")), radius=F.max(F.size("tokens")).cast("long"))


@query("run_incremental", "SELECT c_custkey AS sample FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(spark, sf):
    return S.run_incremental(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("sample")),
        table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("sample")),
    )


@query("validate_layout", """WITH req(kind, level) AS (VALUES ('1-URGENT','error'),('2-HIGH','error'),('3-MEDIUM','warning')),
want AS (SELECT c_nationkey AS w FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT c_custkey AS sample, level, 'missing '||kind AS problem FROM customer CROSS JOIN req
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderpriority=kind)
UNION ALL SELECT c_custkey, 'error', 'radius mismatch' FROM customer WHERE c_nationkey <> (SELECT w FROM want)
UNION ALL SELECT o_custkey, 'error', 'spot count mismatch' FROM orders GROUP BY 1
 HAVING count(*) FILTER (o_orderstatus='F') <> count(*) FILTER (o_orderstatus='O')""")
def _(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    req = spark.createDataFrame([("1-URGENT", "error"), ("2-HIGH", "error"), ("3-MEDIUM", "warning")], "kind string, level string")
    status = lambda s: F.count(F.when(F.col("o_orderstatus") == s, 1))
    return S.validate_layout(
        o.select(F.col("o_custkey").alias("sample"), F.col("o_orderpriority").alias("kind")),
        c.select(F.col("c_custkey").alias("sample")), req,
        c.select(F.col("c_custkey").alias("sample"), F.col("c_nationkey").alias("radius")),
        o.groupBy(F.col("o_custkey").alias("sample")).agg(status("F").alias("n_props"), status("O").alias("n_locs")),
    )


@query("rank_domains", "SELECT c_name AS domain, (dense_rank() OVER (ORDER BY c_name)-1)::INT AS domain_id FROM (SELECT DISTINCT c_name FROM customer)")
def _(spark, sf):
    return S.rank_domains(table(spark, sf, "customer"), "c_name").withColumnRenamed("c_name", "domain")


@query("domain_join", """SELECT o_orderkey, o_custkey AS sample, coalesce(c_nationkey, -1) AS domain_id FROM orders
LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey=c_custkey""")
def _(spark, sf):
    d = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("sample"), F.col("c_nationkey").alias("domain_id"))
    return S.domain_join(table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("sample")), d)


@query("domain_offset", """SELECT s_name AS sample, ((SELECT max(c_nationkey) FROM customer) + dense_rank() OVER (ORDER BY s_name))::INT AS domain_id FROM supplier""")
def _(spark, sf):
    return S.domain_offset(
        table(spark, sf, "supplier").select(F.col("s_name").alias("sample")),
        table(spark, sf, "customer").select(F.col("c_nationkey").alias("domain_id")),
    )


_GROUPS = ("ring", "small", "hot", "o")


@query("infer_group", """SELECT p_partkey, p_name AS sample, CASE WHEN n_hits=1 THEN
 CASE WHEN contains(p_name,'ring') THEN 'ring' WHEN contains(p_name,'small') THEN 'small' WHEN contains(p_name,'hot') THEN 'hot' ELSE 'o' END END AS "group", n_hits
FROM (SELECT *, (contains(p_name,'ring')::INT+contains(p_name,'small')::INT+contains(p_name,'hot')::INT+contains(p_name,'o')::INT)::INT AS n_hits FROM part)""")
def _(spark, sf):
    return S.infer_group(table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("sample")), _GROUPS)


@query("sample_report", "SELECT sample, max(row)+1 AS height, max(col)+1 AS width, count(*) AS n_tokens, 8 AS k, 64 AS d FROM tokens GROUP BY 1", ["tokens"])
def _(spark, sf):
    return S.sample_report(fx.scores(spark, sf).where("state = 1"))


@query("safe_label", """SELECT p_partkey, translate(p_name||'/'||p_type||'\\'||p_brand,'/\\ ','--_') AS label, translate(p_name||':'||p_type,'/ :','___') AS colon_label FROM part""")
def _(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", safe_label(F.concat("p_name", F.lit("/"), "p_type", F.lit("\\"), "p_brand")).alias("label"),
        safe_label(F.concat("p_name", F.lit(":"), "p_type"), colon=True).alias("colon_label"),
    )


@query("assign_colour", """SELECT p_partkey, p_type AS ctype, coalesce(CASE p_type WHEN 'ECONOMY' THEN '#ff0000' WHEN 'LARGE' THEN '#00ff00' END,
 ['#111111','#222222','#333333'][p_partkey%3+1]) AS colour FROM part""")
def _(spark, sf):
    cm = spark.createDataFrame([("ECONOMY", "#ff0000"), ("LARGE", "#00ff00")], "ctype string, colour string")
    p = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("ctype"), F.col("p_partkey").alias("class_idx"))
    return assign_colour(p, cm, ["#111111", "#222222", "#333333"]).select("p_partkey", "ctype", "colour")
