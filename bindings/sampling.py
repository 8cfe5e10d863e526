"""Coresets, splits and token sampling."""

from pyspark.sql import functions as F

from slideloom.operators import cells as C, coreset as K

from . import fixtures as fx
from .fixtures import cte, r6, table
from .spatial import _DISK
from .registry import query

_H = "((({0})::HUGEINT*2654435761+{1})%4294967296)::BIGINT"

cte("spot_entropy", """SELECT spot, domain_id, cls, entropy, CASE WHEN entropy>=e1 THEN 1 ELSE 0 END + CASE WHEN entropy>=e2 THEN 1 ELSE 0 END AS ebin FROM (
 SELECT *, quantile_cont(entropy, 1.0/3) OVER (PARTITION BY domain_id) AS e1, quantile_cont(entropy, 2.0/3) OVER (PARTITION BY domain_id) AS e2 FROM (
 SELECT spot, domain_id, (arg_min(class_idx, (-p, class_idx))) AS cls, -sum(q*ln(q)) AS entropy FROM (
 SELECT *, greatest(p,1e-8)/sum(greatest(p,1e-8)) OVER (PARTITION BY spot) AS q FROM labels_full) GROUP BY 1,2))""", ("labels_full",))
cte("budget", """SELECT domain_id, count(*) AS n_domain, greatest(1, round_even(greatest(1, ceil(0.25::DOUBLE*(SELECT count(*) FROM spot_entropy)))*count(*)/(SELECT count(*) FROM spot_entropy)::DOUBLE,0))::BIGINT AS budget FROM spot_entropy GROUP BY 1""", ("spot_entropy",))


@query("entropy_bins", "SELECT spot, cls::INT AS cls, round(entropy,6) AS entropy, ebin::INT AS ebin FROM spot_entropy", ["spot_entropy"])
def _(spark, sf):
    return K.entropy_bins(fx.label_table(spark, sf)).select("spot", "cls", r6("entropy", "entropy"), "ebin")


@query("coreset_budget", "SELECT domain_id, n_domain, budget FROM budget", ["budget"])
def _(spark, sf):
    return K.coreset_budget(fx.label_table(spark, sf))


_ALLOC = """st AS (SELECT domain_id, cls, ebin, count(*) AS n_s, any_value(n_domain) AS nd, any_value(budget) AS budget, any_value(budget)*count(*)/any_value(n_domain)::DOUBLE AS share FROM spot_entropy JOIN budget USING (domain_id) GROUP BY 1,2,3),
a0 AS (SELECT *, greatest(1, round_even(share,0))::BIGINT AS a FROM st), a1 AS (SELECT *, (budget - sum(a) OVER (PARTITION BY domain_id))::BIGINT AS drift FROM a0),
a2 AS (SELECT *, a + CASE WHEN row_number() OVER (PARTITION BY domain_id ORDER BY share-a DESC, cls, ebin) <= drift THEN 1 ELSE 0 END AS b FROM a1),
un AS (SELECT domain_id, cls, ebin, share, b, drift, unnest(generate_series(1, least(b-1, -drift))) AS u FROM a2 WHERE drift<0 AND b>1),
cut AS (SELECT domain_id, cls, ebin, count(*) AS cut FROM (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY b-(u-1)-share DESC, cls, ebin) AS r FROM un) WHERE r <= -drift GROUP BY 1,2,3),
al AS (SELECT a2.*, b-coalesce(cut,0) AS alloc FROM a2 LEFT JOIN cut USING (domain_id, cls, ebin))"""


@query("stratum_allocation", f"WITH {_ALLOC} SELECT domain_id, cls::INT AS cls, ebin::INT AS ebin, n_s, alloc FROM al", ["spot_entropy", "budget"])
def _(spark, sf):
    from slideloom.plans.scale import settle

    d = settle(K.entropy_bins(fx.label_table(spark, sf)).select("domain_id", "spot", "cls", "ebin"))
    b = K.coreset_budget(d)
    return K.stratum_allocation(d.groupBy("domain_id", "cls", "ebin").agg(F.count(F.lit(1)).alias("n_s")).join(b, "domain_id"))


@query("coreset_stratified", f"""WITH {_ALLOC} SELECT domain_id, spot, cls::INT AS cls, ebin::INT AS ebin FROM (SELECT s.*, alloc, row_number() OVER (PARTITION BY domain_id, cls, ebin ORDER BY {_H.format('spot', 5)}, spot) AS r
 FROM spot_entropy s JOIN al USING (domain_id, cls, ebin)) WHERE r<=alloc""", ["spot_entropy", "budget"])
def _(spark, sf):
    return K.coreset_stratified(fx.label_table(spark, sf), seed=5, scheme="mul")


_CELLS = "SELECT spot, domain_id, lv, string_agg(floor(p*pow(2,lv))::BIGINT::VARCHAR, ',' ORDER BY class_idx) AS c FROM labels_full, generate_series(0,13) g(lv) WHERE domain_id>=0 GROUP BY 1,2,3"


@query("coreset_kcenter", f"""WITH ce AS ({_CELLS}), oc AS (SELECT domain_id, lv, count(DISTINCT c) AS n FROM ce WHERE lv<=12 GROUP BY 1,2),
ft AS (SELECT domain_id, budget, coalesce(max(lv) FILTER (WHERE n<=budget),0) AS lv FROM budget JOIN oc USING (domain_id) GROUP BY 1,2),
hs AS (SELECT DISTINCT spot, domain_id, {_H.format('spot', 0)} AS h FROM labels_full WHERE domain_id>=0),
rp AS (SELECT spot, domain_id, c.lv-f.lv AS t, row_number() OVER (PARTITION BY domain_id, c.lv, c ORDER BY h, spot) AS r FROM ce c JOIN ft f USING (domain_id) JOIN hs USING (spot, domain_id) WHERE c.lv-f.lv IN (0,1)),
tr AS (SELECT spot, domain_id, min(t) AS t FROM rp WHERE r=1 GROUP BY 1,2),
rk AS (SELECT domain_id, spot, row_number() OVER (PARTITION BY domain_id ORDER BY coalesce(t,2)*1073741824+h//4, spot) AS r FROM hs LEFT JOIN tr USING (spot, domain_id))
SELECT domain_id, spot FROM rk JOIN ft USING (domain_id) WHERE r<=budget""", ["labels_full", "budget"])
def _(spark, sf):
    return K.coreset_kcenter(fx.label_table(spark, sf), scheme="mul")


# the whole spot path: labels, coreset, tokens; a sample for each domain, all with the same grid
@query("soft_examples", f"""WITH {_ALLOC}, kept AS (SELECT domain_id, spot FROM (SELECT s.*, alloc, row_number() OVER (PARTITION BY domain_id, cls, ebin ORDER BY {_H.format('spot', 5)}, spot) AS r
 FROM spot_entropy s JOIN al USING (domain_id, cls, ebin)) WHERE r<=alloc)
SELECT 's'||domain_id AS sample, spot, domain_id, round(p,6) AS y0, pos::INT AS pos, round(feat[1]::DOUBLE,6) AS first FROM kept JOIN labels_full USING (domain_id, spot) JOIN ({_DISK}) USING (spot) WHERE class_idx=0 AND n=13""",
       ["spot_entropy", "budget", "labels_full", "grid_spots", "tokens"])
def _(spark, sf):
    from slideloom.plans.pipelines import soft_examples

    name = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
    p = fx.props(spark, sf).withColumn("sample", name("domain_id"))
    domains = p.select("sample", "domain_id").distinct()
    spots = fx.grid_spots(spark, sf).drop("sample").join(p.select("sample", "spot").distinct(), "spot")
    t = fx.tokens(spark, sf).withColumn("sample", F.explode(F.array(*[F.lit(f"s{i}") for i in range(5)])))
    d = soft_examples(p.drop("domain_id"), fx.vocab(spark, sf), spots, t, domains, 2, seed=5, ids="spot", scheme="mul")
    d = d.select("sample", "spot", "domain_id", r6(F.get("y", F.lit(0)), "y0"), F.posexplode("tokens").alias("pos", "f"))
    return d.select("sample", "spot", "domain_id", "y0", "pos", r6(F.get("f", F.lit(0)).cast("double"), "first"))


@query("domain_counts", "SELECT domain_id, count(*) AS n FROM examples WHERE domain_id>=0 GROUP BY 1", ["examples"])
def _(spark, sf):
    return K.domain_counts(fx.examples(spark, sf))


@query("inverse_weights", "SELECT id, CASE WHEN domain_id>=0 THEN 1.0::DOUBLE/count(*) OVER (PARTITION BY domain_id) ELSE 1.0 END AS weight FROM examples", ["examples"])
def _(spark, sf):
    return K.inverse_weights(fx.examples(spark, sf)).select("id", "weight")


@query("weighted_resample", f"""WITH rws AS (SELECT id, domain_id, row_number() OVER (ORDER BY CASE WHEN domain_id>=0 THEN domain_id ELSE -1 END, id)-1 AS pos FROM examples),
grp AS (SELECT domain_id, min(pos) AS off, count(*) AS n, row_number() OVER (PARTITION BY domain_id>=0 ORDER BY domain_id)-1 AS k FROM rws GROUP BY 1),
tot AS (SELECT count(*) FILTER (domain_id>=0) AS d, coalesce(sum(n) FILTER (domain_id<0),0)::BIGINT AS u FROM grp),
slot AS (SELECT CASE WHEN domain_id>=0 THEN k ELSE d END AS slot, off, n FROM grp, tot),
dr AS (SELECT i AS draw, floor({_H.format('i', 3)}/4294967296.0::DOUBLE*(d+u))::BIGINT AS x, {_H.format('i::HUGEINT*69069+1', 3)}/4294967296.0::DOUBLE AS u2, d FROM (SELECT unnest(generate_series(0,(SELECT count(*)-1 FROM examples))) AS i), tot)
SELECT draw, id, domain_id FROM (SELECT draw, off + CASE WHEN x<d THEN floor(u2*n)::BIGINT ELSE x-d END AS pos FROM dr JOIN slot ON slot=least(x,d)) JOIN rws USING (pos)""", ["examples"])
def _(spark, sf):
    e = fx.examples(spark, sf)
    return K.weighted_resample(e, e.count(), seed=3, scheme="mul")


@query("split_train_val", f"""SELECT event_id, CASE WHEN row_number() OVER (ORDER BY {_H.format('event_id', 42)}, event_id) <= floor(0.1*(SELECT count(*) FROM events)) THEN 'val' ELSE 'train' END AS split FROM events""")
def _(spark, sf):
    return C.split_train_val(table(spark, sf, "events").select("event_id"), "event_id", seed=42, scheme="mul")


@query("sample_cap", f"SELECT bin_id, x, y FROM bins QUALIFY row_number() OVER (ORDER BY {_H.format('bin_id', 0)}, bin_id) <= 3000", ["bins"])
def _(spark, sf):
    return C.sample_cap(fx.bins(spark, sf).select("bin_id", "x", "y"), 3000, "bin_id", scheme="mul")


@query("stratified_cells", f"""WITH c AS (SELECT event_id, user_id%5 AS sample, event_type AS l FROM events), s AS (SELECT sample, l, count(*) AS n, sum(count(*)) OVER (PARTITION BY sample) AS t FROM c GROUP BY 1,2),
q AS (SELECT *, 301.0::DOUBLE*n/t AS q FROM s), a AS (SELECT sample, l, floor(q) + CASE WHEN row_number() OVER (PARTITION BY sample ORDER BY q-floor(q) DESC, l) <= 301-sum(floor(q)) OVER (PARTITION BY sample) THEN 1 ELSE 0 END AS k FROM q)
SELECT sample, event_id AS cell_id, l AS cell_type FROM (SELECT c.*, k, row_number() OVER (PARTITION BY sample, l ORDER BY {_H.format('event_id', 9)}, event_id) AS r FROM c JOIN a USING (sample, l)) WHERE r<=k""")
def _(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 5).alias("sample"), F.col("event_id").alias("cell_id"), F.col("event_type").alias("cell_type"))
    return C.stratified_cells(e, 301, seed=9, scheme="mul").select("sample", "cell_id", "cell_type")


@query("most_frequent", "SELECT user_id, value, n FROM (SELECT user_id, round(value)::BIGINT AS value, count(*) AS n FROM events GROUP BY 1,2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, value)=1")
def _(spark, sf):
    return C.most_frequent(table(spark, sf, "events").select("user_id", F.round("value").cast("long").alias("value")), "value", ["user_id"])


@query("relabel_by_size", """WITH e AS (SELECT event_id, CASE WHEN event_type='error' THEN -1 ELSE user_id END AS label FROM events), r AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label)-1 AS k FROM e WHERE label>=0 GROUP BY 1)
SELECT event_id, label, coalesce(k, label) AS new_label FROM e LEFT JOIN r USING (label)""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "error", -1).otherwise(F.col("user_id")).alias("label"))
    return C.relabel_by_size(e).select("event_id", "label", "new_label")
