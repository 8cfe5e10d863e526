"""Model scoring, ensembles, losses, summaries."""

from pyspark.sql import functions as F

from slideloom.functions.arrays import doubles, outer_scaled
from slideloom.operators import predict as P
from slideloom.operators.samples import rank_domains
from slideloom.plans.pipelines import hard_examples, predict_grid

from . import fixtures as fx
from .fixtures import cte, r6, table
from .registry import query

# --- a small fixed network: four hidden layers of six, four classes, two states ---
WIDTHS = (64, 6, 6, 6, 6)


def _w(i, j, layer, state):
    return ((i * 7 + j * 3 + layer * 5 + state * 2) % 11 - 5) / 10.0


def _b(j, layer, state):
    return ((j * 5 + layer + state) % 7 - 3) / 20.0


def states():
    out = []
    for s in (0, 1):
        layers = [
            ([[_w(i, j, l, s) for j in range(WIDTHS[l + 1])] for i in range(WIDTHS[l])], [_b(j, l, s) for j in range(WIDTHS[l + 1])])
            for l in range(4)
        ]
        head = ([[_w(i, j, 4, s) for j in range(4)] for i in range(6)], [_b(j, 4, s) for j in range(4)])
        out.append({"layers": layers, "head": head})
    return out


def _layer(src, l, n, leaky=True):
    lin = f"sum(v*((dim*7+j*3+{l}*5+state*2)%11-5)/10.0::DOUBLE) + any_value(((j*5+{l}+state)%7-3)/20.0::DOUBLE)"
    act = "CASE WHEN x>0 THEN x ELSE 0.1::DOUBLE*x END" if leaky else "x"
    return f"SELECT vec_id, state, j AS dim, {act} AS v FROM (SELECT vec_id, state, j, {lin} AS x FROM {src}, generate_series(0,{n - 1}) t(j) GROUP BY 1,2,3)"


cte("net_in", "SELECT vec_id, dim, v, s AS state FROM token_dims, (VALUES (0),(1)) t(s)", ("token_dims",))
cte("net1", _layer("net_in", 0, 6), ("net_in",))
cte("net2", _layer("net1", 1, 6), ("net1",))
cte("net3", _layer("net2", 2, 6), ("net2",))
cte("net4", _layer("net3", 3, 6), ("net3",))
cte("net5", _layer("net4", 4, 4, False), ("net4",))
cte("net_p", "SELECT vec_id, state, dim, exp(v-m)/sum(exp(v-m)) OVER (PARTITION BY vec_id, state) AS p FROM (SELECT *, max(v) OVER (PARTITION BY vec_id, state) AS m FROM net5)", ("net5",))


@query("score_tokens", """SELECT vec_id, state::INT AS state, 'z' AS kind, dim::INT AS dim, round(v,6)+0.0 AS v FROM net4 UNION ALL SELECT vec_id, state::INT, 'p', dim::INT, round(p,6) FROM net_p""", ["net4", "net_p"])
def _(spark, sf):
    d = P.score_tokens(fx.tokens(spark, sf), states(), keys=("vec_id",))
    long = lambda c: d.select("vec_id", "state", F.lit(c).alias("kind"), F.posexplode(c).alias("dim", "v"))
    return long("z").unionByName(long("p")).withColumn("v", r6("v"))


_PRED = """md AS (SELECT vec_id, dim, quantile_cont(v,0.5) AS v FROM net4 GROUP BY 1,2), nm AS (SELECT vec_id, dim, v/sqrt(greatest(sum(v*v) OVER (PARTITION BY vec_id),1e-12)) AS v FROM md), pm AS (SELECT vec_id, dim, avg(p) AS p FROM net_p GROUP BY 1,2)"""


@query("predict_grid", f"""WITH {_PRED} SELECT row, col, 'z' AS kind, nm.dim::INT AS dim, round(nm.v,6)+0.0 AS v FROM nm JOIN tokens USING (vec_id) WHERE label<5
UNION ALL SELECT row, col, 'p', pm.dim::INT, round(p,6) FROM pm JOIN tokens USING (vec_id) WHERE label<5""", ["net4", "net_p", "tokens"])
def _(spark, sf):
    d = predict_grid(fx.tokens(spark, sf), states(), fx.mask(spark, sf))
    long = lambda c: d.select("row", "col", F.lit(c).alias("kind"), F.posexplode(c).alias("dim", "v"))
    return long("z").unionByName(long("p")).withColumn("v", r6("v"))


def _ensemble_sql(median):
    return f"""WITH m AS (SELECT row, col, dim, {median} AS v FROM latent_long GROUP BY 1,2,3)
SELECT row, col, 'z' AS kind, dim::INT AS dim, round(v/sqrt(greatest(sum(v*v) OVER (PARTITION BY row, col),1e-12)),6)+0.0 AS v FROM m
UNION ALL SELECT row, col, 'p', k::INT, round(avg(p),6) FROM score_long GROUP BY row, col, k"""


def _ensemble(spark, sf, median):
    d = P.ensemble_combine(fx.scores(spark, sf), median)
    long = lambda c: d.select("row", "col", F.lit(c).alias("kind"), F.posexplode(c).alias("dim", "v"))
    return long("z").unionByName(long("p")).withColumn("v", r6("v"))


@query("ensemble_combine", _ensemble_sql("quantile_cont(z,0.5)"), ["latent_long", "score_long"])
def _(spark, sf):
    return _ensemble(spark, sf, "average")


@query("ensemble_combine_lower", _ensemble_sql("quantile_disc(z,0.5)"), ["latent_long", "score_long"])
def _(spark, sf):
    return _ensemble(spark, sf, "lower")


@query("token_pool", "SELECT row AS spot, k::INT AS cls, round(avg(p),6) AS p FROM score_long GROUP BY 1,2", ["score_long"])
def _(spark, sf):
    d = P.token_pool(fx.scores(spark, sf).withColumn("spot", F.col("row")))
    return d.select("spot", F.posexplode("p").alias("cls", "p")).withColumn("p", r6("p"))


# truth: one-hot of label % 8 for hard rows (label >= 5), 0.5/0.5 on two neighbours for soft ones
_TRUTH = "CASE WHEN label>=5 THEN (k=label%8)::INT::DOUBLE ELSE 0.5*((k=label%8)::INT+(k=(label+1)%8)::INT) END"


def _with_truth(spark, sf):
    lab = F.col("label")
    y = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.when(
        lab >= 5, (k == lab % 8).cast("double")).otherwise(0.5 * ((k == lab % 8).cast("int") + (k == (lab + 1) % 8).cast("int"))))
    return fx.scores(spark, sf).withColumns({"y": y, "resolution": F.when(lab >= 5, 1).otherwise(0)})


_CURVE = f"""SELECT state AS epoch, count(DISTINCT vec_id) FILTER (label<5) AS n_soft, count(DISTINCT vec_id) FILTER (label>=5) AS n_hard,
 avg(pow(p-({_TRUTH}),2)) FILTER (label<5) AS mse, avg(-ln(greatest(p,1e-8))) FILTER (label>=5 AND k=label%8) AS nll FROM score_long GROUP BY 1"""


@query("eval_losses", f"SELECT epoch, n_soft, n_hard, round(mse,6) AS mse, round(nll,6) AS nll, round(mse+0.3*nll,6) AS loss FROM ({_CURVE})", ["score_long"])
def _(spark, sf):
    d = P.eval_losses(_with_truth(spark, sf).withColumnRenamed("state", "epoch"), 0.3, ["epoch"])
    return d.select("epoch", "n_soft", "n_hard", *[r6(c, c) for c in ("mse", "nll", "loss")])


def _curve(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.avg("value").alias("val_loss")).select(
        (F.datediff("day", F.lit("2024-01-01")) * 24 + F.col("hour")).alias("epoch"), "val_loss")


_HOURS = "SELECT date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts))::INT AS epoch, avg(value) AS val_loss FROM events GROUP BY 1"


@query("best_epochs", f"SELECT epoch, round(val_loss,6) AS val_loss FROM ({_HOURS}) ORDER BY val_loss, epoch LIMIT 3")
def _(spark, sf):
    return P.best_epochs(_curve(spark, sf)).withColumn("val_loss", r6("val_loss"))


@query("early_stop", f"""WITH c AS (SELECT *, row_number() OVER (ORDER BY epoch) AS i, min(val_loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({_HOURS}))
SELECT min(epoch) AS stop_epoch FROM (SELECT epoch, i - max(CASE WHEN before IS NULL OR val_loss<before THEN i END) OVER (ORDER BY epoch) AS waited FROM c) WHERE waited>=2""")
def _(spark, sf):
    return P.early_stop(_curve(spark, sf), 2)


@query("recon_error", """SELECT round(avg(pow(v-1.1::DOUBLE*v*v,2)),6) AS recon, count(*) AS n_values FROM token_dims WHERE ((vec_id*65536+dim)::HUGEINT*2654435761+4)%4294967296 < floor(0.3::DOUBLE*4294967296)""", ["token_dims"])
def _(spark, sf):
    t = fx.tokens(spark, sf).select("vec_id", F.col("feat").alias("x"), F.transform("feat", lambda v: 1.1 * v.cast("double") * v.cast("double")).alias("xhat"))
    return P.recon_error(t, "vec_id", seed=4, scheme="mul").select(r6("recon", "recon"), "n_values")


_DOM = """WITH l AS (SELECT vec_id, state, label-1 AS d, k, ln(p) AS logit, p FROM score_long WHERE label>=1 AND label<=8),
c AS (SELECT vec_id, state, -max(logit) FILTER (k=d) AS ce, 1+exp(sum(p*ln(p+1e-5))) AS w FROM l GROUP BY 1,2)"""


def _domain(spark, sf, weighted):
    d = fx.scores(spark, sf).withColumn("domain_id", F.when(F.col("label") > 8, -1).otherwise(F.col("label") - 1))
    return P.domain_loss(d, entropy_weighted=weighted).select(r6("domain_loss", "domain_loss"))


@query("domain_loss", _DOM + " SELECT round(avg(ce),6) AS domain_loss FROM c", ["score_long"])
def _(spark, sf):
    return _domain(spark, sf, False)


@query("domain_loss_weighted", _DOM + " SELECT round(avg(ce*w)/(avg(w)+1e-6),6) AS domain_loss FROM c", ["score_long"])
def _(spark, sf):
    return _domain(spark, sf, True)


@query("percentile_clip", """SELECT event_id, event_type, round(least(greatest(value,lo),hi),6) AS clipped, round(lo,6) AS vmin, round(hi,6) AS vmax FROM events
JOIN (SELECT event_type, quantile_cont(value,0.05) AS lo, quantile_cont(value,0.95) AS hi FROM events GROUP BY 1) USING (event_type)""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    d = P.percentile_clip(e, by=["event_type"], col="value")
    return d.select("event_id", "event_type", *[r6(c, c) for c in ("clipped", "vmin", "vmax")])


@query("dominant_class", "SELECT spot, arg_min(class_idx, (-p, class_idx))::INT AS class_idx FROM labels_full GROUP BY 1", ["labels_full"])
def _(spark, sf):
    return P.dominant_class(fx.label_table(spark, sf), p="y").select("spot", "class_idx")


@query("composition", """WITH d AS (SELECT spot, domain_id, arg_min(class_idx, (-p, class_idx)) AS class_idx FROM labels_full GROUP BY 1,2)
SELECT domain_id AS sample, class_idx::INT AS class_idx, ctype, count(*) AS n, round(count(*)/sum(count(*)) OVER (PARTITION BY domain_id),6) AS share FROM d JOIN vocab USING (class_idx) GROUP BY 1,2,3""", ["labels_full", "vocab"])
def _(spark, sf):
    d = fx.label_table(spark, sf).withColumnRenamed("domain_id", "sample")
    return P.composition(d, fx.vocab(spark, sf), p="y").withColumn("share", r6("share"))


@query("lognormal_moments", "SELECT event_id, round(exp(value/100+value/400*0.5),6) AS ln_mean, round((exp(value/400)-1)*exp(value/100*2+value/400),6) AS ln_variance FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("value") / 100).alias("mean"), (F.col("value") / 400).alias("variance"))
    return P.lognormal_moments(e).select("event_id", r6("ln_mean", "ln_mean"), r6("ln_variance", "ln_variance"))


@query("conditional_outer", "SELECT vec_id, (k*64+dim)::INT AS pos, round(p*v/8.0,6)+0.0 AS v FROM (SELECT * FROM score_long WHERE state=1) s JOIN token_dims USING (vec_id)", ["score_long", "token_dims"])
def _(spark, sf):
    d = fx.scores(spark, sf).where("state = 1").join(fx.tokens(spark, sf).select("vec_id", "feat"), "vec_id")
    return d.select("vec_id", F.posexplode(outer_scaled("p", doubles("feat"))).alias("pos", "v")).withColumn("v", r6("v"))


# --- patches scored by a fixed linear model ---------------------------------
@query("score_patches", """WITH x AS (SELECT vec_id, dim, (v-(ARRAY[0.1,0.2,0.3,0.4])[dim%4+1]::DOUBLE)/0.5 AS v FROM token_dims),
c AS (SELECT vec_id, 'cls' AS kind, d AS dim, sum(v*((x.dim*3+d)%5-2)/10.0::DOUBLE) AS v FROM x, generate_series(0,2) t(d) GROUP BY 1,2,3),
l AS (SELECT vec_id, 'local' AS kind, (dim//4//4//2)*2*4 + (dim//4%4//2)*4 + dim%4 AS dim, avg(v) AS v FROM x GROUP BY 1,2,3)
SELECT vec_id, kind, dim::INT AS dim, round(v,4)+0.0 AS v FROM (SELECT * FROM c UNION ALL SELECT * FROM l)""", ["token_dims"])
def _(spark, sf):
    def make_model():
        import numpy as np

        i, d = np.arange(64)[:, None], np.arange(3)[None]
        w = ((i * 3 + d) % 5 - 2) / 10.0

        def model(x):
            n = len(x)
            return x.reshape(n, 64) @ w, x.reshape(n, 2, 2, 2, 2, 4).mean(axis=(2, 4))

        return model

    p = fx.tokens(spark, sf).select("vec_id", F.col("feat").alias("pixels"))
    d = P.score_patches(p, make_model, (4, 4, 4), (0.1, 0.2, 0.3, 0.4), (0.5, 0.5, 0.5, 0.5), (2, 2, 4))
    flat = d.select("vec_id", "cls", F.flatten(F.flatten("local")).alias("local"))
    long = lambda c: flat.select("vec_id", F.lit(c).alias("kind"), F.posexplode(c).alias("dim", "v"))
    return long("cls").unionByName(long("local")).withColumn("v", F.round(F.col("v").cast("double"), 4) + F.lit(0.0))


# --- whole cell path ---------------------------------------------------------
@query("hard_examples", """WITH v AS (SELECT (dense_rank() OVER (ORDER BY s)-1)::INT AS class_idx, s FROM (SELECT DISTINCT c_mktsegment AS s FROM customer WHERE c_mktsegment<>'MACHINERY')),
qc AS (SELECT o_custkey AS cell_id FROM orders GROUP BY 1 HAVING sum(o_totalprice)>=1000000 AND count(DISTINCT o_orderpriority)>=4),
c AS (SELECT DISTINCT p.sample, p.cell_id, class_idx FROM pairs p JOIN customer ON c_custkey=p.cell_id JOIN v ON c_mktsegment=s WHERE p.cell_id IN (SELECT cell_id FROM qc)),
s AS (SELECT class_idx, count(*) AS n, sum(count(*)) OVER () AS t FROM c GROUP BY 1), q AS (SELECT *, 200.0::DOUBLE*n/t AS q FROM s),
a AS (SELECT class_idx, floor(q) + CASE WHEN row_number() OVER (ORDER BY q-floor(q) DESC, class_idx::VARCHAR) <= 200-sum(floor(q)) OVER () THEN 1 ELSE 0 END AS k FROM q),
ch AS (SELECT * FROM (SELECT c.*, k, row_number() OVER (PARTITION BY class_idx ORDER BY (cell_id::HUGEINT*2654435761+1)%4294967296, cell_id) AS r FROM c JOIN a USING (class_idx)) WHERE r<=k),
r AS (SELECT p.sample, p.cell_id, p.bin_id, class_idx, row_number() OVER (PARTITION BY p.cell_id ORDER BY (bin_id::HUGEINT*2654435761+1)%4294967296, bin_id) AS hr, row_number() OVER (PARTITION BY p.cell_id ORDER BY bin_id) AS br, count(*) OVER (PARTITION BY p.cell_id) AS k FROM pairs p JOIN ch USING (cell_id))
SELECT sample, cell_id, class_idx, p::INT AS pos, bin_id FROM r, generate_series(0,4) t(p) WHERE CASE WHEN k>=5 THEN hr=p+1 ELSE br=p%k+1 END""", ["pairs"])
def _(spark, sf):
    cells = fx.cells(spark, sf)
    ann = cells.where("cell_state <> 'MACHINERY'").select("sample", "cell_id", "cell_state")
    counts = table(spark, sf, "orders").groupBy(
        F.lit("s0").alias("sample"), F.col("o_custkey").alias("cell_id"), F.col("o_orderpriority").alias("gene")
    ).agg(F.sum("o_totalprice").alias("cnt"))
    names = ann.select("cell_state").distinct()
    mapping = names.select(F.col("cell_state").alias("fine"), F.col("cell_state").alias("coarse"))
    vocab = rank_domains(names, "cell_state", "class_idx").withColumnRenamed("cell_state", "ctype")
    d = hard_examples(cells.drop("cell_state"), ann, mapping, counts, fx.bins(spark, sf), vocab, 4, 10, 5, 200, seed=1, scheme="mul", min_counts=1_000_000, min_genes=4)
    return d.select("sample", "cell_id", "class_idx", "pos", "bin_id")
