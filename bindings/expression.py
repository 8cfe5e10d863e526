"""Counts, reference profiles and proportions."""

from slideloom.operators import cells as Q, counts as C

from . import fixtures as fx
from .fixtures import r6
from .registry import query


@query("collapse_duplicates", "SELECT sample, spot, gene, cnt FROM counts", ["counts"])
def _(spark, sf):
    return C.collapse_duplicates(fx.raw_counts(spark, sf))


@query("qc_cells", "SELECT sample, spot, gene, cnt FROM counts WHERE (sample, spot) IN (SELECT (sample, spot) FROM counts GROUP BY sample, spot HAVING sum(cnt)>=50 AND count(*) FILTER (cnt>0)>=2)", ["counts"])
def _(spark, sf):
    return Q.qc_cells(fx.counts(spark, sf), 50, 2, cell=("sample", "spot")).select("sample", "spot", "gene", "cnt")


@query("min_umi_reference", "SELECT sample, cell, gene, cnt FROM ref_counts WHERE (sample, cell) IN (SELECT (sample, cell) FROM ref_counts GROUP BY sample, cell HAVING sum(cnt)>=250)", ["ref_counts"])
def _(spark, sf):
    return C.min_umi_reference(fx.ref_counts(spark, sf), 250).select("sample", "cell", "gene", "cnt")


_PROFILE = """SELECT {g} ctype, gene, sum(cnt)/any_value(n) AS mu FROM ref_counts JOIN ref_labels USING (sample, cell)
 JOIN (SELECT {g} ctype, count(*) AS n FROM ref_labels WHERE (sample, cell) IN (SELECT (sample, cell) FROM ref_counts) GROUP BY ALL) USING ({g} ctype) GROUP BY ALL"""


def _profile(spark, sf, group=None):
    return C.reference_profile(fx.ref_counts(spark, sf), fx.ref_labels(spark, sf), group)


@query("reference_profile", f"SELECT ctype, gene, round(mu,6) AS mu FROM ({_PROFILE.format(g='')})", ["ref_counts", "ref_labels"])
def _(spark, sf):
    return _profile(spark, sf).withColumn("mu", r6("mu"))


@query("reference_profile_group", f"SELECT grp, ctype, gene, round(mu,6) AS mu FROM ({_PROFILE.format(g='grp,')})", ["ref_counts", "ref_labels"])
def _(spark, sf):
    return _profile(spark, sf, "grp").withColumn("mu", r6("mu"))


@query("normalise_weights", "SELECT sample, spot, gene, round(cnt/sum(cnt) OVER (PARTITION BY sample, spot),6) AS p FROM counts", ["counts"])
def _(spark, sf):
    return C.normalise_weights(fx.counts(spark, sf), col="cnt").select("sample", "spot", "gene", r6("p", "p"))


@query("reference_profile_sample", f"SELECT sample, ctype, gene, round(mu,6) AS mu FROM ({_PROFILE.format(g='sample,')})", ["ref_counts", "ref_labels"])
def _(spark, sf):
    return _profile(spark, sf, "sample").withColumn("mu", r6("mu"))


def _em(iters, per=""):
    """SQL of the EM rounds; ``per`` is 'sample, ' for a profile of each sample."""
    on = f"({per}gene)"
    out = f"""WITH profile AS ({_PROFILE.format(g=per)}), tot AS (SELECT {per} ctype, sum(mu) AS s FROM profile GROUP BY ALL),
 sp AS (SELECT DISTINCT sample, spot FROM counts JOIN profile USING {on} WHERE cnt>0),
 w0 AS (SELECT sp.sample, spot, ctype, 1.0::DOUBLE/count(*) OVER (PARTITION BY sp.sample, spot) AS w FROM sp JOIN tot ON {'sp.sample=tot.sample' if per else 'true'})"""
    for i in range(iters):
        out += f""", h{i} AS (SELECT c.sample, c.spot, c.gene, any_value(c.cnt) AS cnt, sum(w*mu) AS hat FROM counts c JOIN profile p USING {on} JOIN w{i} w ON w.sample=c.sample AND w.spot=c.spot AND w.ctype=p.ctype WHERE cnt>0 GROUP BY 1,2,3)
 , u{i} AS (SELECT h.sample, h.spot, p.ctype, sum(cnt/hat*mu) AS g FROM h{i} h JOIN profile p USING {on} WHERE hat>0 GROUP BY 1,2,3)
 , w{i + 1} AS (SELECT w.sample, w.spot, w.ctype, w.w*coalesce(g,0)/s AS w FROM w{i} w JOIN tot USING ({per}ctype) LEFT JOIN u{i} u ON u.sample=w.sample AND u.spot=w.spot AND u.ctype=w.ctype)"""
    return out + f" SELECT sample, spot, ctype, round(w/sum(w) OVER (PARTITION BY sample, spot),6) AS p FROM w{iters}"


@query("deconvolve", _em(4), ["counts", "ref_counts", "ref_labels"])
def _(spark, sf):
    return C.deconvolve(fx.counts(spark, sf), _profile(spark, sf), 4).select("sample", "spot", "ctype", r6("p", "p"))


@query("deconvolve_sample", _em(4, "sample, "), ["counts", "ref_counts", "ref_labels"])
def _(spark, sf):
    d = C.deconvolve(fx.counts(spark, sf), _profile(spark, sf, "sample"), 4, per="sample")
    return d.select("sample", "spot", "ctype", r6("p", "p"))
