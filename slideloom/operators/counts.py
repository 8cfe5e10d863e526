"""Sparse counts in long form: collapsing, reference profiles, proportions, deconvolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.scale import attach_row, beside, dealt, reread, settle


def names(keys):
    """A column name or several as a list."""
    return [keys] if isinstance(keys, str) else list(keys)


def min_umi_reference(counts, min_umi=10, cell=("sample", "cell"), cnt="cnt"):
    """Counts of reference cells whose total reaches ``min_umi``."""
    cell = names(cell)
    keep = counts.groupBy(*cell).agg(F.sum(cnt).alias("_t")).where(F.col("_t") >= min_umi).select(*cell)
    return counts.join(keep, cell, "left_semi")


def collapse_duplicates(counts, keys=("sample", "spot", "gene"), cnt="cnt"):
    """Sum rows that share a gene symbol."""
    return counts.groupBy(*keys).agg(F.sum(cnt).alias(cnt))


def reference_profile(counts, labels, group=None, min_umi=None, cell=("sample", "cell"), broadcast_rows=500_000):
    """Mean count per (group,) cell type and gene; cells without the gene count as zero.

    ``counts(*cell, gene, cnt)``, ``labels(*cell, ctype[, group])`` with one row per cell;
    ``group`` names a column or several, such as the sample for a profile of each. Counts and labels
    meet in tasks of bounded size, dealt by cell; a side of over ``broadcast_rows`` rows is never broadcast.
    """
    cell = names(cell)
    c = reread(min_umi_reference(counts, min_umi, cell) if min_umi else counts)
    by = (names(group) if group else []) + ["ctype"]
    labels = labels.select(*dict.fromkeys([*cell, *by]))
    n = labels.count()
    rows = max(c.count(), n)
    known = settle(dealt(c.select(*cell), cell, rows).distinct())
    own = dealt(labels, cell, rows).join(beside(known, cell, rows, known.count(), broadcast_rows=broadcast_rows), cell, "left_semi")
    cells = own.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    typed = dealt(c, cell, rows).join(beside(labels, cell, rows, n, broadcast_rows=broadcast_rows), cell)
    sums = typed.groupBy(*by, "gene").agg(F.sum("cnt").alias("_s"))
    return sums.join(cells, by).select(*by, "gene", (F.col("_s") / F.col("_n")).alias("mu"))


def normalise_weights(w, by=("sample", "spot"), col="weight", out="p"):
    """Weights divided by their sum per spot; NULL where the sum is zero. A spot has one row per class."""
    tot = w.groupBy(*by).agg(F.sum(col).alias("_t"))
    return w.join(tot, list(by)).withColumn(out, F.col(col) / F.nullif(F.col("_t"), F.lit(0.0))).drop("_t")


def deconvolve(counts, profile, iters=50, spot=("sample", "spot"), per=(), rows_per_task=40_000, carried_bytes=64_000_000):
    """Cell-type proportions of each spot for a fixed profile, by EM for a Poisson mixture.

    w_k <- w_k (sum_g y_g mu_gk / yhat_g) / (sum_g mu_gk), from equal weights.
    ``counts`` has one row per (*spot, gene). ``per`` names columns of the profile, among those of
    ``spot``, for which it differs (a profile per sample, say); a type without genes in a profile gets weight 0 there. Spots are grouped by
    hash into tasks of about ``rows_per_task`` counts, so the iterations need no shuffle. One profile for
    all of at most ``carried_bytes`` (genes x types x 8) travels with the tasks; others join on gene.
    ``delta`` is the last change of the weights. Genes outside the profile are
    ignored; spots without any shared gene are absent.
    """
    spot, per = names(spot), names(per)
    profile = settle(profile.select(*per, "gene", "ctype", "mu"))
    counts = reread(counts.select(*spot, "gene", "cnt").where(F.col("cnt") > 0))
    types = [r[0] for r in profile.select("ctype").distinct().orderBy("ctype").collect()]  # one row per class
    dense = lambda m: F.transform(F.array(*[F.lit(c) for c in types]), lambda c: F.coalesce(m[c], F.lit(0.0)))
    by_gene = profile.groupBy(*per, "gene").agg(F.map_from_entries(F.collect_list(F.struct("ctype", F.col("mu").cast("double")))).alias("_m"))
    by_gene = by_gene.select(*per, "gene", dense(F.col("_m")).alias("_mu"))
    sums = profile.groupBy(*per, "ctype").agg(F.sum("mu").cast("double").alias("_s"))
    sums = sums.groupBy(*per).agg(dense(F.map_from_entries(F.collect_list(F.struct("ctype", "_s")))).alias("_total"))
    tasks = max(1, -(-counts.count() // rows_per_task))
    d = counts.withColumn("_t", F.pmod(F.xxhash64(*spot), F.lit(tasks)))
    small = not per and profile.select("gene").distinct().count() * len(types) * 8 <= carried_bytes
    if small:
        table = by_gene.toPandas()
        total = list((sums.first() or {"_total": []})["_total"])
        d = d.join(F.broadcast(by_gene.select("gene")), "gene", "left_semi")
    else:
        d = d.join(by_gene, [*per, "gene"])
        d = d.join(sums, per) if per else attach_row(d, sums)

    def fit(pdf):
        import numpy as np
        import pandas as pd

        first = ~pdf.duplicated(spot)
        spots = pdf.loc[first, spot].reset_index(drop=True)
        si = pd.MultiIndex.from_frame(spots).get_indexer(pd.MultiIndex.from_frame(pdf[spot]))
        order = np.argsort(si, kind="stable")
        si = si[order]
        begin = np.searchsorted(si, np.arange(len(spots)))
        if small:
            mu = np.stack(table["_mu"].to_numpy())[pd.Index(table["gene"]).get_indexer(pdf["gene"])][order]
            tot = np.tile(np.asarray(total, dtype=float), (len(spots), 1))
        else:
            mu = np.stack(pdf["_mu"].to_numpy()[order])
            tot = np.stack(pdf.loc[first, "_total"].to_numpy())
        y = pdf["cnt"].to_numpy(dtype=float)[order]
        w = np.where(tot > 0, 1.0, 0.0)
        w /= w.sum(axis=1, keepdims=True)
        delta = np.zeros(len(spots))
        for _ in range(iters):
            hat = (w[si] * mu).sum(axis=1)
            ratio = np.divide(y, hat, out=np.zeros_like(y), where=hat > 0)
            new = w * np.add.reduceat(ratio[:, None] * mu, begin) / np.where(tot > 0, tot, 1.0)
            delta = np.abs(new - w).max(axis=1)
            w = new
        s = w.sum(axis=1, keepdims=True)
        p = np.divide(w, s, out=np.full_like(w, np.nan), where=s > 0)
        out = spots.loc[np.repeat(np.arange(len(spots)), len(types))].reset_index(drop=True)
        return out.assign(ctype=np.tile(types, len(spots)), weight=w.ravel(), p=p.ravel(), delta=np.repeat(delta, len(types)))

    kinds = ", ".join(f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in spot)
    ck = profile.schema["ctype"].dataType.simpleString()
    return d.groupBy("_t").applyInPandas(fit, f"{kinds}, ctype {ck}, weight double, p double, delta double")
