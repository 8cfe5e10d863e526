"""Training-subset selection: entropy strata, budgets, k-center cover, domain weights, resampling."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.arrays import argmax_first, doubles, entropy
from ..plans.scale import attach, attach_row, exact_quantiles, global_index, hash32, reread, settle, take_smallest


def entropy_bins(labels, n=3, y="y", by="domain_id"):
    """Label entropy, quantile bin of the entropy within the domain, and first-argmax class."""
    d = labels.withColumns({"entropy": entropy(y), "cls": argmax_first(y)})
    inner = [i / n for i in range(1, n)]
    if not inner:
        return d.withColumn("ebin", F.lit(0))
    names = [f"_e{i}" for i in range(len(inner))]
    d = reread(d)
    edges = exact_quantiles(d.select(by, "entropy"), [by], "entropy", inner, names)
    # the outermost edges lie beyond every value, so only inner edges decide
    b = sum((F.when(F.col("entropy") >= F.col(nm), 1).otherwise(0) for nm in names), F.lit(0))
    return attach(d, edges, by).withColumn("ebin", b.cast("int")).drop(*names)


def coreset_budget(labels, frac=0.25, by="domain_id"):
    """Rows to keep per domain: max(1, round(K n_d / N)) with K = max(1, ceil(frac N)).

    Rounding is half to even. Unknown domains (< 0) get no budget but count in N.
    """
    per = labels.groupBy(by).agg(F.count(F.lit(1)).alias("n_domain"))
    tot = per.agg(F.sum("n_domain").alias("_all"))
    keep = F.greatest(F.lit(1), F.ceil(F.lit(float(frac)) * F.col("_all")))
    return attach_row(per, tot).where(F.col(by) >= 0).select(
        by, "n_domain",
        F.greatest(F.lit(1), F.rint(keep * F.col("n_domain") / F.col("_all"))).cast("long").alias("budget"),
    )


def stratum_allocation(strata, by="domain_id", keys=("cls", "ebin")):
    """Rows per stratum: max(1, round(K n_s / N)), then settled to sum to K.

    ``strata`` has (by, *keys, n_s, n_domain, budget). Missing rows go to the
    strata furthest below their share, surplus is taken one row at a time from
    those furthest above it, never below one row. With more strata than budget
    every stratum keeps one row. Strata are classes times entropy bins: a few
    hundred rows per domain at most.
    """
    keys = list(keys)
    share = F.col("budget") * F.col("n_s") / F.col("n_domain")
    s = strata.withColumn("_share", share).withColumn("_a", F.greatest(F.lit(1), F.rint("_share")).cast("long"))
    dom = Window.partitionBy(by)
    s = s.withColumn("_drift", F.col("budget") - F.sum("_a").over(dom))
    gap = Window.partitionBy(by).orderBy(F.desc(F.col("_share") - F.col("_a")), *keys)
    s = s.withColumn("_a", F.col("_a") + F.when(F.row_number().over(gap) <= F.col("_drift"), 1).otherwise(0))
    units = s.where((F.col("_drift") < 0) & (F.col("_a") > 1)).select(
        by, *keys, "_share", "_a", "_drift",
        F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("_a") - 1, -F.col("_drift")))).alias("_u"),
    )
    over = Window.partitionBy(by).orderBy(F.desc(F.col("_a") - (F.col("_u") - 1) - F.col("_share")), *keys)
    cut = units.withColumn("_r", F.row_number().over(over)).where(F.col("_r") <= -F.col("_drift")).groupBy(by, *keys).agg(
        F.count(F.lit(1)).alias("_cut")
    )
    return s.join(cut, [by, *keys], "left").select(
        by, *keys, "n_s", (F.col("_a") - F.coalesce("_cut", F.lit(0))).alias("alloc")
    )


def coreset_stratified(labels, frac=0.25, seed=0, ids="spot", y="y", by="domain_id", bins=3, scheme="xx"):
    """Keys kept by (class, entropy-bin) strata within each domain; at most a stratum's own size."""
    d = settle(entropy_bins(labels, bins, y, by).select(by, ids, "cls", "ebin"))
    budget = coreset_budget(d, frac, by)
    strata = d.where(F.col(by) >= 0).groupBy(by, "cls", "ebin").agg(F.count(F.lit(1)).alias("n_s")).join(budget, by)
    alloc = settle(stratum_allocation(strata, by)).withColumnRenamed("alloc", "n")
    d = d.withColumn("_h", hash32(ids, seed, scheme))
    return take_smallest(d, [by, "cls", "ebin"], "_h", [ids], alloc).drop("_h")


def coreset_kcenter(labels, frac=0.25, seed=0, ids="spot", y="y", by="domain_id", levels=12, scheme="xx"):
    """Keys that cover label space, ``coreset_budget`` per domain, by one rule at every size.

    Farthest-first choice is sequential, so a net takes its place: label vectors are
    cut into cells of side 2**-level. The finest level (at most ``levels``) whose occupied
    cells fit the budget gives the row of smallest hash of every cell, those of
    the next finer level come next, then all others in hash order. Every row of a domain is
    within one cell diagonal, sqrt(width) * 2**-level, of a kept row, where that level exists.
    """
    d = settle(labels.select(by, ids, doubles(y).alias("_y")))
    budget = settle(coreset_budget(d, frac, by))
    known = d.join(budget.select(by), by, "left_semi").withColumn("_h", hash32(ids, seed, scheme))

    def cell(level):
        return F.transform("_y", lambda v: F.floor(v * F.pow(F.lit(2.0), level)).cast("long"))

    # all levels in one pass; cells nest, so their number never falls
    every = known.select(by, F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("_lv"), "_y")
    occupied = every.select(by, "_lv", cell(F.col("_lv")).alias("_c")).distinct().groupBy(by, "_lv").agg(F.count(F.lit(1)).alias("_n"))
    fits = settle(budget.join(occupied, by).groupBy(by, "budget").agg(
        F.coalesce(F.max(F.when(F.col("_n") <= F.col("budget"), F.col("_lv"))), F.lit(0)).alias("_lv")
    ))
    at = settle(known.join(fits.select(by, "_lv"), by))

    def first(extra):
        best = at.groupBy(by, cell(F.col("_lv") + extra).alias("_c")).agg(F.min(F.struct("_h", ids)).alias("_m"))
        return best.select(by, F.col(f"_m.{ids}").alias(ids), F.lit(extra).alias("_t"))

    tier = first(0).unionByName(first(1)).groupBy(by, ids).agg(F.min("_t").alias("_t"))
    ranked = at.select(by, ids, "_h").join(tier, [by, ids], "left").withColumn(
        "_h", F.coalesce("_t", F.lit(2)).cast("long") * 1073741824 + F.shiftright("_h", 2)
    )
    kept = take_smallest(ranked.select(by, ids, "_h"), [by], "_h", [ids], budget.select(by, F.col("budget").alias("n")))
    return kept.select(by, ids)


def domain_counts(examples, by="domain_id"):
    """Examples per known domain."""
    return examples.where(F.col(by) >= 0).groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def inverse_weights(examples, by="domain_id", out="weight"):
    """1 / n(domain); 1.0 for unknown domains, and for all when fewer than two domains are known."""
    n = domain_counts(examples, by)
    d = attach_row(attach(examples, n.withColumnRenamed("n", "_n"), by), n.agg(F.count(F.lit(1)).alias("_nd")))
    return d.withColumn(
        out, F.when((F.col("_nd") >= 2) & F.col("_n").isNotNull(), F.lit(1.0) / F.col("_n")).otherwise(1.0)
    ).drop("_n", "_nd")


def weighted_resample(examples, n, seed=0, ids="id", by="domain_id", scheme="xx"):
    """``n`` draws with replacement, each row weighted by ``inverse_weights``.

    A known domain has total weight 1 and an unknown row weight 1, so a draw picks a
    slot among domains and unknown rows, then a position inside it; rows are found
    by an equi-join on their global position.
    """
    examples = reread(examples.select(ids, by))
    nd = domain_counts(examples, by).agg(F.count(F.lit(1)).alias("_nd"))
    d = attach_row(examples.select(ids, by), nd).withColumn(
        "_g", F.when((F.col("_nd") >= 2) & (F.col(by) >= 0), F.col(by)).otherwise(-1)
    )
    rows = settle(global_index(d.select(ids, by, "_g"), ["_g", ids], "_pos"))
    grp = settle(rows.groupBy("_g").agg(F.min("_pos").alias("_off"), F.count(F.lit(1)).alias("_n")))
    # one row per domain; unknown rows take the last slot
    known = F.col("_g") >= 0
    grp = grp.withColumn("_slot", F.when(known, F.row_number().over(Window.partitionBy(known).orderBy("_g")) - 1))
    tot = grp.agg(
        F.count(F.when(known, 1)).alias("_d"), F.coalesce(F.sum(F.when(~known, F.col("_n"))), F.lit(0)).alias("_u")
    )
    grp = attach_row(grp, tot).select(
        F.coalesce(F.col("_slot"), F.col("_d")).cast("long").alias("_slot"), "_off", "_n"
    )
    draws = examples.sparkSession.range(n).withColumnRenamed("id", "draw")
    # fixed value: multiplier that decorrelates the second arithmetic draw
    u1 = hash32("draw", seed, scheme) / 4294967296.0
    u2 = hash32(F.col("draw") * 69069 + 1, seed, scheme) / 4294967296.0
    draws = attach_row(draws.withColumns({"_u1": u1, "_u2": u2}), tot).withColumn(
        "_x", F.floor(F.col("_u1") * (F.col("_d") + F.col("_u")))
    ).withColumn("_slot", F.least(F.col("_x"), F.col("_d")))
    draws = attach(draws, grp, "_slot", "inner").withColumn(
        "_pos",
        F.col("_off") + F.when(F.col("_slot") < F.col("_d"), F.floor(F.col("_u2") * F.col("_n"))).otherwise(F.col("_x") - F.col("_d")),
    )
    return draws.select("draw", "_pos").join(rows, "_pos").select("draw", ids, by)
