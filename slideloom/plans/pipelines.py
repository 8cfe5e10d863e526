"""Whole workflows as single compositions of operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as C, coreset as K, grid as G, ml as M, predict as P, spots as S, tiles as T
from .scale import settle


def tissue_mask(pixels, slides, tile=16, bins=None, density=100.0, levels=64, min_size=None, clusters=4, rescue=2):
    """Keep mask over tiles: (sample, row, col, low_density, low_ratio, keep).

    Tiles in sparse regions of the intensity plane are flagged; those whose texture
    cluster has one of the lowest scores are rescued; Otsu on the contrast ratio flags
    flat tiles; small components can be dropped last (off unless ``min_size`` is given).
    Samples with fewer than two textured candidates skip the rescue. One row per tile
    is written between the pixel stages and the rest; per-sample values are joined as they are.
    """
    t = settle(T.contrast_ratio(T.weighted_intensity(settle(T.tile_stats(pixels, slides, tile)))))
    t = settle(T.density_flag(t, bins, density))
    cand = T.colour_artefact(t.where("low_density")).where(~F.col("artefact")).select("sample", "row", "col")
    enough = cand.groupBy("sample").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 2).select("sample")
    cand = settle(cand.join(enough, "sample", "left_semi"))
    if not cand.isEmpty():
        tex = settle(T.glcm_texture(pixels, cand, levels, tile).select("sample", "row", "col", "energy", "homogeneity", "entropy"))
        tex = T.minmax_normalise(tex, ("energy", "homogeneity", "entropy")).fillna(0.0)
        lab = settle(M.gmm(tex, k=clusters))
        low = T.lowest_score_clusters(T.cluster_scores(lab), rescue).select("sample", "cluster")
        saved = lab.join(low, ["sample", "cluster"], "left_semi").select("sample", "row", "col", F.lit(True).alias("_saved"))
        t = t.join(saved, ["sample", "row", "col"], "left").withColumn(
            "low_density", F.col("low_density") & F.col("_saved").isNull()
        ).drop("_saved")
    t = T.ratio_filter(settle(t))
    out = t.select("sample", "row", "col", "low_density", "low_ratio").withColumn("keep", ~F.col("low_density") & ~F.col("low_ratio"))
    if min_size:
        big = G.remove_small_components(out.where("keep"), min_size).withColumn("_big", F.lit(True))
        out = out.join(big, ["sample", "row", "col"], "left").withColumn("keep", F.col("keep") & F.col("_big").isNotNull()).drop("_big")
    return out


def soft_examples(props, vocab, spots, tokens, domains, r, frac=0.25, strategy="stratified", seed=0, ids=None, scheme="xx"):
    """Labels first, tokens only for the kept spots: (sample, spot, domain_id, y, tokens).

    ``props(sample, spot, ctype, p)``, ``spots(sample, spot, row, col)`` on the grid. ``ids``
    names a column whose values no two samples share; the default makes one of sample and spot.
    """
    from ..operators.samples import domain_join

    lab = settle(domain_join(S.label_vectors(props, vocab, ["sample", "spot"]), domains).withColumn(
        "key", F.concat_ws("/", "sample", F.col("spot").cast("string"))
    ))
    ids = ids or "key"
    pick = K.coreset_kcenter if strategy == "kcenter" else K.coreset_stratified
    kept = settle(pick(lab, frac, seed, ids=ids, scheme=scheme).select(ids))
    lab = lab.join(kept, ids, "left_semi")
    at = spots.join(lab.select("sample", "spot"), ["sample", "spot"], "left_semi")
    tok = G.finite_examples(G.disk_tokens(at, tokens, r))
    return lab.select("sample", "spot", "domain_id", "y").join(tok, ["sample", "spot"])


def hard_examples(cells, ann, mapping, counts, bins, vocab, n_classes, r, t, target, seed=0, scheme="xx", min_counts=50, min_genes=20):
    """Cell path: annotate, filter, label, map bins, sample cells, choose tokens.

    ``counts(sample, cell_id, gene, cnt)`` decides which cells pass. Returns (sample, cell_id, class_idx, pos, bin_id); features join on bin_id last.
    """
    c = C.annotate_cells(cells, ann, mapping)
    if counts is not None:
        ok = C.qc_cells(counts, min_counts, min_genes, ("sample", "cell_id")).select("sample", "cell_id").distinct()
        c = c.join(ok, ["sample", "cell_id"], "left_semi")
    c = settle(C.label_matrix(c, vocab, n_classes))
    # any one bin makes a candidate; bins are looked for again only around the cells chosen, and pairs are never made
    some = C.near_lists(c.where("valid"), bins, r, "first", 1).select("sample", "cell_id").distinct()
    cand = c.where("valid").join(some, ["sample", "cell_id"], "left_semi")
    chosen = settle(C.stratified_cells(cand.select("sample", "cell_id", "class_idx"), target, "class_idx", seed=seed, scheme=scheme))
    kept = c.where("valid").join(chosen.select("sample", "cell_id"), ["sample", "cell_id"], "left_semi")
    tok = C.pad_or_sample_near(kept, bins, r, t, seed=seed, scheme=scheme)
    return tok.join(chosen.select("sample", "cell_id", "class_idx"), ["sample", "cell_id"])


def predict_grid(tokens, states, mask=None, median="average"):
    """Score masked tokens under every state and combine the states in the same task: no shuffle."""
    kept = G.apply_mask(tokens, mask) if mask is not None else tokens
    return P.score_tokens(kept, states, combine=median)
