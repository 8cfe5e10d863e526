"""Tile statistics and the filters that build a tissue mask."""

from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from ..plans.scale import attach, exact_quantiles, reread, settle


def tile_stats(pixels, slides, tile=16):
    """Population sd over all pixels and channels, and mean R, G, B, per tile.

    Slides that are no multiple of ``tile`` act as if their last row and column
    repeated: those pixels just count more often.
    """
    geo = slides.select("sample", F.col("height").alias("_h"), F.col("width").alias("_w"))
    pad = lambda side: F.pmod(F.lit(tile) - F.pmod(F.col(side), F.lit(tile)), F.lit(tile))
    times = lambda c, side: F.when(F.col(c) == F.col(side) - 1, pad(side) + 1).otherwise(1)
    d = attach(pixels, geo, "sample", "inner").withColumn("_n", times("y", "_h") * times("x", "_w"))
    n, v = F.col("_n"), lambda c: F.col(c).cast("long")
    g = d.groupBy(
        "sample", F.floor(F.col("y") / tile).alias("row"), F.floor(F.col("x") / tile).alias("col")
    ).agg(
        F.sum(n).alias("_k"), *[F.sum(n * v(c)).alias(f"_{c}") for c in "rgb"],
        F.sum(n * (v("r") * v("r") + v("g") * v("g") + v("b") * v("b"))).alias("_q"),
    )
    k = F.col("_k")
    mean = (F.col("_r") + F.col("_g") + F.col("_b")) / (3 * k)
    return g.select(
        "sample", "row", "col",
        F.sqrt(F.greatest(F.col("_q") / (3 * k) - mean * mean, F.lit(0.0))).alias("sd"),
        (F.col("_r") / k).alias("mr"), (F.col("_g") / k).alias("mg"), (F.col("_b") / k).alias("mb"),
    )


def weighted_intensity(tiles):
    """z: tile colour means weighted by each channel's population variance over the sample."""
    tiles = reread(tiles)
    var = tiles.groupBy("sample").agg(*[F.var_pop(f"m{c}").alias(f"_v{c}") for c in "rgb"])
    total = F.col("_vr") + F.col("_vg") + F.col("_vb")
    z = (F.col("mr") * F.col("_vr") + F.col("mg") * F.col("_vg") + F.col("mb") * F.col("_vb")) / F.nullif(total, F.lit(0.0))
    return tiles.join(var, "sample", "left").withColumn("z", z).drop("_vr", "_vg", "_vb")


def minmax_normalise(df, col, plus_one=False, out=None, by="sample"):
    """(x - min) / (max - min) per sample, optionally + 1; NULL where the range is zero. NULLs are ignored.

    ``col`` is a column or several, which share one pass; ``out`` names the results.
    """
    cols = [col] if isinstance(col, str) else list(col)
    names = cols if out is None else [out] if isinstance(out, str) else list(out)
    df = reread(df)
    rng = df.groupBy(by).agg(*[f(c).alias(f"_{n}{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))])
    v = lambda i, c: (F.col(c) - F.col(f"_lo{i}")) / F.nullif(F.col(f"_hi{i}") - F.col(f"_lo{i}"), F.lit(0.0))
    joined = df.join(rng, by, "left")
    joined = joined.withColumns({n: v(i, c) + 1 if plus_one else v(i, c) for i, (n, c) in enumerate(zip(names, cols))})
    return joined.drop(*[f"_{n}{i}" for i in range(len(cols)) for n in ("lo", "hi")])


def contrast_ratio(tiles):
    """minmax((minmax(sd) + 1) / (minmax(z) + 1)) per sample; tiles carry sd and z."""
    tiles = reread(tiles)
    rng = tiles.groupBy("sample").agg(
        F.min("sd").alias("_a"), F.max("sd").alias("_b"), F.min("z").alias("_c"), F.max("z").alias("_d")
    )
    sd = (F.col("sd") - F.col("_a")) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0.0)) + 1
    z = (F.col("z") - F.col("_c")) / F.nullif(F.col("_d") - F.col("_c"), F.lit(0.0)) + 1
    d = tiles.join(rng, "sample", "left").withColumns({"sd_norm": sd, "z_norm": z}).withColumn(
        "ratio", F.col("sd_norm") / F.col("z_norm")
    ).drop("_a", "_b", "_c", "_d")
    # the ratio is cheap: its range is taken from a second pass over the tiles
    top = d.groupBy("sample").agg(F.min("ratio").alias("_lo"), F.max("ratio").alias("_hi"))
    return d.join(top, "sample", "left").withColumn(
        "ratio", (F.col("ratio") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    ).drop("_lo", "_hi")


def _gauss(sigma, truncate=4.0):
    half = int(truncate * sigma + 0.5)
    w = [math.exp(-(i * i) / (2.0 * sigma * sigma)) for i in range(-half, half + 1)]
    s = sum(w)
    return [x / s for x in w]


def density_flag(tiles, bins=None, thresh=100.0, x="z", y="sd", bins_per_tile=0.00005):
    """Flag tiles in sparse regions of the (z, sd) plane.

    A bins x bins histogram per sample is smoothed by a Gaussian (sigma =
    max(1, floor(0.02 bins)), mirrored edges); a tile is flagged when its smoothed
    count is below ``thresh``. Lookup uses left-closed search, so the exact minimum
    falls outside and counts as density 0. ``bins`` defaults to floor(``bins_per_tile`` N),
    at least 1, with each sample's own N. Smoothing handles one histogram line at a time.
    """
    tiles = reread(tiles)
    info = tiles.groupBy("sample").agg(
        F.count(F.lit(1)).alias("_n"), F.min(x).cast("double").alias("_x0"), F.max(x).cast("double").alias("_x1"),
        F.min(y).cast("double").alias("_y0"), F.max(y).cast("double").alias("_y1"),
    )
    own = F.greatest(F.floor(F.col("_n") * bins_per_tile), F.lit(1)) if bins is None else F.lit(bins)
    info = info.withColumn("_bins", own.cast("int"))

    def unit(c, lo, hi):
        return (F.col(c) - F.col(lo)) / F.nullif(F.col(hi) - F.col(lo), F.lit(0.0)) * F.col("_bins")

    d = tiles.join(info.drop("_n"), "sample", "left").withColumns({"_ux": unit(x, "_x0", "_x1"), "_uy": unit(y, "_y0", "_y1")})
    right = lambda c: F.least(F.floor(F.col(c)), F.col("_bins") - 1).cast("int")
    left = lambda c: (F.ceil(F.col(c)) - 1).cast("int")
    hist = d.where(F.col("_ux").isNotNull() & F.col("_uy").isNotNull()).groupBy(
        "sample", "_bins", right("_ux").alias("bx"), right("_uy").alias("by")
    ).agg(F.count(F.lit(1)).cast("double").alias("v"))

    def line(along, across):
        def conv(pdf):
            import numpy as np
            import pandas as pd

            bins = int(pdf["_bins"].iloc[0])
            w = _gauss(max(1, int(bins * 0.02)))
            half = (len(w) - 1) // 2
            v = np.zeros(bins)
            v[pdf[along].to_numpy()] = pdf["v"].to_numpy()
            ext = np.pad(v, half, mode="symmetric")
            res = np.convolve(ext, np.asarray(w), mode="valid")
            return pd.DataFrame({
                "sample": pdf["sample"].iloc[0], "_bins": np.int32(bins), along: np.arange(bins, dtype="int32"),
                across: np.int32(pdf[across].iloc[0]), "v": res,
            })

        return conv

    kind = tiles.schema["sample"].dataType.simpleString()
    schema = f"sample {kind}, _bins int, bx int, by int, v double"
    smooth = hist.groupBy("sample", "bx").applyInPandas(line("by", "bx"), schema)
    smooth = smooth.groupBy("sample", "by").applyInPandas(line("bx", "by"), schema)
    d = d.withColumns({"bx": left("_ux"), "by": left("_uy")}).drop("_ux", "_uy", "_x0", "_x1", "_y0", "_y1", "_bins")
    return d.join(smooth.drop("_bins"), ["sample", "bx", "by"], "left").withColumn("density", F.coalesce("v", F.lit(0.0))).withColumn(
        "low_density", F.col("density") < thresh
    ).drop("bx", "by", "v")


def value_histogram(df, value, bins=256, by="sample"):
    """Non-empty equal-width bins between each sample's extremes: (sample, bin, center, n)."""
    df = reread(df)
    rng = df.groupBy(by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / bins
    at = F.coalesce(
        F.least(F.floor((F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins), F.lit(bins - 1)),
        F.lit(0),
    ).cast("int")
    return df.where(F.col(value).isNotNull()).join(rng, by, "left").groupBy(by, at.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.first(F.col("_lo")).alias("_lo"), F.first(step).alias("_s")
    ).select(by, "bin", (F.col("_lo") + (F.col("bin") + 0.5) * F.col("_s")).alias("center"), "n")


def cumulative_histogram(df, value, bins=256, by="sample"):
    """Histogram with forward and reverse cumulative counts (at most ``bins`` rows per sample)."""
    up = Window.partitionBy(by).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(by).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return value_histogram(df, value, bins, by).withColumns({
        "below": F.sum("n").over(up), "above": F.sum("n").over(down),
    })


def otsu_threshold(df, value, bins=256, upper=0.9, by="sample"):
    """Threshold per sample that maximises between-class variance of values below the ``upper`` quantile."""
    d = df = reread(df.select(by, value))
    if upper is not None:
        q = exact_quantiles(df, [by], value, [upper], ["_q"])
        d = settle(df.select(by, value).join(q, by).where(F.col(value) < F.col("_q")).drop("_q"))
    h = value_histogram(d, value, bins, by)
    up = Window.partitionBy(by).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    al = Window.partitionBy(by)
    m = F.col("n") * F.col("center")
    h = h.withColumns({"_w1": F.sum("n").over(up), "_m1": F.sum(m).over(up), "_w": F.sum("n").over(al), "_m": F.sum(m).over(al)})
    w2 = F.col("_w") - F.col("_w1")
    gap = F.col("_m1") / F.col("_w1") - (F.col("_m") - F.col("_m1")) / F.nullif(w2, F.lit(0).cast("long"))
    # relative to the total variance bound, so that values of any size compare alike; equal to 12 digits is a tie
    spread = F.max("center").over(al) - F.min("center").over(al)
    share = F.col("_w1") / F.col("_w") * (w2 / F.col("_w")) * F.pow(gap / F.nullif(spread, F.lit(0.0)), 2)
    h = h.withColumn("_var", F.coalesce(F.round(share, 12), F.lit(-1.0)))
    return h.groupBy(by).agg(F.min_by("center", F.struct(-F.col("_var"), F.col("bin"))).alias("threshold"))


def ratio_filter(tiles, keep="low_density", value="ratio"):
    """Low-ratio flag: the threshold comes from tiles that passed density and is applied to all."""
    tiles = reread(tiles)
    t = otsu_threshold(tiles.where(~F.col(keep)), value)
    return tiles.join(t, "sample", "left").withColumn("low_ratio", F.coalesce(F.col(value) < F.col("threshold"), F.lit(False)))


def colour_artefact(tiles):
    """Green, grey or over-bright tiles by mean colour."""
    r, g, b = F.col("mr"), F.col("mg"), F.col("mb")
    m = (r + g + b) / 3
    sd = F.sqrt(((r - m) * (r - m) + (g - m) * (g - m) + (b - m) * (b - m)) / 3)
    return tiles.withColumns({
        "is_green": (g > r + 20) & (g > b + 20),
        "is_grey": sd < 10,
        "is_bright": (r > 230) & (g > 230) & (b > 230),
    }).withColumn("artefact", F.col("is_green") | F.col("is_grey") | F.col("is_bright"))


def grey_level(levels=64):
    """Truncated luminance, then truncated to ``levels`` grey levels."""
    # fixed values: luminance weights
    grey = F.floor(F.col("r") * 0.2125 + F.col("g") * 0.7154 + F.col("b") * 0.0721)
    return F.floor(grey / 255.0 * (levels - 1)).cast("int")


def glcm_texture(pixels, mask=None, levels=64, tile=16):
    """Energy, homogeneity and entropy of horizontal grey-level pairs, and Laplacian variance, per tile.

    One exchange by tile serves the neighbour lookup and both aggregations. Unordered
    pairs are counted once and weighted for the symmetric matrix. The Laplacian uses
    the tile alone, mirrored at its edge without repeating the border pixel.
    """
    d = pixels.select(
        "sample", F.floor(F.col("y") / tile).alias("row"), F.floor(F.col("x") / tile).alias("col"),
        "y", "x", grey_level(levels).alias("_g"),
    )
    if mask is not None:
        d = attach(d, mask.select("sample", "row", "col"), ["sample", "row", "col"], "left_semi")
    key = ["sample", "row", "col"]
    # at most tile * tile rows per window
    across = Window.partitionBy(*key).orderBy("y", "x")
    down = Window.partitionBy(*key).orderBy("x", "y")
    near = lambda fn, w, same: F.when(fn(same, 1).over(w) == F.col(same), fn("_g", 1).over(w))
    d = d.withColumns({
        "_e": near(F.lead, across, "y"), "_w": near(F.lag, across, "y"),
    }).withColumns({"_s": near(F.lead, down, "x"), "_n": near(F.lag, down, "x")})
    edge = lambda a, b: F.coalesce(F.col(a), F.col(b), F.col("_g"))
    lap = edge("_e", "_w") + edge("_w", "_e") + edge("_s", "_n") + edge("_n", "_s") - 4 * F.col("_g")
    d = d.withColumns({
        "_l": lap, "_a": F.least("_g", "_e"), "_b": F.greatest("_g", "_e"),
    }).withColumn("_a", F.when(F.col("_e").isNotNull(), F.col("_a"))).withColumn("_b", F.when(F.col("_e").isNotNull(), F.col("_b")))
    pairs = d.groupBy(*key, "_a", "_b").agg(
        F.count(F.lit(1)).alias("_c"), F.sum("_l").alias("_ls"), F.sum(F.col("_l") * F.col("_l")).alias("_lq")
    )
    is_pair = F.col("_a").isNotNull()
    pairs = pairs.withColumn("_t", F.sum(F.when(is_pair, F.col("_c"))).over(Window.partitionBy(*key)))
    same = F.col("_a") == F.col("_b")
    p = F.when(same, F.col("_c") / F.col("_t")).otherwise(F.col("_c") / (2 * F.col("_t")))
    m = F.when(same, 1.0).otherwise(2.0)
    diff = F.col("_a") - F.col("_b")
    tot, k = F.sum("_ls"), F.sum("_c")
    return pairs.groupBy(*key).agg(
        F.sqrt(F.sum(F.when(is_pair, m * p * p))).alias("energy"),
        F.sum(F.when(is_pair, m * p / (1 + diff * diff))).alias("homogeneity"),
        (-F.sum(F.when(is_pair, m * p * F.log2(p)))).alias("entropy"),
        (F.sum("_lq") / k - (tot / k) * (tot / k)).alias("sharpness"),
    )


def cluster_scores(df, cluster="cluster", by=("sample",)):
    """Mean texture per cluster, score = energy + homogeneity - entropy, and size."""
    g = df.groupBy(*by, cluster).agg(
        *[F.avg(c).alias(c) for c in ("energy", "homogeneity", "entropy")], F.count(F.lit(1)).alias("n")
    )
    return g.withColumn("score", F.col("energy") + F.col("homogeneity") - F.col("entropy"))


def lowest_score_clusters(scores, n=2, cluster="cluster", by=("sample",)):
    """The ``n`` clusters with the smallest score per sample."""
    w = Window.partitionBy(*by).orderBy("score", cluster)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
