"""Scoring with user models, ensembles, losses and summaries of predictions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F, types as T

from ..functions.arrays import argmax_first, l2_normalise, mean_across, median_across, total, let
from ..plans.scale import attach, exact_quantiles, hash32, reread


def score_tokens(tokens, states, keys=("sample", "row", "col"), feat="feat", slope=0.1, combine=None):
    """Latent vector and class probabilities of each token under each model state.

    ``states`` is a list of ``{"layers": [(W, b), ...], "head": (W, b)}`` with W of
    shape (in, out). Layers use a leaky rectifier; the head ends in a softmax.
    Non-finite inputs become 0 or the largest finite value. Tokens stream through in
    Arrow batches and are never shuffled. With ``combine`` ("average" or "lower") the
    states are merged like ``ensemble_combine`` inside the batch: one row per token.
    """
    if combine not in (None, "average", "lower"):
        raise ValueError(f"unknown median {combine!r}")
    import numpy as np

    keys = list(keys)
    packed = [
        ([(np.asarray(w, float), np.asarray(b, float)) for w, b in s["layers"]], tuple(np.asarray(a, float) for a in s["head"]))
        for s in states
    ]

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x0 = np.nan_to_num(np.stack([np.asarray(v, dtype="float32") for v in pdf[feat]])).astype(float)
            zs, ps = [], []
            for s, (layers, (hw, hb)) in enumerate(packed):
                z = x0
                for w, b in layers:
                    z = z @ w + b
                    z = np.where(z > 0, z, slope * z)
                logit = z @ hw + hb
                e = np.exp(logit - logit.max(axis=1, keepdims=True))
                p = e / e.sum(axis=1, keepdims=True)
                if combine:
                    zs.append(z)
                    ps.append(p)
                    continue
                out = pdf[keys].copy()
                out["state"], out["z"], out["p"] = np.int32(s), list(z), list(p)
                yield out
            if combine:
                z = np.median(zs, axis=0) if combine == "average" else np.sort(zs, axis=0)[(len(zs) - 1) // 2]
                z = z / np.sqrt(np.maximum((z * z).sum(axis=1, keepdims=True), 1e-12))
                out = pdf[keys].copy()
                out["z"], out["p"] = list(z), list(np.mean(ps, axis=0))
                yield out

    schema = T.StructType(
        [tokens.schema[k] for k in keys]
        + ([] if combine else [T.StructField("state", T.IntegerType())])
        + [T.StructField("z", T.ArrayType(T.DoubleType())), T.StructField("p", T.ArrayType(T.DoubleType()))]
    )
    return tokens.select(*keys, feat).mapInPandas(run, schema)


def score_patches(patches, make_model, shape, mean, sd, local_shape, pixels="pixels", batch_size=256):
    """Run a user's patch model: ``pixels`` (flat, channels last, 0..1) to cls and local vectors.

    ``make_model()`` returns ``f(x[n, h, w, c]) -> (cls[n, d], local[n, i, j, e])`` and is
    called once per Python worker. Channels are normalised by (x - mean) / sd first.
    """
    from pyspark.ml.functions import predict_batch_udf

    i, j, e = local_shape

    def make():
        import numpy as np

        f = make_model()
        m, s = np.asarray(mean, float), np.asarray(sd, float)

        def predict(x):
            x = np.asarray(x, float).reshape(-1, *shape)
            cls, loc = f((x - m) / s)
            return {"cls": np.asarray(cls, "float32"), "flat": np.asarray(loc, "float32").reshape(len(x), -1)}

        return predict

    out = T.StructType([
        T.StructField("cls", T.ArrayType(T.FloatType())), T.StructField("flat", T.ArrayType(T.FloatType())),
    ])
    n = shape[0] * shape[1] * shape[2]
    udf = predict_batch_udf(make, return_type=out, batch_size=batch_size, input_tensor_shapes=[[n]])
    local = F.transform(
        F.sequence(F.lit(0), F.lit(i - 1)),
        lambda a: F.transform(F.sequence(F.lit(0), F.lit(j - 1)), lambda b: F.slice("_o.flat", (a * j + b) * e + 1, e)),
    )
    return patches.withColumn("_o", udf(pixels)).withColumns({"cls": F.col("_o.cls"), "local": local}).drop("_o")


def ensemble_combine(scores, median="average", keys=("sample", "row", "col")):
    """Per token: elementwise median of z over states, rescaled to unit length, and mean of p.

    ``median="lower"`` takes the lower of the middle pair. A token has one row per state.
    """
    g = scores.groupBy(*keys).agg(F.collect_list("z").alias("_z"), F.collect_list("p").alias("_p"))
    return g.select(
        *keys, l2_normalise(median_across("_z", lower=median == "lower")).alias("z"), mean_across("_p").alias("p")
    )


def token_pool(scores, keys=("sample", "spot"), p="p"):
    """Mean token probability per spot; vector sums run in the JVM with partial aggregation."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return scores.groupBy(*keys).agg(vector_to_array(Summarizer.mean(array_to_vector(p))).alias(p))


def eval_losses(pred, weight=1.0, by=(), p="p", y="y", resolution="resolution"):
    """MSE over soft rows (resolution 0), NLL over hard rows (1), and mse + weight * nll.

    Per row values are averaged once in one aggregation; a missing part counts as 0.
    """
    sq = F.aggregate(F.zip_with(p, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    nll = -F.log(F.greatest(F.get(F.col(p), argmax_first(y)), F.lit(1e-8)))
    soft, hard = F.col(resolution) == 0, F.col(resolution) == 1
    g = pred.groupBy(*by).agg(
        F.count(F.when(soft, 1)).alias("n_soft"), F.count(F.when(hard, 1)).alias("n_hard"),
        (F.sum(F.when(soft, sq)) / F.sum(F.when(soft, F.size(y)))).alias("_m"), F.avg(F.when(hard, nll)).alias("_n"),
    )
    m, n = F.coalesce("_m", F.lit(0.0)), F.coalesce("_n", F.lit(0.0))
    return g.withColumns({"mse": m, "nll": n, "loss": m + F.lit(float(weight)) * n}).drop("_m", "_n")


def recon_error(df, ids, x="x", xhat="xhat", ratio=0.3, seed=0, by=(), scheme="xx"):
    """Mean squared error over a seeded random share of the values (all of them when ratio <= 0).

    Sums are formed inside each row; nothing is exploded.
    """
    cells = F.zip_with(x, xhat, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    if ratio > 0:
        limit = int(ratio * 4294967296)
        key = (lambda i: F.col(ids) * 65536 + i) if scheme == "mul" else (lambda i: [F.col(ids), i])
        cells = F.filter(
            F.transform(cells, lambda v, i: F.when(hash32(key(i), seed, scheme) < limit, v)), lambda v: v.isNotNull()
        )
    d = df.select(*by, cells.alias("_c"))
    return d.groupBy(*by).agg(
        (F.sum(total("_c")) / F.nullif(F.sum(F.size("_c")), F.lit(0).cast("long"))).alias("recon"),
        F.sum(F.size("_c")).cast("long").alias("n_values"),
    )


def domain_loss(pred, logits="logits", domain="domain_id", p="p", entropy_weighted=False, by=()):
    """Cross-entropy of domain logits over known domains, optionally weighted by 1 + exp(-H(p)).

    Weights are divided by their mean + 1e-6.
    """
    lse = let(F.array_max(logits), lambda m: m + F.log(F.aggregate(F.col(logits), F.lit(0.0), lambda a, v: a + F.exp(v - m))))
    d = pred.where(F.col(domain) >= 0).withColumn("_ce", lse - F.get(F.col(logits), F.col(domain).cast("int")))
    if not entropy_weighted:
        return d.groupBy(*by).agg(F.avg("_ce").alias("domain_loss"))
    h = -F.aggregate(F.col(p), F.lit(0.0), lambda a, v: a + v * F.log(v + 1e-5))
    d = d.withColumn("_w", F.lit(1.0) + F.exp(-h))
    return d.groupBy(*by).agg((F.avg(F.col("_ce") * F.col("_w")) / (F.avg("_w") + 1e-6)).alias("domain_loss"))


def best_epochs(curve, n=3, metric="val_loss", epoch="epoch"):
    """The ``n`` epochs with the smallest metric."""
    return curve.orderBy(metric, epoch).limit(n)


def early_stop(curve, patience, metric="val_loss", epoch="epoch"):
    """First epoch by which the metric has not improved for ``patience`` epochs; no row if training goes on."""
    # one row per epoch
    w = Window.partitionBy(F.lit(0)).orderBy(epoch)
    before = F.min(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = curve.withColumn("_i", F.row_number().over(w)).withColumn(
        "_up", F.when(before.isNull() | (F.col(metric) < before), F.col("_i"))
    ).withColumn("_wait", F.col("_i") - F.max("_up").over(w))
    return d.where(F.col("_wait") >= patience).agg(F.min(epoch).alias("stop_epoch")).where(F.col("stop_epoch").isNotNull())


def percentile_clip(values, lo=5.0, hi=95.0, by=("sample", "ctype"), col="p", out="clipped"):
    """Values limited to the exact lo/hi percentiles of their group (pass rows inside the mask)."""
    values = reread(values)
    q = exact_quantiles(values, list(by), col, [lo / 100.0, hi / 100.0], ["vmin", "vmax"])
    return attach(values, q, list(by)).withColumn(out, F.least(F.greatest(F.col(col), F.col("vmin")), F.col("vmax")))


def dominant_class(pred, mask=None, p="p"):
    """Index of the first largest probability; -1 outside the mask."""
    d = pred.withColumn("class_idx", argmax_first(p))
    if mask is None:
        return d
    from .grid import apply_mask

    return apply_mask(d, mask, "class_idx")


def composition(pred, vocab, mask=None, p="p"):
    """Positions per dominant class and their share, per sample (masked-out positions excluded)."""
    d = dominant_class(pred, mask, p).where(F.col("class_idx") >= 0)
    n = d.groupBy("sample", "class_idx").agg(F.count(F.lit(1)).alias("n"))
    tot = n.groupBy("sample").agg(F.sum("n").alias("_t"))
    return attach(attach(n, tot, "sample"), vocab.select("class_idx", "ctype"), "class_idx").select(
        "sample", "class_idx", "ctype", "n", (F.col("n") / F.col("_t")).alias("share")
    )


def assign_colour(classes, cmap, palette, name="ctype", idx="class_idx", out="colour"):
    """Colour of each class from a (ctype, colour) table, else palette[idx mod len]."""
    m = cmap.select(F.col("ctype").alias(name), F.col("colour").alias("_c"))
    pal = F.array(*[F.lit(c) for c in palette])
    return attach(classes, m, name).withColumn(
        out, F.coalesce("_c", F.get(pal, F.pmod(F.col(idx), F.lit(len(palette)))))
    ).drop("_c")


def lognormal_moments(df, mean="mean", variance="variance"):
    """Mean and variance of exp(X) for X normal with the given moments."""
    m, v = F.col(mean), F.col(variance)
    return df.withColumns({
        "ln_mean": F.exp(m + v * 0.5), "ln_variance": (F.exp(v) - 1) * F.exp(m * 2 + v),
    })
