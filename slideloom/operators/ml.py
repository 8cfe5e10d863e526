"""Distributed statistics and models on vector columns."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Window, functions as F

from ..functions.arrays import all_finite, doubles, l2_normalise
from ..functions.scalars import inverse_distance
from ..plans.scale import attach_row, exact_quantiles, hash32, reread, settle


def _moments(df, feat):
    """One row: count, mean and population sd of a vector column."""
    from pyspark.ml.stat import Summarizer

    s = df.select(Summarizer.metrics("count", "mean", "variance").summary(array_to_vector(doubles(feat))).alias("_s"))
    n = F.col("_s.count")
    return s.select(
        vector_to_array("_s.mean").alias("_mean"),
        F.transform(vector_to_array("_s.variance"), lambda v: F.sqrt(F.greatest(v, F.lit(0.0)) * (n - 1) / n)).alias("_sd"),
    )


def _scaled(df, moments, feat, eps, sd=True):
    d = attach_row(df, moments)
    out = F.zip_with(doubles(feat), "_mean", lambda x, m: x - m)
    if sd:
        out = F.zip_with(out, "_sd", lambda x, s: x / (s + eps))
    return d.withColumn(feat, out).drop("_mean", "_sd")


def standardise(df, feat="feat", eps=1e-12):
    """Zero mean and unit population sd per dimension."""
    df = reread(df)
    return _scaled(df, _moments(df, feat), feat, eps)


def pca(df, k, feat="feat", out="pc"):
    """First ``k`` principal components of the centred vectors, beside the vectors.

    Each component's sign makes its largest loading positive. The model is fitted on the vectors as they are
    and the projected mean is taken off afterwards, so no centred copy is made.
    """
    import numpy as np
    from pyspark.ml.feature import PCA

    df = reread(df)
    mean = np.array(_moments(df, feat).first()["_mean"])  # one number per dimension
    d = df.withColumn("_v", array_to_vector(doubles(feat)))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(d.select("_v"))
    load = model.pc.toArray()
    sign = np.sign(load[np.abs(load).argmax(axis=0), np.arange(load.shape[1])])
    numbers = lambda v: F.array(*[F.lit(float(x)) for x in v])
    shifted = F.zip_with(vector_to_array("_p"), numbers(mean @ load), lambda a, b: a - b)
    return model.transform(d).withColumn(out, F.zip_with(shifted, numbers(sign), lambda a, b: a * b)).drop("_v", "_p")


def _spread_centres(points, k, rng):
    """k-means++ centres from a bounded sample."""
    import numpy as np

    out = [points[rng.integers(len(points))]]
    far = ((points - out[0]) ** 2).sum(1)
    while len(out) < k:
        total = far.sum()
        at = rng.choice(len(points), p=far / total) if total > 0 else rng.integers(len(points))
        out.append(points[at])
        far = np.minimum(far, ((points - out[-1]) ** 2).sum(1))
    return np.array(out)


def kmeans_sweep(df, ks=(5, 10, 15, 20, 25, 30), seed=42, feat="feat", keys=("sample", "row", "col"), iters=50, sample_rows=4096):
    """Cluster labels for several K: (keys, k, cluster).

    One Lloyd loop trains all K together: every round is one scan that assigns each row to its nearest centre of every K
    (ties to the smaller number) and adds up sums and counts in the tasks; the driver gets sum(ks) rows. A K whose labels no longer
    change stays as it is. Centres start by k-means++ on the ``sample_rows`` vectors of smallest hash; an
    empty cluster keeps its centre. Rows without a finite vector get no label; without rows there are none.
    """
    import numpy as np
    import pyarrow as pa

    d = settle(df.select(*keys, doubles(feat).alias("_f")).where(F.col("_f").isNotNull() & (F.size("_f") > 0) & F.forall("_f", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))))
    first = d.select("_f").orderBy(F.xxhash64("_f", F.lit(seed)), "_f").limit(sample_rows).collect()
    kinds = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in keys)
    if not first:
        return d.sparkSession.createDataFrame([], f"{kinds}, k int, cluster int")
    points = np.array([r[0] for r in first], float)
    rng, width = np.random.default_rng(seed), points.shape[1]
    centres = {k: _spread_centres(points, k, rng) for k in ks}

    def matrix(column):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(-1, width)

    def nearest(x, c):
        # compared without the row's own length, which is the same for every centre
        return ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)

    def sums_of(centres):
        def run(batches):
            sums = {k: np.zeros((len(c), width + 1)) for k, c in centres.items()}
            for b in batches:
                x = matrix(b.column(0))
                for k, c in centres.items():
                    at = nearest(x, c)
                    sums[k][:, width] += np.bincount(at, minlength=k)
                    for j in range(width):
                        sums[k][:, j] += np.bincount(at, x[:, j], k)
            for k, v in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, k, np.int32)), pa.array(np.arange(k, dtype=np.int32)), *map(pa.array, v.T.copy())], names=names)

        names = ["k", "cluster", *[f"s{j}" for j in range(width + 1)]]
        parts = d.select("_f").mapInArrow(run, "k int, cluster int, " + ", ".join(f"{n} double" for n in names[2:]))
        return parts.groupBy("k", "cluster").agg(*[F.sum(n).alias(n) for n in names[2:]]).collect()

    moving = dict(centres)
    for _ in range(iters):
        new = {k: c.copy() for k, c in moving.items()}
        for r in sums_of(moving):
            if r[-1] > 0:
                new[r["k"]][r["cluster"]] = np.array(r[2:-1]) / r[-1]
        centres.update(new)
        moving = {k: c for k, c in new.items() if np.abs(c - moving[k]).max() > 1e-9 * (1 + np.abs(c).max())}
        if not moving:
            break
    order = list(ks)

    def label(batches):
        for b in batches:
            x = matrix(b.column(b.num_columns - 1))
            n = len(x)
            for k in order:
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.full(n, k, np.int32)), pa.array(nearest(x, centres[k]).astype(np.int32))], names=[*keys, "k", "cluster"])

    return d.mapInArrow(label, f"{kinds}, k int, cluster int")


def gmm(df, feats=("homogeneity", "energy", "entropy"), k=4, by="sample", keys=("row", "col"), iters=100, tol=1e-3, ridge=1e-6):
    """Gaussian mixture with full covariances, fitted for all samples at once.

    Start: quantile groups of the first feature. Each round, tasks add up
    responsibilities per sample and component in one pass over the rows; only these
    sums are shuffled, and the driver turns them into the next parameters (a few
    dozen numbers per sample). Ends when no sample's mean log-likelihood moves by
    more than ``tol``. Returns (by, keys, feats, cluster).
    """
    import numpy as np

    feats, keys = list(feats), list(keys)
    d = len(feats)
    kind = df.schema[by].dataType.simpleString()
    rows = settle(df.select(by, *keys, *[F.col(f).cast("double").alias(f) for f in feats]).dropna(subset=feats))
    cuts = exact_quantiles(rows, [by], feats[0], [i / k for i in range(1, k)], [f"_c{i}" for i in range(1, k)])
    start = rows.join(cuts, by, "left").withColumn(
        "k", sum((F.when(F.col(feats[0]) > F.col(f"_c{i}"), 1).otherwise(0) for i in range(1, k)), F.lit(0))
    )
    quad = [(i, j) for i in range(d) for j in range(i, d)]
    names = ["n", "ll"] + [f"s{i}" for i in range(d)] + [f"q{i}_{j}" for i, j in quad]
    x = [F.col(f) for f in feats]
    stats = start.groupBy(by, "k").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.lit(float("-inf")).alias("ll"),
        *[F.sum(x[i]).alias(f"s{i}") for i in range(d)], *[F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i, j in quad],
    )

    def solve(sums):
        """Weights, means, precisions and log-determinants per sample from the collected sums."""
        model, ll = {}, {}
        for r in sums:
            if r[by] not in model:
                model[r[by]] = (np.zeros(k), np.zeros((k, d)), np.tile(np.eye(d), (k, 1, 1)), np.zeros(k))
                ll[r[by]] = r["ll"]
            w, mu, prec, logdet = model[r[by]]
            c, n = r["k"], max(r["n"], 1e-12)
            m = np.array([r[f"s{i}"] for i in range(d)]) / n
            cov = np.zeros((d, d))
            for i, j in quad:
                cov[i, j] = cov[j, i] = r[f"q{i}_{j}"] / n - m[i] * m[j]
            cov += ridge * np.eye(d)
            w[c], mu[c], prec[c], logdet[c] = r["n"], m, np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
        mean_ll = {}
        for s, (w, *_rest) in model.items():
            mean_ll[s] = ll[s] / w.sum()
            w /= w.sum()
        return model, mean_ll

    def respond(v, par):
        w, mu, prec, logdet = par
        diff = v[:, None, :] - mu
        with np.errstate(divide="ignore"):
            lp = np.log(w) - 0.5 * (np.einsum("nki,kij,nkj->nk", diff, prec, diff) + logdet + d * np.log(2 * np.pi))
        top = lp.max(axis=1, keepdims=True)
        e = np.exp(lp - top)
        return e / e.sum(axis=1, keepdims=True), float((top[:, 0] + np.log(e.sum(axis=1))).sum())

    def totals(model):
        def run(batches):
            import pandas as pd

            for pdf in batches:
                for s, at in pdf.groupby(by, sort=False).indices.items():
                    v = pdf[feats].to_numpy(dtype=float)[at]
                    r, ll = respond(v, model[s])
                    cols = np.concatenate([v, np.stack([v[:, i] * v[:, j] for i, j in quad], 1)], 1)
                    out = pd.DataFrame(np.column_stack([r.sum(0), np.full(k, ll), r.T @ cols]), columns=names)
                    out[by], out["k"] = s, np.arange(k, dtype="int32")
                    yield out[[by, "k", *names]]

        return run

    stat_schema = f"{by} {kind}, k int, " + ", ".join(f"{c} double" for c in names)
    model, before = solve(stats.collect())  # k rows per sample
    for _ in range(iters):
        sums = rows.mapInPandas(totals(model), stat_schema).groupBy(by, "k").agg(*[F.sum(c).alias(c) for c in names])
        model, now = solve(sums.collect())
        if all(abs(now[s] - before[s]) < tol for s in now):
            break
        before = now

    def label(batches):
        for pdf in batches:
            out = pdf[[by, *keys, *feats]].copy()
            out["cluster"] = np.int32(0)
            v = pdf[feats].to_numpy(dtype=float)
            for s, at in pdf.groupby(by, sort=False).indices.items():
                out.iloc[at, -1] = respond(v[at], model[s])[0].argmax(axis=1).astype("int32")
            yield out

    cols = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [by, *keys, *feats])
    return rows.mapInPandas(label, cols + ", cluster int")


def harmonise_batches(df, batch="sample", ids="id", feat="pc", clusters=50, rounds=3, sigma=0.1, theta=2.0, ridge=1.0, seed=42):
    """Batch-corrected vectors by rounds of soft clustering and per-cluster ridge correction.

    Rows stay on executors: a round adds up responsibilities per (cluster, batch), a
    small system per cluster is solved on the driver by elimination (clusters x batches x width
    numbers, which are the model), and rows are corrected where they are. ``ridge`` must be positive. Inputs are usually components.
    """
    import numpy as np
    from pyspark.ml.clustering import KMeans

    rows = settle(df.select(ids, F.col(batch).cast("string").alias("_b"), doubles(feat).alias("_x")))
    batches = sorted(r[0] for r in rows.select("_b").distinct().collect())  # one name per sample
    if ridge <= 0:
        raise ValueError("ridge must be positive")
    km = KMeans(k=clusters, seed=seed, featuresCol="_v", maxIter=10).fit(
        rows.select(array_to_vector(l2_normalise("_x", 1e-24)).alias("_v"))
    )
    y = np.array(km.clusterCenters())
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    pos = {b: i for i, b in enumerate(batches)}
    nb = len(batches)
    penalty = np.ones((len(y), nb))
    k1 = df.schema[ids].dataType.simpleString()

    def soft(z, b, y, penalty):
        u = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        lr = -2.0 * (1.0 - u @ y.T) / sigma
        lr -= lr.max(axis=1, keepdims=True)
        r = np.exp(lr) * penalty[:, b].T
        return u, r / r.sum(axis=1, keepdims=True)

    def walk(x, b, history):
        """Replay the corrections so far: each one used the assignment of its own round."""
        z = x
        for yy, pen, w in history:
            _, r = soft(z, b, yy, pen)
            z = x - np.einsum("nk,knd->nd", r, w[:, b])
        return z

    history = []
    for _ in range(rounds):
        frozen = (list(history), y, penalty)

        def gather(it, frozen=frozen):
            import pandas as pd

            hist, yy, pen = frozen
            acc = {}  # one entry per batch seen by this task
            for pdf in it:
                if not len(pdf):
                    continue
                x = np.stack([np.asarray(v, float) for v in pdf["_x"]])
                b = pdf["_b"].map(pos).to_numpy()
                z = walk(x, b, hist)
                u, r = soft(z, b, yy, pen)
                cols = np.concatenate([np.ones((len(x), 1)), x, u], 1)
                for i in np.unique(b):
                    acc[i] = acc.get(i, 0) + r[b == i].T @ cols[b == i]
            for i, v in acc.items():
                yield pd.DataFrame({"k": np.arange(len(v), dtype="int32"), "b": np.int32(i), "v": v.tolist()})

        from pyspark.ml.stat import Summarizer

        part = rows.mapInPandas(gather, "k int, b int, v array<double>")
        total = part.groupBy("k", "b").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).collect()
        width = (len(total[0]["v"]) - 1) // 2
        o = np.zeros((len(y), nb))
        sx = np.zeros((len(y), nb, width))
        su = np.zeros((len(y), width))
        for r in total:
            v = np.asarray(r["v"])
            o[r["k"], r["b"]] = v[0]
            sx[r["k"], r["b"]] = v[1:1 + width]
            su[r["k"]] += v[1 + width:]
        # intercept and one offset per batch: only the diagonal and one row are filled, so
        # offsets are eliminated one by one and the intercept remains
        keep = o / (o + ridge)
        left = (o * ridge / (o + ridge)).sum(axis=1)[:, None]
        base = (sx * (1 - keep)[:, :, None]).sum(axis=1) / np.maximum(left, 1e-300)
        w = (sx - o[:, :, None] * base[:, None]) / (o + ridge)[:, :, None]
        history.append((y, penalty, w))
        expect = o.sum(axis=1, keepdims=True) * o.sum(axis=0, keepdims=True) / max(o.sum(), 1e-12)
        penalty = ((expect + 1) / (o + 1)) ** theta
        y = su / np.maximum(np.linalg.norm(su, axis=1, keepdims=True), 1e-12)

    def finish(it):
        for pdf in it:
            if not len(pdf):
                continue
            x = np.stack([np.asarray(v, float) for v in pdf["_x"]])
            z = walk(x, pdf["_b"].map(pos).to_numpy(), history)
            out = pdf[[ids, "_b"]].rename(columns={"_b": batch})
            out[feat] = list(z)
            yield out

    return rows.mapInPandas(finish, f"{ids} {k1}, {batch} string, {feat} array<double>")


def fit_soft_labels(ex, replicas=2, hard_weight=1.0, seed=0, ids="id", feat="feat", y="y", resolution="resolution", max_iter=50, reg=1e-3):
    """Class probabilities learnt from soft and hard labels, once per replica.

    Each example becomes one weighted row per class with positive probability; hard
    rows (resolution 1) carry ``hard_weight``. Replica 0 uses all rows once, others a
    seeded Poisson bootstrap. Returns (replica, cls, intercept, coef).
    """
    from pyspark.ml.classification import LogisticRegression

    rows = settle(ex.select(
        ids, doubles(feat).alias("_f"), F.when(F.col(resolution) == 1, float(hard_weight)).otherwise(1.0).alias("_w"), F.col(y).alias("_y"),
    ))
    base = rows.select(ids, "_f", "_w", F.posexplode("_y").alias("cls", "_p")).where(F.col("_p") > 0)
    spark = ex.sparkSession
    out = []
    for rep in range(replicas):
        w = F.col("_w") * F.col("_p")
        if rep:
            u = hash32(ids, seed + rep) / 4294967296.0
            cum, copies = 0.0, F.lit(0)
            for c in range(20):  # u has 32 bits, so no draw is above 12
                cum += math.exp(-1.0) / math.factorial(c)
                copies = copies + F.when(u > cum, 1).otherwise(0)
            w = w * copies
        d = base.select(array_to_vector("_f").alias("_v"), F.col("cls").cast("double").alias("_y"), w.alias("_wt")).where(F.col("_wt") > 0)
        m = LogisticRegression(
            featuresCol="_v", labelCol="_y", weightCol="_wt", family="multinomial", maxIter=max_iter, regParam=reg
        ).fit(d)
        coef, icpt = m.coefficientMatrix.toArray(), m.interceptVector.toArray()
        out += [(rep, c, float(icpt[c]), [float(v) for v in coef[c]]) for c in range(len(icpt))]
    return spark.createDataFrame(out, "replica int, cls int, intercept double, coef array<double>")


def soft_label_states(model_rows):
    """Collected rows of ``fit_soft_labels`` as states for ``score_tokens`` (no hidden layer)."""
    import numpy as np

    reps = {}
    for r in model_rows:
        reps.setdefault(r["replica"], {})[r["cls"]] = (r["coef"], r["intercept"])
    return [
        {"layers": [], "head": (np.array([v[c][0] for c in sorted(v)]).T, np.array([v[c][1] for c in sorted(v)]))}
        for _, v in sorted(reps.items())
    ]


def _linear(train, query, targets, rng, ids, feat):
    """Least squares for all targets at once; ``train`` and ``query`` carry scaled features."""
    import numpy as np
    from pyspark.ml.stat import Summarizer

    low = np.array([rng[f"_lo_{t}"] for t in targets], float)
    span = np.array([rng[f"_hi_{t}"] for t in targets], float) - low

    def add(it):
        import pandas as pd

        total = 0
        for pdf in it:
            if len(pdf):
                x = np.stack([np.asarray(v, float) for v in pdf[feat]])
                y = (pdf[targets].to_numpy(float) - low) / (span + 1e-12)
                rows = np.concatenate([np.ones((len(x), 1)), x, y], 1)
                total = total + rows.T @ rows
        if not np.isscalar(total):
            yield pd.DataFrame({"i": np.arange(len(total), dtype="int32"), "v": list(total)})

    targets = list(targets)
    parts = train.select(feat, *targets).mapInPandas(add, "i int, v array<double>")
    sums = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).orderBy("i").collect()  # one row per column
    gram = np.array([r["v"] for r in sums])
    d = len(gram) - len(targets)
    coef = np.linalg.lstsq(gram[:d, :d], gram[:d, d:], rcond=None)[0]

    def predict(it):
        for pdf in it:
            x = np.stack([np.asarray(v, float) for v in pdf[feat]]) if len(pdf) else np.zeros((0, d - 1))
            y = np.clip(coef[0] + x @ coef[1:], 0, 1) * span + low
            yield pdf[[ids]].assign(**{t: y[:, i] for i, t in enumerate(targets)})

    kind = query.schema[ids].dataType.simpleString()
    return query.select(ids, feat).mapInPandas(predict, f"`{ids}` {kind}, " + ", ".join(f"`{t}` double" for t in targets))


def regress_impute(train, query, targets, ids="id", feat="feat", regressor=None):
    """Targets predicted from standardised features and min-max scaled targets, limited to the seen range.

    ``regressor()`` makes an MLlib regressor, fitted once per target; without it all targets share one least-squares
    fit with an intercept, from one pass that adds up products of columns. Query rows with a
    non-finite feature get NULL.
    """
    train = reread(train.select(feat, *targets))
    mom = settle(_moments(train, feat))
    rng = train.agg(
        *[F.min(t).cast("double").alias(f"_lo_{t}") for t in targets], *[F.max(t).cast("double").alias(f"_hi_{t}") for t in targets]
    ).first()
    ok = all_finite(feat, nested=False)
    q = query.select(ids, feat)
    scaled = _scaled(q.where(ok), mom, feat, 1e-12)
    if regressor is None:
        return q.select(ids).join(_linear(_scaled(train, mom, feat, 1e-12), scaled, targets, rng, ids, feat), ids, "left")
    x = settle(_scaled(train.select(feat, *targets), mom, feat, 1e-12)).withColumn("_v", array_to_vector(feat))
    out = scaled.withColumn("_v", array_to_vector(feat)).drop(feat)
    for t in targets:
        lo, hi = rng[f"_lo_{t}"], rng[f"_hi_{t}"]
        reg = regressor().setFeaturesCol("_v").setLabelCol("_y").setPredictionCol("_z")
        m = reg.fit(x.select("_v", ((F.col(t) - lo) / (hi - lo + 1e-12)).alias("_y")))
        out = m.transform(out).withColumn(t, F.least(F.greatest(F.col("_z"), F.lit(0.0)), F.lit(1.0)) * (hi - lo) + lo).drop("_z")
    return q.select(ids).join(out.drop("_v"), ids, "left")


def knn_impute(train, query, targets, k=5, weights="uniform", train_id="train_id", query_id="query_id", feat="feat",
               block_rows=4096, query_rows=16384, seed=0):
    """Exact k-nearest-neighbour mean and variance of each target: (query_id, target, mean, variance).

    Training rows are grouped around pivots; both sides are packed, a group's rows in blocks of bounded size, each one row of a
    written table. A query is first compared with one block of its nearest pivot, which bounds its k-th distance; the triangle and
    half-plane bounds then name the only groups that can hold nearer rows. Tasks read blocks of queries against blocks of those
    groups from the two tables: no vector is copied for each group that it visits, and a task emits k rows for each of its queries.
    Ties go to the smaller training id. Training rows with a non-finite value take no part; queries with one get NULL. There are
    as many groups as blocks, but at most the square root of the training rows, whose pivots the driver holds.
    """
    import numpy as np
    import pyarrow as pa

    if weights not in ("uniform", "distance"):
        raise ValueError(f"unknown weights {weights!r}")
    train, query = reread(train.select(train_id, feat, *targets).where(all_finite(feat, nested=False))), reread(query.select(query_id, feat))
    kt, kq = train.schema[train_id].dataType.simpleString(), query.schema[query_id].dataType.simpleString()
    # vectors stay in their own width until a task computes with them
    own = lambda d: F.col(feat) if d.schema[feat].dataType.simpleString() in ("array<float>", "array<double>") else doubles(feat)
    tv = train.select(train_id, own(train).alias("_f"))
    good = query.select(query_id, own(query).alias("_f")).where(all_finite("_f", nested=False))
    # keep one task's vectors near 64 MB a side, whatever their width
    width = train.select(F.max(F.size(feat))).first()[0] or 1
    block_rows, query_rows = (max(1, min(n, 8_000_000 // width)) for n in (block_rows, query_rows))
    n = train.count()
    m = int(max(1, min(math.isqrt(n), -(-n // block_rows))))
    pv = np.array([list(r["_f"]) for r in tv.withColumn("_h", hash32(train_id, seed)).orderBy("_h", train_id).limit(m).collect()], dtype=float)
    gap = np.sqrt(((pv[:, None] - pv[None]) ** 2).sum(-1)) if m * m * pv.shape[1] < 5e7 else np.stack([np.sqrt(((pv - p) ** 2).sum(-1)) for p in pv])

    def matrix(vectors):
        return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), width)

    def to_pivots(x, p=slice(None)):
        d2 = (x ** 2).sum(1)[:, None] - 2 * x @ pv[p].T + (pv[p] ** 2).sum(1)
        return np.sqrt(np.maximum(d2, 0))

    def placed(d, held, *cols):
        """Rows with the nearest of the pivots that are ``held`` (cell) and its distance (_d)."""
        def place(batches):
            for b in batches:
                far = np.where(held, to_pivots(matrix(b.column("_f"))), np.inf)
                found = {"cell": far.argmin(1).astype(np.int32), "_d": far.min(1)}
                yield pa.RecordBatch.from_arrays([pa.array(found[c]) if c in found else b.column(c) for c in cols], names=list(cols))

        kinds = {"cell": "int", "_d": "double"}
        return d.mapInArrow(place, ", ".join(f"`{c}` {kinds.get(c) or d.schema[c].dataType.simpleString()}" for c in cols))

    def parts(d, held, rows, name):
        """Blocks of each cell; counted in a pass of its own, so that no placed vectors are written."""
        return settle(placed(d, held, "cell").groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / float(rows)).cast("int").alias(name)))

    def cut(ident, name):
        return F.pmod(F.xxhash64(ident), F.coalesce(name, F.lit(1))).cast("int")

    blocks = parts(tv, np.ones(m, bool), block_rows, "_blocks")
    pack = F.collect_list(F.struct(train_id, "_f"))
    dealt_train = placed(tv, np.ones(m, bool), train_id, "_f", "cell", "_d").join(blocks, "cell", "left").withColumn("block", cut(train_id, "_blocks"))
    packed = settle(dealt_train.groupBy("cell", "block").agg(pack.alias("_s"), F.max("_d").alias("_radius")).select(
        F.col("cell").alias("_cell"), "block", F.col(f"_s.{train_id}").alias("_tids"), F.flatten("_s._f").alias("_tv"), "_radius"))
    radius = np.full(m, -np.inf)
    for r in packed.groupBy("_cell").agg(F.max("_radius").alias("_r")).collect():  # one row per pivot
        radius[r["_cell"]] = r["_r"]
    held = np.isfinite(radius)

    def lower(x, home, cells):
        """Lower bounds of the distances from rows of ``x``, of the cell ``home``, to rows of ``cells``, less what rounding may add."""
        d, own = to_pivots(x, cells), np.sqrt(((x - pv[home]) ** 2).sum(1))[:, None]
        scale = np.sqrt(max((x ** 2).sum(1).max(), (pv ** 2).sum(1).max()))
        apart = gap[home][cells]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart > 1e-7 * scale, (d ** 2 - own ** 2) / (2 * apart), 0.0)
        return np.maximum(d - radius[cells], plane) * (1 - 1e-9) - 1e-7 * scale - 1e-9

    def first(row):
        return np.arange(len(row)) - np.searchsorted(row, row)

    def closer(x, rows, best, bound, b, tid):
        """``best`` (row, training id, distance; at most k a row) with what ``b`` has nearer to ``rows``; ``bound`` follows the k-th."""
        norms = (b ** 2).sum(1)
        take = min(len(b), k)
        found = [best] if best else []
        for s in range(0, len(rows), 256):
            at = rows[s:s + 256]
            y = x[at]
            yy = (y ** 2).sum(1)
            approx = (-2 * y) @ b.T
            approx += norms
            # all within the rounding error of the k-th, so that equal distances stay together
            slack = 1e-12 * width * (norms.max() + yy)
            limit = bound[at] ** 2 - yy + slack
            if np.isinf(limit).any():
                limit = np.minimum(limit, np.partition(approx, take - 1, axis=1)[:, take - 1] + slack)
            row, col = np.nonzero(approx <= limit[:, None])
            if not len(row):
                continue
            d = np.concatenate([np.sqrt(((y[row[i:i + 65536]] - b[col[i:i + 65536]]) ** 2).sum(-1)) for i in range(0, len(row), 65536)])
            order = np.lexsort((tid[col], d, row))
            row, col, d = row[order], col[order], d[order]
            keep = first(row) < k
            found.append((at[row[keep]], tid[col[keep]], d[keep]))
        if not found:
            return best
        row, ids, d = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((ids, d, row))
        row, ids, d = row[order], ids[order], d[order]
        at = first(row)
        last = at == k - 1
        bound[row[last]] = np.minimum(bound[row[last]], d[last])
        return row[at < k], ids[at < k], d[at < k]

    def start(q, t):
        """A block of queries as one row, with a bound of each k-th distance and the cells that any of them must visit."""
        ids, flat = q.column(query_id).combine_chunks(), q.column("_f").combine_chunks()
        many = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)] if len(q) else [0], pa.int32()), a)
        bound, cells = np.full(len(q), np.inf), []
        if len(q):
            x, home = matrix(flat), q.column("cell")[0].as_py()
            if len(t):
                b = t.column("_tv").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
                closer(x, np.arange(len(x)), None, bound, b, np.arange(len(b)))
            want = np.arange(m) == home
            step = max(1, 500_000 // m)
            for s in range(0, len(x), step):
                want |= (lower(x[s:s + step], home, slice(None)) <= bound[s:s + step, None]).any(0)
            cells = np.flatnonzero(want & held)
        return pa.table({
            "cell": q.column("cell").combine_chunks()[:1], "chunk": q.column("chunk").combine_chunks()[:1], "_qids": many(ids),
            "_qv": many(flat.flatten()), "_bound": many(pa.array(bound)), "_cells": many(pa.array(cells, pa.int32())),
        })

    def search(batches):
        at, best = None, None

        def done():
            row, tid, d = best
            return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(tid, named), pa.array(d)], names=[query_id, train_id, "dist"])

        for batch in batches:
            named = batch.schema.field("_tids").type.value_type
            value = lambda c, i: batch.column(c).slice(i, 1).flatten()  # noqa: B023, E731
            for i, key in enumerate(zip(batch.column("cell").to_pylist(), batch.column("chunk").to_pylist())):
                if key != at:
                    if best:
                        yield done()
                    at, best, ids = key, None, value("_qids", i)
                    x = value("_qv", i).to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), width)
                    bound = value("_bound", i).to_numpy(zero_copy_only=False).copy()
                cell = batch.column("_cell")[i].as_py()
                rows = np.arange(len(x)) if cell == key[0] else np.flatnonzero(lower(x, key[0], [cell])[:, 0] <= bound)
                if len(rows):
                    tid = value("_tids", i).to_numpy(zero_copy_only=False)
                    b = value("_tv", i).to_numpy(zero_copy_only=False).astype(float).reshape(len(tid), width)
                    best = closer(x, rows, best, bound, b, tid)
        if best:
            yield done()

    # enough blocks of queries for all cores, none larger than the bound
    cores = train.sparkSession.sparkContext.defaultParallelism
    chunk_rows = max(min(query_rows, 1024), min(query_rows, query.count() // (4 * cores)))
    chunks = parts(good, held, chunk_rows, "_chunks")
    tasks = max(1, min(4 * cores, chunks.agg(F.sum("_chunks")).first()[0] or 1))
    on = ["cell", "chunk"]
    asks = placed(good, held, query_id, "_f", "cell").join(chunks, "cell", "left").select(query_id, "_f", "cell", cut(query_id, "_chunks").alias("chunk"))
    one = packed.where("block = 0").select("_tv", F.col("_cell").alias("cell")).join(chunks, "cell").select(
        "_tv", "cell", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("chunk"))
    asks, one = (d.repartition(tasks, *on).groupBy(*on) for d in (asks, one))
    asking = settle(asks.cogroup(one).applyInArrow(
        start, f"cell int, chunk int, _qids array<{kq}>, _qv {good.schema['_f'].dataType.simpleString()}, _bound array<double>, _cells array<int>"))
    # few reads of the training side by each task: a query has k rows for each of them
    reads = max(1, -(-n * width // 8_000_000))
    pairs = asking.crossJoin(packed.drop("_radius", "block").coalesce(reads).hint("shuffle_replicate_nl")).where(F.array_contains("_cells", F.col("_cell")))
    best = Window.partitionBy(query_id).orderBy("dist", train_id)
    found = pairs.drop("_cells").mapInArrow(search, f"`{query_id}` {kq}, `{train_id}` {kt}, dist double")
    found = settle(found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r"))
    w = F.lit(1.0) if weights == "uniform" else inverse_distance("dist")
    hit = found.join(train.select(train_id, *[F.col(t).cast("double") for t in targets]), train_id).withColumn("_w", w)
    mean = hit.groupBy(query_id).agg(F.sum("_w").alias("_tw"), *[(F.sum(F.col("_w") * F.col(t)) / F.sum("_w")).alias(f"_m_{t}") for t in targets])
    var = hit.join(mean, query_id).groupBy(query_id).agg(*[
        F.struct(
            F.lit(t).alias("target"), F.max(f"_m_{t}").alias("mean"),
            (F.sum(F.col("_w") * F.pow(F.col(t) - F.col(f"_m_{t}"), 2)) / F.sum("_w")).alias("variance"),
        ).alias(t) for t in targets
    ])
    long = var.select(query_id, F.explode(F.array(*targets)).alias("_s")).select(query_id, "_s.target", "_s.mean", "_s.variance")
    every = query.select(query_id, F.explode(F.array(*[F.lit(t) for t in targets])).alias("target"))
    return every.join(long, [query_id, "target"], "left")
