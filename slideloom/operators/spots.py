"""Spots: alignment of proportions, counts and positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window, functions as F

from ..plans.scale import attach, attach_row


def in_tissue(pos, flag="in_tissue"):
    return pos.where(F.col(flag) == 1)


def align_spots(props, pos, on=("sample", "barcode")):
    """Proportions joined to positions, and a one-row-per-sample report of what each side lost."""
    on = list(on)
    keys = (
        props.select(*on).distinct().withColumn("_p", F.lit(1))
        .join(pos.select(*on).distinct().withColumn("_q", F.lit(1)), on, "full_outer")
    )
    by = on[:-1] or [F.lit("all").alias("sample")]
    report = keys.groupBy(*by).agg(
        F.count(F.when(F.col("_p").isNotNull() & F.col("_q").isNotNull(), 1)).alias("n_aligned"),
        F.count(F.when(F.col("_q").isNull(), 1)).alias("props_only"),
        F.count(F.when(F.col("_p").isNull(), 1)).alias("positions_only"),
    )
    return props.join(pos, on), report


def shared_spots(a, b, on="spot"):
    """Both sides restricted to keys found in the other. An empty overlap shows as two empty frames."""
    return (
        a.join(b.select(on).distinct(), on, "left_semi"),
        b.join(a.select(on).distinct(), on, "left_semi"),
    )


def sort_shared(a, b, on="spot"):
    """``shared_spots`` with both outputs sorted by key; call it only when writing results."""
    x, y = shared_spots(a, b, on)
    return x.orderBy(on), y.orderBy(on)


def align_counts(counts, pos, on=("sample", "spot")):
    """Counts of spots that have a position."""
    return counts.join(pos.select(*on).distinct(), list(on), "left_semi")


def key_intersect(a, b, on):
    return a.select(*on).intersect(b.select(*on))


def key_except(a, b, on):
    """Rows of ``a`` whose key is absent from ``b``."""
    return a.join(b.select(*on).distinct(), list(on), "left_anti")


def align_columns(df, target, key="spot"):
    """Key first, then ``target`` columns (missing ones 0), then any others."""
    extra = [c for c in df.columns if c != key and c not in target]
    made = [(F.col(c) if c in df.columns else F.lit(0.0)).alias(c) for c in target]
    return df.select(key, *made, *extra)


def wide_proportions(props, classes, key="spot", ctype="ctype", p="p"):
    """Long (key, class, p) to one column per class of the given vocabulary, zeros where absent."""
    return props.groupBy(key).agg(
        *[F.coalesce(F.sum(F.when(F.col(ctype) == c, F.col(p))), F.lit(0.0)).alias(c) for c in classes]
    )


def label_vectors(props, vocab, keys, ctype="ctype", p="p"):
    """Long proportions to an ARRAY<DOUBLE> in vocabulary order.

    ``vocab(class_idx, ctype)`` has one row per class; absent classes are 0.
    """
    k = vocab.agg(F.max("class_idx").alias("_k"))
    d = attach(props, vocab.select("class_idx", F.col("ctype").alias(ctype)), ctype, "inner")
    m = d.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("class_idx", p))).alias("_m"))
    return attach_row(m, k).select(
        *keys,
        F.transform(F.sequence(F.lit(0), F.col("_k").cast("int")), lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0))).alias("y"),
    )


def variance_order(props, n_spots, ctype="ctype", p="p"):
    """Classes by descending sample variance over all spots; absent rows count as zero.

    ``n_spots`` is a one-row frame (n). Sums are pre-aggregated per class.
    """
    s = props.groupBy(ctype).agg(F.sum(p).alias("_s"), F.sum(F.col(p) * F.col(p)).alias("_q"))
    d = attach_row(s, n_spots.select(F.col("n").cast("double").alias("_n")))
    var = F.when(F.col("_n") > 1, (F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n")) / F.nullif(F.col("_n") - 1, F.lit(0.0)))
    # one row per class
    return d.select(ctype, var.alias("variance")).withColumn(
        "class_idx", (F.row_number().over(Window.orderBy(F.desc("variance"), F.asc(ctype))) - 1).cast("int")
    )


def order_classes(props, n_spots, ctype="ctype", p="p"):
    """Ordered vocabulary (class_idx, ctype)."""
    return variance_order(props, n_spots, ctype, p).select("class_idx", ctype)


def concat_features(*frames, on=("sample", "row", "col"), feat="feat", out="feat"):
    """Join feature families on position and concatenate their vectors in order."""
    named = [f.select(*on, F.col(feat).alias(f"_f{i}")) for i, f in enumerate(frames)]
    d = reduce(lambda a, b: a.join(b, list(on)), named)
    return d.select(*on, F.concat(*[f"_f{i}" for i in range(len(frames))]).alias(out))
