"""Vector and label expressions on ARRAY columns (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def let(value, fn):
    """Evaluate ``value`` once per row and use it inside higher-order functions."""
    return F.element_at(F.transform(F.array(_c(value)), fn), 1)


def total(arr):
    return F.aggregate(_c(arr), F.lit(0.0), lambda a, x: a + x.cast("double"))


def doubles(arr):
    return F.transform(_c(arr), lambda x: x.cast("double"))


def softmax(arr):
    a = doubles(arr)
    shifted = let(a, lambda v: let(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m))))
    return let(shifted, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def l2_normalise(arr, eps=1e-12):
    a = doubles(arr)
    return let(
        a,
        lambda v: let(
            F.sqrt(F.greatest(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x), F.lit(eps))),
            lambda n: F.transform(v, lambda x: x / n),
        ),
    )


def clip(arr, lo, hi):
    return F.transform(_c(arr), lambda x: F.least(F.greatest(x.cast("double"), F.lit(float(lo))), F.lit(float(hi))))


def entropy(arr, lo=1e-8):
    """Natural-log entropy after clipping to [lo, 1] and renormalising."""
    return let(
        clip(arr, lo, 1.0),
        lambda p: let(
            total(p),
            lambda s: -F.aggregate(p, F.lit(0.0), lambda a, x: a + (x / s) * F.log(x / s)),
        ),
    )


def argmax_first(arr):
    """0-based index of the first maximum."""
    return (F.array_position(_c(arr), F.array_max(_c(arr))) - 1).cast("int")


def one_hot(idx, k):
    i = _c(idx)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.when(j == i, 1.0).otherwise(0.0))


def outer_scaled(p, z):
    """Flattened p (x) z divided by sqrt(len z)."""
    return F.flatten(
        F.transform(_c(p), lambda pk: F.transform(_c(z), lambda zd: pk.cast("double") * zd.cast("double") / F.sqrt(F.size(_c(z)))))
    )


def all_finite(tokens, nested=True):
    def ok(x):
        d = x.cast("double")
        return x.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))

    if nested:
        return F.forall(_c(tokens), lambda t: F.forall(t, ok))
    return F.forall(_c(tokens), ok)


# fixed values: the largest finite 32-bit float
FLOAT32_MAX = 3.4028234663852886e38


def finite_or_extreme(x):
    """NaN to 0, infinities to the type's extremes."""
    d = x.cast("double")
    return (
        F.when(F.isnan(d) | x.isNull(), 0.0)
        .when(d == float("inf"), FLOAT32_MAX)
        .when(d == float("-inf"), -FLOAT32_MAX)
        .otherwise(d)
    )


def median_across(vectors, lower=False):
    """Elementwise median of an array of equal-length vectors (one per model state).

    Even counts average the middle pair; ``lower`` takes the smaller one instead.
    """
    def pick(s):
        n = F.size(s)
        lo = F.element_at(s, F.floor((n + 1) / 2).cast("int"))
        return lo if lower else (lo + F.element_at(s, (F.floor(n / 2) + 1).cast("int"))) / 2

    return let(
        _c(vectors),
        lambda vs: F.transform(
            F.sequence(F.lit(0), F.size(F.element_at(vs, 1)) - 1),
            lambda d: let(F.array_sort(F.transform(vs, lambda v: F.get(v, d).cast("double"))), pick),
        ),
    )


def mean_across(vectors):
    return let(
        _c(vectors),
        lambda vs: F.transform(
            F.sequence(F.lit(0), F.size(F.element_at(vs, 1)) - 1),
            lambda d: F.aggregate(vs, F.lit(0.0), lambda a, v: a + F.get(v, d).cast("double")) / F.size(vs),
        ),
    )


def disk_offsets(radius, ring=None):
    """Offsets (di, dj), row-major, with di^2+dj^2 <= radius^2; ``ring`` keeps only an outer band."""
    ceil = int(-(-radius // 1))
    inner = (radius - ring) ** 2 if ring is not None else None
    axis = F.sequence(F.lit(-ceil), F.lit(ceil))
    square = F.flatten(
        F.transform(axis, lambda i: F.transform(axis, lambda j: F.struct(i.alias("di"), j.alias("dj"))))
    )

    def keep(o):
        d2 = o.di * o.di + o.dj * o.dj
        cond = d2 <= radius ** 2
        return cond & (d2 >= inner) if inner is not None else cond

    return F.filter(square, keep)


def square_offsets(size):
    axis = F.sequence(F.lit(-size), F.lit(size))
    return F.flatten(
        F.transform(axis, lambda i: F.transform(axis, lambda j: F.struct(i.alias("di"), j.alias("dj"))))
    )


def center_weight(i, j, size=14, sigma=0.5):
    """Gaussian weight of position (i, j) in a size x size patch over [-1, 1]^2, maximum 1."""
    u = _c(i).cast("double") * (2.0 / (size - 1)) - 1.0
    v = _c(j).cast("double") * (2.0 / (size - 1)) - 1.0
    near = 0.0 if size % 2 else 1.0 / (size - 1)
    return F.exp((2 * near * near - (u * u + v * v)) / (2 * sigma * sigma))
