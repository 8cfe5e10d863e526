"""Whitening of embeddings along leading components found by Chebyshev-filtered subspace iteration."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from slideloom.plans.scale import settle

#: Integers of entries beyond this size would not stay exact as doubles.
LARGEST = float(2**52)


class Whitening(NamedTuple):
    n: int
    sums: np.ndarray  # per dimension, exact
    trace: float
    values: np.ndarray  # falling
    vectors: np.ndarray  # one column a component
    residual: float  # largest |V q - e q| over the greatest eigenvalue
    passes: int


def vectors_of(df: DataFrame, vector: str, keep: list[str] | None = None, scale: float = 1024.0, shift: int = 100_000) -> DataFrame:
    """Rows whose vector is whole and finite: x (array<long>, floor(scale * entry) + shift) and _row (the columns ``keep`` of ``df``, else all).

    Vectors that are null, empty, or hold null or non-finite entries are dropped. All others must have one
    length; vectors of another length than the longest one raise an error when they are read.
    """
    v = F.col(f"`{vector}`")
    entry = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    doubles = F.transform(v, lambda c: c.cast("double"))
    whole = df.where(v.isNotNull() & (F.size(v) > 0) & ~F.exists(doubles, entry))
    whole_number = lambda c: F.least(F.greatest(F.floor(c * scale), F.lit(-LARGEST)), F.lit(LARGEST)).cast("long") + shift
    return whole.select(F.transform(doubles, whole_number).alias("x"), F.struct(*[F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]).alias("_row"))


def blocks(batches, width: int):
    """The int64 rows of each batch as a matrix."""
    for b in batches:
        column = b.column(0)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        if len(flat) != len(column) * width:
            raise ValueError(f"vectors must all have {width} entries")
        yield flat.reshape(-1, width)


def added(rows: DataFrame, width: int, columns: int, work, kind: str = "double") -> np.ndarray:
    """Sum over all blocks of the (width, columns) matrix ``work(block)``: added in tasks, then by a grouped sum; the driver gets ``width`` rows."""
    names = [f"c{j}" for j in range(columns)]

    def run(batches):
        total = None
        for block in blocks(batches, width):
            part = work(block)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), *[pa.array(total[:, j]) for j in range(columns)]], names=["i", *names])

    parts = rows.select("x").mapInArrow(run, "i int, " + ", ".join(f"{c} {kind}" for c in names))
    got = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect()
    out = np.zeros((width, columns), np.int64 if kind == "long" else np.float64)
    for r in got:
        out[r["i"]] = r[1:]
    return out


def rayleigh_ritz(q: np.ndarray, vq: np.ndarray):
    """Ritz values (falling), vectors, V times them, and the residual norm of each."""
    small = q.T @ vq
    e, s = np.linalg.eigh((small + small.T) / 2)
    e, s = e[::-1], s[:, ::-1]
    q, vq = q @ s, vq @ s
    return e, q, vq, np.linalg.norm(vq - q * e, axis=0)


def fit(rows: DataFrame, components: int = 8, tolerance: float = 1e-13, rounds: int = 60, degree: int = 16, seed: int = 5) -> Whitening | None:
    """The leading eigenpairs of the covariance of ``rows`` (x array<long>; read once a pass), None without rows.

    A block of orthonormal columns Q goes through a Chebyshev polynomial of the covariance V: the recurrence
    is one pass a degree, each the sum over rows of (x - mean)ᵀ((x - mean) Q) / n. The polynomial stays within 1
    between the bounds of the unwanted spectrum and grows fast above it. Then QR and Rayleigh-Ritz give new pairs;
    the upper bound is the block's last Ritz value. Ends when every wanted pair has a residual norm of
    ``tolerance`` times the greatest eigenvalue (certified: an eigenvalue lies that close), or when rounding stops all progress below
    1e-10; a slower case after ``rounds`` raises an error. The block has 16 columns more than wanted (all dimensions, if fewer).
    """
    first = rows.select(F.max(F.size("x"))).first()[0]
    if first is None:
        return None
    width = int(first)
    counted = added(rows, width, 2, lambda x: np.stack([x.sum(0), np.full(width, len(x))], 1), "long")
    sums, n = counted[:, 0], int(counted[0, 1])
    mean = sums / n
    passes = 1

    def times(q):
        nonlocal passes
        passes += 1
        with_trace = np.zeros(q.shape[1] + 1)

        def work(x, q=q):
            c = x - mean
            return np.column_stack([c.T @ (c @ q), (c * c).sum(0)])

        out = added(rows, width, len(with_trace), work) / n
        return out[:, :-1], float(out[:, -1].sum())

    wanted = min(components, width)
    size = min(width, wanted + 16)
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))
    vq, trace = times(q)
    e, q, vq, off = rayleigh_ritz(q, vq)
    # V has no negative eigenvalue, and a random block's least Ritz value lies well above the bottom
    low = max(0.0, e[-1] - 4 * off[-1])
    before = math.inf
    for _ in range(rounds):
        worst = off[:wanted].max() / max(e[0], 1e-300)
        if worst <= tolerance or (worst < 1e-10 and worst > before / 4) or e[0] <= 0 or size == width:
            return Whitening(n, sums, trace, np.maximum(e[:wanted], 0), q[:, :wanted], float(worst), passes)
        before = worst
        high = max(e[-1], low + 1e-12 * e[0])
        middle, half = (high + low) / 2, (high - low) / 2
        # scaled so that the greatest wanted direction stays near 1
        sigma = first_sigma = half / (e[0] - middle)
        p0, p1 = q, (vq - middle * q) * (sigma / half)
        gain = math.acosh(max((e[wanted - 1] - middle) / half, 1 + 1e-9))
        steps = min(degree, max(3, math.ceil(math.log(worst / tolerance) / gain) + 1))
        for _ in range(steps - 1):
            following = 1 / (2 / first_sigma - sigma)
            vp, _ = times(p1)
            p0, p1 = p1, (vp - middle * p1) * (2 * following / half) - p0 * (sigma * following)
            sigma = following
        q, _ = np.linalg.qr(p1)
        vq, trace = times(q)
        e, q, vq, off = rayleigh_ritz(q, vq)
    raise ArithmeticError(f"residual {worst:.1e} after {passes} passes")


def whiten(df: DataFrame, vector: str = "embedding", components: int = 8, keep: list[str] | None = None, **how) -> DataFrame:
    """Every row with a whole finite vector, once for each leading component (at most ``components``, at most the dimensions).

    Columns: _row (the columns ``keep`` of ``df``, else all), component (from 1), n, deviation (sum over dimensions of (n*x - S)², exact; null if it
    doesn't fit a long), whitened (x - S/n on the component, over the root of its eigenvalue), explained (eigenvalue over trace) and
    identity_error (one value: largest absolute entry of whitened's covariance minus the identity). Components
    that carry no variance (under 1e-12 of the trace, as with few or equal rows) have a null whitened and
    stay out of identity_error; without any variance explained is null. Rows alike, also in id, count and come out each. A
    component's sign makes its largest entry positive. A table without such vectors gives no rows.
    """
    rows = settle(vectors_of(df, vector, keep))
    kind = rows.schema["_row"].dataType.simpleString()
    spark = df.sparkSession
    found = fit(rows, components, **how)
    schema = f"_row {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if found is None:
        return spark.createDataFrame([], schema)
    width, n, mean = len(found.sums), found.n, found.sums / found.n
    turned = found.vectors * np.where(np.take_along_axis(found.vectors, np.abs(found.vectors).argmax(0)[None], 0) < 0, -1.0, 1.0)
    live = found.values > 1e-12 * found.trace
    over = np.where(live, np.sqrt(np.where(live, found.values, 1.0)), 1.0)
    score = turned / over
    many = len(over)
    gram = added(rows, width, many + 1, lambda x: _gram((x - mean) @ score, width))[:many] / n
    whole = gram[:, :many] - np.outer(gram[:, -1], gram[:, -1]) - np.eye(many)
    error = float(np.abs(whole[np.ix_(live, live)]).max()) if live.any() else None
    explained = [float(v / found.trace) if found.trace > 0 else None for v in found.values]

    def run(batches):
        for b in batches:
            x = next(blocks([b], width))
            t = n * x - found.sums
            size = (t.astype(float) ** 2).sum(1)
            exact = [int(d) for d in (t * t).sum(1)]
            for i in np.flatnonzero(size > 9e18):
                whole = sum(int(c) ** 2 for c in t[i])
                exact[i] = whole if whole < 2**63 else None
            w = (x - mean) @ score
            m = len(x)
            take = np.repeat(np.arange(m), many)
            values = pa.array(w.ravel(), mask=np.tile(~live, m))
            yield pa.RecordBatch.from_arrays(
                [b.column(1).take(pa.array(take)), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), m)), pa.array(np.full(m * many, n)),
                 pa.array(exact, pa.int64()).take(pa.array(take)), values, pa.array(explained * m, pa.float64()), pa.array([error] * (m * many), pa.float64())],
                names=["_row", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select("x", "_row").mapInArrow(run, schema)


def _gram(w: np.ndarray, width: int) -> np.ndarray:
    """wᵀw and the sums of w, in the first rows of a matrix of ``width`` rows."""
    out = np.zeros((width, w.shape[1] + 1))
    out[: w.shape[1], :-1], out[: w.shape[1], -1] = w.T @ w, w.sum(0)
    return out
