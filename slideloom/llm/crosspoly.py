"""Nearest neighbours by cross-polytope hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from slideloom.plans.scale import settle


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows (a power of two long), scaled to keep lengths."""
    n, half = x.shape[1], 1
    while half < n:
        x = x.reshape(len(x), -1, 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


class CrossPolytope:
    """``tables`` hash functions of unit vectors of length ``dim``, each made of ``hashes`` pseudo-rotations.

    A pseudo-rotation is three rounds of random signs and the Hadamard transform; the
    hash is the signed axis nearest to the rotated vector.
    """

    def __init__(self, dim: int, tables: int, hashes: int = 1, seed: int = 7):
        self.size = 1 << max(1, (dim - 1).bit_length())
        self.axes = 2 * self.size
        self.tables, self.hashes = tables, hashes
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, hashes, 3, self.size))

    def _rotated(self, x, table, part):
        r = np.zeros((len(x), self.size))
        r[:, : x.shape[1]] = x
        for signs in self.signs[table, part]:
            r = hadamard(r * signs)
        return np.concatenate([r, -r], 1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Bucket of each row in each table, numbered over all tables."""
        out = np.zeros((len(x), self.tables), np.int64)
        for t in range(self.tables):
            for h in range(self.hashes):
                out[:, t] = out[:, t] * self.axes + self._rotated(x, t, h).argmax(1)
            out[:, t] += t * self.axes**self.hashes
        return out

    def probes(self, x: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` buckets of each table with the least sum of squared gaps to the best axis."""
        near = min(self.axes, count)
        out = []
        for t in range(self.tables):
            cost, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
            for h in range(self.hashes):
                r = self._rotated(x, t, h)
                best = np.argsort(-r, axis=1, kind="stable")[:, :near]
                high = np.take_along_axis(r, best, 1)
                gap = (high[:, :1] - high) ** 2
                cost = (cost[:, :, None] + gap[:, None, :]).reshape(len(x), -1)
                code = (code[:, :, None] * self.axes + best[:, None, :]).reshape(len(x), -1)
                pick = np.argsort(cost, axis=1, kind="stable")[:, :count]
                cost, code = np.take_along_axis(cost, pick, 1), np.take_along_axis(code, pick, 1)
            out.append(code + t * self.axes**self.hashes)
        return np.concatenate(out, 1)


def vectors(table: DataFrame, ident: str, vector: str, dim: int | None) -> tuple[DataFrame, int, np.dtype]:
    """Rows that take part (id, raw bytes, squared length), their number of components, and the bytes' kind."""
    element = table.schema[vector].dataType.elementType.simpleString()
    kind = np.dtype("<f4" if element == "float" else "<f8")
    if dim is None:
        sizes = table.where(F.size(vector) > 0).groupBy(F.size(vector).alias("n")).agg(F.count(F.lit(1)).alias("rows"))
        most = sizes.orderBy(F.desc("rows"), "n").first()
        dim = most["n"] if most else 1
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    whole = (F.size(vector) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    rows = table.where(F.col(ident).isNotNull() & F.col(vector).isNotNull()).where(whole & some)

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
            norm = np.einsum("ij,ij->i", x.astype("f8"), x.astype("f8"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(norm)], names=["id", "raw", "norm"])

    return rows.select(F.col(ident).cast("long").alias("id"), F.col(vector).alias("v")).mapInArrow(run, "id long, raw binary, norm double"), dim, kind


def nearest(
    table: DataFrame, queries: Column, ident: str = "vec_id", vector: str = "embedding", k: int = 20, dim: int | None = None,
    tables: int = 16, probes: int = 12, hashes: int = 1, pilot: int = 2_000, block: int = 4_096, seed: int = 7,
) -> DataFrame:
    """For each row that fulfils ``queries``: the ``k`` found rows of largest inner product.

    Returns query_id, rank (from 1), vec_id, score (double precision, original vectors), ties to the
    smaller id; the query's own id is no candidate. All rows are indexed; search is by ``probes`` buckets in each of ``tables``
    hash tables, and every candidate is ranked by its exact score. For inner
    products, rows get one more component that gives all the same length
    (the longest), queries a zero: nearest by angle is then largest by product.

    ``pilot`` rows, the same at every size, and then the best bucket of each table give each query
    a score that its k-th result reaches for certain, so the other buckets return only rows that reach it. A vector
    that more than k + 1 rows share is indexed for the k + 1 smallest ids, which are all a result can
    hold. Buckets and probes of a bucket over ``block`` rows are cut into blocks that meet pairwise. For many more rows
    than 10,000 times the axes raise ``hashes``, which squares the number of buckets.

    Vectors null, zero, of another length than ``dim`` (default: the commonest), or with null or non-finite components take no part, nor do null ids. Rows that
    repeat an id and vector count once. With no valid rows the result is empty.
    """
    rows, dim, kind = vectors(table, ident, vector, dim)
    rows = settle(rows)
    longest = rows.agg(F.max("norm")).first()[0]
    longest = float(longest) if longest else 1.0
    hasher = CrossPolytope(dim + 1, tables, hashes, seed)
    matrix = lambda raw: np.frombuffer(b"".join(raw), kind).reshape(-1, dim).astype("f8")

    few = F.row_number().over(Window.partitionBy("raw").orderBy("id"))
    index = rows.distinct().withColumn("_n", few).where(F.col("_n") <= k + 1).select("id", "raw", "norm")
    asked = table.where(queries).select(F.col(ident).cast("long").alias("id")).distinct()
    asked = rows.join(asked, "id", "left_semi").select("id", "raw").distinct()
    sample = index.orderBy(F.xxhash64("id"), "id").limit(pilot).collect()
    known_ids = np.array([r["id"] for r in sample], np.int64)
    known = matrix([bytes(r["raw"]) for r in sample]) if sample else np.zeros((0, dim))
    held = rows.sparkSession.sparkContext.broadcast((known_ids, known))

    def hashed(batches):
        for b in batches:
            x = matrix(b.column("raw").to_pylist())
            norm = b.column("norm").to_numpy()
            unit = np.concatenate([x, np.sqrt(np.maximum(longest - norm, 0))[:, None]], 1) / np.sqrt(longest)
            codes = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * tables, pa.array(hasher.codes(unit).ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("raw"), codes], names=["id", "raw", "codes"])

    def probed(batches):
        ids, known = held.value
        for b in batches:
            x = matrix(b.column("raw").to_pylist())
            own = b.column("id").to_numpy()
            unit = np.concatenate([x / np.linalg.norm(x, axis=1)[:, None], np.zeros((len(x), 1))], 1)
            score = x @ known.T
            score[own[:, None] == ids[None, :]] = -np.inf
            reach = np.full(len(x), -np.inf)
            if len(ids) >= k:
                reach = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
            codes = hasher.probes(unit, probes)
            codes = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * codes.shape[1], pa.array(codes.ravel()))
            best = best_of(own, x, ids, known, reach)
            at = np.searchsorted(best[0], np.arange(len(x) + 1))
            found = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(best[1]), pa.array(best[2])], ["id", "score"]))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("raw"), pa.array(reach), codes, found], names=["id", "raw", "reach", "codes", "found"])

    def best_of(own, x, ids, known, reach):
        """Rows of x, ids and exact scores of up to k best (ties whole) that reach the bound."""
        out = [], [], []
        for a in range(0, len(x), 512):
            score = x[a : a + 512] @ known.T
            score[own[a : a + 512, None] == ids[None, :]] = -np.inf
            floor = reach[a : a + 512]
            if len(ids) > k:
                floor = np.maximum(floor, np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k])
            # the slack covers rounding; scores are then computed in one fixed order
            row, col = np.nonzero((score >= floor[:, None] - 1e-9 * longest) & (score > -np.inf))
            exact = np.einsum("ij,ij->i", x[a + row], known[col])
            for part, value in zip(out, (row + a, ids[col], exact)):
                part.append(value)
        return [np.concatenate(p) if p else np.zeros(0, t) for p, t in zip(out, (np.int64, np.int64, np.float64))]

    stored = settle(index.mapInArrow(hashed, "id long, raw binary, codes array<long>"))
    search = settle(asked.mapInArrow(probed, "id long, raw binary, reach double, codes array<long>, found array<struct<id:long,score:double>>"))
    entries = stored.select("id", "raw", F.explode("codes").alias("bucket"))
    wanted = search.select("id", "raw", "reach", F.size("codes").alias("_s"), F.posexplode("codes").alias("_p", "bucket"))
    wanted = wanted.withColumn("_first", F.col("_p") % (F.col("_s") / tables).cast("int") == 0).drop("_p", "_s")
    # big buckets are at most 100,000: each has over a 100,000th of all entries
    count = lambda d, name: d.groupBy("bucket").agg(F.count(F.lit(1)).alias(name))
    tally = settle(count(entries.select("bucket"), "n").join(count(wanted.select("bucket"), "q"), "bucket"))
    sums = tally.agg(F.sum("n"), F.sum("q")).first()
    at_most = [max(block, (s or 0) // 50_000) for s in sums]
    big = tally.where((F.col("n") > at_most[0]) | (F.col("q") > at_most[1])).select(
        "bucket", F.ceil(F.col("n") / at_most[0]).alias("_np"), F.ceil(F.col("q") / at_most[1]).alias("_qp")
    )
    one = F.lit(1).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(n), one) - 1))
    mine = lambda n: F.pmod(F.xxhash64("id"), F.coalesce(F.col(n), one))
    left = entries.join(F.broadcast(big), "bucket", "left").withColumn("np", mine("_np")).withColumn("qp", every("_qp"))
    right = wanted.join(F.broadcast(big), "bucket", "left").withColumn("qp", mine("_qp")).withColumn("np", every("_np"))
    keys = ["bucket", "np", "qp"]
    left, right = left.select(*keys, "id", "raw"), right.select(*keys, "id", "raw", "reach", "_first")

    def rank(entries: pa.Table, wanted: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        own = wanted.column("id").to_numpy()
        if len(own) and entries.num_rows:
            x, known = matrix(wanted.column("raw").to_pylist()), matrix(entries.column("raw").to_pylist())
            row, ids, score = best_of(own, x, entries.column("id").to_numpy(), known, wanted.column("reach").to_numpy())
            found = [own[row], ids, score]
        return pa.table({"query_id": found[0], "vec_id": found[1], "score": found[2]})

    kinds = "query_id long, vec_id long, score double"
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def met(part):
        return left.groupBy(*keys).cogroup(part.drop("_first").groupBy(*keys)).applyInArrow(rank, kinds)

    def best(hits):
        once = hits.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    # the best bucket of each table first: its k-th score is a far better bound for the others
    first = search.select(F.col("id").alias("query_id"), F.explode("found").alias("_f")).select("query_id", F.col("_f.id").alias("vec_id"), F.col("_f.score").alias("score"))
    first = settle(best(first.unionByName(met(right.where("_first")))))
    reached = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("_reached"))
    later = right.where("not _first").join(reached, "id", "left").withColumn("reach", F.greatest("reach", "_reached")).drop("_reached")
    out = best(first.drop("rank").unionByName(met(later.select(*right.columns))))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
