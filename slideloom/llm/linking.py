"""Links between sets that meet in inverted lists, at linear cost for groups of near copies.

Pairing every list would make all pairs of a group of near copies. Instead each set in a long list is
first compared with one member (hub) of the largest group in its lists; what links joins a
component, and inside a component nothing needs a comparison any more. After some rounds only pairs
across components are left; those that bounds don't rule out are all compared, each once. So no
link between components is lost, whatever hubs were drawn and whichever lists are called long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from slideloom.llm.common import text_of
from slideloom.llm.simhash import components, shingles, whole_key
from slideloom.plans.scale import settle


def shingle_set(text: str, words: int, seed: int) -> np.ndarray:
    return np.unique(np.array(shingles(text, words, seed), np.uint64))


#: Bits of a set's parity map.
PARITY = 1024


def parities(found: np.ndarray) -> np.ndarray:
    """Whether an odd number of elements fall on each of PARITY places. Two sets differ in as many elements at least as their maps in bits."""
    odd = np.bincount((found % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def shingle_sets(docs: DataFrame, asked: DataFrame, ident: str, text: str, words: int, seed: int) -> DataFrame:
    """fp, items (the hashes of the whole set) and bits (its parity map) of the nodes ``asked`` (fp, _none, _id, _hash: one row that has the set)."""
    def run(batches):
        for b in batches:
            sets = [shingle_set(t.as_py(), words, seed) for t in b.column(1)]
            ends = np.cumsum([0] + [len(s) for s in sets])
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]
            maps = np.concatenate([parities(s) for s in sets]) if sets else np.zeros(0, np.int64)
            lists.append(pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * (PARITY // 64), pa.int32()), pa.array(maps)))
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=["fp", "items", "bits"])

    key = whole_key(docs, ident, text)
    texts = docs.select(*[c.alias(n) for n, c in key.items()], text_of(text).alias("_text")).join(asked, list(key)).select("fp", "_text")
    return texts.mapInArrow(run, "fp long, items array<long>, bits array<long>").dropDuplicates(["fp"])


def enough(shared: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether ``shared`` elements make sets of ``a`` and ``b`` elements similar: 100 * intersection >= percent * union."""
    return shared.cast("long") * (100 + percent) >= (a + b).cast("long") * percent


def link(nodes: DataFrame, sets: DataFrame, percent: int, match: int = 1, rounds: int = 4, long_list: int = 32, known: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) that join all sets that share a key, ``match`` tokens and ``percent`` % of their elements.

    ``nodes`` has fp, n (set size), keys (an array: the node's lists) and tokens (an array, compared only if ``match``
    is over 1), ``sets`` fp, items and bits. Every edge is counted on whole sets. Two bounds, which never rule out a
    true edge, spare comparisons: elements that no other node holds can't be shared, and sets differ in as many
    elements at least as their parity maps in bits. ``known`` are candidates (a, b) from elsewhere: those that share ``percent`` % are
    edges too, and what they join is compared no more.
    """
    rare = sets.select("fp", F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("c"), F.min("fp").alias("fp"))
    own = rare.where("c = 1").groupBy("fp").agg(F.count(F.lit(1)).alias("own"))
    most = F.col("n") - F.coalesce("own", F.lit(0))
    nodes = nodes.join(own, "fp", "left").withColumn("most", most.cast("int")).drop("own")
    # a node whose own elements are too many has no partner at all
    nodes = settle(nodes.where(enough(F.col("most"), F.col("n"), F.col("most"), percent)))
    lists = settle(nodes.select("fp", F.explode("keys").alias("k")))
    several = settle(lists.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"))
    lists = settle(lists.join(several, "k"))

    def side(frame, name):
        return frame.select(*[F.col(c).alias(c if c == "k" else f"{name}_{c}") for c in frame.columns])

    def fits(x, y):
        shared = F.least(f"{x}_most", f"{y}_most")
        return enough(shared, F.col(f"{x}_n"), F.col(f"{y}_n"), percent)

    def enough_tokens(pairs):
        if match <= 1:
            return pairs
        tokens = nodes.select("fp", "tokens")
        both = pairs.join(side(tokens, "x"), pairs["a"] == F.col("x_fp")).join(side(tokens, "y"), pairs["b"] == F.col("y_fp"))
        return both.where(F.size(F.array_intersect("x_tokens", "y_tokens")) >= match).select("a", "b")

    def close(x, y):
        differ = sum((F.bit_count(F.get(f"{x}_bits", i).bitwiseXOR(F.get(f"{y}_bits", i))) for i in range(PARITY // 64)), F.lit(0))
        a, b = F.col(f"{x}_n"), F.col(f"{y}_n")
        return (a + b - differ).cast("long") * (100 + percent) >= (a + b).cast("long") * 2 * percent

    def confirm(pairs):
        whole = sets.select("fp", "items")
        both = pairs.join(side(whole, "a"), pairs["a"] == F.col("a_fp")).join(side(whole, "b"), pairs["b"] == F.col("b_fp"))
        shared = F.size(F.array_intersect("a_items", "b_items"))
        return settle(both.where(enough(shared, F.size("a_items"), F.size("b_items"), percent)).select("a", "b"))

    narrow = nodes.select("fp", "n", "most")
    edges, roots = None, None
    if known is not None:
        both = known.join(side(narrow, "x"), known["a"] == F.col("x_fp")).join(side(narrow, "y"), known["b"] == F.col("y_fp"))
        edges = confirm(settle(both.where(fits("x", "y")).select("a", "b")))
        roots = settle(components(edges).select(F.col("node").alias("fp"), "root"))

    def placed():
        """Every posting with the component of its node, and the largest component of each list that has several."""
        at = lists.join(narrow, "fp")
        if roots is None:
            at = at.withColumn("root", F.col("fp"))
        else:
            at = at.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        return settle(at)

    for turn in range(rounds + 1):
        at = placed()
        draw = F.min_by(F.struct("fp", "n", "most"), F.xxhash64(F.col("fp"), F.lit(turn)))
        top = at.groupBy("k", "root").agg(F.count(F.lit(1)).alias("c"), draw.alias("hub"))
        top = top.groupBy("k").agg(F.max_by(F.struct("root", "hub"), F.struct("c", "root")).alias("t"), F.count(F.lit(1)).alias("roots"), F.sum("c").alias("size"))
        top = top.where("roots > 1").select("k", "size", F.col("t.root").alias("top"), *[F.col(f"t.hub.{c}").alias(f"h_{c}") for c in ("fp", "n", "most")])
        top = settle(top)
        longs = top.where(F.col("size") > long_list)
        if turn == rounds or longs.isEmpty():
            break
        asked = side(at, "x").join(longs, "k").where((F.col("x_root") != F.col("top")) & fits("x", "h"))
        asked = asked.groupBy("x_fp", "h_fp").agg(F.count(F.lit(1)).alias("c"))
        asked = asked.groupBy(F.col("x_fp").alias("a")).agg(F.max_by("h_fp", F.struct("c", "h_fp")).alias("b"))
        found = confirm(settle(enough_tokens(asked)))
        edges = found if edges is None else edges.unionByName(found)
        roots = settle(components(edges).select(F.col("node").alias("fp"), "root"))

    # pairs between components: every pair once, at the smallest key its nodes share
    wide = at.join(top.select("k", "top"), "k").join(nodes.select("fp", "keys").join(sets.select("fp", "bits"), "fp"), "fp")
    wide = wide.withColumn("main", F.col("root") == F.col("top")).drop("top")
    x, y = side(wide.where("not main"), "x"), side(wide, "y").withColumnRenamed("k", "y_k")
    once = (F.col("x_root") != F.col("y_root")) & (F.col("y_main") | (F.col("x_fp") < F.col("y_fp"))) & fits("x", "y")
    first = F.array_min(F.array_intersect("x_keys", "y_keys")) == F.col("k")
    pairs = x.join(y, (F.col("k") == F.col("y_k")) & once & close("x", "y") & first)
    found = confirm(settle(enough_tokens(pairs.select(F.col("x_fp").alias("a"), F.col("y_fp").alias("b")))))
    return found if edges is None else edges.unionByName(found)
