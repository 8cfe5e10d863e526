"""Linear quadtrees over tables of points, one tree per sample.

A node is one number: a leading 1 and two bits a level, so a parent is ``id >> 2`` and the root is 1. A sample's
leaves follow its own density; no level, side or bound is common to all samples.

* ``plant``       the leaf of every site
* ``grow``        all nodes with their boxes, from the leaves upward
* ``leaf_pairs``  pairs of leaves that may hold nearest neighbours, by descending node against node
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window, functions as F

from .scale import attach, settle

#: Levels below the root; sites nearer than 2**-30 of their sample's extent may share a leaf beyond its occupancy.
DEPTH = 30
_STEP = 5
_HOP = 3


def _spread(v):
    """The lower 32 bits of ``v`` with a zero before each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def plant(sites, key, occupancy):
    """``sites`` (key, _x, _y, …: distinct finite points) with ``_leaf``: the coarsest node of at most ``occupancy`` sites.

    Sites are counted by cell five levels at a time; the levels between come from windows over at most 1,024 cells.
    Only sites without a leaf go on to finer cells.
    """
    extent = sites.groupBy(key).agg(
        F.min("_x").alias("_x0"), F.min("_y").alias("_y0"), F.greatest(F.max("_x") - F.min("_x"), F.max("_y") - F.min("_y")).alias("_side")
    )
    last = (1 << DEPTH) - 1

    def at(c):
        share = F.when(F.col("_side") > 0, (F.col(f"_{c}") - F.col(f"_{c}0")) / F.col("_side")).otherwise(0.0)
        return _spread(F.least(F.floor(share * float(1 << DEPTH)), F.lit(last)).cast("long"))

    todo = settle(attach(sites, extent, key).withColumn("_code", at("x") + F.shiftleft(at("y"), 1)).drop("_x0", "_y0", "_side"))
    kept = []
    for level in range(0, DEPTH, _STEP):
        low = level + _STEP
        todo = todo.withColumn("_p", F.shiftright("_code", 2 * (DEPTH - low)))
        cells = todo.groupBy(key, "_p").agg(F.count(F.lit(1)).alias("_n"))
        fits = []
        for i in range(0 if level == 0 else 1, _STEP + 1):
            inside = F.sum("_n").over(Window.partitionBy(key, F.shiftright("_p", 2 * (_STEP - i))))
            cells = cells.withColumn(f"_s{i}", inside)
            fits.append(F.when(F.col(f"_s{i}") <= occupancy, level + i))
        cells = cells.select(key, "_p", F.coalesce(*fits, F.lit(DEPTH if low == DEPTH else None).cast("int")).alias("_lv"))
        todo = settle(attach(todo, cells, [key, "_p"], "inner").drop("_p"))
        one = F.lit(1).cast("long")
        node = F.call_function("shiftleft", one, F.col("_lv") * 2) + F.call_function("shiftright", F.col("_code"), (F.lit(DEPTH) - F.col("_lv")) * 2)
        kept.append(todo.where(F.col("_lv").isNotNull()).withColumn("_leaf", node).drop("_code", "_lv"))
        todo = todo.where(F.col("_lv").isNull()).drop("_lv")
        if todo.isEmpty():
            break
    return settle(reduce(lambda a, b: a.unionByName(b), kept))


def gap2(a, b, far=False):
    """Least (or greatest) squared distance between two boxes, named by their column prefixes."""
    def side(c):
        right, left = F.col(f"{a}{c}1") - F.col(f"{b}{c}0"), F.col(f"{b}{c}1") - F.col(f"{a}{c}0")
        return F.greatest(right, left) if far else F.greatest(-right, -left, F.lit(0.0))

    return side("x") * side("x") + side("y") * side("y")


def grow(planted, key, bound):
    """All nodes: key, _id, _inner, the box of their sites and ``_u``, a squared distance in which every site has a neighbour.

    ``bound`` is a column of the sites: the squared distance to some other site, infinite if none is known yet.
    """
    box = lambda c: [F.min(f"_{c}0").alias(f"_{c}0"), F.max(f"_{c}1").alias(f"_{c}1")]
    leaves = planted.select(key, "_leaf", F.col("_x").alias("_x0"), F.col("_x").alias("_x1"), F.col("_y").alias("_y0"), F.col("_y").alias("_y1"), bound.alias("_u"))
    leaves = leaves.groupBy(key, "_leaf").agg(*box("x"), *box("y"), F.max("_u").alias("_u"), F.count(F.lit(1)).alias("_n"))
    up = leaves.withColumn("_up", F.explode(F.sequence(F.lit(0), F.floor((F.length(F.bin("_leaf")) - 1) / 2).cast("int"))))
    nodes = up.groupBy(key, F.call_function("shiftright", F.col("_leaf"), F.col("_up") * 2).alias("_id")).agg(
        *box("x"), *box("y"), F.max("_u").alias("_u"), F.sum("_n").alias("_n"), (F.max("_up") > 0).alias("_inner")
    )
    w, h = F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")
    return settle(nodes.withColumn("_u", F.least("_u", F.when(F.col("_n") > 1, w * w + h * h))))


def leaf_pairs(nodes, key):
    """Ordered pairs of different leaves (_a, _b), b's box (_bx0 …) and ``_u``: a site of a has its nearest neighbour in a or in one of its b.

    A pair of nodes goes on to the pairs of nodes three levels below them (or of their leaves) if the boxes are no farther apart than the smallest known bound
    of a: its own, its parents', or the farthest corners of a and any node paired with it. So a lone far site
    descends into the near side of a dense cluster only. A node meets the few nodes around it at every level; no node is a hot key.
    """
    # three levels a round: nodes of every third level, and leaves below the last such level above them
    depth = F.floor((F.length(F.bin("_id")) - 1) / 2).cast("int")
    up = F.when(depth > 0, (depth - 1) % _HOP + 1).otherwise(0)
    below = nodes.where((depth > 0) & ((depth % _HOP == 0) | ~F.col("_inner"))).withColumn("_from", F.call_function("shiftright", F.col("_id"), up * 2))
    kids = settle(below.unionByName(nodes.where("NOT _inner").withColumn("_from", F.col("_id"))).drop("_n"))

    def side(s):
        names = {c: f"_{s}{c[1:]}" for c in ("_x0", "_x1", "_y0", "_y1")}
        return kids.withColumnsRenamed({**names, "_u": f"_u{s}", "_inner": f"_in{s}", "_id": f"_i{s}", "_from": f"_{s}"})

    pairs = nodes.where("_id = 1 AND _n > 1").select(key, F.col("_id").alias("_a"), F.col("_id").alias("_b"), "_u")
    found = []
    while True:
        met = pairs.join(side("a"), [key, "_a"]).join(side("b").drop("_ub"), [key, "_b"]).withColumn("_u", F.least("_u", "_ua"))
        met = settle(met.withColumn("_d2", gap2("_a", "_b")).where(F.col("_d2") <= F.col("_u")).drop("_a", "_b", "_ua"))
        best = met.groupBy(key, "_ia").agg(F.min(F.least("_u", F.when(F.col("_ia") != F.col("_ib"), gap2("_a", "_b", far=True)))).alias("_best"))
        near = met.join(best, [key, "_ia"]).where(F.col("_d2") <= F.col("_best")).withColumn("_u", F.col("_best"))
        near = near.withColumnsRenamed({"_ia": "_a", "_ib": "_b"})
        ended = ~F.col("_ina") & ~F.col("_inb")
        found.append(near.where(ended & (F.col("_a") != F.col("_b"))).select(key, "_a", "_b", "_u", "_bx0", "_bx1", "_by0", "_by1"))
        pairs = settle(near.where(~ended).select(key, "_a", "_b", "_u"))
        if pairs.isEmpty():
            return reduce(lambda a, b: a.unionByName(b), found)
