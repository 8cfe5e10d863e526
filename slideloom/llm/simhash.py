"""SimHash near-duplicates through an inverted index of fingerprint bytes."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from slideloom.llm.common import boxed, text_of, unboxed
from slideloom.plans.scale import settle

#: The sets of four byte positions whose numbers cancel out (XOR 0). Any three positions lie
#: in one of them, and its complement is again one of them: so two fingerprints that agree in five
#: positions or more agree in all positions of at least one set.
POSITIONS = tuple(c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0)


def shingles(text: str, words: int, seed: int) -> list[int]:
    """Hashes of all runs of ``words`` words, ASCII letters in lower case; of all words if they are fewer."""
    parts = text.encode().lower().split()
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(parts), seed)] if parts else []
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = [0, *(ends[:-words] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())]


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """SimHash of the shingles of ``words`` words, ASCII letters in lower case."""
    return folded(shingles(text, words, seed))


def folded(hashes: list[int]) -> int:
    """The fingerprint of hashes: a bit is 1 if set in over half of them."""
    if not hashes:
        return 0
    lanes = np.array(hashes, np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8)
    out = 0
    for lane in range(8):
        tally = np.bincount(lanes[:, lane], minlength=256)
        ones = tally @ BITS
        out |= int(np.packbits(2 * ones > len(hashes), bitorder="little")[0]) << 8 * lane
    return out


BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """Columns ident and fp (the 64 bits as a long) of every row. A null text has no words: fp 0."""
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches):
        for b in batches:
            bits = [fingerprint(t.as_py(), words, seed) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(bits, np.uint64).view(np.int64))], names=["doc", "fp"])

    out = docs.select(F.col(ident).alias("doc"), text_of(text).alias("t")).mapInArrow(run, f"doc {kind}, fp long")
    return out.withColumnRenamed("doc", ident)


def _byte(fp, i):
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(255)


def shared_bytes(a, b):
    """How many positional bytes two fingerprints share."""
    return sum(((_byte(a, i) == _byte(b, i)).cast("int") for i in range(8)), F.lit(0))


def near(a, b, bits):
    return F.bit_count(a.bitwiseXOR(b)) <= bits


def links(prints: DataFrame, bits: int = 3, long_list: int = 64) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, enough to join all that differ in at most ``bits`` bits (3 at most).

    Inverted index: each fingerprint is posted under the bytes at every set of POSITIONS.
    Two fingerprints within 3 bits share at least 5 of 8 positional bytes and so meet in
    a list; pairs of a list are tallied by shared positional bytes, those under 5
    dropped, the rest verified. (Lists of a single byte would hold 1/256 of all rows each and their pairs grow with the
    square of the corpus; four bytes keep lists short.)

    A list of over ``long_list`` fingerprints, as large groups of near copies make, isn't
    paired. There each fingerprint is posted under itself with any of 0, 1 or 2 bits changed in
    the four other bytes. Two within 3 bits meet at a place within 1 bit of the one and 2 of the
    other. At a place with a fingerprint within 1 bit, all that meet are linked to it,
    which is true (1 + 2 bits) and joins them all; other places link none. So long
    lists cost in proportion to their length and lose no link.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the index guarantees shared bytes for up to 3 bits")
    fp = F.col("fp")

    def key(places):
        out = F.lit(0).cast("long")
        for i in places:
            out = F.shiftleft(out, 8).bitwiseOR(_byte(fp, i))
        return out

    posted = prints.select(
        "fp", F.posexplode(F.array(*[key(p) for p in POSITIONS])).alias("list", "bytes")
    )
    sized = posted.groupBy("list", "bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = settle(sized)
    short = posted.join(sized.where(F.col("n") <= long_list), ["list", "bytes"]).drop("n")
    a, b = short.withColumnRenamed("fp", "a"), short.withColumnRenamed("fp", "b")
    pairs = a.join(b, ["list", "bytes"]).where(F.col("a") < F.col("b"))
    pairs = pairs.where(shared_bytes(F.col("a"), F.col("b")) >= 8 - bits).where(near(F.col("a"), F.col("b"), bits)).select("a", "b")
    longs = sized.where(F.col("n") > long_list)
    if longs.isEmpty():
        return pairs.distinct()
    lists = posted.join(longs, ["list", "bytes"]).drop("n")
    # changes within the four bytes that the list leaves free
    free = [[8 * i + j for i in range(8) if i not in p for j in range(8)] for p in POSITIONS]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    near_by = min(1, bits)
    far_by = bits - near_by

    change = settle(prints.sparkSession.createDataFrame(
        [(n, signed(sum(1 << x for x in c)), len(c)) for n, bs in enumerate(free) for r in range(max(near_by, far_by) + 1) for c in combinations(bs, r)],
        "list int, mask long, d int",
    ))
    # one row for each position set and change: 14 * 529 at most
    places = lists.join(F.broadcast(change), "list").withColumn("place", fp.bitwiseXOR(F.col("mask")))
    hubs = places.where(F.col("d") <= near_by).groupBy("list", "place").agg(F.min("fp").alias("hub"))
    stars = places.join(hubs, ["list", "place"]).where(F.col("fp") != F.col("hub"))
    stars = stars.select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")).where(near(F.col("a"), F.col("b"), bits))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Columns node and root (the smallest node reachable) for every node of the edges (a, b).

    Large-star and small-star steps in turn until nothing changes; every step is written
    to the shared folder, so lost executors cost one step. Rounds grow with the
    logarithm of the longest path. Only one number reaches the driver each round.
    """
    edges = settle(edges.select("a", "b"))
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = settle(both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        small = settle(small.where(F.col("a") != F.col("b")).distinct())
        changed = small.join(edges, (small["a"] == edges["b"]) & (small["b"] == edges["a"]), "left_anti").isEmpty() and (
            edges.join(small, (small["a"] == edges["b"]) & (small["b"] == edges["a"]), "left_anti").isEmpty()
        )
        edges = small.select(F.col("b").alias("a"), F.col("a").alias("b"))
        if changed:
            break
    tops = edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(tops)


def near_duplicates(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42, bits: int = 3,
) -> DataFrame:
    """Columns ident, fp and component_id of every row.

    Rows whose fingerprints differ in at most ``bits`` bits are linked, and
    ``component_id`` is the smallest id that links reach, the row's own included. Rows of one
    fingerprint are one node, so copies cost nothing beyond their own row. Texts without
    words have fingerprint 0 and link like any other. Null ids take part and get the smallest id
    reached, null if all are null; an empty table gives no rows.
    """
    rows = settle(fingerprints(docs, ident, text, words, seed))
    nodes = settle(rows.groupBy("fp").agg(F.min(ident).alias("least")))
    linked = components(links(nodes.select("fp"), bits))
    linked = linked.join(nodes, linked["node"] == nodes["fp"]).select("fp", "root", "least")
    tops = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    joined = settle(linked.join(tops, "root").select("fp", "component_id"))
    own = nodes.join(joined, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(own, "fp").select(ident, "fp", "component_id")


def keep_one(docs: DataFrame, ident: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42, bits: int = 3) -> DataFrame:
    """The documents without near-duplicates (see ``near_duplicates``): one row of each component, as ``keep_first`` chooses it."""
    key = whole_key(docs, ident, text)
    named = docs.select(F.struct(*[c.alias(n) for n, c in key.items()]).alias("_key"), F.col(text).alias("_text"))
    rows = settle(fingerprints(named, "_key", "_text", words, seed).select("_key.*", "fp"))
    return keep_first(docs, rows, links(rows.select("fp").distinct(), bits), ident, text)


def whole_key(docs: DataFrame, ident: str, text: str) -> dict[str, Column]:
    """Join columns of a row, never null: its id, whether it has none, and a hash of its text. In this order rows without an id come last."""
    return {
        "_none": F.col(ident).isNull(), "_id": F.coalesce(F.col(ident), F.lit(0).cast(docs.schema[ident].dataType)),
        "_hash": F.xxhash64(F.col(text).isNull(), F.col(text)),
    }


def keep_first(docs: DataFrame, rows: DataFrame, edges: DataFrame, ident: str, text: str) -> DataFrame:
    """One row of each component: that with the smallest id, rows without an id last, then with the smallest hash of its text.

    ``rows`` has the key (see ``whole_key``) and fp of every row of ``docs``, ``edges`` (a, b) link values of fp. Rows alike in
    id and text are one document; of them the one with the smallest hash of all columns stays. The same id with texts
    of different components stays once for each.
    """
    linked = settle(components(edges))
    first = rows.groupBy("fp").agg(F.min(F.struct("_none", "_id", "_hash")).alias("_first"))
    rooted = first.join(linked, first["fp"] == linked["node"], "left").select(F.coalesce("root", "fp").alias("root"), "_first")
    kept = settle(rooted.groupBy("root").agg(F.min("_first").alias("_first")).select("_first.*"))
    # rows alike meet before the shuffle; the join stands on its partitions: texts are shuffled once
    key = whole_key(docs, ident, text)
    plain = [f"_row.`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString()]
    single = boxed(docs, **key).groupBy(*key).agg(F.min_by("_row", F.xxhash64(*plain)).alias("_row"))
    return unboxed(single.join(kept, list(key)), docs)
