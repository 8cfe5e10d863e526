"""Near copies by the exact similarity of their shingle sets, found by fingerprint bytes and by signature coordinates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from slideloom.llm.common import text_of
from slideloom.llm.coordinates import MATCH, prefixes, signature
from slideloom.llm.linking import link, shingle_sets
from slideloom.llm.simhash import folded, keep_first, links, shingles, whole_key
from slideloom.plans.scale import settle

#: Differing bits that the byte index joins: as many as its lists guarantee.
BITS = 3


def measure(docs: DataFrame, ident: str, text: str, words: int, seed: int) -> DataFrame:
    """The key of every row (see ``whole_key``), fp (a hash of its set of shingles), n (its size), bits (the SimHash of its shingles) and tokens (its signature)."""
    def run(batches):
        for b in batches:
            runs = [shingles(t.as_py(), words, seed) for t in b.column(3)]
            sets = [np.unique(np.array(r, np.uint64)) for r in runs]
            prints = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            bits = np.array([folded(r) for r in runs], np.uint64).view(np.int64)
            signed = [signature(s) for s in sets]
            ends = np.cumsum([0] + [len(s) for s in signed])
            flat = np.concatenate(signed) if signed else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(prints), pa.array([len(s) for s in sets], pa.int32()), pa.array(bits), lists],
                names=["_none", "_id", "_hash", "fp", "n", "bits", "tokens"],
            )

    key, kind = whole_key(docs, ident, text), docs.schema[ident].dataType.simpleString()
    named = docs.select(*[c.alias(n) for n, c in key.items()], text_of(text).alias("_text"))
    return named.mapInArrow(run, f"_none boolean, _id {kind}, _hash long, fp long, n int, bits long, tokens array<long>")


def byte_pairs(nodes: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b) of fp that join all ``nodes`` (fp, bits) whose SimHashes differ in ``most`` bits or fewer: those of the byte index, and stars of one SimHash."""
    held = settle(nodes.groupBy("bits").agg(F.min("fp").alias("rep")))
    same = nodes.join(held, "bits").where(F.col("fp") != F.col("rep")).select(F.col("rep").alias("a"), F.col("fp").alias("b"))
    near = links(held.select(F.col("bits").alias("fp")), most).select(F.col("a").alias("x"), F.col("b").alias("y"))
    near = near.join(held.select(F.col("bits").alias("x"), F.col("rep").alias("a")), "x").join(held.select(F.col("bits").alias("y"), F.col("rep").alias("b")), "y")
    return near.select("a", "b").unionByName(same)


def similar(docs: DataFrame, rows: DataFrame, ident: str, text: str, words: int, seed: int, percent: int) -> DataFrame:
    """Edges (a, b) that join all different sets (fp) with a Jaccard similarity of ``percent`` % or more, counted on the whole sets.

    Pairs of the byte index are verified first, and what they join is compared no more. Pairs of 0.8 differ in more bits
    than 8 bytes can guarantee: all others meet in the inverted join of coordinates, which alone would miss a link with probability under 1e-5.
    """
    nodes = settle(rows.groupBy("fp").agg(
        F.first("n").alias("n"), F.min("bits").alias("bits"), F.first("tokens").alias("tokens"), F.min(F.struct("_none", "_id", "_hash")).alias("_key")
    ))
    active = settle(prefixes(nodes, MATCH))
    sets = settle(shingle_sets(docs, active.select("fp", "_key.*"), ident, text, words, seed))
    # the byte index does the work of the first round; hubs of later ones link next to nothing here and cost as many jobs
    return link(active.drop("_key", "bits"), sets, percent, MATCH, rounds=1, known=byte_pairs(active.select("fp", "bits"), BITS))


def keep_one(docs: DataFrame, ident: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, seed: int = 42) -> DataFrame:
    """The documents without near copies: one row of each group, as ``keep_first`` chooses it.

    Two texts are linked if the sets of their shingles of ``words`` words (ASCII letters in lower case)
    have a Jaccard similarity of ``percent`` % or more; a group is what links reach. A text of fewer words is
    one shingle; null texts and texts without words have the empty set and are one group. Signatures are made for 80 % or more.
    """
    if not 80 <= percent <= 100:
        raise ValueError("the match threshold is made for similarities from 80 %")
    rows = settle(measure(docs, ident, text, words, seed))
    return keep_first(docs, rows, similar(docs, rows, ident, text, words, seed, percent), ident, text)
