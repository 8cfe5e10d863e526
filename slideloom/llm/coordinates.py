"""MinHash near-duplicates by an inverted join of signature coordinates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from slideloom.llm.common import text_of
from slideloom.llm.linking import link, shingle_set, shingle_sets
from slideloom.llm.simhash import components, whole_key
from slideloom.plans.scale import settle

#: Coordinates of a signature, and how many a pair must share. A pair of similarity 0.8 agrees in
#: 51 on average; fewer than 36 have probability 4e-6, and less for more similar pairs.
COORDINATES, MATCH = 64, 36
_FACTORS, _SHIFTS = np.random.default_rng(11).integers(0, 2**64, (2, COORDINATES), np.uint64, endpoint=False)
_FACTORS |= np.uint64(1)


def signature(found: np.ndarray) -> np.ndarray:
    """A posting key for each coordinate: the least hash of the set with the coordinate's number in its last bits."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for start in range(0, len(found), 4096):
        part = found[start : start + 4096, None]
        least = np.minimum(least, (part * _FACTORS + _SHIFTS).min(0))
    return ((least & ~np.uint64(COORDINATES - 1)) | np.arange(COORDINATES, dtype=np.uint64)).view(np.int64)


def measure(docs: DataFrame, ident: str, text: str, words: int, seed: int) -> DataFrame:
    """The key of every row (see ``whole_key``), fp (a hash of its set of shingles), n (its size) and tokens (its signature)."""
    def run(batches):
        for b in batches:
            sets = [shingle_set(t.as_py(), words, seed) for t in b.column(3)]
            prints = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            signed = [signature(s) for s in sets]
            ends = np.cumsum([0] + [len(s) for s in signed])
            flat = np.concatenate(signed) if signed else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(prints), pa.array([len(s) for s in sets], pa.int32()), lists], names=["_none", "_id", "_hash", "fp", "n", "tokens"]
            )

    key, kind = whole_key(docs, ident, text), docs.schema[ident].dataType.simpleString()
    named = docs.select(*[c.alias(n) for n, c in key.items()], text_of(text).alias("_text"))
    return named.mapInArrow(run, f"_none boolean, _id {kind}, _hash long, fp long, n int, tokens array<long>")


def prefixes(nodes: DataFrame, match: int) -> DataFrame:
    """The nodes (with tokens) that can share ``match`` coordinates with another, and in keys the lists they must meet in.

    Only coordinate values that two nodes or more hold can collide. A node with t of them
    and a partner share ``match``, so both hold one of the t - match + 1 values rarest in the corpus:
    those lists are merged, the long ones beyond are skipped and only looked at for candidates.
    """
    posted = nodes.select("fp", F.explode("tokens").alias("k"))
    shared = settle(posted.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    ranked = posted.join(shared, "k").groupBy("fp").agg(F.sort_array(F.collect_list(F.struct("c", "k"))).alias("r"))
    ranked = settle(ranked.where(F.size("r") >= match).select("fp", F.slice("r.k", F.lit(1), F.size("r") - (match - 1)).alias("keys")))
    return nodes.join(ranked, "fp")


def near_duplicates(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", words: int = 4, percent: int = 80, seed: int = 42, match: int = MATCH,
) -> DataFrame:
    """Columns ident, n_shingles, component_id and kept for every row.

    A row's set holds the distinct shingles of ``words`` words (ASCII letters in lower case); with fewer
    words, all of them are its one shingle. Two rows are linked if 100 * intersection >= ``percent`` * union, counted on
    the whole sets (elements are 64-bit hashes); component_id is the smallest id that links reach. Null
    texts and texts without words have the empty set and link with nothing, not even each other. Rows of one set
    are one node. Null ids take part: component_id is null only if all ids of the component are, and then all its
    rows are kept; else kept is ident = component_id, so rows that repeat an id are kept or dropped together. Other
    columns are not read; an empty table gives no rows.

    Signatures are made for 80 % or more; a link is missed with probability under 1e-5 each (see ``MATCH``), and found anyway
    if other links join the two.
    """
    if not 80 <= percent <= 100:
        raise ValueError("the match threshold is made for similarities from 80 %")
    rows = settle(measure(docs, ident, text, words, seed))
    holds = F.min(F.when(~F.col("_none"), F.col("_id"))).alias("least")
    full = rows.where("n > 0")
    nodes = settle(full.groupBy("fp").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.min(F.struct("_none", "_id", "_hash")).alias("_key"), holds))
    active = settle(prefixes(nodes.select("fp", "n", "tokens", "_key"), match))
    sets = settle(shingle_sets(docs, active.select("fp", "_key.*"), ident, text, words, seed))
    linked = components(link(active.drop("_key"), sets, percent, match))
    linked = settle(linked.join(nodes.select("fp", "least"), F.col("node") == F.col("fp")).select("fp", "root", "least"))
    tops = linked.groupBy("root").agg(F.min("least").alias("joined"))
    joined = linked.join(tops, "root").select("fp", "joined")
    own = settle(nodes.select("fp", "least").join(joined, "fp", "left").select("fp", F.coalesce("joined", "least").alias("component_id")))
    narrow = rows.select("_none", "_id", "fp", "n")
    done = narrow.where("n > 0").join(own, "fp").select("_none", "_id", "n", "component_id")
    alone = narrow.where("n = 0").select("_none", "_id", "n", F.when(~F.col("_none"), F.col("_id")).alias("component_id"))
    ident_of = F.when(~F.col("_none"), F.col("_id"))
    return done.unionByName(alone).select(
        ident_of.alias(ident), F.col("n").cast("long").alias("n_shingles"), "component_id", ident_of.eqNullSafe(F.col("component_id")).alias("kept")
    )
