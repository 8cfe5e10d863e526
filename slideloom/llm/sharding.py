"""Sharding by longest-processing-time scheduling."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, functions as F, types as T

from slideloom.llm.common import number_within, text_of
from slideloom.plans.scale import settle


def lpt(sizes: list[tuple[int, int]], shards: int) -> list[int]:
    """Shard of each (size, tie) unit: largest unit first, always to the least loaded shard."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i][0], sizes[i][1])):
        load, shard = heapq.heappop(heap)
        out[i] = shard
        heapq.heappush(heap, (load + sizes[i][0], shard))
    return out


def shard_by_size(
    docs: DataFrame, shards: int = 24, ident: str = "doc_id", text: str = "text", overhead: int = 8,
    buckets: int = 65_536, shares: int = 1_000,
) -> DataFrame:
    """Put every document into one of ``shards`` shards of nearly equal bytes.

    Documents with equal texts stay together. A group over 1/(shards*shares) of all
    bytes is scheduled by itself: there are at most shards*shares such groups. The others
    share ``buckets`` units by a hash of the text, so the driver schedules at most
    buckets + shards*shares units whatever the input, by the same rule at every size.

    Returns ident, size, text_crc32, shard, slot (gapless in each shard). A null text
    counts as the empty text; a null id is kept. Rows that repeat stay together
    and get slots of their own. An empty table gives no rows. One group larger than
    a fair share makes its shard that large: it may not be split.
    """
    t = text_of(text)
    rows = settle(docs.select(
        F.col(ident).alias("_doc"), (F.octet_length(t) + overhead).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("_group"),
    ))
    groups = settle(rows.groupBy("_group").agg(F.sum("size").alias("_bytes")))
    total = groups.agg(F.sum("_bytes")).first()[0] or 0
    alone = F.col("_bytes") * (shards * shares) > F.lit(total)
    bucket = F.pmod("_group", F.lit(buckets))
    units = groups.groupBy(alone.alias("alone"), F.when(alone, F.col("_group")).otherwise(bucket).alias("unit")).agg(
        F.sum("_bytes").alias("bytes")
    ).collect()
    placed = lpt([(u.bytes, u.unit) for u in units], shards)
    kind = T.StructType([T.StructField("_unit", T.LongType()), T.StructField("_shard", T.IntegerType())])

    def plan(which):
        part = [(u.unit, s) for u, s in zip(units, placed) if u.alone == which]
        return F.broadcast(docs.sparkSession.createDataFrame(part, kind))

    big, small = plan(True), plan(False)
    out = rows.join(big.select(F.col("_unit").alias("_group"), F.col("_shard").alias("_own")), "_group", "left").withColumn("_unit", bucket)
    out = out.join(small, "_unit", "left").withColumn("shard", F.coalesce("_own", "_shard"))
    out = settle(out.select("_doc", "size", "text_crc32", "shard"))
    return number_within(out, "shard", ["_doc", "text_crc32", "size"], "slot").select(
        F.col("_doc").alias(ident), "size", "text_crc32", "shard", "slot"
    )
