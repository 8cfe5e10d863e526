"""LPT sharding."""

import random
import zlib

from slideloom.llm.queries import QUERIES
from slideloom.llm.sharding import lpt, shard_by_size


def test_lpt_follows_the_rule():
    rng = random.Random(2)
    sizes = [(rng.randint(1, 1000), i) for i in range(400)]
    loads, want = [0] * 7, {}
    for size, i in sorted(sizes, key=lambda s: (-s[0], s[1])):
        s = min(range(7), key=lambda s: (loads[s], s))
        loads[s] += size
        want[i] = s
    assert lpt(sizes, 7) == [want[i] for i in range(400)]
    assert lpt([], 3) == []


def check(rows, texts, shards):
    slots, load, place = {}, [0] * shards, {}
    for r, t in zip(rows, texts):
        slots.setdefault(r["shard"], []).append(r["slot"])
        load[r["shard"]] += r["size"]
        assert place.setdefault(t or "", r["shard"]) == r["shard"]
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return load


def test_query(spark, sf_dir):
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op7_lpt_shards"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "bytes")
    load = check(rows, [docs[r.doc_id] for r in rows], 24)
    assert max(load) - min(load) <= max(r.size for r in rows)


def test_edges(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "bb"]) * rng.randint(1, 300), i) for i in range(3000)]
    rows += [(5000 + i, "the same text", 0) for i in range(1500)] + [(None, None, 1), (None, "", 2), (9000, "z" * 500_000, 3)] + [(9001, "twin", 4)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, shard long")
    out = shard_by_size(df.withColumnRenamed("shard", "slot"), shards=5).collect()
    by = {}
    for i, t, _ in rows:
        by.setdefault((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())), t)
    load = check(out, [by[r.doc_id, r["size"], r.text_crc32] for r in out], 5)
    assert len(out) == len(rows) and sorted(load)[-1] >= 500_008
    rest = [x for x in load if x < 500_000]
    assert max(rest) - min(rest) < 20_000
    assert shard_by_size(df.limit(0)).count() == 0
