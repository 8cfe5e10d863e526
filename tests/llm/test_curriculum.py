"""Curriculum mixing against a plain Python version."""

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pytest
from check import compare, oracle
from pyspark.sql import functions as F

from slideloom.llm.curriculum import SCHEDULES, mix, plan_mix, time_of
from slideloom.llm.queries import QUERIES, SQL

WORD = re.compile("[^ \t\n\x0b\x0c\r]+")


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Fill by weight, stop the full, share the excess, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] >= most * sizes[s]}
        if not full:
            out |= {s: level * w[s] for s in free}
            break
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= full
    return out


@pytest.mark.parametrize("schedule", [*SCHEDULES, (0.0, 1.0), (1.0, 0.0), (0.0, 1.0, 0.0, 2.0), (3.0, 0.0, 1.0)])
def test_time_inverts_the_integral(spark, schedule):
    shares = np.linspace(0, 1, 101)
    df = spark.createDataFrame([(float(s),) for s in shares], "s double")
    got = [r.t for r in df.select(time_of(F.col("s"), schedule).alias("t")).collect()]
    grid = np.linspace(0, 1, 200_001)
    w = np.interp(grid, np.linspace(0, 1, len(schedule)), schedule)
    done = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
    assert np.abs(np.interp(got, grid, done / done[-1]) - shares).max() < 1e-4
    assert (np.diff(got) >= -1e-12).all() and min(got) >= 0 and max(got) <= 1


def test_plan_against_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    size = {d.doc_id: len(WORD.findall(d.text or "")) for d in docs}
    sizes = defaultdict(int)
    for d in docs:
        sizes[d.source] += size[d.doc_id]
    want = targets(sizes)
    order = defaultdict(list)
    for d in docs:
        order[d.source].append((hashlib.md5(str(d.doc_id).encode()).hexdigest(), d.doc_id))
    taken = {}
    for s, ids in order.items():
        at, quota = 0, math.floor(want[s] + 0.5)
        for _, i in sorted(ids):
            taken[i] = sum(max(0, min(size[i], quota - k * sizes[s] - at)) for k in range(2))
            at += size[i]
    rows = {r.doc_id: r for r in QUERIES["op9_curriculum_mix"](spark, sf_dir).collect()}
    for d in docs:
        r = rows[d.doc_id]
        assert (r.size, r.source_size, r.taken) == (size[d.doc_id], sizes[d.source], taken[d.doc_id])
        assert math.isclose(r.target, want[d.source], rel_tol=1e-9) and r.taken <= 2 * r.size


def test_matches_sql(spark, sf_dir):
    name = "op9_curriculum_mix"
    assert compare(QUERIES[name](spark, sf_dir), oracle(sf_dir), SQL[name]) == ""


def test_mix_reads_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix(docs, position="at").collect()
    assert [r["at"] for r in out] == sorted(r["at"] for r in out)
    text = {d.doc_id: d.text for d in docs.collect()}
    words = defaultdict(int)
    for r in out:
        assert text[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        words[r.doc_id] += len(WORD.findall(r.text))
    assert words == {r._doc: r.taken for r in plan_mix(docs).collect() if r.taken}
    half = defaultdict(float)
    for r in out:
        half[r.source, r["at"] > 0.5] += len(WORD.findall(r.text))
    # the second source in turn grows over time, the third shrinks
    names = sorted({s for s, _ in half})
    assert half[names[1], True] > half[names[1], False] and half[names[2], True] < half[names[2], False]


def test_nulls_repeats_empty(spark):
    rows = [(1, "a b c", "x", 1), (1, "a b c", "x", 1), (2, None, "x", 2), (None, "d e", None, 3), (3, "", "zero", 4), (4, "w " * 50_000, "y", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _r int").withColumn("_id", F.lit("x")).withColumn("_row", F.lit(1))
    plan = {(r._doc, r["source"]): r for r in plan_mix(df).collect()}
    sizes = {"x": 6, None: 2, "zero": 0, "y": 50_000}
    want = targets(sizes)
    for (i, s), r in plan.items():
        assert math.isclose(r.target, want[s], abs_tol=1e-9) and r.source_size == sizes[s]
    assert plan[1, "x"]._copies == 2 and plan[2, "x"].taken == 0 and plan[3, "zero"].taken == 0
    out = mix(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} >= {1, 4}
    assert mix(df.limit(0)).count() == 0 and plan_mix(df.limit(0)).count() == 0
    assert mix(df.where("doc_id = 2")).count() == 0


def test_one_document_in_two_sources(spark):
    """Each source reads its own row: never more than twice its size, and as planned."""
    rows = [(1, "one two three four", "x"), (1, "one two three four", "y"), (2, "five six", "x"), (3, "seven eight nine", None), (1, "one two three four", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {(r._doc, r["source"]): r.taken for r in plan_mix(df).collect()}
    words = defaultdict(int)
    for r in mix(df).collect():
        words[r.doc_id, r.source] += len(WORD.findall(r.text))
    assert words == {k: v for k, v in plan.items() if v}
