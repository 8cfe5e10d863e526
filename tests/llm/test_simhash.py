"""SimHash near-duplicates against a plain Python version over all pairs."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from slideloom.llm.queries import QUERIES
from slideloom.llm.simhash import POSITIONS, components, fingerprint, keep_one, links, near_duplicates


def slow_print(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [words[i : i + n] for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64(" ".join(s).encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, bits=3):
    """Smallest index reachable, over all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_positions_cover_every_three_bytes():
    assert len(POSITIONS) == 14
    for i in range(8):
        for j in range(i):
            for k in range(j):
                assert any(not {i, j, k} & set(p) for p in POSITIONS)


@pytest.mark.parametrize("text", ["", " \n\t", "One", "One two", "A b C d e", "É x ß y É x ß", "a " * 500, "w\x0bx\x0cy\rz"])
def test_fingerprint(text):
    assert fingerprint(text) == slow_print(text)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("long_list", [64, 2])
@pytest.mark.parametrize("bits", [3, 2, 1, 0])
def test_links_join_all_near_pairs(spark, long_list, bits):
    rng = random.Random(bits)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for p in rng.sample(sorted(prints), 30):
        for _ in range(rng.randint(1, 8)):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                p ^= 1 << b
            prints.add(p)
    prints = sorted(prints)
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    edges = links(df, bits, long_list)
    for r in edges.collect():
        assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= bits
    roots = {r.node: r.root for r in components(edges).collect()}
    got = [roots.get(signed(p), signed(p)) for p in prints]
    want = groups(prints, bits)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 4000)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}, 5000: 4000, 4000: 4000}
    assert components(df.limit(0)).count() == 0


def test_query_against_all_pairs(spark, sf_dir):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda d: d.doc_id)
    prints = [slow_print(d.text or "") for d in docs]
    want = {docs[i].doc_id: (f"{prints[i]:016x}", docs[g].doc_id) for i, g in enumerate(groups(prints))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op4_simhash_bytes"](spark, sf_dir).collect()}
    assert got == want


def test_nulls_repeats_and_clashing_columns(spark):
    body = "some words that make a text of its own kind here"
    rows = [(7, None, "a"), (3, "", "b"), (None, body, "c"), (9, body, "d"), (9, body, "e"), (4, "x " * 40_000, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").withColumn("fp", F.lit(1))
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(7, 3), (3, 3), (None, 9), (9, 9), (9, 9), (4, 4)], key=str)
    kept = keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 9]
    assert near_duplicates(df.limit(0)).count() == 0 and keep_one(df.limit(0)).count() == 0


def test_keep_one_of_null_and_repeated_ids(spark):
    prose = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(None, prose(1)), (None, prose(2)), (None, prose(2)), (None, prose(3)), (5, prose(3)), (7, prose(4)), (7, prose(5)), (7, prose(5)), (8, prose(5)), (None, None), (None, "")]
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, n long").repartition(5)
    kept = keep_one(df).collect()
    want = [(None, prose(1)), (None, prose(2)), (5, prose(3)), (7, prose(4)), (7, prose(5))]
    assert sorted(((r.doc_id, r.text) for r in kept if r.text), key=str) == sorted(want, key=str)
    assert sum(not r.text for r in kept) == 1
