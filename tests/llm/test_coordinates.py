"""MinHash near-duplicates against exact similarity over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from slideloom.llm.coordinates import near_duplicates
from slideloom.llm.queries import QUERIES


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def brute(rows, words=4, percent=80):
    """{(id, text): (n_shingles, component_id)} of rows with ids, over all pairs."""
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for sh in s:
            holders.setdefault(sh, []).append(i)
    shared = {}
    for h in holders.values():
        for x in range(len(h)):
            for y in range(x):
                shared[h[y], h[x]] = shared.get((h[y], h[x]), 0) + 1
    for (i, j), m in shared.items():
        if 100 * m >= percent * (len(sets[i]) + len(sets[j]) - m):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for i, (ident, _) in enumerate(rows):
        if ident is not None:
            least[find(i)] = min(ident, least.get(find(i), ident))
    return [(len(sets[i]), least.get(find(i))) for i in range(len(rows))]


def compare(out, rows):
    want = sorted(((i, n, c, i == c) for (i, _), (n, c) in zip(rows, brute(rows))), key=repr)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out), key=repr) == want


def test_query_against_all_pairs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    compare(QUERIES["op12_minhash_coordinates"](spark, sf_dir).collect(), rows)


def test_groups_chains_and_a_common_passage(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"W{rng.getrandbits(40):x}" for _ in range(n)]
    texts, base = [], fresh(220)
    for _ in range(160):  # a wide group: some of it out of reach
        copy = list(base)
        for at in rng.sample(range(220), rng.randint(0, 14)):
            copy[at] = fresh(1)[0]
        texts.append(" ".join(copy))
    chain = fresh(150)
    for _ in range(25):  # each near its neighbours only
        chain = chain[6:] + fresh(6)
        texts.append("\n".join(chain))
    passage = fresh(150)
    for _ in range(60):  # similarity 0.74 by the passage alone
        texts.append(" ".join(passage + fresh(26)))
    for _ in range(10):  # pairs among them
        rest = fresh(26)
        texts += [" ".join(passage + rest), " ".join(passage + rest[:-3] + fresh(3))]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 100))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    compare(near_duplicates(df).collect(), rows)


@pytest.mark.parametrize("words", [1, 4])
def test_edges_of_similarity(spark, words):
    """Pairs just above and just below 80 %, counted in shingles."""
    rows = []
    for k in range(40):
        common, n = 40 + k, words - 1
        for extra in (k % 12, 11 - k % 12):
            rows.append((len(rows), " ".join(f"p{k}w{i}" for i in range(common + n)) + "".join(f" p{k}x{len(rows)}y{i}" for i in range(extra))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = near_duplicates(df, words=words).collect()
    want = brute(rows, words)
    assert {r.doc_id: r.component_id for r in out} == {i: c for (i, _), (_, c) in zip(rows, want)}


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (7, None), (8, None), (9, ""), (10, " \n\t"), (11, "One two"), (5, "oNE\x0btwo"), (12, "one two three"), (13, long), (3, long + " end"),
        (None, "a b c d e f"), (20, "A b c d e f"), (None, "x y z q"), (None, "X y z q"), (30, "rep eat ed id"), (30, "rep eat ed id"), (30, "other text of it"),
        (31, "é É ß é x"), (32, "É É ß é x"),
    ]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, tokens string, fp int")
    out = near_duplicates(df).collect()
    want = sorted(((i, n, c, i == c) for (i, _), (n, c) in zip(rows, brute(rows))), key=repr)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out), key=repr) == want
    assert near_duplicates(df.limit(0)).count() == 0
    assert near_duplicates(df.where("text is null")).where("kept and component_id = doc_id and n_shingles = 0").count() == 2
    named = near_duplicates(df.withColumnRenamed("doc_id", "c").withColumn("c", F.col("c").cast("int")), ident="c")
    assert named.columns == ["c", "n_shingles", "component_id", "kept"] and named.count() == len(rows)
    with pytest.raises(ValueError):
        near_duplicates(df, percent=70)
