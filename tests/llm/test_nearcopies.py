"""Near copies of the pipeline's stage against exact similarity over all pairs."""

import random

import corpus_pipeline


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def stage(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect())


def test_copies_from_similarity_eight_tenths(spark):
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.getrandbits(40):x}" for _ in range(n)]
    texts, want = [], []
    for changed in (1, 2, 3, 4, 5, 6, 9, 12, 20) * 6:
        base = fresh(300)
        copy = list(base)
        for at in rng.sample(range(10, 290), changed):
            copy[at] = fresh(1)[0]
        want.append(len(texts))
        texts.append(" ".join(base))
        if jaccard(texts[-1], " ".join(copy)) < 0.8:
            want.append(len(texts))
        texts.append(" ".join(copy))
    assert stage(spark, texts) == want


def test_a_large_group_and_a_common_passage(spark):
    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.getrandbits(40):x}" for _ in range(n)]
    base, passage, texts = fresh(200), fresh(80), []
    for _ in range(200):
        copy = list(base)
        for at in rng.sample(range(200), rng.randint(0, 3)):
            copy[at] = fresh(1)[0]
        texts.append(" ".join(copy))
    for _ in range(150):
        texts.append(" ".join(passage + fresh(60)))
    pair = passage + fresh(60)
    texts += [" ".join(pair), " ".join(pair[:-4] + fresh(4))]
    assert stage(spark, texts) == [0, *range(200, 351)]


def test_candidates_come_from_the_byte_index_and_the_coordinate_join(spark, monkeypatch):
    from slideloom.llm import coordinates, nearcopies

    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.getrandbits(40):x}" for _ in range(n)]
    texts = []
    for changed in (1, 1, 1, 1, 5, 6):
        base = fresh(400)
        copy = list(base)
        for at in rng.sample(range(10, 390), changed):
            copy[at] = fresh(1)[0]
        texts += [" ".join(base), " ".join(copy)]
    seen, link = {}, nearcopies.link

    def watch(nodes, sets, percent, match, known, **rest):
        seen.update(nodes=nodes.collect(), match=match, known=[(r.a, r.b) for r in known.collect()])
        return link(nodes, sets, percent, match, known=known, **rest)

    monkeypatch.setattr(nearcopies, "link", watch)
    assert stage(spark, texts) == list(range(0, 12, 2))
    # lists are the coordinates of the signature, of which a pair must share enough
    assert seen["match"] == coordinates.MATCH and len(seen["nodes"]) == 12
    assert all(len(r.tokens) == coordinates.COORDINATES and set(r.keys) <= set(r.tokens) for r in seen["nodes"])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r._id: r for r in nearcopies.measure(df, "doc_id", "text", 5, 42).collect()}
    apart = lambda i, j: bin((rows[i].bits ^ rows[j].bits) & (2**64 - 1)).count("1")
    near = {frozenset((rows[i].fp, rows[j].fp)) for i in rows for j in rows if i < j and apart(i, j) <= nearcopies.BITS}
    assert near and {frozenset(p) for p in seen["known"]} == near
