"""Token alignment against a plain version over all pairs of byte ranges."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from slideloom.llm.queries import QUERIES, tokenizer
from slideloom.llm.tokenalign import IDS, ByteLevel, PairTexts, Pieces, align, groups_of, written

FILES = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


def spans(ids, pieces):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(pieces[i])))
        at += len(pieces[i])
    return out


def brute(texts):
    """The query's columns after doc_id of every text: links over all pairs of ranges."""
    left, right = ByteLevel(FILES[0]), Pieces(FILES[1])
    found, held = [], {}
    for t in texts:
        a, b, goal = left.encode([" " + (t or "")])[0], right.encode([t or ""])[0], (" " + (t or "")).encode()
        if not t or b"".join(left.pieces[i] for i in a) != goal or b"".join(right.pieces[i] for i in b) != goal:
            a, b = [], []
        sa, sb = spans(a, left.pieces), spans(b, right.pieces)
        links = [(x, y) for x, (f, g) in zip(a, sa) for y, (h, k) in zip(b, sb) if f < k and h < g]
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        parts, low = [], 0
        for c in cuts:
            parts.append(",".join(str(x) for x, (f, g) in zip(a, sa) if low <= f and g <= c) + "|" + ",".join(str(y) for y, (h, k) in zip(b, sb) if low <= h and k <= c))
            low = c
        found.append((len(a), len(b), len(cuts), links, ";".join(parts)))
        for p in set(links):
            held[p] = held.get(p, 0) + 1
    best = {}
    for (x, _), c in held.items():
        best[x] = max(c, best.get(x, 0))
    return [
        (na, nb, ng, len(ls), sum(held[p] == best[p[0]] for p in ls), sum(held[p] for p in ls), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for na, nb, ng, ls, g in found
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = [(d.doc_id, d.text if d.text is None or len(d.text) < 2_500 else None) for d in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = align(df, *FILES, keep=["doc_id"], block_bytes=20_000).select("_row.doc_id", *COLUMNS).collect()
    assert {r.doc_id: tuple(r)[1:] for r in out} == dict(zip([i for i, _ in rows], brute([t for _, t in rows])))
    whole = QUERIES["op13_token_alignment"](spark, sf_dir).collect()
    same = {d.doc_id for d, (_, t) in zip(docs, rows) if t == d.text}
    few = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) for r in whole}
    assert len(whole) == len(docs) and all(few[r.doc_id] == (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) for r in out if r.doc_id in same)
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups for r in whole) and sum(r.n_groups > 0 for r in whole) > len(docs) / 2


def test_slices_against_ranges():
    rng = random.Random(2)
    for _ in range(300):
        size = list(range(8))  # an id's size is the id
        a = [rng.randint(1, 7) for _ in range(rng.randint(1, 30))]
        b, left = [], sum(a)
        while left:
            b.append(rng.randint(1, min(7, left)))
            left -= b[-1]
        to_a, to_b, lasts, wide, links = groups_of(a, b, np.array(size), np.array(size))
        sa, sb = ([(sum(v[:i]), sum(v[: i + 1])) for i in range(len(v))] for v in (a, b))
        assert sorted(links) == sorted(x * IDS + y for x, (f, g) in zip(a, sa) for y, (h, k) in zip(b, sb) if f < k and h < g)
        assert list(zip(to_a, to_b)) == [(i + 1, k + 1) for i, (_, g) in enumerate(sa) for k, (_, e) in enumerate(sb) if g == e]
        assert written(lasts, wide, a, b, PairTexts()).count(";") == len(to_a) - 1


def test_texts_after_one_another_are_like_one():
    """A block's links come text by text: as many as its tokens less its groups."""
    rng, size = random.Random(3), np.arange(8)
    for _ in range(50):
        texts = []
        for _ in range(rng.randint(1, 6)):
            a, b = [rng.randint(1, 7) for _ in range(rng.randint(0, 9))], []
            while sum(b) < sum(a):
                b.append(rng.randint(1, min(7, sum(a) - sum(b))))
            texts.append((a, b))
        each = [groups_of(a, b, size, size) for a, b in texts]
        whole_a, whole_b = sum((a for a, _ in texts), []), sum((b for _, b in texts), [])
        to_a, _, lasts, wide, links = groups_of(whole_a, whole_b, size, size)
        cuts = np.cumsum([len(a) + len(b) - len(e[0]) for (a, b), e in zip(texts, each)])[:-1]
        assert [sorted(x) for x in np.split(links, cuts)] == [sorted(e[4]) for e in each]
        assert [list(x) for x in np.split(lasts, np.cumsum([len(e[2]) for e in each])[:-1])] == [list(e[2]) for e in each]
        line = written(lasts, wide, whole_a, whole_b, PairTexts())
        assert line == ";".join(w for (a, b), e in zip(texts, each) if (w := written(e[2], e[3], a, b, PairTexts())))


def test_parts_of_a_block_make_no_difference(spark, monkeypatch):
    from slideloom.llm import tokenalign

    texts = [None, "", "ﬁ", *(f"some words {i} and more, {i * i}" for i in range(60)), "word " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = sorted(align(df, *FILES, groups=True).collect())
    monkeypatch.setattr(tokenalign, "PART_BYTES", 100)
    assert sorted(align(df, *FILES, groups=True).collect()) == want


def test_a_worker_reads_the_files_once(spark, monkeypatch, tmp_path):
    import shutil
    import types

    import pyarrow as pa

    from slideloom.llm import tokenalign

    paths, reads = [str(shutil.copy(f, tmp_path)) for f in FILES], []
    for name in ("ByteLevel", "Pieces"):
        real = getattr(tokenalign, name)
        monkeypatch.setattr(tokenalign, name, lambda p, real=real: reads.append(p) or real(p))
    monkeypatch.setattr(tokenalign, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))

    class Stop(Exception):
        pass

    def grab(self, fn, schema):
        raise Stop(fn)

    docs = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", grab)
    try:
        align(docs, *paths)
    except Stop as stop:
        task = stop.args[0]
    rows = pa.array([{"doc_id": 1, "text": "some words"}, {"doc_id": 2, "text": ""}])
    batch = pa.RecordBatch.from_arrays([pa.array(["some words", ""]), rows], names=["t", "_row"])
    first, *others = [[b.to_pydict() for b in task(iter([batch]))] for _ in range(3)]
    assert reads == paths and all(o == first for o in others)


def test_ids_are_those_of_the_file(sf_dir):
    """Against the library that the file is made for, also on odd characters."""
    from pyarrow.parquet import read_table
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(FILES[0])
    plain.encode_special_tokens = True
    texts = [t for t in read_table(f"{sf_dir}/documents.parquet", columns=["text"]).column(0).to_pylist() if t]
    rng = random.Random(6)
    kinds = [range(0x20, 0x7F), range(0x250), range(0x2000, 0x2070), range(0x20, 0xD800), range(0x1F300, 0x1FA00), [9, 10, 13, 32, 0x1C, 0x85, 0xA0, 0x3000, 0x27, 0x73]]
    for _ in range(1500):
        kind = rng.choice(kinds)
        texts.append("".join(chr(rng.choice(kind)) for _ in range(rng.randint(1, 60))))
    texts += ["<|endoftext|>", "it's we'LL they'd", "a" * 3000, "  \n\n x"]
    own = ByteLevel(FILES[0])
    for t in texts:
        ids = own.encode([t])[0]
        assert ids == plain.encode(t, add_special_tokens=False).ids
        assert b"".join(own.pieces[i] for i in ids) == t.encode()


def test_odd_rows(spark):
    texts = [
        None, "", " ", "\n", "  two  spaces ", "a\x00b", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ is a space elsewhere", "日本語 とемоџи 🙂🏽 é", "ﬁ ligature ½",
        "word " * 20_000, "same text", "same text", "​﻿", "\r\n\t x", "ＡＢＣ",
    ]
    df = spark.createDataFrame([(i, t, "r", 1) for i, t in enumerate(texts)], "doc_id long, text string, _row string, n_a int").repartition(3)
    out = {r._row.doc_id: r for r in align(df, *FILES, groups=True).collect()}
    light = [t if t is None or len(t) < 1000 else "" for t in texts]
    want = brute(light)
    for i, (t, w) in enumerate(zip(light, want)):
        if t or not texts[i]:
            r = out[i]
            assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == (*w[:4], w[6]) and r._row.n_a == 1 and r._row.text == texts[i]
            assert (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == r.groups_sha256
    assert out[10].n_links == 20_000 * 1 + out[10].n_a + out[10].n_b - out[10].n_groups - 20_000 and out[11][4:] == out[12][4:]
    assert align(df.limit(0), *FILES).count() == 0
    none = align(df.where("text is null or text = ''"), *FILES)
    assert none.where("n_links = 0 and n_best = 0 and count_sum = 0 and groups_sha256 = ''").count() == 2
    assert none.columns == ["_row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert align(df.select("doc_id", F.lit(None).cast("string").alias("text")), *FILES).count() == len(texts)
