"""Packing: tokens against the tokenizer, plans against what they promise."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from slideloom.llm.packing import Plan, WordCache, batches_of, nnls, pack, patterns, pieces
from slideloom.llm.queries import QUERIES, tokenizer


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer())


def test_cache_gives_the_tokenizer_s_ids(plain):
    rng = random.Random(3)
    blocks = ((9, 0x250), (0x300, 0x340), (0x390, 0x3D0), (0x1E00, 0x1E40), (0x2000, 0x2060), (0x3040, 0x3060), (0x1F600, 0x1F620))
    pool = [chr(i) for a, b in blocks for i in range(a, b)] + ["'s", "'ll", "<|endoftext|>", " ", "a", "b"] * 20
    texts = ["", " ", "a <|endoftext|>b it's İΣ don't x́ ́y\x1cz", *("".join(rng.choices(pool, k=40)) for _ in range(2000))]
    cache = WordCache(plain, limit=500)
    for a, b in batches_of(pa.array(texts), 2_000):
        for t, ids in zip(texts[a:b], cache.encode(pa.array(texts[a:b]))):
            assert plain.encode(t, add_special_tokens=False).ids == ids.tolist(), t


def test_nnls_finds_the_projection():
    rng = np.random.default_rng(1)
    a = rng.random((30, 12))
    b = a @ np.maximum(rng.normal(size=12), 0) + 0.01 * rng.random(30)
    x = nnls(a, b, 60)
    g = a.T @ (a @ x - b)
    assert (x >= 0).all() and (g > -1e-8).all() and np.abs(g[x > 0]).max() < 1e-8


def test_patterns_fill_the_sequence():
    assert all(sum(p) == 64 and len(p) <= 3 and list(p) == sorted(p, reverse=True) for p in patterns(64))
    assert (64,) in patterns(64) and (32, 32) in patterns(64)


@pytest.mark.parametrize("low,high,n", [(1, 4096, 5000), (1200, 2600, 4000), (10, 600, 20000), (4096, 4096, 7), (1, 1, 9000), (2049, 4000, 300)])
def test_plan_places_everything_tightly(low, high, n):
    rng = np.random.default_rng(0)
    counts = Counter(rng.integers(low, high + 1, n).tolist())
    plan = Plan(dict(counts))
    runs = plan.runs()
    fill, placed = Counter(), Counter()
    for length, total in counts.items():
        own = runs[runs[:, 0] == length]
        starts = own[:, 1].tolist()
        assert starts[0] == 0 and starts == sorted(set(starts))
        for (_, r, s, o), end in zip(own.tolist(), [*starts[1:], total]):
            for k in range(end - r):
                placed[s + k, o] += 1
                fill[s + k] += length
    assert max(fill.values()) <= 4096 and len(fill) == plan.sequences and set(placed.values()) == {1}
    least = -(-sum(k * v for k, v in counts.items()) // 4096)
    big = sum(v for k, v in counts.items() if k > 2048)
    assert plan.sequences <= max(least, big) * 1.02 + 2


def whole(rows, limit=4096):
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(seqs)


def test_query_against_the_tokenizer(spark, sf_dir, plain):
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op1_pattern_packing"](spark, sf_dir).collect()
    whole(rows)
    got = {(r.doc_id, r.piece): r for r in rows}
    for i, t in docs.items():
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, s in enumerate(range(0, len(ids), 4096)):
            r = got.pop((i, k))
            part = ids[s : s + 4096]
            assert (r.start, r.length, r.ids_crc32) == (s, len(part), zlib.crc32(part.tobytes()))
    assert not got


def test_nulls_long_texts_repeats_and_empty(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "", "y"), (2, "word " * 30_000, "z"), *[(3, "same text", "w")] * 50]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    out = pack(pieces(df, tokenizer())).collect()
    assert len(out) == 3 + 8 + 50 and whole(out) == 8
    assert sorted(r.length for r in out if r.doc_id in (1, None)) == [1, 1, 1]
    assert pack(pieces(df.limit(0), tokenizer())).count() == 0


def test_a_worker_reads_the_tokenizer_once(spark, monkeypatch, tmp_path):
    import shutil

    import tokenizers

    path, reads = str(shutil.copy(tokenizer(), tmp_path / "t.json")), []

    class Reader:
        @staticmethod
        def from_file(p):
            reads.append(p)
            return real.from_file(p)

    class Docs:
        """Hands out the function that a task runs."""

        schema = spark.createDataFrame([], "doc_id long, text string").schema
        select = withColumnRenamed = lambda self, *a: self

        def mapInArrow(self, fn, schema):
            self.fn = fn
            return self

    real = tokenizers.Tokenizer
    monkeypatch.setattr(tokenizers, "Tokenizer", Reader)
    task = pieces(Docs(), path).fn
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words", ""])], names=["doc", "text"])
    first, *others = [[b.to_pydict() for b in task(iter([batch]))] for _ in range(4)]
    assert reads == [path] and all(o == first for o in others)


def test_new_parts_are_coded_at_once_not_one_by_one(plain):
    cache, model, calls = WordCache(plain), plain.model, []

    class Model:
        def tokenize(self, part):
            calls.append(part)
            return model.tokenize(part)

    cache.model = Model()
    rng = random.Random(8)
    words = ["".join(rng.choice("etaoinshrdlu'.</w>Éß9") for _ in range(rng.randint(1, 14))) for _ in range(5000)]
    texts = [" ".join(words), "It's \n <|endoftext|> </w> x</w> WE'LL", "ab" * 600 + " c", "", " "]
    got = [ids.tolist() for ids in cache.encode(pa.array(texts))]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert calls == ["ab" * 600]
