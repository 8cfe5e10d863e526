"""The pipeline against its stages in plain Python, and tables that hold odd rows."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from slideloom.llm.queries import tokenizer

from test_coordinates import brute as components, words_of
from test_linequality import brute as rules
from test_secrets import brute as secrets


def expected(docs):
    """Texts by id after the first three stages."""
    judged = rules([(d.doc_id, d.text, d.source) for d in docs], 10, 0.05, 0.3)
    kept = {}
    for d in docs:
        if judged[d.doc_id][6]:
            kept[d.doc_id] = "\n".join(x for i, x in enumerate(d.text.split("\n")) if i not in judged[d.doc_id][7])
    ids = sorted(kept)
    words = [words_of(kept[i]) for i in ids]
    group = components([(i, kept[i]) for i in ids], 5)
    # texts without words are one group of the stage
    bare = min((i for i, w in zip(ids, words) if not w), default=None)
    out = {}
    for i, w, (_, g) in zip(ids, words, group):
        if i == (g if w else bare):
            text, parts, end = kept[i], [], 0
            for s in secrets(text):
                if s[0] > end or not parts:
                    parts += [text[end : s[0]], "[SECRET]"]
                end = max(end, s[3])
            out[i] = "".join(parts) + text[end:]
    return out


def test_stages_against_python(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = expected(docs.collect())
    out = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, out, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        path = str(tmp_path / stage.__name__)
        out.write.parquet(path)
        out = spark.read.parquet(path)
    assert {r.doc_id: r.text for r in out.collect()} == want
    assert all(r.n_chars == len(r.text) for r in out.collect())
    mixed = corpus_pipeline.source_mix(spark, out, sf_dir)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    word = lambda t: len(re.findall("[^ \t\n\x0b\x0c\r]+", t))
    total = sum(word(t) for t in want.values())
    assert abs(sum(word(r.text) for r in rows) - 1.5 * total) <= 20
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer())
    tokens = sum(len(plain.encode(r.text, add_special_tokens=False).ids) + 1 for r in rows)
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert sum(r.length for r in packed) == tokens
    assert len({r.sequence_id for r in packed}) <= -(-tokens // 4096) * 1.03 + 2


def test_odd_tables(spark, tmp_path):
    prose = lambda k: " ".join(f"w{k}x{i}" for i in range(80))
    rows = [(1, prose(1), "en", "a", 1), (1, prose(1), "en", "a", 1), (2, None, None, None, None), (None, prose(2), "de", None, 5), (3, "", "en", "b", 0)]
    rows += [(10 + i, prose(3), "fr", "a", 9) for i in range(40)] + [(90, prose(4) + " token = abcdef123456", "en", "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, table, most in (("rows", df, 4), ("none", df.limit(0), 0)):
        (tmp_path / name).mkdir()
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        assert out.select(F.countDistinct("doc_id")).first()[0] <= most and (out.count() > 0) == (most > 0)
