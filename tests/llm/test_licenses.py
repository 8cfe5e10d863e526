"""Licence scan against a plain Python version."""

import re
from collections import Counter

from pyspark.sql import functions as F

from slideloom.llm.licenses import NOTICES, TEMPLATES, TEXTS, scan

OWNER = re.compile(r"^\s*(copyright|\(c\)|©)", re.I)


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def pairs(w):
    return Counter(zip(w, w[1:]))


def brute(text, least=0.8):
    text = text or ""
    lines = [x for x in text.split("\n") if not OWNER.match(x)]
    parts = [words(" ".join(x for x in p.split("\n") if not OWNER.match(x))) for p in re.split(r"\n[ \t\r]*\n", text)]
    everything = {tuple(words(x)) for x in lines} | {tuple(p) for p in parts} | {tuple(w for p in parts for w in p)}
    out = []
    for w in everything:
        a = pairs(w)
        for label, t in TEMPLATES:
            b = pairs(words(t))
            both = a.total() + b.total()
            if both and a and 2 * (a & b).total() / both >= least - 1e-9:
                out.append((2 * (a & b).total() / both, label, len(w)))
    return sorted(out, key=lambda m: (-m[0], m[1], m[2]))


def test_equals_brute_force(spark):
    mit, bsd3 = TEXTS[0][1], TEXTS[3][1]
    rows = [
        None, "", "no licence here", "Released under the MIT License.", "x y z\nLicensed under CC BY-NC 4.0\nend", "Copyright (c) 2020 me\n\n" + mit,
        "prose first\n\n" + mit.replace("Software", "Program") + "\n\nprose last", bsd3, mit[:300], "released RELEASED under under the the MIT mit License license",
        "This work is licensed under the GNU General Public License, version 3.", "word " * 60_000, " ".join(["the software"] * 100), mit + "\n" + mit,
        "THE SOFTWARE IS PROVIDED", "İ ß ǅ ² ½ licensed under the isc license", "© 2020\nmit",
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("dice", F.lit(1)).withColumn("words", F.lit("w"))
    got = {r.doc_id: [(m.dice, m.license, m.words) for m in r.licenses] for r in scan(df).collect()}
    for i, t in enumerate(rows):
        assert got[i] == brute(t), i
    assert got[5] and got[6] and got[7] and got[3][0][1] == "MIT" and not got[2]
    assert scan(df.limit(0)).count() == 0
    assert sum(1 for n in NOTICES) * 14 + len(TEXTS) == len(TEMPLATES)


def test_query(spark, sf_dir):
    from slideloom.llm.queries import QUERIES

    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op10_license_dice"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r.doc_id])
        assert (r.n_matches, r.license) == (len(want), want[0][1] if want else None)
