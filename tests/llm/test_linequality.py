"""Quality rules against a plain Python version."""

import re
from collections import Counter, defaultdict

from slideloom.llm.linequality import clean, judge

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(f"[^{SPACE}]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    dup, seen = 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def fold(line):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else "0" if "1" <= c <= "9" else c for c in line)
    return " ".join(WORD.findall(low))


def brute(rows, least, share, remain, long_words=10):
    """(id, text, host) -> counts, base_failed, kept, removed places."""
    texts, holders = defaultdict(set), defaultdict(dict)
    for i, t, h in rows:
        texts[h].add(t)
        for line in (t or "").split("\n"):
            if fold(line):
                old = holders[h, fold(line)].get(t)
                holders[h, fold(line)][t] = i if old is None else min(i, old)
    out = {}
    for i, t, h in rows:
        c = counts(t)
        removed, lost = [], 0
        for place, line in enumerate((t or "").split("\n")):
            f = fold(line)
            have = holders.get((h, f), {})
            first = min(have.values()) if have else None
            if f and len(have) > least and (len(f.split()) >= long_words or len(have) > len(texts[h]) * share) and not (i == first):
                removed.append(place)
                lost += len(WORD.findall(line))
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        out[i] = (*c, failed, not failed and c[0] - lost >= c[0] * remain, removed)
    return out


def sample():
    body = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    menu = "Home  About 12 Contact " + "menu " * 40
    rows = [(i, f"{menu.replace('12', str(i))}\n{body(i, 60)}\nShared footer", f"h{i % 2}") for i in range(60)]
    rows += [(100 + i, f"{menu}\nShared footer\n{body(i + 900, 12)}", "h0") for i in range(30)]
    rows += [(200 + i, body(7000, 80), "h1") for i in range(40)]
    rows += [(300, None, "h0"), (301, "", "h0"), (302, body(5, 60), None), (303, "a b c " * 40, "h1"), (304, " \n\t\n", "h1")]
    rows += [(305, "É x # | " + body(8, 70), "h1"), (306, "a b c d " + body(9, 55) + " a b c d", "h1")]
    rows += [(307, "\n".join(["same line here"] * 30 + [body(11, 60)]), "h0"), (308, body(12, 200_000), "h0")]
    return rows


def test_equals_brute_force(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = brute(rows, 10, 0.05, 0.3)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = {r._doc: (*[r[n] for n in names], sorted(r.removed)) for r in judge(df).collect()}
    assert got == want
    assert any(not v[6] and not v[5] for v in want.values()) and any(v[7] for v in want.values())
    kept = {r.doc_id: r.text for r in clean(df).collect()}
    assert set(kept) == {i for i, v in want.items() if v[6]}
    for i, t, _ in rows:
        if i in kept:
            lines = t.split("\n")
            assert kept[i] == "\n".join(x for k, x in enumerate(lines) if k not in want[i][7])


def test_repeated_rows_null_ids_clashing_columns_and_empty(spark):
    rows = [(1, "x y " * 5 + " ".join(map(str, range(60))), "s", "lines", 7)] * 3 + [(None, " ".join(f"q{i}" for i in range(70)), None, "removed", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _id string, _fp int")
    assert len(judge(df).collect()) == 4
    out = clean(df)
    assert out.columns == df.columns and out.count() == 4
    assert judge(df.limit(0)).count() == 0 and clean(df.limit(0)).count() == 0


def test_long_lines_are_common_in_a_host_of_any_size(spark):
    """A passage in 12 of 600 texts goes from all but the first; a short line in as many stays."""
    name = lambda n: "".join("abcdefghij"[int(c)] for c in str(n))  # noqa: E731  # digits would fold together
    body = lambda i: " ".join(f"{name(i)}x{name(j)}" for j in range(60))
    passage, short = " ".join(f"p{name(j)}" for j in range(55)), "read more here"
    rows = [(i, f"{body(i)}\n{passage}\n{short}" if i < 12 else body(i), "s") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    removed = {r._doc: list(r.removed) for r in judge(df).where("size(removed) > 0").collect()}
    assert removed == {i: [1] for i in range(1, 12)}
    assert all(r.kept for r in judge(df).collect())
    got = {r._doc: (r.removed_words, r.kept) for r in judge(df).collect()}
    want = brute(rows, 10, 0.05, 0.3)
    assert {i: v[6] for i, v in want.items()} == {i: k for i, (_, k) in got.items()}
