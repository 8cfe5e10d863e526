"""Block labeller: scanning, gradients, held-out accuracy, and pages of the table."""

import math

import numpy as np
import pytest

from slideloom.llm.blocks import Labeller, examples, extract, featured, leaves, padded, trained
from slideloom.llm.queries import QUERIES


def texts(page):
    return [t for _, t, _ in leaves(page)]


@pytest.mark.parametrize("page,want", [
    ("", []), ("plain &amp; simple", ["plain & simple"]), ("<p>a<p>b<br>c<li>d", ["a", "b c", "d"]),
    ("<p>x <b>y</b>z</p>tail", ["x yz", "tail"]), ("<script>var t='</p>';</script><p>t</p>", ["t"]), ("<style>p{}</style ><p>t", ["t"]),
    ("<!-- <p>no</p> --><p title='a>b'>yes</p>", ["yes"]), ("<p>a &lt;b&gt; &#233; &nbsp; c\n\td</p>", ["a <b> é c d"]),
    ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]), ("<p>5 < 6</p>", ["5 < 6"]), ("<p>cut <a href='x", ["cut <a href='x"]),
    ("<p unclosed='a>b</p>", ["b"]), ("<script>never ends <p>x", []), ("</p></div><div>ok</div></b>", ["ok"]), ("<P>A</P><BR/><DIV>B", ["A", "B"]),
])
def test_leaves(page, want):
    assert texts(page) == want


def test_paths_and_links():
    got = leaves('<body><nav class="Top Menu"><a href=x>one two</a> three</nav><article><p>t</article>')
    assert [x[0] for x in got[0][0]] == ["body", "nav"] and got[0][0][-1][1] == "top menu" and got[0][2] == len("one two")
    assert [x[0] for x in got[1][0]] == ["body", "article", "p"]


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    m = Labeller(size=5, hidden=3)
    m.weights = {k: v.astype(np.float64) for k, v in m.weights.items()}
    pages = [rng.normal(size=(n, 5)) for n in (4, 2, 1)]
    x, mask = padded(pages)
    y = (rng.random(mask.shape) > 0.5) * mask
    _, grads = m.gradient(x.astype(np.float64), mask, y)
    for k, w in m.weights.items():
        for at in [tuple(rng.integers(0, s) for s in w.shape) for _ in range(4)]:
            old = w[at]
            loss = []
            for step in (1e-2, -1e-2):
                w[at] = old + step
                loss.append(m.gradient(x.astype(np.float64), mask, y)[0])
            w[at] = old
            assert abs((loss[0] - loss[1]) / 2e-2 - grads[k][at]) < 2e-3


def test_held_out_accuracy():
    ex = examples(120, 987)
    labels = trained().label([x for x, _ in ex])
    right = sum(int((p == (y > 0)).sum()) for p, (_, y) in zip(labels, ex))
    assert right / sum(len(y) for _, y in ex) > 0.985


def test_labels_depend_on_the_whole_page():
    m = trained()
    x = np.concatenate([e[0] for e in examples(5, 55)])
    alone = np.concatenate([m.label([r[None]])[0] for r in x])
    assert (m.label([x])[0] != alone).any()


def test_pages_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    right = 0
    for r in QUERIES["op8_recurrent_blocks"](spark, sf).collect():
        want = "\n\n".join(t for p, t, _ in leaves(html[r.page_id]) if any(tag == "article" for tag, _ in p))
        right += r.text == want
        assert r.n_chars == len(r.text)
    assert right >= 0.99 * len(html)


@pytest.mark.parametrize("wrappers", range(0, 41, 2))
def test_wrappers_decide_nothing(wrappers):
    m = trained()

    def wrap(page, name=""):
        return f"<div{name}>" * wrappers + page + "</div>" * wrappers

    words = "The river rose over night and the bridge was closed to all traffic until the morning. "
    article = "<h1>Flood closes the bridge</h1>" + "".join(f"<p>{words * 2}Part {i} ends here.</p>" for i in range(5))
    nav = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/s'>Sport</a></li></ul></nav>"
    comments = f"<section class='comments'><h3>Comments</h3><div class='comment'><b>ann</b><p>{words}</p></div><div class='comment'><b>bob</b><p>{words}</p></div></section>"
    footer = "<footer>&copy; the paper, all rights reserved</footer>"
    for page in (
        f"<body>{wrap(nav)}{wrap(f'<article>{article}</article>')}{wrap(comments)}{wrap(footer)}</body>",
        f"<body>{nav}<article>{wrap(article)}</article>{comments}{footer}</body>",
        f"<body>{wrap(nav + f'<article>{article}</article>' + comments + footer)}</body>",
        f"<body>{nav}<article>{article}</article><section class='comments'>{wrap(comments)}</section><footer>{wrap('<p>All rights reserved by the paper.</p>')}</footer></body>",
    ):
        blocks = leaves(page)
        got = [t for (_, t, _), yes in zip(blocks, m.label([featured(blocks)])[0]) if yes]
        assert got == [t for p, t, _ in blocks if any(tag == "article" for tag, _ in p)]


def test_label_equals_a_plain_forward_pass():
    m = trained()
    w = {k: v.astype(float).tolist() for k, v in m.weights.items()}
    hidden = m.hidden
    squash = lambda v: 1 / (1 + math.exp(-max(-30.0, min(30.0, v))))

    def states(rows, d):
        h, c, out = [0.0] * hidden, [0.0] * hidden, []
        for row in rows:
            g = [w["b" + d][k] + sum(v * w["x" + d][j][k] for j, v in enumerate(row) if v) + sum(h[j] * w["h" + d][j][k] for j in range(hidden)) for k in range(4 * hidden)]
            c = [squash(g[hidden + k]) * c[k] + squash(g[k]) * math.tanh(g[3 * hidden + k]) for k in range(hidden)]
            h = [squash(g[2 * hidden + k]) * math.tanh(c[k]) for k in range(hidden)]
            out.append(h)
        return out

    pages = [x for x, _ in examples(6, 4321)]
    for x, got in zip(pages, m.label(pages)):
        rows = x.astype(float).tolist()
        both = zip(states(rows, "f"), states(rows[::-1], "b")[::-1])
        odds = [w["c"][0] + sum(a * b for a, b in zip(f + b, w["o"])) for f, b in both]
        assert all((o > 0) == g for o, g in zip(odds, got) if abs(o) > 1e-3)


def test_links_by_any_open_anchor():
    got = leaves("<p><a href=x><b><i><u><s><em>deep link</em></s></u></i></b></a> rest</p>")
    assert got[0][1:] == ("deep link rest", len("deep link"))


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    long = "<body><nav><ul><li><a href='/'>home</a></ul></nav><article>" + "".join(f"<p>paragraph {i} of some length, with words.</p>" for i in range(3000)) + "</article><footer>&copy; x</footer></body>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", deep), (4, "u", long), (4, "u", long), (None, "u", "<<<>>>&&&;</"), (5, "u", "<article><p>" + "word " * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, _page string, html string")
    out = extract(df)
    assert out.columns == ["page_id", "_page", "text"]
    got = out.collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == "" and by[4].count("\n\n") >= 2990 and "home" not in by[4] and len(by[5]) == 999_999
    assert extract(df.limit(0)).count() == 0
