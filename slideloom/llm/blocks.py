"""Main text of web pages by a recurrent labeller of blocks."""

from __future__ import annotations

import html
import re
import zlib
from functools import lru_cache
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from slideloom.llm.common import spare, text_of

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.S,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# Fixed lists of HTML: elements whose content is never text of the page, elements without an end, elements inside a line.
HIDDEN = frozenset("script style noscript template title svg math iframe object canvas video audio".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
ENDS_ITSELF = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCES = frozenset("table ul ol dl div section article aside nav main body blockquote form td th".split())


def leaves(page: str) -> list[tuple[tuple, str, int]]:
    """The blocks of a page in order: (path of (tag, names) pairs, text, characters inside links).

    A block is the text between the starts and ends of elements that don't stand inside a
    line. Missing end tags are supplied; comments, scripts, styles and the like are no text.
    """
    out, stack, parts, linked, anchors, pos = [], [], [], 0, 0, 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                path = tuple(x for x in stack if x[0] not in INLINE) or (("body", ""),)
                out.append((path, text, linked))
            parts.clear()
        linked = 0

    def add(text):
        nonlocal linked
        text = html.unescape(text) if "&" in text else text
        parts.append(text)
        if anchors:
            linked += len(text.strip())

    def close(k):
        nonlocal anchors
        anchors -= sum(t == "a" for t, _ in stack[k:])
        del stack[k:]

    while True:
        m = TAG.search(page, pos)
        if m is None:
            add(page[pos:])
            break
        if m.start() > pos:
            add(page[pos : m.start()])
        pos = m.end()
        name = m[1] or m[3]
        if not name:
            continue
        name, ending = name.lower(), page[m.start() + 1] == "/"
        attrs = m[2] if m[1] else m[4]
        if name not in INLINE and name != "br":
            flush()
        if ending:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            continue
        if name == "br":
            parts.append(" ")
        if name in VOID:
            continue
        if name in HIDDEN and not attrs.rstrip().endswith("/"):
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, pos)
            pos = end.end() if end else len(page)
            continue
        if name not in INLINE:
            # a paragraph ends where another block begins; items end their own kind
            ends = ENDS_ITSELF.get(name, ()) + ("p",)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    close(k)
                    break
                if stack[k][0] in FENCES and stack[k][0] not in ends:
                    break
        names = " ".join(a or b or c for a, b, c in NAMES.findall(attrs)).lower() if "=" in attrs else ""
        stack.append((name, names))
        anchors += name == "a"
    flush()
    return out


PATH_SIZE, WORD_SIZE, EXTRA = 128, 32, 6


def path_tokens(path: tuple) -> set[str]:
    """Each tag and each word of a name anywhere on the path, once: the number of wrappers around a block doesn't count."""
    return {"t:" + tag for tag, _ in path} | {"n:" + n for _, names in path for n in re.split(r"[^a-z]+", names) if n}


@lru_cache(maxsize=20_000)
def path_vector(path: tuple) -> np.ndarray:
    v = np.zeros(PATH_SIZE, np.float32)

    def put(token, by=1.0):
        h = zlib.crc32(token.encode())
        v[h % PATH_SIZE] += by if h >> 16 & 1 else -by

    for token in sorted(path_tokens(path)):
        put(token, 1.0 if token[0] == "t" else 1.5)
    put("l:" + path[-1][0], 1.5)
    if len(path) > 1:
        put(f"p:{path[-2][0]}>{path[-1][0]}")
    return v


def block_vector(path: tuple, text: str, linked: int) -> np.ndarray:
    """Signed hashes of the tag path, hashed words and a few measures of a block."""
    words = text.lower().encode().split()
    bins = np.bincount(np.fromiter((zlib.crc32(w) % WORD_SIZE for w in words), np.int64, len(words)), minlength=WORD_SIZE)
    n = len(text)
    ends = sum(map(text.count, ".!?,"))
    extra = (np.log1p(n) / 5, linked / max(n, 1), ends / max(len(words), 1), np.log1p(len(words)) / 4, text[-1] in ".!?", len({t for t, _ in path}) / 8)
    return np.concatenate([path_vector(path), (bins / np.sqrt(1 + len(words))).astype(np.float32), np.array(extra, np.float32)])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM over the blocks of a page, and a logistic output for each block."""

    def __init__(self, size: int = PATH_SIZE + WORD_SIZE + EXTRA, hidden: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.weights = {}
        for d in "fb":
            self.weights["x" + d] = rng.normal(0, size**-0.5, (size, 4 * hidden)).astype(np.float32)
            self.weights["h" + d] = rng.normal(0, hidden**-0.5, (hidden, 4 * hidden)).astype(np.float32)
            self.weights["b" + d] = np.repeat(np.array([0, 1, 0, 0], np.float32), hidden)
        self.weights["o"] = rng.normal(0, 0.1, 2 * hidden).astype(np.float32)
        self.weights["c"] = np.zeros(1, np.float32)

    def _run(self, x, mask, d, keep=None):
        """States over time (time, pages, hidden); with ``keep`` also what the gradient needs."""
        hidden, w = self.hidden, self.weights
        gates = x @ w["x" + d] + w["b" + d]
        h = np.zeros((x.shape[1], hidden), np.float32)
        c = np.zeros_like(h)
        out = np.zeros((x.shape[0], x.shape[1], hidden), np.float32)
        for t in range(x.shape[0]) if d == "f" else range(x.shape[0] - 1, -1, -1):
            g = gates[t] + h @ w["h" + d]
            s = sigmoid(g[:, : 3 * hidden])
            i, f, o = s[:, :hidden], s[:, hidden : 2 * hidden], s[:, 2 * hidden :]
            u = np.tanh(g[:, 3 * hidden :])
            m = mask[t][:, None]
            if keep is not None:
                keep.append((t, h, c, i, f, o, u))
            c = m * (f * c + i * u)
            h = m * (o * np.tanh(c))
            out[t] = h
        return out

    def score(self, x, mask):
        """Log odds of the main text; x is (time, pages, features)."""
        both = np.concatenate([self._run(x, mask, "f"), self._run(x, mask, "b")], 2)
        return both @ self.weights["o"] + self.weights["c"]

    def gradient(self, x, mask, y):
        """Loss and gradients of the mean cross entropy, back through time."""
        hidden, w = self.hidden, self.weights
        kept = {"f": [], "b": []}
        both = np.concatenate([self._run(x, mask, d, kept[d]) for d in "fb"], 2)
        p = sigmoid(both @ w["o"] + w["c"])
        n = mask.sum()
        loss = -(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / n
        err = mask * (p - y) / n
        grads = {"o": np.einsum("tp,tph->h", err, both), "c": np.array([err.sum()], np.float32)}
        for k, d in enumerate("fb"):
            dh_out = err[:, :, None] * w["o"][k * hidden : (k + 1) * hidden]
            dgates = np.zeros((*x.shape[:2], 4 * hidden), np.float32)
            gh = np.zeros_like(w["h" + d])
            dh, dc = np.zeros((x.shape[1], hidden), np.float32), np.zeros((x.shape[1], hidden), np.float32)
            for t, h0, c0, i, f, o, u in reversed(kept[d]):
                m = mask[t][:, None]
                c1 = np.tanh(f * c0 + i * u)
                dh = (dh + dh_out[t]) * m
                dc = dc * m + dh * o * (1 - c1 * c1)
                dg = np.concatenate([dc * u * i * (1 - i), dc * c0 * f * (1 - f), dh * c1 * o * (1 - o), dc * i * (1 - u * u)], 1)
                dgates[t] = dg
                gh += h0.T @ dg
                dh, dc = dg @ w["h" + d].T, dc * f
            grads["h" + d] = gh
            grads["x" + d] = np.einsum("tpd,tpg->dg", x, dgates, optimize=True)
            grads["b" + d] = dgates.sum((0, 1))
        return loss, grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 12, batch: int = 24, rate: float = 0.02, seed: int = 5):
        """Adam over batches of pages; the order follows ``seed``."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for a in range(0, len(order), batch):
                some = [pages[i] for i in order[a : a + batch]]
                x, mask = padded([p[0] for p in some])
                y = np.zeros(mask.shape, np.float32)
                for j, (_, labels) in enumerate(some):
                    y[: len(labels), j] = labels
                _, grads = self.gradient(x, mask, y)
                step += 1
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.weights[k] = (self.weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[np.ndarray], cells: int = 20_000) -> list[np.ndarray]:
        """True for each block of the main text. Pages of like length run together, about ``cells`` blocks at once."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            most = max(1, min(256, cells // len(pages[order[-1]])))
            some, order = order[-most:], order[:-most]
            x, mask = padded([pages[i] for i in some])
            score = self.score(x, mask)
            for j, i in enumerate(some):
                out[i] = score[: len(pages[i]), j] > 0
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, pages)), len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros(x.shape[:2], np.float32)
    for j, p in enumerate(pages):
        x[: len(p), j] = p
        mask[: len(p), j] = 1
    return x, mask


MARK = ""


def example(rng: Random) -> str:
    """A made-up page whose main blocks hold MARK: layouts, names and furniture vary, words mean nothing."""
    syllables = [rng.choice("bcdfghlmnprstvz") + rng.choice("aeiouéäñ") + rng.choice(["", "n", "r", "s", "t"]) for _ in range(40)]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    pick = rng.choice
    # pages of junk: every word shouted or with signs behind it
    loud, sign = rng.random() < 0.15, pick(["", "", "", "", "!!", "***", "###", "%%%", "$$$", " | "])
    said = []

    def text(low, high):
        if said and rng.random() < 0.1:
            return pick(said)  # pages repeat themselves
        out = fresh(low, high)
        out = sign.join(out.split(" ")) if sign == " | " else " ".join(w + sign for w in out.split(" "))
        said.append(out.upper() if loud else out)
        return said[-1]

    def fresh(low, high):
        words = [word() + (pick([".", ",", "", "", "", "", "#", "|"]) if rng.random() < 0.2 else "") for _ in range(rng.randint(low, high))]
        return " ".join(words).capitalize() + pick([".", ".", "", "!"])

    name = lambda *names: f' {pick(["class", "class", "id"])}="{pick(["", "", "site-", "page-", "x-"])}{pick(names)}"'
    link = lambda: f'<a href="/{word()}">{text(1, 3)}</a>'
    listed = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(3, 8))) + "</ul>"
    nav = lambda: pick([f"<nav>{listed()}</nav>", f"<div{name('nav', 'menu', 'navbar', 'breadcrumb', 'navigation')}>{pick([listed, link])()}</div>", f"<nav>{link()} {link()} {link()}</nav>"])
    ad = lambda: f"<div{name('ad', 'ads', 'advert', 'banner', 'sponsored', 'promo', 'advertisement')}>{pick(['', '<p>'])}{text(3, 40)}</div>"
    side = lambda: f"<aside{pick(['', name('sidebar', 'widget', 'related')])}>{pick(['', '<h3>' + text(1, 4) + '</h3>'])}{pick([listed(), '<p>' + text(5, 40) + '</p>'])}</aside>"
    box = lambda: f"<div{name('sidebar', 'related', 'share', 'social', 'widget', 'recommended', 'tags')}>{pick([listed(), text(3, 30)])}</div>"
    notice = lambda: f"<div{name('notice', 'cookie', 'consent', 'alert', 'popup', 'newsletter', 'subscribe')}><p>{text(5, 35)}</p>{pick(['', '<button>' + text(1, 2) + '</button>'])}</div>"
    form = lambda: f"<form action='/{word()}'><label>{text(1, 4)}</label><input name=q><button>{text(1, 2)}</button>{pick(['', '<p>' + text(4, 20) + '</p>'])}</form>"
    header = lambda: f"<header{pick(['', name('header', 'masthead', 'top')])}>{pick(['<h1>' + text(1, 4) + '</h1>', '<div>' + text(2, 8) + '</div>', '<p>' + text(2, 12) + '</p>'])}{pick(['', nav()])}</header>"
    footer = lambda: pick([f"<footer{pick(['', name('footer', 'bottom')])}>&copy; {word()} &middot; {text(3, 30)}</footer>", f"<footer><p>{text(4, 30)}</p>{listed()}</footer>", f"<div{name('footer', 'copyright', 'legal')}>{text(4, 30)}</div>"])
    comment = lambda: f"<div class='comment'><b>{word()}</b><p>{text(5, 60)}</p></div>"
    comments = lambda: f"<{pick(['section', 'div'])}{name('comments', 'comment-list', 'replies', 'discussion', 'responses')}><h3>{text(1, 3)}</h3>" + "".join(comment() for _ in range(rng.randint(1, 6))) + pick(["</section>", "</div>"])

    def wrapped(page, most=16):
        """``page`` inside up to ``most`` elements that mean nothing, mostly none."""
        count = rng.randint(1, most) if rng.random() < 0.35 else 0
        plain = rng.random() < 0.5
        for _ in range(count):
            tag = "div" if plain else pick(["div", "div", "section"])
            page = f"<{tag}{'' if plain else pick(['', name('wrapper', 'container', 'inner', 'outer', 'row', 'col', 'layout', 'grid', 'block', 'region', word())])}>{page}</{tag}>"
        return page

    def main():
        out = []
        if rng.random() < 0.9:
            out.append(f"<h1>{MARK}{text(2, 12)}</h1>")
        for _ in range(rng.randint(1, 14)):
            kind = rng.random()
            if kind < 0.68:
                start, end = pick([("<p>", "</p>"), ("<p>", ""), ("<p><b>", "<br>"), ("<p><em>", "</em></p>")])
                out.append(f"{start}{MARK}{text(3, 120)} {pick(['', link()])}{end}")
            elif kind < 0.74:
                out.append(f"<h{(k := rng.randint(2, 4))}>{MARK}{text(2, 8)}</h{k}>")
            elif kind < 0.80:
                tag = pick(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{MARK}{text(3, 25)}{pick(['</li>', ''])}" for _ in range(rng.randint(2, 6))) + f"</{tag}>")
            elif kind < 0.84:
                out.append(f"<blockquote>{MARK}{text(6, 60)}</blockquote>")
            elif kind < 0.87:
                out.append(f"<pre>{MARK}{text(6, 40)}</pre>")
            elif kind < 0.90:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{MARK}{text(1, 5)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif kind < 0.93:
                out.append(f"<figure><img src='/{word()}'><figcaption>{MARK}{text(3, 15)}</figcaption></figure>")
            else:
                out.append(pick([ad, box, side, form, notice])())
        return "".join(out)

    start, end = pick([("<article>", "</article>")] * 4 + [("<main>", "</main>"), ("<main><article>", "</article></main>")] + [
        (f"<div{name('content', 'post', 'entry', 'article', 'story', 'main', 'text', 'body')}>", "</div>"), (f"<section{name('content', 'article', 'post')}>", "</section>"), ("<div>", "</div>"),
    ])
    before = [wrapped(f()) for f in (header, nav, ad, notice, side, box, form) if rng.random() < 0.35] or [nav()]
    rng.shuffle(before)
    after = [wrapped(f()) for f in (comments, footer, ad, side, box, form, notice, nav) if rng.random() < 0.35] or [footer()]
    rng.shuffle(after)
    inner = wrapped(comments()) if rng.random() < 0.1 else ""
    body = "".join(before) + wrapped(f"{start}{wrapped(main())}{inner}{end}") + "".join(after)
    return f"<!DOCTYPE html><html><head><title>{text(2, 8)}</title><style>p{{margin:0}}</style></head><body>{wrapped(body)}</body></html>"


def featured(blocks) -> np.ndarray:
    return np.stack([block_vector(*b) for b in blocks]) if blocks else np.zeros((0, PATH_SIZE + WORD_SIZE + EXTRA), np.float32)


def examples(count: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    rng, out = Random(seed), []
    for _ in range(count):
        blocks = leaves(example(rng))
        labels = np.array([MARK in t for _, t, _ in blocks], np.float32)
        x = featured([(p, t.replace(MARK, "").strip() or "-", n) for p, t, n in blocks])
        # words and measures go missing in some blocks, so that place and neighbours count
        x[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] *= np.array([[rng.random() < 0.6] for _ in blocks])
        x[:, PATH_SIZE + WORD_SIZE :] *= np.array([[rng.random() < 0.7] for _ in blocks])
        out.append((x, labels))
    return out


@lru_cache(maxsize=4)
def trained(count: int = 400, seed: int = 11) -> Labeller:
    """The labeller, fitted on ``count`` made-up pages; the same for a seed."""
    return Labeller().fit(examples(count, seed))


def extract(pages: DataFrame, html_column: str = "html", model: Labeller | None = None, name: str = "text") -> DataFrame:
    """``pages`` with the main text in place of the html: the blocks that the labeller picks, joined by two line ends.

    Every page is read whole by one task; its blocks are labelled with the whole
    page in view. A null or empty page, or one without main blocks, gives an empty text. Other
    columns and repeated rows stay.
    """
    model = model or trained()
    kept = [c for c in pages.columns if c != html_column]
    if name in kept:
        raise ValueError(f"there is a column {name!r} already")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name in kept), f"`{name}` string"])

    def run(batches):
        for b in batches:
            sources = b.column(len(kept))
            texts, blocks, held = [], [], 0

            def close():
                for own, pick in zip(blocks, model.label([featured(x) for x in blocks])):
                    texts.append("\n\n".join(t for (_, t, _), yes in zip(own, pick) if yes))
                blocks.clear()

            for page in sources:
                blocks.append(leaves(page.as_py()))
                held += len(blocks[-1])
                if held > 20_000:
                    close()
                    held = 0
            close()
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(texts, pa.string())], names=[*kept, name])

    return pages.select(*kept, text_of(html_column).alias(spare(pages, "_page"))).mapInArrow(run, schema)
