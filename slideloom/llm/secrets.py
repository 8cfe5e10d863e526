"""Secrets in texts: fixed patterns, and windows of high entropy in candidate strings.

DataFrame functions only; no Python runs on executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from slideloom.llm.common import spare, text_of

# Fixed patterns (kind, pattern, least length, what is measured: 0 the match, 2 its value). For access and
# hex a run too short holds no longer match, so the least length is part of the pattern.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", r"AKIA[A-Z0-9]{16,}", 20, 0),
    ("hex", r"[0-9a-f]{24,}", 24, 0),
)


@dataclass(frozen=True)
class CharacterClass:
    """Candidates of a class, and the entropy (bits) from which a window of them is a secret.

    ``needs`` are patterns that the span must hold, so that words and numbers don't pass.
    """

    kind: str
    candidates: str
    window: int
    bits: float
    needs: tuple[str, ...]


CLASSES = (
    CharacterClass("entropy_hex", r"[0-9A-Fa-f]{24,}", 24, 3.0, ("[0-9]", "[A-Fa-f]")),
    CharacterClass("entropy_base64", r"[A-Za-z0-9+/_=-]{24,}", 24, 4.0, ("[0-9]", "[a-z]", "[A-Z]")),
    # whole words of 16 to 23 that change kind between neighbours, as slugs of words don't
    CharacterClass("entropy_short", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,23}(?![A-Za-z0-9+/_=-])", 16, 3.5, ("[0-9]", "[a-z]", "[A-Z]", "[a-z][0-9A-Z]|[0-9][A-Za-z]")),
    # one case with digits (base32, base36); a letter beyond F, or it is hex
    CharacterClass("entropy_lower", r"(?<![A-Za-z0-9])[a-z0-9]{16,}(?![A-Za-z0-9])", 16, 3.25, ("[0-9]", "[g-z]")),
    CharacterClass("entropy_upper", r"(?<![A-Za-z0-9])[A-Z0-9]{16,}(?![A-Za-z0-9])", 16, 3.25, ("[0-9]", "[G-Z]")),
    CharacterClass("entropy_hex_short", r"(?<![A-Za-z0-9])[0-9A-Fa-f]{16,23}(?![A-Za-z0-9])", 16, 2.75, ("[0-9]", "[A-Fa-f]")),
    CharacterClass("entropy_uuid", r"(?<![A-Za-z0-9-])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![A-Za-z0-9-])", 36, 2.75, ("[0-9]", "[A-Fa-f]")),
)

#: Parts of candidates that hold one of these are no secrets: samples, counting sequences, runs of one letter, digests that name their kind.
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme|deadbeef",
    r"(?i)0123456789|abcdefghij|qwertyuiop",
    r"(.)\1{7}",
    r"(?i)sha(?:1|256|384|512)-",
)

#: The parts of a candidate with something allowed: joined words are judged one by one, a named digest is one part.
PARTS = r"(?i:sha(?:1|256|384|512)-[A-Za-z0-9+/=_-]+)|[A-Za-z0-9+]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also when lambdas use it."""
    return F.get(F.transform(F.array(value), use), 0)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, found) of all matches from left to right, in code points.

    Texts between matches and matches alternate; sums over blocks of 64 give the
    starts, so long texts with many matches don't cost their square.
    """
    regexp = F.lit(pattern)
    block = 64

    def starts(found, gaps):
        sizes = F.transform(found, lambda m, i: F.char_length(F.get(gaps, i)) + F.char_length(m))

        def place(sizes, blocks):
            def start(size, i):
                b = F.floor(i / block).cast("int")
                return (
                    total(F.slice(blocks, F.lit(1), b)) + total(F.slice(sizes, b * block + 1, i - b * block)) + size - F.char_length(F.get(found, i))
                )

            return F.transform(sizes, lambda size, i: let(start(size, i), lambda s: F.struct(
                s.alias("start"), (s + F.char_length(F.get(found, i))).alias("end"), F.get(found, i).alias("found")
            )))

        def blocked(sizes):
            numbers = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int"))
            return F.transform(numbers, lambda b: total(F.slice(sizes, b * block + 1, F.lit(block))))

        return let(sizes, lambda z: let(blocked(z), lambda t: place(z, t)))

    spans = let(F.regexp_extract_all(text, regexp, 0), lambda m: let(F.split(text, pattern, -1), lambda g: starts(m, g)))
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    return F.when(F.rlike(text, regexp), spans).otherwise(none)


def entropy_span(found: Column, cls: CharacterClass) -> Column:
    """(first, last) start of the windows that reach the class's bits, (-1, -1) if none does.

    Counts of the characters of the window, and the sum of n*log2(n) over them, change
    with the one that enters and the one that leaves.
    """
    w = cls.window
    low, high = ord("+"), ord("z")
    weigh = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(w + 2)])
    blank = F.array_repeat(F.lit(0), high - low + 1)

    def swap(counts, code, by):
        return F.transform(counts, lambda n, i: F.when(i == code - low, n + by).otherwise(n))

    def step(state, at):
        code, leaves, i = at["code"], at["leaves"], at["i"]
        n = F.get(state["counts"], code - low)
        entered = swap(state["counts"], code, 1)
        s = state["s"] + F.get(weigh, n + 1) - F.get(weigh, n)

        def out(entered):
            m = F.get(entered, leaves - low)
            return F.struct(
                F.when(leaves.isNull(), entered).otherwise(swap(entered, leaves, -1)).alias("counts"),
                F.when(leaves.isNull(), s).otherwise(s + F.get(weigh, m - 1) - F.get(weigh, m)).alias("s"),
            )

        def hit(new):
            reached = (i >= w - 1) & (F.lit(math.log2(w)) - new["s"] / w >= cls.bits - 1e-9)
            here = i - (w - 1)
            return F.struct(
                new["counts"].alias("counts"), new["s"].alias("s"),
                F.when(reached & (state["first"] < 0), here).otherwise(state["first"]).alias("first"),
                F.when(reached, here).otherwise(state["last"]).alias("last"),
            )

        return let(let(entered, out), hit)

    def walk(codes):
        moves = F.transform(codes, lambda c, i: F.struct(c.alias("code"), F.get(codes, i - w).alias("leaves"), i.alias("i")))
        start = F.struct(blank.alias("counts"), F.lit(0.0).alias("s"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
        return F.aggregate(moves, start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))

    codes = F.transform(F.filter(F.split(found, ""), lambda c: c != ""), F.ascii)
    return let(codes, walk)


def judged(spans: Column, cls: CharacterClass, allowed: tuple[str, ...]) -> Column:
    """Candidates as they are, and of those that hold something allowed the other PARTS of a window or more."""
    fine = lambda found: F.exists(F.array(*map(F.lit, allowed)), lambda a: F.rlike(found, a))

    def parts(s):
        left = F.filter(located(s["found"], PARTS), lambda p: (F.char_length(p["found"]) >= cls.window) & ~fine(p["found"]))
        return F.transform(left, lambda p: F.struct((s["start"] + p["start"]).alias("start"), (s["start"] + p["end"]).alias("end"), p["found"].alias("found")))

    return F.flatten(F.transform(spans, lambda s: F.when(fine(s["found"]), parts(s)).otherwise(F.array(s))))


def secret_spans(text: Column, classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Sorted array of (start, place, kind, end): base matches that pass, and entropy spans not allowed.

    ``place`` is the kind's rank for equal starts.
    """
    kinds = []
    for place, (kind, pattern, least, group) in enumerate(BASE):
        spans = located(text, pattern)
        if group:
            spans = F.filter(spans, lambda s: F.char_length(F.regexp_extract(s["found"], pattern, group)) >= least)
        kinds.append(F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), s["end"].alias("end")
        )))
    for place, cls in enumerate(classes, len(BASE)):
        runs = F.transform(judged(located(text, cls.candidates), cls, allowed), lambda s: let(entropy_span(s["found"], cls), lambda e: F.struct(
            (s["start"] + e["first"]).alias("start"), F.lit(place).alias("place"), F.lit(cls.kind).alias("kind"),
            (s["start"] + e["last"] + cls.window).alias("end"), e["first"].alias("first"),
            F.substr(s["found"], e["first"] + 1, e["last"] - e["first"] + cls.window).alias("own"),
        )))
        good = F.filter(runs, lambda r: (r["first"] >= 0) & F.forall(F.array(*map(F.lit, cls.needs)), lambda n: F.rlike(r["own"], n)))
        kinds.append(F.transform(good, lambda r: F.struct(r["start"], r["place"], r["kind"], r["end"])))
    return F.array_sort(F.concat(*kinds))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, text: str = "text", name: str = "secrets", **settings) -> DataFrame:
    """``docs`` with a column of the secrets of each text: sorted array of (start, place, kind, end).

    A null or empty text has none; every row is kept, repeated ones too. Positions count code points.
    """
    return docs.withColumn(name, secret_spans(text_of(text), **settings))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", **settings) -> DataFrame:
    """``docs`` with ``mark`` in place of every secret; overlapping spans become one. ``n_chars``, if there, follows the text."""
    body = F.col(text)

    def rewrite(spans):
        def before(i):
            return F.coalesce(F.array_max(F.slice(F.transform(spans, lambda s: s["end"]), F.lit(1), i)), F.lit(0))

        parts = F.transform(spans, lambda s, i: let(before(i), lambda e: F.when(
            (s["start"] > e) | (i == 0), F.concat(F.substr(body, e + 1, s["start"] - e), F.lit(mark))
        ).otherwise(F.lit(""))))
        tail = F.substr(body, F.array_max(F.transform(spans, lambda s: s["end"])) + 1)
        return F.concat(F.array_join(parts, ""), tail)

    name = spare(docs, "_secrets")
    out = find_secrets(docs, text, name, **settings)
    some = F.size(name) > 0
    out = out.withColumn(text, F.when(some, let(F.col(name), rewrite)).otherwise(body))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.char_length(body)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.drop(name)
