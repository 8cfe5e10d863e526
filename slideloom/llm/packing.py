"""Packing token sequences by patterns fitted with non-negative least squares."""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from slideloom.llm.common import number_within, text_of
from slideloom.plans.scale import settle


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others for the letters from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = {}, 0x100
    for b in range(256):
        out[b] = chr(b if b in plain else spare)
        spare += b not in plain
    return out


class Table:
    """Strings and their ids, in flat arrays."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def codes(self, texts: list[str]) -> np.ndarray:
        """Place of each string, -1 if it isn't there."""
        return np.fromiter(map(self.known.get, texts, repeat(-1)), np.int64, len(texts))

    def add(self, texts: list[str], ids: np.ndarray, sizes: np.ndarray):
        n = len(self.known)
        self.known.update(zip(texts, range(n, n + len(texts))))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, ids])

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all, and the sizes."""
        sizes = self.sizes[codes]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.starts[codes] - ends + sizes, sizes)], sizes


def listed(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes


class PartCoder:
    """Ids of many parts at once, by a faster library from the model of the same file.

    For byte-level BPE models with a suffix at each part's end whose ids rise along the merges: merging always
    the pair with the smallest id of the result is the same rule. The suffix is written as a newline, which no part holds.
    """

    def __init__(self, model: dict):
        import tiktoken

        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        back = {c: b for b, c in byte_letters().items()}
        ends = {t: bool(suffix) and t.endswith(suffix) for t in vocab}
        letters = {t: t.removesuffix(suffix) if e else t for t, e in ends.items()}
        newline = byte_letters()[10]
        known = {bytes(map(back.__getitem__, letters[t])) + b"\n" * ends[t]: i for t, i in vocab.items() if newline not in t and back.keys() >= set(letters[t])}
        single = [known.get(bytes([b]) + e, len(vocab)) for b in range(256) if b != 10 for e in (b"", b"\n")]
        plain = suffix and suffix not in vocab and not any(model[k] for k in ("dropout", "continuing_subword_prefix", "ignore_merges"))
        if not plain or not merged or merged != sorted(set(merged)) or max(single) >= merged[0]:
            raise ValueError("no byte-level BPE model with a suffix and ids in the order of merges")
        self.last = np.zeros(max(known.values()) + 1, bool)
        self.last[[i for t, i in known.items() if t.endswith(b"\n")]] = True
        self.coder = tiktoken.Encoding("parts", pat_str=r"[^\n]+\n", mergeable_ranks=known, special_tokens={})

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, and how many each has."""
        ids = np.array(self.coder.encode_ordinary("\n".join(parts) + "\n"), np.uint32)
        return ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1)


class WordCache:
    """Token ids of texts, word by word, for tokenizers that never join across ASCII white space.

    Words are looked up in a table of at most ``limit`` words, which starts anew when full;
    only words not in it go to the tokenizer. For a model that splits by a pattern into
    byte-level parts, new Latin words are lower-cased and split here and only their new parts go to a
    faster coder of the same model, all at once, or to the model, which spares the tokenizer's bookkeeping of offsets; other words are encoded whole.
    """

    #: Letters and signs that need no normal form and are white space to nobody.
    PLAIN = re.compile("[!-~\xa1-\u024f]+")
    #: Parts of more letters go to the model.
    LONG = 500

    def __init__(self, tokenizer, limit: int = 200_000):
        self.tokenizer, self.model, self.limit = tokenizer, tokenizer.model, limit
        spec = json.loads(tokenizer.to_str())
        self.marks = [t["content"] for t in spec["added_tokens"]]
        self.letters, self.pattern, self.parts, self.coder = byte_letters(), None, None, None
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        lowers = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        if lowers and len(steps) == 2 and spec["post_processor"] is None and spec["model"]["type"] == "BPE":
            cut, level = steps
            plain = level["type"] == "ByteLevel" and not level["add_prefix_space"] and not level["use_regex"]
            if plain and cut["type"] == "Split" and cut["invert"] and cut["behavior"] == "Removed" and "Regex" in cut["pattern"]:
                self.pattern = regex.compile(cut["pattern"]["Regex"] + "|\n")
                try:
                    self.coder = PartCoder(spec["model"])
                except (ImportError, ValueError):
                    pass
        self.clear()

    def forget(self):
        """Drop all tables; the tokenizer stays."""
        self.parts = None
        self.clear()

    def clear(self):
        self.words = Table()
        if self.parts is None or len(self.parts.known) > self.limit:
            self.parts = Table()
            self.parts.add(["\n"], np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def _split(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of plain words by way of their parts."""
        found = self.pattern.findall("\n".join(words).lower() + "\n")
        codes = self.parts.codes(found)
        new = np.flatnonzero(codes < 0)
        if len(new):
            missing = [found[i] for i in new]
            fresh = list(dict.fromkeys(missing))
            # the faster library's time grows with the square of a part
            short = [p for p in fresh if len(p) <= self.LONG] if self.coder else []
            if short:
                self.parts.add(short, *self.coder.encode(short))
            others = [p for p in fresh if p not in self.parts.known] if len(short) < len(fresh) else []
            if others:
                mapped = [p if p.isascii() else "".join(map(self.letters.__getitem__, p.encode())) for p in others]
                self.parts.add(others, *listed([[t.id for t in self.model.tokenize(m)] for m in mapped]))
            codes[new] = self.parts.codes(missing)
        ids, sizes = self.parts.gather(codes)
        ends = np.cumsum(sizes)[codes == 0]
        return ids, np.diff(ends, prepend=0)

    def learn(self, words: list[str]):
        marked = any(m in w for m in self.marks for w in words)
        plain = [w for w in words if self.PLAIN.fullmatch(w) and not (marked and any(m in w for m in self.marks))] if self.pattern else []
        if plain:
            self.words.add(plain, *self._split(plain))
        others = [w for w in words if w not in self.words.known]
        if others:
            self.words.add(others, *listed([e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """uint32 ids of each text of a string array without nulls."""
        if len(self.words.known) > self.limit:
            self.clear()
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        unique = words.dictionary.to_pylist()
        codes = self.words.codes(unique)
        new = np.flatnonzero(codes < 0)
        if len(new):
            missing = [unique[i] for i in new]
            self.learn(missing)
            codes[new] = self.words.codes(missing)
        ids, sizes = self.words.gather(codes[words.indices.to_numpy()])
        offsets = split.offsets.to_numpy()
        bounds = np.concatenate([[0], np.cumsum(sizes)])[offsets - offsets[0]]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


@lru_cache(maxsize=1)
def word_cache(path: str) -> WordCache:
    """The cache of a tokenizer's file, read once by a Python worker: read again in each of its tasks, the freed pieces
    of former copies pile up and the worker grows with the number of tasks."""
    from tokenizers import Tokenizer

    return WordCache(Tokenizer.from_file(path))


def batches_of(texts: pa.Array, size: int = 4_000_000):
    """Ranges of ``texts`` of about ``size`` bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start, base = 0, 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, base + size, "right")))
        yield start, stop
        start, base = stop, int(ends[stop - 1])


def pieces(docs: DataFrame, tokenizer: str, ident: str = "doc_id", text: str = "text", limit: int = 4096, end: int = 1) -> DataFrame:
    """The token pieces of every document: ident, piece, start, length, ids_crc32.

    ``tokenizer`` is a file of the ``tokenizers`` library that each executor can read, and
    whose pre-tokenizer splits at ASCII white space. Every
    document ends with id ``end``; only documents of more than ``limit`` ids are cut. A
    null text is the empty one: a single id.
    """
    kind = docs.schema[ident].dataType.simpleString()

    def cut(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = word_cache(tokenizer)
        gc.disable()  # tables of many small objects without cycles
        try:
            for batch in batches:
                texts = batch.column(1)
                for a, b in batches_of(texts):
                    rows, piece, start, length, crc = [], [], [], [], []
                    for i, ids in enumerate(cache.encode(texts.slice(a, b - a)), a):
                        ids = np.append(ids, np.uint32(end)).astype("<u4")
                        for k, s in enumerate(range(0, len(ids), limit)):
                            part = ids[s : s + limit]
                            rows.append(i)
                            piece.append(k)
                            start.append(s)
                            length.append(len(part))
                            crc.append(zlib.crc32(part.tobytes()))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                        names=["doc", "piece", "start", "length", "ids_crc32"],
                    )
        finally:
            # the worker goes on to other tasks
            cache.forget()
            gc.enable()
            gc.collect()
            pa.default_memory_pool().release_unused()

    out = docs.select(F.col(ident).alias("doc"), text_of(text).alias("text")).mapInArrow(
        cut, f"doc {kind}, piece int, start long, length long, ids_crc32 long"
    )
    return out.withColumnRenamed("doc", ident)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int) -> np.ndarray:
    """Non-negative least squares by active sets; at most ``rounds`` columns enter."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= tol:
            break
        active[best] = True
        while True:
            on = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[on] = z
                break
            low = z <= 0
            step = x[on][low] / np.maximum(x[on][low] - z[low], 1e-300)
            x[on] += step.min() * (z - x[on])
            active[on[x[on] <= tol * 1e-6]] = False
            active[on[low][step == step.min()]] = False
            x[~active] = 0
    return x


def patterns(bins: int, most: int = 3) -> list[tuple[int, ...]]:
    """Falling tuples of at most ``most`` bin numbers that sum to ``bins``, each over a quarter of it.

    Shorter documents are worth more as filling for what patterns leave free.
    """
    out = []

    def grow(prefix, left, top):
        if left == 0:
            out.append(prefix)
        elif len(prefix) < most:
            for b in range(min(left, top), bins // 4, -1):
                if b * (most - len(prefix)) >= left:
                    grow((*prefix, b), left - b, b)

    grow((), bins, bins)
    return out


class Plan:
    """Packs with the same lengths in the same order, and how often each occurs.

    The plan depends on the histogram of lengths alone, which has at most ``limit`` entries.
    """

    def __init__(self, counts: dict[int, int], limit: int = 4096, bins: int = 128):
        self.limit, self.width = limit, -(-limit // bins)
        self.left = dict(counts)
        self.open: list[list] = [[] for _ in range(limit + 1)]
        self.filled = 0  # bit s: packs with s free tokens exist
        self.full: list[tuple[int, tuple]] = []
        self._fit(-(-limit // self.width))
        self._residual()

    def _put(self, count, lengths, free):
        if free:
            self.open[free].append((count, lengths))
            self.filled |= 1 << free
        else:
            self.full.append((count, lengths))

    def _fit(self, bins):
        """Take the rounded repeats of every fitted pattern from the histogram."""
        queues = [[] for _ in range(bins + 1)]
        for length in sorted(self.left):
            queues[-(-length // self.width)].append(length)
        have = np.array([sum(self.left[n] for n in q) for q in queues[1:]], float)
        shapes = [p for p in patterns(bins) if all(have[b - 1] for b in p)]
        if not shapes:
            return
        a = np.zeros((bins, len(shapes)))
        for j, p in enumerate(shapes):
            for b in p:
                a[b - 1, j] += 1
        # a token left over costs the same in every bin
        weight = np.arange(1, bins + 1) / bins
        repeats = nnls(a * weight[:, None], have * weight, 3 * bins)
        for j in sorted(np.flatnonzero(repeats), key=lambda j: (-repeats[j], shapes[j])):
            need = {b: shapes[j].count(b) for b in shapes[j]}
            n = min(int(np.floor(repeats[j] + 0.5)), *(int(have[b - 1]) // m for b, m in need.items()))
            if n <= 0:
                continue
            for b, m in need.items():
                have[b - 1] -= n * m
            slots = [self._take(queues[b], n) for b in shapes[j]]
            while n:
                k = min(s[-1][1] for s in slots)
                lengths = tuple(s[-1][0] for s in slots)
                self._put(k, lengths, self.limit - sum(lengths))
                for s in slots:
                    s[-1][1] -= k
                    if not s[-1][1]:
                        s.pop()
                n -= k

    def _take(self, queue, n):
        """[length, count] runs of the n longest documents of a bin, shortest run first."""
        out = []
        while n:
            k = min(n, self.left[queue[-1]])
            out.append([queue[-1], k])
            self.left[queue[-1]] -= k
            n -= k
            if not self.left[queue[-1]]:
                queue.pop()
        return out[::-1]

    def _residual(self):
        """Best fit of what is left, longest first, into the least free space that holds it."""
        for length in sorted(self.left, reverse=True):
            c = self.left[length]
            while c:
                above = self.filled >> length
                if not above:
                    per = self.limit // length
                    for packs, docs in ((c // per, per), (1, c % per)):
                        if packs and docs:
                            self._put(packs, (length,) * docs, self.limit - length * docs)
                    break
                free = length + (above & -above).bit_length() - 1
                packs, lengths = self.open[free].pop()
                k = min(packs, c)
                if k < packs:
                    self.open[free].append((packs - k, lengths))
                elif not self.open[free]:
                    self.filled &= ~(1 << free)
                self._put(k, (*lengths, length), free - length)
                c -= k

    def runs(self) -> np.ndarray:
        """Rows (length, first rank, first sequence, offset), sorted: where documents of a length go by rank."""
        out, used, sequence = [], {}, 0
        for count, lengths in [*self.full, *(p for packs in self.open for p in packs)]:
            offset = 0
            for n in lengths:
                out.append((n, used.get(n, 0), sequence, offset))
                used[n] = used.get(n, 0) + count
                offset += n
            sequence += count
        self.sequences = sequence
        return np.array(sorted(out), np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, ident: str = "doc_id", limit: int = 4096, bins: int = 128) -> DataFrame:
    """Give every piece a sequence and a place in it, for as few sequences as the plan finds.

    Lengths are counted (at most ``limit`` numbers reach the driver). Patterns of up to three length classes
    that fill a sequence are fitted to the counts by non-negative least squares, rounded
    to what is there, and the rest goes by best fit into the space that patterns leave
    and into new sequences. Ranks inside each length, taken in parallel, then tell each
    piece its run in the plan. ``pieces`` has ident, piece, start, length (1 to ``limit``)
    and any other columns, and is written once; sequence_id and offset are added. Rows alike get places of
    their own; an empty table gives no rows.
    """
    rows = settle(pieces)
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return rows.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    shared = rows.sparkSession.sparkContext.broadcast(Plan(counts, limit, bins).runs())
    ranked = number_within(rows, "length", [ident, "piece", "start"], "_rank")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def place(batches):
        runs = shared.value
        key = runs[:, 0] << 44 | runs[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            at = runs[np.searchsorted(key, length << 44 | rank, "right") - 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(at[:, 2] + rank - at[:, 1]), pa.array(at[:, 3])],
                names=[*names, "sequence_id", "offset"],
            )

    names = rows.columns
    return ranked.select(*names, "_rank").mapInArrow(place, f"{kinds}, sequence_id long, offset long")
