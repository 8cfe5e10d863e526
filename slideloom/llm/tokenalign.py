"""Alignment of two tokenizers' ids over the same bytes."""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from slideloom.llm.common import text_of
from slideloom.llm.packing import batches_of, byte_letters, listed
from slideloom.plans.scale import settle

#: A link's two ids in one number: ids of the second tokenizer are below this.
IDS = 1 << 20
#: Bytes of text that are aligned at once: bounds what a task's arrays take beside a block's pairs.
PART_BYTES = 500_000
#: Between ids, the two sides of a group, and groups.
COMMA, BAR, SEMICOLON = (pa.scalar(c, pa.large_string()) for c in ",|;")


class ByteLevel:
    """A byte-level BPE file (JSON): ids of texts, special tokens being plain text, and the bytes of every id.

    The file's ids must rise along its merges, as in files that training wrote; then merging always the
    pair with the smallest id of the result is the same rule, and a faster library can apply it.
    """

    #: Fixed value: the split pattern that byte-level files with ``use_regex`` stand for.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut, model = spec["pre_tokenizer"] or {}, spec["model"]
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if cut.get("type") != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"] or spec["normalizer"] or model["type"] != "BPE" or merged != sorted(merged):
            raise ValueError(f"{path} is no plain byte-level BPE file with ids in the order of merges")
        back = {c: b for b, c in byte_letters().items()}
        special = {t["content"] for t in spec["added_tokens"]}
        known = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        self.pieces = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            self.pieces[i] = token
        self.coder = tiktoken.Encoding("file", pat_str=self.SPLIT, mergeable_ranks=known, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.coder.encode_ordinary(t) for t in texts]


class Pieces:
    """A SentencePiece model with byte fallback; U+2581 stands for a space."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(len(self.model))]
        self.pieces = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=1)
def coders(first: str, second: str) -> list[tuple]:
    """Both files' coders with the sizes and bytes of all ids, read once by a Python worker."""
    return [(c, np.array(list(map(len, c.pieces)), np.int64), pa.array(c.pieces, pa.large_binary())) for c in (ByteLevel(first), Pieces(second))]


def groups_of(ids_a, ids_b, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the slices between byte offsets at which tokens of both end stop in a and in b; the number of each slice's last
    link; the slices with more than one token on a side (number, first and last of a, of b); and all links, in
    order: id pairs whose bytes overlap. Tokens are of one byte or more, and both sides of equally many bytes.

    Each side has a table from every byte offset to the number of its tokens that end by then; the offsets at which both
    end, in order, cut the two lists. Between two neighbouring ends of either side lie bytes of one token of each,
    and of no other such stretch: a link for each stretch. Texts one after another are like one text: a text's end is an end of both.
    """
    a, b = np.asarray(ids_a, np.int64), np.asarray(ids_b, np.int64)
    ends_a, ends_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    total = int(ends_a[-1]) if len(a) else 0
    at_a, at_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
    at_a[ends_a] = at_b[ends_b] = True
    upto_a, upto_b = np.cumsum(at_a, dtype=np.int32), np.cumsum(at_b, dtype=np.int32)
    common, every = np.flatnonzero(at_a & at_b), np.flatnonzero(at_a | at_b)
    to_a, to_b = upto_a[common].astype(np.int64), upto_b[common].astype(np.int64)
    from_a, from_b = np.concatenate([[0], to_a])[:-1], np.concatenate([[0], to_b])[:-1]
    at = np.flatnonzero((to_a - from_a > 1) | (to_b - from_b > 1))
    wide = np.stack([at, from_a[at], to_a[at] - 1, from_b[at], to_b[at] - 1], 1)
    lasts = a[to_a - 1] * IDS + b[to_b - 1]
    return to_a, to_b, lasts, wide, a[upto_a[every - 1]] * IDS + b[upto_b[every - 1]]


class PairTexts:
    """Ids as decimal text, each made once: at most the greatest id's number."""

    def __init__(self):
        self.numbers = pa.array([], pa.large_string())

    def of(self, ids: np.ndarray) -> pa.Array:
        top = int(ids.max(initial=-1))
        if top >= len(self.numbers):
            self.numbers = pa.array(np.arange(top + 1)).cast(pa.large_string())
        return self.numbers.take(pa.array(ids))

    def listed(self, ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
        """The ids from each place to another, comma-joined."""
        ends = np.cumsum(last - first + 1)
        places = np.arange(ends[-1]) + np.repeat(last + 1 - ends, last - first + 1)
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends])), self.of(ids[places])), COMMA)


def group_texts(lasts: np.ndarray, wide: np.ndarray, ids_a, ids_b, texts: PairTexts) -> pa.Array:
    """Each group as text: decimal ids of both sides, ``a1,a2|b1``."""
    out = pc.binary_join_element_wise(texts.of(lasts // IDS), texts.of(lasts % IDS), BAR)
    if not len(wide):
        return out
    g, i, last_a, k, last_b = wide.T
    sides = texts.listed(np.asarray(ids_a, np.int64), i, last_a), texts.listed(np.asarray(ids_b, np.int64), k, last_b)
    mask = np.zeros(len(lasts), bool)
    mask[g] = True
    return pc.replace_with_mask(out, pa.array(mask), pc.binary_join_element_wise(*sides, BAR))


def written(lasts: np.ndarray, wide: np.ndarray, ids_a, ids_b, texts: PairTexts) -> str:
    """The groups of one text, joined: ``a1,a2|b1;a3|b2,b3``."""
    return joined(group_texts(lasts, wide, ids_a, ids_b, texts), np.array([0, len(lasts)]))[0]


def joined(groups: pa.Array, bounds: np.ndarray) -> list[str]:
    """Each text's groups, of those between two neighbouring bounds."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), groups), SEMICOLON).to_pylist()


def faithful(ids: np.ndarray, counts: np.ndarray, pieces: pa.Array, sizes: np.ndarray, goals: list[bytes]) -> np.ndarray:
    """Whether the bytes of each text's tokens are those it should have."""
    flat = pieces.take(pa.array(ids)).buffers()[2]
    flat = flat.to_pybytes() if flat else b""
    ends = np.concatenate([[0], np.cumsum(sizes[ids])])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return np.fromiter((flat[x:y] == g for x, y, g in zip(ends, ends[1:], goals)), bool, len(goals))


def align(docs: DataFrame, first: str, second: str, text: str = "text", keep: list[str] | None = None, groups: bool = False, block_bytes: int = 4_000_000) -> DataFrame:
    """Every row with the alignment of its tokens by two tokenizers.

    ``first`` is a byte-level BPE file, given a space and the text; ``second`` a SentencePiece model, which adds the
    space itself. Columns: _row (the columns ``keep`` of ``docs``, else all), n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256
    and, if ``groups``, groups (the text that is hashed: decimal ids of both sides, in order). A link's count is the number of rows
    that hold its id pair; n_best counts a row's links whose count is the highest of their first id. Null and empty
    texts, and texts that either tokenizer doesn't give back byte by byte (as with normalised or unknown
    characters), have no tokens: zeros and ''. Rows alike count each. An empty table gives no rows.

    Tasks align their rows in blocks of about ``block_bytes`` of text (one longer text is a block of its own). A block
    is aligned in parts and keeps its distinct pairs once; rows refer to them by place. So counting and looking up move one
    row for each block and pair, not for each link; a block's rows and answers meet again by the block's number.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]).alias("_row")
    kind = docs.select(row).schema["_row"].dataType.simpleString()
    named = docs.select(text_of(f"`{text}`").alias("t"), row)

    def run(batches):
        (left, size_a, bytes_a), (right, size_b, bytes_b) = coders(first, second)
        texts_of = PairTexts()
        task, number = TaskContext.get().partitionId(), 0
        for b in batches:
            for low, high in batches_of(b.column(0), block_bytes):
                block_texts = b.column(0).slice(low, high - low)
                pairs, times, facts, hashes, lines = [], [], [], [], []
                for start, stop in batches_of(block_texts, PART_BYTES):
                    texts = block_texts.slice(start, stop - start).to_pylist()
                    spaced = [" " + t for t in texts]
                    goals = [t.encode() for t in spaced]
                    ids_a, n_a = listed(left.encode(spaced))
                    ids_b, n_b = listed(right.encode(texts))
                    good = faithful(ids_a, n_a, bytes_a, size_a, goals) & faithful(ids_b, n_b, bytes_b, size_b, goals)
                    good &= np.fromiter(map(bool, texts), bool, len(texts))
                    ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
                    n_a, n_b = n_a * good, n_b * good
                    to_a, _, lasts, wide, links = groups_of(ids_a, ids_b, size_a, size_b)
                    bounds = np.searchsorted(to_a, np.concatenate([[0], np.cumsum(n_a)]), "right")
                    n_links = n_a + n_b - np.diff(bounds)
                    for own in np.split(links, np.cumsum(n_links)[:-1]):
                        p, c = np.unique(own, return_counts=True)
                        pairs.append(p)
                        times.append(c.astype(np.int32))
                    facts.append((n_a, n_b, np.diff(bounds), n_links))
                    part = joined(group_texts(lasts, wide, ids_a, ids_b, texts_of), bounds)
                    hashes += [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in part]
                    lines += part if groups else [None] * len(part)
                flat = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
                known, place, held = np.unique(flat, return_inverse=True, return_counts=True)
                ends = np.cumsum([0] + [len(p) for p in pairs]).astype(np.int32)
                block = (task << 24) + number
                number += 1
                rows, n = b.column(1).slice(low, high - low), high - low
                lists = lambda flat, off: pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block)), rows, *(pa.array(np.concatenate(f)) for f in zip(*facts)), pa.array(hashes, pa.string()), pa.array(lines, pa.string()),
                     lists(place.astype(np.int32), ends), lists(np.concatenate(times) if times else np.zeros(0, np.int32), ends),
                     pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))], names=names)
                if len(known):
                    one = [0, len(known)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block]), pa.nulls(1, rows.type), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()), pa.nulls(1, pa.string()),
                         pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32())), lists(known, one), lists(held.astype(np.int32), one)], names=names)

    names = ["block", "_row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "place", "times", "pairs", "held"]
    schema = f"block long, _row {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, place array<int>, times array<int>, pairs array<long>, held array<int>"
    done = settle(named.mapInArrow(run, schema))
    known = done.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("at", "p"))
    known = known.select("block", "at", F.col("p.pairs").alias("pair"), F.col("p.held").alias("held"))
    counts = settle(known.groupBy("pair").agg(F.sum("held").alias("count")))
    # one row for each id of the first tokenizer: bounded by its vocabulary
    best = counts.groupBy(F.expr(f"pair div {IDS}").alias("a")).agg(F.max("count").alias("most"))
    counts = counts.withColumn("a", F.expr(f"pair div {IDS}")).join(F.broadcast(best), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answer = F.array_sort(F.collect_list(F.struct("at", "count", "best")))
    answers = known.select("block", "at", "pair").join(counts, "pair").groupBy("block").agg(answer.alias("s"))
    answers = answers.select(F.col("block").alias("asked"), F.col("s.count").alias("count"), F.col("s.best").alias("best"))

    def finish(rows, answer):
        flat = rows.column("place").combine_chunks()
        place, off = flat.flatten().to_numpy(), np.asarray(flat.offsets)
        times = rows.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
        if len(place):
            count = answer.column("count").combine_chunks().flatten().to_numpy()
            best = answer.column("best").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            good, total = times * best[place], times * count[place]
        else:
            good = total = np.zeros(0, np.int64)
        upto = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[off - off[0]])
        out = rows.drop_columns(["block", "place", "times"])
        return out.append_column("n_best", pa.array(upto(good))).append_column("count_sum", pa.array(upto(total)))

    facts = done.where("_row is not null").drop("pairs", "held")
    out = facts.groupBy("block").cogroup(answers.groupBy("asked")).applyInArrow(
        finish, f"_row {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, n_best long, count_sum long"
    )
    return out if groups else out.drop("groups")
