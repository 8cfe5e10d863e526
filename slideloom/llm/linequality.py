"""Quality rules on documents, and on lines that many documents of a host share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from slideloom.llm.common import boxed, row_key, unboxed
from slideloom.plans.scale import settle

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
#: Lines are compared in lower case (ASCII), with every digit as 0 and single spaces.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")


def repeated_words(words: list[bytes]) -> int:
    """Words inside some window of three that occurs twice or more in the list."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) >= 2_000_000:  # keep three words inside 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(seen) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : k + len(twice)] |= twice
    return int(inside.sum())


def measure_text(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and (place, hash, words) of every line with a word."""
    if not text:
        return 0, 0, 0, 0, 0, [], [], []
    raw = text.encode()
    words = raw.split()
    places, hashes, sizes, seen, again = [], [], [], set(), 0
    for i, line in enumerate(raw.split(b"\n")):
        own = line.translate(FOLD).split()
        if own:
            again += line in seen
            seen.add(line)
            places.append(i)
            hashes.append(xxhash.xxh64_intdigest(b" ".join(own)))
            sizes.append(len(own))
    blanks = len(raw) - len(raw.translate(None, SPACES))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), len(text) - blanks, symbols, again, repeated_words(words), places, hashes, sizes


def measure(docs: DataFrame, ident: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Counts of every row and its lines, in one pass over the texts: _id, _fp, _doc, _host, the counts, lines (place, hash, words)."""
    kinds = {c: docs.schema[c].dataType.simpleString() for c in (ident, host)}
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for b in batches:
            rows = [measure_text(t.as_py()) for t in b.column(4)]
            columns = list(zip(*rows)) or [()] * 8
            sizes = np.cumsum([0] + [len(p) for p in columns[5]])
            flat = [pa.array([v for r in c for v in r], t) for c, t in zip(columns[5:], (pa.int32(), pa.uint64(), pa.int32()))]
            lines = pa.ListArray.from_arrays(
                pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([flat[0], flat[1].view(pa.int64()), flat[2]], ["place", "hash", "words"])
            )
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], *[pa.array(c, pa.int64()) for c in columns[:5]], lines], names=["_id", "_fp", "_doc", "_host", *counts, "lines"]
            )

    keyed = docs.select(
        *[c.alias(k) for k, c in row_key(ident, text).items()], F.col(ident).alias("_doc"), F.col(host).alias("_host"), F.col(text).alias("_text")
    )
    schema = f"_id long, _fp long, _doc {kinds[ident]}, _host {kinds[host]}, {', '.join(c + ' long' for c in counts)}, lines array<struct<place int, hash long, words int>>"
    return keyed.mapInArrow(run, schema)


def judge(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", host: str = "source",
    least: int = 10, share: float = 0.05, remain: float = 0.3, long_words: int = 10,
) -> DataFrame:
    """Counts and verdict of every row, and the places of the lines to remove.

    A line (see FOLD) is counted once for each different text of a host that holds it, so exact copies
    don't make a line common. Lines of ``long_words`` words or more are common above ``least`` texts, however large
    the host; shorter ones, which differing documents may well share, above ``least`` texts and ``share`` of the host's
    texts. A common line is removed everywhere but in the host's first document that has it (smallest
    id). A document is depleted, and not kept, if under ``remain`` of its words are left;
    it also fails with under 50 words, or with over half of them in repeated windows of three
    (base_failed).

    Columns: _id, _fp (see ``row_key``), _doc, the counts, removed_words, base_failed, kept,
    removed (places). A null or empty text has no words and fails; a null host is a host.
    Rows alike in id and text are judged alike, one row each. An empty table gives no rows.
    """
    rows = settle(measure(docs, ident, text, host))
    alike = rows.groupBy("_id", "_fp", "_host").agg(F.first("lines").alias("lines"))
    lines = alike.select("_id", "_fp", "_host", F.explode("lines").alias("_l")).select("_id", "_fp", "_host", "_l.*")
    texts = rows.groupBy("_host", "_fp").agg(F.lit(1)).groupBy("_host").agg(F.count(F.lit(1)).alias("_texts"))
    counted = (
        lines.groupBy("_host", "hash", "_fp").agg(F.min("_id").alias("_least"), F.first("words").alias("_words"))
        .groupBy("_host", "hash").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_least", "_fp")).alias("_first"), F.first("_words").alias("_words"))
        .where(F.col("_n") > least)
    )
    common = counted.join(texts.withColumnRenamed("_host", "_h"), F.col("_host").eqNullSafe(F.col("_h")))
    common = settle(common.where((F.col("_words") >= long_words) | (F.col("_n") > F.col("_texts") * share)).select("_h", F.col("hash").alias("_hash"), "_first"))
    hit = lines.join(common, F.col("_host").eqNullSafe(F.col("_h")) & (F.col("hash") == F.col("_hash")))
    hit = hit.where((F.col("_id") != F.col("_first._least")) | (F.col("_fp") != F.col("_first._fp")))
    lost = hit.groupBy(F.col("_id").alias("_i"), F.col("_fp").alias("_f"), F.col("_host").alias("_h")).agg(
        F.sum("words").alias("removed_words"), F.collect_list("place").alias("removed")
    )
    same = (F.col("_id") == F.col("_i")) & (F.col("_fp") == F.col("_f")) & F.col("_host").eqNullSafe(F.col("_h"))
    out = rows.drop("lines").join(lost, same, "left").drop("_i", "_f", "_h")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    gone = F.coalesce("removed_words", F.lit(0).cast("long"))
    return out.withColumns({
        "removed_words": gone, "removed": F.coalesce("removed", F.array().cast("array<int>")), "base_failed": failed,
        "kept": ~failed & (F.col("n_words") - gone >= F.col("n_words") * remain),
    })


def clean(docs: DataFrame, ident: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The kept documents without the lines to remove; ``n_chars``, if there, follows the text. Other columns stay."""
    judged = judge(docs, ident, text, host, **limits)
    verdict = judged.where("kept").groupBy(F.col("_id").alias("_i"), F.col("_fp").alias("_f"), F.col("_host").alias("_h")).agg(
        F.first("removed").alias("_removed")
    )
    keyed = boxed(docs, **row_key(ident, text), _host=F.col(host))
    out = keyed.join(verdict, (F.col("_id") == F.col("_i")) & (F.col("_fp") == F.col("_f")) & F.col("_host").eqNullSafe(F.col("_h")))
    old, changed = F.col("_row")[text], F.size("_removed") > 0
    left = F.filter(F.split(old, "\n", -1), lambda x, i: ~F.array_contains("_removed", i))
    out = out.withColumn("_text", F.when(changed, F.array_join(left, "\n")).otherwise(old))
    new = {text: F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.char_length("_text")).otherwise(F.col("_row")["n_chars"])
    return unboxed(out, docs, **new)
