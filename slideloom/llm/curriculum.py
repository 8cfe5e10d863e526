"""Mixing sources to target weights along a training run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from slideloom.llm.common import WORD, boxed, row_key, text_of, unboxed
from slideloom.plans.scale import settle

#: Weight of a source at evenly spaced moments of the run, relative to its overall weight.
SCHEDULES = ((1.0, 1.0), (0.5, 1.0, 1.5), (1.5, 1.0, 0.5))


def time_of(share: Column, schedule: tuple[float, ...]) -> Column:
    """Moment in [0, 1] by which a source has delivered ``share`` of its words.

    The schedule is piecewise linear; its integral is quadratic in each piece and is
    inverted there in closed form.
    """
    if len(schedule) < 2 or min(schedule) < 0 or max(schedule) <= 0:
        raise ValueError("a schedule needs two or more weights, none negative and one positive")
    step = 1.0 / (len(schedule) - 1)
    area = sum((a + b) / 2 * step for a, b in zip(schedule, schedule[1:]))
    done, out = 0.0, None
    pieces = []
    for i, (a, b) in enumerate(zip(schedule, schedule[1:])):
        a, b = a / area, b / area
        rest = F.greatest(share - done, F.lit(0.0))
        # a*u + (b-a)/(2*step)*u*u = rest, in the form that is stable for a = b
        root = F.sqrt(F.greatest(F.lit(a * a) + 2 * (b - a) / step * rest, F.lit(0.0)))
        u = F.when(rest > 0, 2 * rest / (F.lit(a) + root)).otherwise(0.0)
        done += (a + b) / 2 * step
        pieces.append((done, F.least(F.lit(i * step) + u, F.lit((i + 1) * step))))
    for top, value in reversed(pieces):
        out = value if out is None else F.when(share <= top, value).otherwise(out)
    return out


def plan_mix(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0,
    schedules: tuple[tuple[float, ...], ...] = SCHEDULES,
) -> DataFrame:
    """Words that a curriculum takes from every document, and when.

    Sources in code-point order (null last) take the weights and schedules in turn. They
    divide ``share`` of all words by weight; a source's target stops at ``most``
    times its size and the excess goes to the others by weight. Every source is read round
    and round in a fixed hashed order until its target is met, so a document is
    taken ``most`` times at most; the position of each reading is the moment at which
    the source's integrated schedule reaches the reading's middle word.

    Returns one row per distinct (id, text): _id, _fp (see ``row_key``), _copies (rows alike), size,
    source, source_size, target, taken, and readings (reading, words, position). Rows alike
    share their words evenly, rounded down. A null text has no words and is
    never taken; an empty table gives no rows.
    """
    digest = F.md5(F.coalesce(F.col(ident).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(
        *[c.alias(k) for k, c in row_key(ident, text).items()], F.col(ident).alias("_doc"), F.col(source).alias("_source"),
        F.regexp_count(text_of(text), F.lit(WORD)).cast("long").alias("size"), digest.alias("_order"),
    )
    rows = settle(
        rows.groupBy("_id", "_fp", "_source", "_order", "size").agg(F.first("_doc").alias("_doc"), F.count(F.lit(1)).alias("_copies"))
        .withColumn("_cell", F.substring("_order", 1, 3))
    )
    words = F.col("size") * F.col("_copies")
    # 4096 cells a source: its running sum is taken inside cells and over cells
    cells = settle(rows.groupBy("_source", "_cell").agg(F.sum(words).alias("_words")))
    by_name = Window.orderBy(F.asc_nulls_last("_source"))
    turn = F.row_number().over(by_name) - 1
    pick = F.array(*[F.lit(float(w)) for w in weights])
    sources = cells.groupBy("_source").agg(F.sum("_words").alias("source_size")).withColumn("_turn", turn)
    sources = sources.withColumn("_w", F.get(pick, F.col("_turn") % len(weights)))
    # a source is full when level * weight passes its cap; full sources come first by cap / weight
    cap = F.col("source_size") * float(most)
    by_ratio = Window.orderBy(F.col("source_size") / F.col("_w"), F.asc_nulls_last("_source"))
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = sources.withColumns({
        "_full": F.coalesce(F.sum(cap).over(earlier), F.lit(0.0)),
        "_left": F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(earlier), F.lit(0.0)),
        "_all": F.sum("source_size").over(everything) * float(share),
    })
    level = (F.col("_all") - F.col("_full")) / F.col("_left")
    sources = sources.withColumn("_open", level * F.col("_w") < cap)
    first_open = F.first(F.when(F.col("_open"), level), True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    sources = sources.withColumn("target", F.when(F.col("_open"), first_open * F.col("_w")).otherwise(cap)).drop("_open")
    before = Window.partitionBy("_source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = cells.withColumn("_start", F.coalesce(F.sum("_words").over(before), F.lit(0))).drop("_words")
    sums = sums.join(sources, sums["_source"].eqNullSafe(sources["_source"])).drop(sources["_source"])
    inside = Window.partitionBy("_source", "_cell").orderBy("_order", "_id", "_fp").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_at", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    same = summed["_source"].eqNullSafe(sums["_source"]) & (summed["_cell"] == sums["_cell"])
    out = summed.join(sums, same).drop(sums["_source"]).drop(sums["_cell"]).withColumn("_at", F.col("_at") + F.col("_start"))
    quota = F.floor(F.col("target") + 0.5).cast("long")

    def reading(k):
        wanted = quota - F.col("source_size") * k - F.col("_at")
        each = F.floor(F.greatest(F.least(wanted, words), F.lit(0)) / F.col("_copies")).cast("long")
        middle = F.try_divide(F.col("source_size") * k + F.col("_at") + each * F.col("_copies") / 2, F.col("target"))
        moments = F.array(*[time_of(middle, s) for s in schedules])
        return F.struct(
            F.lit(k).alias("reading"), each.alias("words"), F.get(moments, F.col("_turn") % len(schedules)).alias("position")
        )

    rounds = -int(-most // 1)
    readings = F.filter(F.array(*[reading(k) for k in range(rounds)]), lambda r: r["words"] > 0)
    return out.select(
        "_id", "_fp", "_doc", "_copies", "size", F.col("_source").alias("source"), "source_size", "target",
        F.aggregate(readings, F.lit(0).cast("long"), lambda a, r: a + r["words"]).alias("taken"), readings.alias("readings"),
    )


def mix(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", position: str | None = None, **plan) -> DataFrame:
    """The documents as a training run reads them, sorted by position.

    A document read twice appears twice; one whose last reading is cut keeps its first
    words and the white space before them (``n_chars`` follows, if there is one). Other columns stay; ``position``
    names a column for the moment of the reading. Documents not taken are left out.
    """
    chosen = settle(plan_mix(docs, ident, text, source, **plan).select("_id", "_fp", F.col("source").alias("_from"), F.col("size").alias("_size"), F.explode("readings").alias("_r")))
    # the same id and text may stand in several sources, each with readings of its own
    rows = boxed(docs, **row_key(ident, text), _source=F.col(source))
    same = (rows["_id"] == chosen["_id"]) & (rows["_fp"] == chosen["_fp"]) & rows["_source"].eqNullSafe(chosen["_from"])
    out = rows.join(chosen, same).drop(chosen["_id"], chosen["_fp"])
    # the first n words with what stands before each
    old, words = F.col("_row")[text], F.col("_r.words")
    parts = F.regexp_extract_all(old, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0)
    whole = words == F.col("_size")
    out = out.withColumn("_text", F.when(whole, old).otherwise(F.array_join(F.slice(parts, 1, words.cast("int")), "")))
    new = {text: F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(whole, F.col("_row")["n_chars"]).otherwise(F.char_length("_text"))
    if position:
        at = {position: F.col("_r.position")}
        docs, new = docs.withColumn(position, F.lit(0.0)), new | at
    return unboxed(out.orderBy("_r.position", "_id", "_fp"), docs, **new)
