"""Building blocks that keep plans safe when one key holds much of the data.

* ``settle``          cut lineage through a table in the shared folder
* ``reread``          copy an input that is read twice, unless it is a plain scan
* ``attach``          join a small per-group table; Spark checks its size
* ``attach_row``      join a one-row global aggregate
* ``salted_pair``     equi-join whose hot keys are split on both sides
* ``flag_smallest``   exact "n smallest per group" without one task per group
* ``exact_quantiles`` exact quantiles without a whole group in one buffer
* ``global_index``    dense 0-based position in a total order
* ``rank_within``     rank inside each key, however large one key is
* ``spread_cells``    a numbered run of rows for each row, made by many tasks
* ``dealt``           tasks of bounded size before a group or join by narrow rows
* ``beside``          the other side of a join in such tasks, broadcast only when it is small
* ``halo_blocks``     bounded square blocks of a grid plus a border
* ``connected``       components of a graph by labels and shortcuts
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

_LOCAL_ROOT = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A private temporary folder is used only by a local session that names none.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if sc.applicationId not in _LOCAL_ROOT:
        path = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, path, True)
        _LOCAL_ROOT[sc.applicationId] = path
    return _LOCAL_ROOT[sc.applicationId]


def work_folder(spark: SparkSession) -> str:
    """The application's own folder below ``checkpoint_root``."""
    return f"{checkpoint_root(spark)}/slideloom-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> bool:
    """Delete all tables this application has settled, when no frame made from them is read any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(work_folder(spark))
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result has no lineage, survives lost executors, and carries a real file
    size, so Spark's own broadcast threshold decides how later joins use it.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# plan nodes whose work is worth keeping when a frame is read more than once
_COSTLY = re.compile(r"(?m)^[\s:+|-]*(Aggregate|Join|Window|Generate|Sort|GlobalLimit|Union|Repartition|MapInPandas|FlatMap|ArrowEval|BatchEval|SerializeFromObject)")


def reread(df: DataFrame) -> DataFrame:
    """``df`` itself when it is a plain scan with projections and filters, else its settled copy.

    For inputs an operator reads twice: a scan prunes columns and is cheap to repeat,
    a join or aggregation is not.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return settle(df) if _COSTLY.search(plan) else df


def attach(df: DataFrame, small: DataFrame, on, how="left") -> DataFrame:
    """Join per-group values onto ``df``.

    ``small`` is settled first: it is broadcast only if its written size is under
    ``spark.sql.autoBroadcastJoinThreshold``; otherwise the join shuffles and AQE
    splits skewed partitions of ``df``.
    """
    return df.join(settle(small), on, how)


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a global aggregate, which is one row by construction, to every row."""
    one = F.lit(1)
    return df.withColumn("_one", one).join(F.broadcast(row.withColumn("_one", one)), "_one").drop("_one")


def hash32(ids, seed=0, scheme="xx"):
    """Sampling key in [0, 2**32). ``mul`` is plain arithmetic on an integer id."""
    cols = [F.col(c) if isinstance(c, str) else c for c in (ids if isinstance(ids, (list, tuple)) else [ids])]
    if scheme == "mul":
        # products of the halves stay inside 64 bits for every id
        word, half = F.lit(4294967296), F.lit(65536)
        i = F.pmod(cols[0].cast("long"), word)
        high = F.pmod(F.shiftright(i, 16) * F.lit(2654435761 % 65536), half) * half
        return F.pmod(F.pmod(i, half) * F.lit(2654435761) + high + F.lit(int(seed)), word)
    if scheme != "xx":
        raise ValueError(f"unknown hash scheme {scheme!r}")
    return F.pmod(F.xxhash64(*cols, F.lit(int(seed))), F.lit(4294967296))


def salted_pair(left, right, keys, left_id, right_id, hot_rows=200_000, broadcast_rows=500_000):
    """Inner equi-join of two frames that may have been expanded; every pair appears once.

    One pre-aggregated pass counts rows per key and in all. A side of at most
    ``broadcast_rows`` rows is broadcast. Otherwise both are shuffled and keys with
    more than ``hot_rows`` rows on a side are cut into pieces on that side, the other
    side's rows being repeated for each piece. Spark's own size estimate is not used
    here because it ignores how much an explode grew a side.
    """
    n, side = F.col("_n"), F.col("_s")
    # one row per hot key and one (NULL key) for all others together
    tally = settle(
        left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_s", F.lit(0))
        .unionByName(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_s", F.lit(1)))
        .groupBy(*keys)
        .agg(F.sum(F.when(side == 0, n)).alias("_l"), F.sum(F.when(side == 1, n)).alias("_r"))
        .fillna(0, ["_l", "_r"])
        .groupBy(F.when(F.greatest("_l", "_r") > hot_rows, F.struct(*keys)).alias("_k"))
        .agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    )
    hot = tally.where(F.col("_k").isNotNull()).select(
        "_k.*", *[F.greatest(F.ceil(F.col(c) / hot_rows), F.lit(1)).alias(o) for c, o in (("_l", "_ls"), ("_r", "_rs"))]
    )
    total = tally.agg(F.sum("_l").alias("l"), F.sum("_r").alias("r")).first()
    rows = {k: v or 0 for k, v in total.asDict().items()}
    if min(rows.values()) <= broadcast_rows:
        return left.join(F.broadcast(right), keys) if rows["r"] <= rows["l"] else F.broadcast(left).join(right, keys)
    if hot.isEmpty():
        return left.hint("merge").join(right, keys)
    one = F.lit(1).cast("long")
    lh = left.join(hot, keys, "left").withColumns({"_ls": F.coalesce("_ls", one), "_rs": F.coalesce("_rs", one)})
    rh = right.join(hot, keys, "left").withColumns({"_ls": F.coalesce("_ls", one), "_rs": F.coalesce("_rs", one)})
    lh = (
        lh.withColumn("_lp", F.pmod(F.xxhash64(left_id), F.col("_ls")))
        .withColumn("_rp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rs") - 1)))
        .drop("_ls", "_rs")
    )
    rh = (
        rh.withColumn("_rp", F.pmod(F.xxhash64(right_id), F.col("_rs")))
        .withColumn("_lp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_ls") - 1)))
        .drop("_ls", "_rs")
    )
    return lh.hint("merge").join(rh, [*keys, "_lp", "_rp"]).drop("_lp", "_rp")


def _cut(counts, groups, budget, value):
    """Per group: the first ``value`` at which the running count reaches ``n``, and how many it must give."""
    w = Window.partitionBy(*groups).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        counts.withColumn("_cum", F.sum("_n").over(w)).join(budget, groups)
        .where((F.col("_cum") >= F.col("_want")) & (F.col("_cum") - F.col("_n") < F.col("_want")))
        .select(*groups, F.col(value), (F.col("_want") - F.col("_cum") + F.col("_n")).alias("_want"))
    )


def flag_smallest(df, groups, hash_col, ties, budget, flag="chosen", small_rows=500_000):
    """Mark exactly the ``n`` rows per group with the smallest (``hash_col``, ``ties``).

    ``budget`` holds one row per group: the group columns and ``n``. Rows are counted
    by the upper 16 bits of the hash, then by the whole hash inside the one bucket at
    the cut; only rows with exactly the cut's hash are ranked. The passes before the
    last read only keys, and the wide rows are read once and never shuffled. Up to
    ``small_rows`` rows in all are simply ranked.
    """
    groups = list(groups)
    if not groups:
        groups = ["_g"]
        df = df.withColumn("_g", F.lit(0))
        budget = budget.withColumn("_g", F.lit(0))
    h, one = F.col(hash_col), F.count(F.lit(1)).alias("_n")
    narrow = reread(df.select(*groups, hash_col, *ties).withColumn("_b", F.shiftright(h, 16)))
    if narrow.limit(small_rows + 1).count() <= small_rows:
        rank = F.row_number().over(Window.partitionBy(*groups).orderBy(hash_col, *ties))
        picked = settle(
            narrow.join(budget.select(*groups, F.col("n").alias("_want")), groups).withColumn("_r", rank)
            .where(F.col("_r") <= F.col("_want")).select(*groups, *ties, F.lit(True).alias(flag))
        )
        return df.join(picked, [*groups, *ties], "left").withColumn(flag, F.coalesce(flag, F.lit(False))).drop("_g")
    sizes = settle(narrow.groupBy(*groups, "_b").agg(one))
    want = settle(
        budget.select(*groups, F.col("n").cast("long").alias("_want"))
        .join(sizes.groupBy(*groups).agg(F.sum("_n").alias("_all")), groups)
    )
    part = F.col("_want") < F.col("_all")
    bucket = settle(_cut(sizes, groups, want.where(part & (F.col("_want") > 0)).drop("_all"), "_b"))
    at = narrow.join(bucket, [*groups, "_b"]).groupBy(*groups, "_want", hash_col).agg(one)
    edge = settle(_cut(at.drop("_want"), groups, bucket.drop("_b"), hash_col))
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*ties))
    last = settle(
        narrow.drop("_b").join(edge, [*groups, hash_col]).withColumn("_r", rank)
        .where(F.col("_r") <= F.col("_want")).select(*groups, *ties, F.lit(True).alias("_last"))
    )
    limit = settle(want.join(edge.select(*groups, F.col(hash_col).alias("_edge")), groups, "left").select(
        *groups, F.when(~part, F.lit(2 ** 32)).otherwise(F.coalesce("_edge", F.lit(-1))).alias("_edge")
    ))
    return df.join(limit, groups, "left").join(last, [*groups, *ties], "left").withColumn(
        flag, F.coalesce(h < F.col("_edge"), F.lit(False)) | F.coalesce("_last", F.lit(False))
    ).drop("_edge", "_last", "_g")


def take_smallest(df, groups, hash_col, ties, budget):
    return flag_smallest(df, groups, hash_col, ties, budget, "_keep").where("_keep").drop("_keep")


def exact_quantiles(df, groups, value, probs, names=None, accuracy=10_000):
    """Exact linearly interpolated quantiles per group, one column per probability.

    A bounded sketch brackets each quantile; the rows inside the brackets are then
    counted by value and ranked. The sketch's rank error is at most n/accuracy, so
    a bracket of a few times that width always holds the wanted ranks; a miss
    raises an error instead of giving a wrong value. Groups of at most 2*accuracy
    rows, where the width would be under two ranks, are ranked whole.
    """
    names = names or [f"q{i}" for i in range(len(probs))]
    groups = list(groups)
    drop_g = not groups
    if drop_g:
        groups = ["_g"]
        df = df.withColumn("_g", F.lit(0))
    v = F.col(value).cast("double")
    df = reread(df.where(v.isNotNull()).select(*groups, v.alias("_v")))
    pad = 4.0 / accuracy
    aggs = [F.count(F.lit(1)).alias("_n")]
    few = F.count(F.lit(1)) <= 2 * accuracy
    for i, p in enumerate(probs):
        lo, hi = p - pad, p + pad
        near_lo = F.min("_v") if lo <= 0 else F.percentile_approx("_v", lo, accuracy)
        near_hi = F.max("_v") if hi >= 1 else F.percentile_approx("_v", hi, accuracy)
        aggs.append(F.when(few, F.min("_v")).otherwise(near_lo).alias(f"_lo{i}"))
        aggs.append(F.when(few, F.max("_v")).otherwise(near_hi).alias(f"_hi{i}"))
    brackets = settle(df.groupBy(*groups).agg(*aggs))
    # rows under a bracket count towards rank but keep no value; rows over it are dropped
    parts = F.filter(
        F.array(*[
            F.when(
                F.col("_v") <= F.col(f"_hi{i}"),
                F.struct(F.lit(i).alias("i"), F.when(F.col("_v") >= F.col(f"_lo{i}"), F.col("_v")).alias("v")),
            )
            for i in range(len(probs))
        ]),
        lambda t: t.isNotNull(),
    )
    inside = (
        df.join(brackets, groups).select(*groups, "_n", F.explode(parts).alias("_t"))
        .groupBy(*groups, "_n", F.col("_t.i").alias("_i"), F.col("_t.v").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    )
    w = Window.partitionBy(*groups, "_i").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.get(F.array(*[F.lit(float(p)) for p in probs]), F.col("_i")) * (F.col("_n") - 1)
    lo_rank = F.floor(at)
    hi_rank = F.least(lo_rank + 1, F.col("_n") - 1)
    known = F.col("_v").isNotNull()
    pick = inside.withColumn("_cum", F.sum("_c").over(w)).groupBy(*groups, "_i").agg(
        F.min(F.when(known & (F.col("_cum") > lo_rank), F.col("_v"))).alias("_a"),
        F.min(F.when(known & (F.col("_cum") > hi_rank), F.col("_v"))).alias("_z"),
        F.max(F.when(~known, F.col("_cum") > lo_rank)).alias("_miss"),
        F.max(at - lo_rank).alias("_f"),
    )
    val = F.when(
        F.col("_a").isNull() | F.col("_z").isNull() | F.coalesce("_miss", F.lit(False)),
        F.raise_error(F.lit("quantile bracket missed; raise accuracy")).cast("double"),
    ).otherwise(F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_f"))
    out = pick.groupBy(*groups).agg(
        *[F.max(F.when(F.col("_i") == i, val)).alias(nm) for i, nm in enumerate(names)]
    )
    return out.drop("_g") if drop_g else out


def global_index(df, order, name="pos"):
    """Dense 0-based position in a total order: range sort plus per-partition offsets."""
    tagged = settle(
        df.orderBy(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_mid", 33).cast("int"))
    )
    # one row per sort partition: the ordered window stays small
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offs = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off")
    )
    local = F.col("_mid") - F.shiftleft(F.col("_part").cast("long"), 33)
    return attach(tagged, offs, "_part").withColumn(name, local + F.col("_off")).drop("_mid", "_part", "_off")


def rank_within(df, keys, order, name="pos", hot_rows=2_000_000):
    """0-based rank of every row inside its key.

    Keys with more than ``hot_rows`` rows are ranked by a range sort over all of them
    (which splits a key over tasks), the others by a window.
    """
    keys = list(keys)
    hot = settle(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(*keys))
    ranked = lambda d: d.withColumn(
        name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long")
    )
    if hot.isEmpty():
        return ranked(df)
    big = global_index(df.join(hot, keys, "left_semi"), [*keys, *order], name)
    first = big.groupBy(*keys).agg(F.min(name).alias("_first"))
    big = attach(big, first, keys).withColumn(name, F.col(name) - F.col("_first"))
    return ranked(df.join(hot, keys, "left_anti")).unionByName(big.select(*df.columns, name))


def spread_cells(df, count, name="cell", piece=250_000):
    """Every row of ``df`` repeated with ``name`` = 0 .. ``count`` - 1 (a column).

    Runs are cut into pieces of at most ``piece`` rows before any row is made, and pieces are dealt over tasks
    by hash, as many partitions as pieces: so a row with a large count is made by many tasks.
    """
    cut = settle(df.withColumn("_n", F.coalesce(F.col(count) if isinstance(count, str) else count, F.lit(0)).cast("long")).where("_n > 0")
                 .withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / piece)))))
    pieces = cut.count()
    if pieces > 1:
        cut = cut.repartition(min(pieces, 100_000), F.xxhash64(*[c for c in cut.columns if c != "_n"]))
    first = F.col("_p") * piece
    return cut.withColumn(name, F.explode(F.sequence(first, F.least(first + piece, F.col("_n")) - 1))).drop("_n", "_p")


def halo_blocks(df, row, col, block, halo):
    """Send each grid row to its block and to blocks whose border of ``halo`` holds it.

    With unique positions a block gets at most (block + 2*halo)**2 rows.
    """
    def span(c):
        return F.sequence(F.floor((F.col(c) - halo) / block), F.floor((F.col(c) + halo) / block))

    return df.withColumn("_br", F.explode(span(row))).withColumn("_bc", F.explode(span(col)))


def connected(edges):
    """node and root (the smallest node reachable) of every node of ``edges`` (a, b); nodes may be of any ordered type.

    Every node takes the smallest label next to it and the label of its own label, until nothing changes; shortcuts make long
    paths cost a logarithm of rounds. Each round is a written table; only one yes or no reaches the driver.
    """
    both = settle(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "root"), "b").select(F.col("a").alias("node"), "root")
        jump = labels.select("node", F.col("root").alias("_r")).join(labels.select(F.col("node").alias("_r"), "root"), "_r")
        least = seen.unionByName(jump.select("node", "root")).groupBy("node").agg(F.min("root").alias("_low"))
        step = settle(labels.join(least, "node").select("node", F.least("root", "_low").alias("root"), (F.col("_low") < F.col("root")).alias("_moved")))
        labels = step.drop("_moved")
        if step.where("_moved").isEmpty():
            return labels


def dealt(df: DataFrame, keys, rows: int, rows_per_task=400_000) -> DataFrame:
    """``df``, of about ``rows`` rows, dealt by its keys into tasks of bounded size.

    Adaptive execution merges shuffled parts by their compressed bytes, of which narrow rows need few: a task then groups or
    sorts millions of rows. It leaves a stated number of parts alone. Small tables stay as they are.
    """
    if rows <= rows_per_task:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // rows_per_task)), *keys)


def beside(df: DataFrame, keys, rows: int, own_rows: int, rows_per_task=400_000, broadcast_rows=500_000) -> DataFrame:
    """``df``, of ``own_rows`` rows, to be joined by ``keys`` onto a frame ``dealt`` for ``rows`` rows.

    Up to ``broadcast_rows`` rows Spark may broadcast it. More are dealt alike and merged: Spark's size estimate ignores
    how much an explode grew a side, and a broadcast table is held whole by every task.
    """
    return df if own_rows <= broadcast_rows else dealt(df, keys, rows, rows_per_task).hint("merge")
