"""Grid and mask operators: neighbourhoods, smoothing, components and patch fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window, functions as F, types as T

from ..functions.arrays import all_finite, center_weight, disk_offsets, finite_or_extreme
from ..plans.scale import attach, connected, halo_blocks, settle, spread_cells


def densify_grid(tokens, slides, dim, tile=16, feat="feat"):
    """Every cell of the (height // tile) x (width // tile) grid; zeros where no token, outside tokens dropped.

    Cells are numbered and made in pieces, so one slide is made by many tasks.
    """
    across = F.floor(F.col("width") / tile)
    sizes = slides.select("sample", across.alias("_w"), (F.floor(F.col("height") / tile) * across).alias("_n"))
    cells = spread_cells(sizes.where("_w > 0").select("sample", "_w", F.col("_n").alias("_all")), "_all", "_i")
    grid = cells.select("sample", F.floor(F.col("_i") / F.col("_w")).alias("row"), (F.col("_i") % F.col("_w")).alias("col"))
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return grid.join(tokens.select("sample", "row", "col", feat), ["sample", "row", "col"], "left").withColumn(
        feat, F.coalesce(F.col(feat), zero)
    )


def apply_mask(df, mask, col=None, fill=-1, on=("sample", "row", "col")):
    """Only masked-in rows; with ``col`` all rows stay and that column becomes ``fill`` outside."""
    m = mask.select(*on).distinct()
    if col is None:
        return df.join(m, list(on), "left_semi")
    return df.join(m.withColumn("_in", F.lit(True)), list(on), "left").withColumn(
        col, F.when(F.col("_in"), F.col(col)).otherwise(F.lit(fill))
    ).drop("_in")


def binarise_mask(px, channels=("r", "g", "b"), out="mask"):
    """True where any of the channels is above zero."""
    top = F.greatest(*channels) if len(channels) > 1 else F.col(channels[0])
    return px.withColumn(out, top > 0)


def mask_reduce(mask, factor, col="mask"):
    """Blocks whose mean is above one half."""
    return mask.groupBy(
        "sample", F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")
    ).agg((F.avg(F.col(col).cast("double")) > 0.5).alias(col))


def mask_union(a, b, on=("sample", "row", "col"), flag="flag"):
    """Keep mask: positions flagged by neither side. A position missing from one side counts as unflagged."""
    both = a.select(*on, F.col(flag).alias("_f")).unionByName(b.select(*on, F.col(flag).alias("_f")))
    return both.groupBy(*on).agg((~F.bool_or("_f")).alias("keep"))


def rescued_tiles(before, after, on=("sample", "row", "col"), flag="flag"):
    """Positions flagged before a step and not after it."""
    return before.where(F.col(flag)).select(*on).join(
        after.where(~F.col(flag)).select(*on), list(on), "left_semi"
    )


def upsample_mask(mask, tile=16, cols=("mask",)):
    """Tile mask to pixel mask, nearest neighbour."""
    seq = F.sequence(F.lit(0), F.lit(tile - 1))
    return mask.withColumn("_i", F.explode(seq)).withColumn("_j", F.explode(seq)).select(
        "sample", (F.col("row") * tile + F.col("_i")).alias("y"), (F.col("col") * tile + F.col("_j")).alias("x"), *cols
    )


def erode_mask(mask, slides, size):
    """Masked-in cells whose whole (2 size + 1)^2 window, cut at the slide edge, is masked in.

    ``mask`` lists true cells. Two counting passes, along rows then columns, each
    inside one grid line.
    """
    d = attach(mask.select("sample", "row", "col"), slides.select("sample", "grid_h", "grid_w"), "sample", "inner")

    def full(df, along, across, extent):
        w = Window.partitionBy("sample", across).orderBy(along).rangeBetween(-size, size)
        want = F.least(F.col(along) + size, F.col(extent) - 1) - F.greatest(F.col(along) - size, F.lit(0)) + 1
        return df.withColumn("_k", F.count(F.lit(1)).over(w)).where(F.col("_k") == want).drop("_k")

    return full(full(d, "col", "row", "grid_w"), "row", "col", "grid_h").select("sample", "row", "col")


def _focal(grid, slides, weights, value, block, largest=False):
    """Windowed weighted mean (or maximum) with mirrored borders, one bounded block at a time.

    A window of even size reaches one cell further up and left. Blocks of vectors
    are smaller, and vectors are worked on 128 components at a time.
    """
    half = len(weights) // 2
    field = grid.schema[value].dataType
    vector = isinstance(field, T.ArrayType)
    block = max(min(block, 64) if vector else block, 4 * half, 1)
    out_t = "array<double>" if vector else "double"
    d = attach(grid.select("sample", "row", "col", value), slides.select("sample", "grid_h", "grid_w"), "sample", "inner")
    # mirror cells within ``half`` of an edge so that blocks need no knowledge of the slide
    def mirrored(c, extent):
        x = F.col(c)
        return F.filter(
            F.array(x, F.when(x < half, -1 - x), F.when(x >= F.col(extent) - half, 2 * F.col(extent) - 1 - x)),
            lambda v: v.isNotNull(),
        )

    d = d.withColumn("_in", F.lit(True))
    d = d.withColumn("_m", F.explode(mirrored("row", "grid_h"))).withColumn("_in", F.col("_in") & (F.col("_m") == F.col("row")))
    d = d.withColumn("row", F.col("_m")).drop("_m")
    d = d.withColumn("_m", F.explode(mirrored("col", "grid_w"))).withColumn("_in", F.col("_in") & (F.col("_m") == F.col("col")))
    d = d.withColumn("col", F.col("_m")).drop("_m", "grid_h", "grid_w")
    d = halo_blocks(d, "row", "col", block, half)
    w = [float(x) for x in weights]

    def smooth(pdf):
        import numpy as np
        import pandas as pd

        br, bc = int(pdf["_br"].iloc[0]), int(pdf["_bc"].iloc[0])
        side = block + 2 * half
        r = pdf["row"].to_numpy() - (br * block - half)
        c = pdf["col"].to_numpy() - (bc * block - half)
        if vector:
            given = pdf[value].notna().to_numpy()
            lists = [np.asarray(x, dtype=float) for x in pdf[value][given]]
            v = np.full((len(pdf), len(lists[0]) if lists else 0), np.nan)
            if lists:
                v[given] = lists
        else:
            given = np.ones(len(pdf), bool)
            v = pdf[value].to_numpy(dtype=float)[:, None]
        ok = given & np.isfinite(v).all(axis=1)
        core = pdf["_in"].to_numpy() & (r >= half) & (r < half + block) & (c >= half) & (c < half + block)

        def windows(x, empty):
            plane = np.full((side, side, x.shape[1]), empty)
            plane[r[ok], c[ok]] = x[ok]
            if largest:
                rows = np.maximum.reduce([plane[i:i + block] for i in range(len(w))])
                full = np.maximum.reduce([rows[:, i:i + block] for i in range(len(w))])
            else:
                rows = sum(w[i] * plane[i:i + block] for i in range(len(w)))
                full = sum(w[i] * rows[:, i:i + block] for i in range(len(w)))
            return full[r[core] - half, c[core] - half]

        parts = [windows(v[:, a:a + 128], -np.inf if largest else 0.0) for a in range(0, v.shape[1], 128)]
        mean = np.concatenate(parts, 1) if parts else np.zeros((int(core.sum()), 0))
        if not largest:
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = mean / windows(np.ones((len(v), 1)), 0.0)
        mean[~ok[core]] = np.nan
        res = pd.DataFrame({"sample": pdf["sample"][core], "row": pdf["row"][core], "col": pdf["col"][core]})
        present = ok[core]
        if vector:
            res[value] = pd.Series([m.tolist() if p else None for m, p in zip(mean, present)], index=res.index, dtype=object)
        else:
            res[value] = mean[:, 0]
        return res

    kind = grid.schema["sample"].dataType.simpleString()
    return d.groupBy("sample", "_br", "_bc").applyInPandas(
        smooth, f"sample {kind}, row long, col long, {value} {out_t}"
    )


def focal_mean(grid, slides, size, value="value", block=128):
    """size x size moving mean, mirrored borders; an even window reaches one cell further up and left.

    Missing cells (NULL, NaN or absent) take no weight and stay missing.
    """
    return _focal(grid, slides, [1.0 / size] * size, value, block)


def focal_max(grid, slides, size, value="value", block=128):
    """Moving maximum over size x size cells (the next odd size, if even), mirrored borders; missing cells are passed over and stay missing."""
    return _focal(grid, slides, [1.0] * (size + 1 - size % 2), value, block, largest=True)


def focal_gaussian(grid, slides, size, value="value", block=128):
    """Gaussian smoothing with sigma = size / 4, cut at ceil(4 sigma) cells."""
    import math

    sigma = size / 4.0
    half = math.ceil(sigma * 4.0)
    w = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-half, half + 1)]
    s = sum(w)
    return _focal(grid, slides, [x / s for x in w], value, block)


def sample_at_points(spots, grid, slides, size, value="feat", kernel="gaussian", block=64):
    """Smooth the grid, then look up the value at each spot."""
    smooth = focal_gaussian if kernel == "gaussian" else focal_mean
    return spots.join(smooth(grid, slides, size, value, block), ["sample", "row", "col"])


def disk_tokens(spots, tokens, r, spot="spot", feat="feat", block=64):
    """Feature vectors of all tokens within r cells of each spot, in row-major order.

    A spot whose disk is not wholly present (grid border) is left out; the others of
    its sample stay. Every list has the fixed disk size. Tokens go to blocks of cells with a
    border of r, so each vector is shuffled little more than once; lists are made inside the blocks, and sent on
    some spots at a time, however many a block holds.
    """
    import math

    reach = math.floor(r)
    disk = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if i * i + j * j <= r * r]
    block = max(block, 4 * reach, 1)
    at = lambda c: F.col(c).cast("long").alias(c)
    placed = F.col("row").isNotNull() & F.col("col").isNotNull()
    cells = halo_blocks(tokens.where(placed).select("sample", at("row"), at("col"), feat), "row", "col", block, reach)
    asked = spots.where(placed).select("sample", spot, at("row"), at("col")).withColumns(
        {"_br": F.floor(F.col("row") / block), "_bc": F.floor(F.col("col") / block)}
    )

    kinds = {c: d.schema[c].dataType.simpleString() for d, c in ((spots, "sample"), (spots, spot), (tokens, feat))}
    keys = ["sample", "_br", "_bc"]
    kept = [*keys, "row", "col"]
    both = cells.select(*kept, F.lit(None).cast(kinds[spot]).alias("_spot"), F.lit(False).alias("_asks"), F.col(feat).alias("_feat")).unionByName(
        asked.select(*kept, F.col(spot).alias("_spot"), F.lit(True).alias("_asks"), F.lit(None).cast(kinds[feat]).alias("_feat")))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.filter(pc.invert(b.column("_asks"))), b.filter(b.column("_asks"))) for b in batches]
        cells, asked = (pa.Table.from_batches([p[i].drop_columns(["_spot" if i == 0 else "_feat"]) for p in parts]) for i in (0, 1))
        if not len(cells) or not len(asked):
            return
        vectors = cells.column("_feat").combine_chunks()
        top, left = cells.column("_br")[0].as_py() * block - reach, cells.column("_bc")[0].as_py() * block - reach
        side = block + 2 * reach
        place = np.full((side, side), -1, np.int64)
        place[cells.column("row").to_numpy() - top, cells.column("col").to_numpy() - left] = np.arange(len(cells))
        i, j = np.array(disk).T
        # about 16 MB of values a batch
        step = max(1, 2_000_000 // (len(disk) * max(1, -(-len(vectors.flatten()) // len(vectors)))))
        for s in range(0, len(asked), step):
            some = asked.slice(s, step).combine_chunks()
            r0, c0 = some.column("row").to_numpy() - top, some.column("col").to_numpy() - left
            got = place[r0[:, None] + i, c0[:, None] + j]
            keep = np.flatnonzero((got >= 0).all(axis=1))
            if not len(keep):
                continue
            ends = pa.array(np.arange(len(keep) + 1, dtype=np.int32) * len(disk))
            lists = pa.ListArray.from_arrays(ends, vectors.take(pa.array(got[keep].ravel())))
            rows = some.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([rows.column("sample").combine_chunks(), rows.column("_spot").combine_chunks(), lists], names=["sample", spot, "tokens"])

    return both.groupBy(*keys).applyInArrow(gather, f"sample {kinds['sample']}, {spot} {kinds[spot]}, tokens array<{kinds[feat]}>")


def disk_report(spots, tokenised, spot="spot"):
    """Spots per sample, and how many lost their place at the border."""
    d = spots.join(tokenised.select("sample", spot).withColumn("_k", F.lit(1)), ["sample", spot], "left")
    return d.groupBy("sample").agg(
        F.count(F.lit(1)).alias("n_spots"), F.count(F.when(F.col("_k").isNull(), 1)).alias("n_dropped")
    )


def disk_crop(spots, tokens, r, dim, spot="spot", feat="feat"):
    """The whole (2r+1)^2 window of each spot, zero vectors outside the disk; long form (di, dj)."""
    from ..functions.arrays import square_offsets

    want = spots.select("sample", spot, F.col("row").alias("_r"), F.col("col").alias("_c"), F.explode(square_offsets(r)).alias("_o")).select(
        "sample", spot, F.col("_o.di").alias("di"), F.col("_o.dj").alias("dj"),
        (F.col("_r") + F.col("_o.di")).cast("long").alias("row"), (F.col("_c") + F.col("_o.dj")).cast("long").alias("col"),
    )
    d = want.hint("merge").join(tokens.select("sample", F.col("row").cast("long"), F.col("col").cast("long"), feat), ["sample", "row", "col"])
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    inside = F.col("di") * F.col("di") + F.col("dj") * F.col("dj") <= r * r
    return d.withColumn(feat, F.when(inside, F.col(feat)).otherwise(zero)).select("sample", spot, "di", "dj", feat)


def finite_examples(ex, tokens="tokens"):
    """Examples whose every token value is finite."""
    return ex.where(all_finite(tokens, isinstance(ex.schema[tokens].dataType.elementType, T.ArrayType)))


def nan_to_num(df, col):
    """NaN to 0 and infinities to the largest finite value, in a number or an array column."""
    if isinstance(df.schema[col].dataType, T.ArrayType):
        return df.withColumn(col, F.transform(col, finite_or_extreme))
    return df.withColumn(col, finite_or_extreme(F.col(col)))


def _prune_by_border(cells, min_size, block):
    """``remove_small_components`` for small ``min_size``: one shuffle, no iteration over the table.

    A smaller group lies within ``min_size`` cells of each of its members, so a block plus that border decides its own
    cells exactly. Inside a block labels spread ``min_size`` times; a label still next to a different one belongs to a
    larger group.
    """
    d = halo_blocks(cells, "row", "col", block, min_size)

    def prune(pdf):
        import numpy as np

        pdf = pdf.drop_duplicates(["row", "col"])
        side = block + 2 * min_size
        r0 = int(pdf["_br"].iloc[0]) * block
        c0 = int(pdf["_bc"].iloc[0]) * block
        r = pdf["row"].to_numpy() - (r0 - min_size)
        c = pdf["col"].to_numpy() - (c0 - min_size)
        big = np.iinfo(np.int64).max
        lab = np.full((side + 2, side + 2), big)
        on = np.zeros(lab.shape, bool)
        on[r + 1, c + 1] = True
        lab[r + 1, c + 1] = np.arange(len(r))
        shifts = [(a, b) for a in (0, 1, 2) for b in (0, 1, 2)]
        for _ in range(min_size):
            near = np.minimum.reduce([lab[a:a + side, b:b + side] for a, b in shifts])
            lab[1:-1, 1:-1] = np.where(on[1:-1, 1:-1], near, big)
        mixed = np.zeros(len(r), bool)
        mine = lab[r + 1, c + 1]
        for a, b in shifts:
            other = lab[r + a, c + b]
            mixed[mine[(other != big) & (other != mine)]] = True
        size = np.bincount(mine, minlength=len(r))
        keep = (size[mine] >= min_size) | mixed[mine]
        core = (r >= min_size) & (r < min_size + block) & (c >= min_size) & (c < min_size + block)
        return pdf.loc[keep & core, ["sample", "row", "col"]]

    kind = cells.schema["sample"].dataType.simpleString()
    return d.groupBy("sample", "_br", "_bc").applyInPandas(prune, f"sample {kind}, row long, col long")


def remove_small_components(mask, min_size=10, block=256):
    """Drop 8-connected groups of fewer than ``min_size`` cells; ``mask`` lists true cells.

    Up to a quarter of ``block``, a border of ``min_size`` cells around each block decides everything in one pass. Beyond,
    blocks of ``block`` x ``block`` cells are labelled alone, and pieces of groups that meet at a block border
    are joined as a graph of pieces: edges between two pieces that are large enough by themselves decide nothing and are
    left out. So a task holds at most (1.5 * ``block``) ** 2 cells whatever ``min_size``. Repeated cells count and come
    out once; cells without a row or column are dropped.
    """
    d = mask.select("sample", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).dropna(subset=["row", "col"])
    if 4 * min_size <= block:
        return _prune_by_border(d, min_size, block)
    d = d.withColumns({"_br": F.floor(F.col("row") / block), "_bc": F.floor(F.col("col") / block)})

    def label(pdf):
        import numpy as np

        pdf = pdf.drop_duplicates(["row", "col"]).sort_values(["row", "col"])
        r = pdf["row"].to_numpy() - int(pdf["_br"].iloc[0]) * block
        c = pdf["col"].to_numpy() - int(pdf["_bc"].iloc[0]) * block
        at = np.full((block + 1, block + 2), -1)
        at[r, c + 1] = np.arange(len(r))
        near = [at[r + a, c + 1 + b] for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))]
        u = np.concatenate([np.nonzero(n >= 0)[0] for n in near])
        v = np.concatenate([n[n >= 0] for n in near])
        root = np.arange(len(r))
        while (apart := root[u] != root[v]).any():
            x, y = root[u[apart]], root[v[apart]]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root != root[root]).any():
                root = root[root]
        size = np.bincount(root, minlength=len(r))[root]
        # a piece is named by its first cell
        return pdf[["sample", "row", "col"]].assign(p_row=pdf["row"].to_numpy()[root], p_col=pdf["col"].to_numpy()[root], size=size)

    kind = mask.schema["sample"].dataType.simpleString()
    cells = settle(d.groupBy("sample", "_br", "_bc").applyInPandas(
        label, f"sample {kind}, row long, col long, p_row long, p_col long, size long"
    ).select("sample", "row", "col", F.struct("sample", "p_row", "p_col").alias("piece"), "size"))
    rest = cells.where(F.col("size") < min_size)
    # cells next to a block border, and their neighbours beyond it
    inner = lambda c: F.pmod(F.col(c), F.lit(block)).between(1, block - 2)
    rim = settle(cells.where(~(inner("row") & inner("col"))))
    steps = F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    ask = rim.where(F.col("size") < min_size).select("sample", "row", "col", F.col("piece").alias("a"), F.explode(steps).alias("s"))
    ask = ask.select("sample", (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"), "a")
    edges = settle(ask.join(rim.withColumnRenamed("piece", "b"), ["sample", "row", "col"]).where("a != b").select("a", "b").distinct())
    # sums over whole groups of pieces; each piece has one size
    sizes = rim.groupBy(F.col("piece").alias("node")).agg(F.first("size").alias("size"))
    grouped = settle(connected(edges).join(sizes, "node"))
    large = grouped.groupBy("root").agg(F.sum("size").alias("n")).where(F.col("n") >= min_size)
    saved = settle(grouped.join(large, "root").select(F.col("node").alias("piece")))
    kept = cells.where(F.col("size") >= min_size).unionByName(rest.join(saved, "piece", "left_semi").select(*cells.columns))
    return kept.select("sample", "row", "col")


def patch_expand_join(patches, tile=16, cls="cls", local="local"):
    """Patch to its token cells: (sample, row, col, i, j, feat = cls ++ local[i][j])."""
    d = patches.select("sample", "patch_id", "top", "left", cls, F.posexplode(local).alias("i", "_row"))
    d = d.select("sample", "patch_id", "top", "left", cls, "i", F.posexplode("_row").alias("j", "_v"))
    return d.select(
        "sample", "patch_id",
        (F.floor(F.col("top") / tile) + F.col("i")).alias("row"),
        (F.floor(F.col("left") / tile) + F.col("j")).alias("col"),
        "i", "j", F.concat(F.col(cls), F.col("_v")).alias("feat"),
    )


def overlap_average(patch_tokens, size=14, sigma=0.5, crop=0, feat="feat"):
    """Centre-weighted mean of all patches covering a token, shifted by ``crop`` cells.

    The vector sums run in the JVM with partial aggregation before the shuffle.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    d = patch_tokens.withColumn("_w", center_weight("i", "j", size, sigma)).withColumn(
        "_v", array_to_vector(F.transform(feat, lambda x: x.cast("double")))
    )
    return d.groupBy("sample", "row", "col").agg(
        vector_to_array(Summarizer.mean(F.col("_v"), F.col("_w"))).alias(feat)
    ).select("sample", (F.col("row") - crop).alias("row"), (F.col("col") - crop).alias("col"), feat)


def fuse_patches(patches, slides, mask=None, size=14, tile=16, crop=7, sigma=0.5, block=56):
    """Patches to fused tokens on the slide grid: centre-weighted overlap mean, crop, mask.

    Patches go whole to each block of tokens they touch (about a quarter more rows),
    so token vectors are never shuffled; a block covers ``block`` x ``block`` tokens.
    """
    block = max(block, size)

    def span(c):
        top = F.floor(F.col(c) / tile)
        return F.sequence(F.floor(top / block), F.floor((top + size - 1) / block))

    d = patches.withColumn("_br", F.explode(span("top"))).withColumn("_bc", F.explode(span("left"))).withColumn(
        "local", F.flatten("local")
    )

    def fuse(pdf):
        import numpy as np
        import pandas as pd

        br, bc = int(pdf["_br"].iloc[0]) * block, int(pdf["_bc"].iloc[0]) * block
        axis = np.linspace(-1, 1, size)
        wt = np.exp(-(axis[:, None] ** 2 + axis[None, :] ** 2) / (2 * sigma * sigma))
        wt /= wt.max()
        acc = norm = None
        for top, left, cls, loc in zip(pdf["top"], pdf["left"], pdf["cls"], pdf["local"]):
            loc = np.stack([np.asarray(v, dtype=float) for v in loc]).reshape(size, size, -1)
            cls = np.asarray(cls, dtype=float)
            if acc is None:
                acc = np.zeros((block, block, len(cls) + loc.shape[2]))
                norm = np.zeros((block, block))
            r, c = int(top) // tile - br, int(left) // tile - bc
            r0, r1, c0, c1 = max(r, 0), min(r + size, block), max(c, 0), min(c + size, block)
            w = wt[r0 - r:r1 - r, c0 - c:c1 - c]
            acc[r0:r1, c0:c1, :len(cls)] += w[..., None] * cls
            acc[r0:r1, c0:c1, len(cls):] += w[..., None] * loc[r0 - r:r1 - r, c0 - c:c1 - c]
            norm[r0:r1, c0:c1] += w
        rr, cc = np.nonzero(norm)
        vec = acc[rr, cc] / np.maximum(norm[rr, cc], 1e-6)[:, None]
        return pd.DataFrame({
            "sample": pdf["sample"].iloc[0], "row": rr + br - crop, "col": cc + bc - crop, "feat": list(vec),
        })

    kind = patches.schema["sample"].dataType.simpleString()
    out = d.groupBy("sample", "_br", "_bc").applyInPandas(fuse, f"sample {kind}, row long, col long, feat array<double>")
    s = slides.select("sample", "grid_h", "grid_w")
    out = attach(out, s, "sample", "inner").where(
        (F.col("row") >= 0) & (F.col("col") >= 0) & (F.col("row") < F.col("grid_h")) & (F.col("col") < F.col("grid_w"))
    ).drop("grid_h", "grid_w")
    return apply_mask(out, mask) if mask is not None else out
