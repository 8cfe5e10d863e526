"""Slide geometry: resolution, coordinates, windows and paddings (one row per slide or spot)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import micron_per_pixel
from ..plans.scale import attach, attach_row, reread, spread_cells

# fixed values: pixel size of one imaging platform (micron), and resolutions that cameras write by default
UM_PER_PX = 0.2125
DEFAULT_DPI = (72, 96, 150)


def rescale_coords(pos, slides, target="mpp_target", cols=("x", "y")):
    """Scale raw pixel coordinates by mpp_raw / target, rounding halves to even."""
    s = slides.select("sample", (F.col("mpp_raw") / F.col(target)).alias("_s"))
    out = attach(pos, s, "sample", "inner")
    return out.withColumns({c: F.rint(F.col(c) * F.col("_s")).cast("long") for c in cols}).drop("_s")


def coords_to_grid(pos, slides):
    """Pixel (x, y) to grid (row, col): integer factor image // grid, halves to even."""
    s = slides.select(
        "sample",
        F.floor(F.col("height") / F.col("grid_h")).alias("_fy"),
        F.floor(F.col("width") / F.col("grid_w")).alias("_fx"),
    )
    return attach(pos, s, "sample", "inner").withColumns({
        "row": F.rint(F.col("y") / F.col("_fy")).cast("long"),
        "col": F.rint(F.col("x") / F.col("_fx")).cast("long"),
    }).drop("_fy", "_fx")


def um_to_px(cells, px=UM_PER_PX, cols=("x", "y")):
    return cells.withColumns({c: F.col(c) / F.lit(float(px)) for c in cols})


def spot_radius(slides, tile=16):
    """Raw radius, truncated scaled radius, and radius in grid cells."""
    raw = F.col("spot_diameter") / 2.0
    scaled = (raw * (F.col("mpp_raw") / F.col("mpp_target"))).cast("long")
    return slides.withColumns({
        "radius_raw": raw, "radius": scaled, "grid_radius": F.floor(scaled / F.lit(tile)).cast("long"),
    })


def dpi_to_mpp(headers, reject_defaults=True, dpi="dpi", unit="unit"):
    """Microns per pixel from header resolution; camera defaults are not trusted when ``reject_defaults``."""
    mpp = micron_per_pixel(dpi, unit)
    bad = F.col(dpi).isin(list(DEFAULT_DPI)) if reject_defaults else F.lit(False)
    return headers.withColumns({
        "mpp": F.when(~bad, mpp),
        "reason": F.when(bad, "default resolution").when(mpp.isNull(), "no resolution"),
    })


def resolve_mpp(df, order=("override", "per_sample", "header")):
    """First value present in ``order``; ``method`` names the column it came from."""
    return df.withColumns({
        "mpp": F.coalesce(*[F.col(c) for c in order]),
        "method": F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in order]),
    })


def audit_resolution(df, target=0.5):
    """Scale, upscale flag, status and group size at four decimals, one row per sample.

    ``n_resolutions`` counts distinct rounded values over all samples that were read.
    """
    d = reread(df).withColumns({
        "scale": F.col("mpp") / F.lit(float(target)),
        "mpp4": F.round("mpp", 4),
    }).withColumn(
        "status", F.when(F.col("mpp").isNull(), "failed").when(F.col("scale") > 1.0, "upscale").otherwise("ok")
    )
    groups = d.where(F.col("mpp").isNotNull()).groupBy("mpp4").agg(F.count(F.lit(1)).alias("n_same"))
    return attach_row(attach(d, groups, "mpp4"), groups.agg(F.count(F.lit(1)).alias("n_resolutions")))


def audit_failures(audited, ext="extension"):
    """Failed reads per file extension."""
    return audited.where(F.col("status") == "failed").groupBy(
        F.coalesce(F.col(ext), F.lit("unknown")).alias(ext)
    ).agg(F.count(F.lit(1)).alias("n_failed"))


def scale_for_display(pos, slides, max_side):
    """Shrink coordinates and radius so the longer side is at most ``max_side``; never enlarge."""
    s = slides.select(
        "sample",
        F.least(F.lit(1.0), F.lit(float(max_side)) / F.greatest("height", "width")).alias("scale"),
        F.col("radius").alias("_r"),
    )
    small = F.col("scale") < 1.0
    return attach(pos, s, "sample", "inner").withColumns({
        "x": F.when(small, F.rint(F.col("x") * F.col("scale"))).otherwise(F.col("x")).cast("long"),
        "y": F.when(small, F.rint(F.col("y") * F.col("scale"))).otherwise(F.col("y")).cast("long"),
        "radius": F.when(
            small, F.greatest(F.lit(1).cast("long"), (F.col("_r") * F.col("scale")).cast("long"))
        ).otherwise(F.col("_r").cast("long")),
    }).drop("_r")


def sliding_windows(slides, patch=224, stride=112):
    """Every full window (top, left) after zero padding of patch // 2 on each side."""
    pad = 2 * (patch // 2)

    def starts(side):
        last = F.col(side) + pad - patch
        return F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(stride).cast("long")))

    return slides.select("sample", F.explode(starts("height")).alias("top"), starts("width").alias("_l")).select(
        "sample", "top", F.explode("_l").alias("left")
    )


def region_grid(slides, rows, cols):
    """rows x cols tiling; the last row and column take the remainder."""
    seq = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    tw, th = F.floor(F.col("width") / cols), F.floor(F.col("height") / rows)
    d = slides.withColumn("row", F.explode(seq(rows))).withColumn("col", F.explode(seq(cols)))
    x, y = F.col("col") * tw, F.col("row") * th
    return d.select(
        "sample", "row", "col", x.alias("x"), y.alias("y"),
        F.when(F.col("col") < cols - 1, tw).otherwise(F.col("width") - x).alias("w"),
        F.when(F.col("row") < rows - 1, th).otherwise(F.col("height") - y).alias("h"),
    )


def pad_extent(slides, multiple):
    """Each side rounded up to a multiple, and how much was added."""
    up = lambda c: (F.ceil(F.col(c) / F.lit(multiple)) * multiple).cast("long")
    return slides.withColumns({
        "padded_width": up("width"), "padded_height": up("height"),
        "pad_x": up("width") - F.col("width"), "pad_y": up("height") - F.col("height"),
    })


def crop_pixels(pixels, slides, extent, mode="edge", fill=0, values=("r", "g", "b")):
    """Pixels of ``extent = (top, bottom, left, right)``, which may exceed the raster.

    ``edge`` repeats the nearest border pixel, ``constant`` writes ``fill``. Only
    border pixels are repeated; coordinates are re-based to the extent's corner.
    """
    top, bottom, left, right = extent
    d = attach(pixels, slides.select("sample", F.col("height").alias("_h"), F.col("width").alias("_w")), "sample", "inner")
    if mode == "constant":
        # above and below over the whole width, left and right beside the raster: each strip holds only rows of the result
        lit = lambda v: F.lit(v).cast("long")
        h, w = F.col("height").cast("long"), F.col("width").cast("long")
        beside = F.greatest(lit(top), lit(0)).alias("y0"), F.least(lit(bottom), h).alias("y1")
        strips = F.array(
            F.struct(lit(top).alias("y0"), F.least(lit(bottom), lit(0)).alias("y1"), lit(left).alias("x0"), lit(right).alias("x1")),
            F.struct(F.greatest(lit(top), h).alias("y0"), lit(bottom).alias("y1"), lit(left).alias("x0"), lit(right).alias("x1")),
            F.struct(*beside, lit(left).alias("x0"), F.least(lit(right), lit(0)).alias("x1")),
            F.struct(*beside, F.greatest(lit(left), w).alias("x0"), lit(right).alias("x1")),
        )
        strips = slides.select("sample", F.explode(strips).alias("_s")).select("sample", "_s.*").where("y1 > y0 and x1 > x0")
        wide = F.col("x1") - F.col("x0")
        cells = spread_cells(strips, (F.col("y1") - F.col("y0")) * wide, "_i")
        grid = cells.select(
            "sample", (F.col("y0") + F.floor(F.col("_i") / wide)).alias("y"), (F.col("x0") + F.col("_i") % wide).alias("x"),
            *[F.lit(fill).alias(v) for v in values],
        )
        inside = d.where(F.col("y").between(top, bottom - 1) & F.col("x").between(left, right - 1))
        out = inside.select("sample", "y", "x", *values).unionByName(grid)
    else:
        def reach(c, last, lo, hi):
            a = F.when(F.col(c) == 0, F.least(F.lit(lo), F.lit(0))).otherwise(F.col(c))
            z = F.when(F.col(c) == last, F.greatest(F.lit(hi - 1), last)).otherwise(F.col(c))
            return F.sequence(a.cast("long"), z.cast("long"))

        d = d.select(
            "sample", *values, F.col("x").alias("_x0"), "_w",
            F.explode(reach("y", F.col("_h") - 1, top, bottom)).alias("y"),
        ).where(F.col("y").between(top, bottom - 1))
        out = d.withColumn("x", F.explode(reach("_x0", F.col("_w") - 1, left, right))).where(
            F.col("x").between(left, right - 1)
        ).select("sample", "y", "x", *values)
    return out.withColumns({"y": F.col("y") - top, "x": F.col("x") - left})


def window_mask_join(windows, mask, patch=224, stride=112):
    """Windows that overlap a masked pixel; ``mask(sample, y, x)`` is in unpadded pixels.

    Each mask pixel names the windows covering it by integer arithmetic, so the
    join is on equal keys; distinct windows are found before the join.
    """
    pad = patch // 2

    def cover(c):
        p = F.col(c) + pad
        lo = F.greatest(F.lit(0).cast("long"), F.ceil((p - (patch - 1)) / F.lit(stride)).cast("long"))
        return F.sequence(lo, F.floor(p / F.lit(stride)).cast("long"))

    # one row per distinct pair of covering ranges before expanding
    hit = (
        mask.select("sample", cover("y").alias("_t"), cover("x").alias("_l")).distinct()
        .select("sample", F.explode("_t").alias("_ti"), "_l")
        .select("sample", (F.col("_ti") * stride).alias("top"), F.explode("_l").alias("_li"))
        .select("sample", "top", (F.col("_li") * stride).alias("left"))
        .distinct()
    )
    return windows.join(hit.hint("merge"), ["sample", "top", "left"], "left_semi")
