"""Sample manifests, domains, completeness checks and per-sample summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window, functions as F

from ..functions.scalars import glob_regex
from ..plans.scale import attach, attach_row, global_index

# fixed values: technology name to resolution id
TECH_RESOLUTION = {"vis": 0, "xen": 1}


def discover_samples(manifest, pattern=None, include=None, exclude=None, name="sample"):
    """Distinct sample names. ``include`` beats ``pattern`` (one or several globs); ``exclude`` always applies."""
    c = F.col(name)
    out = manifest.select(name).where(c.isNotNull())
    if include is not None:
        out = out.where(c.isin(list(include)))
    elif pattern:
        pats = [pattern] if isinstance(pattern, str) else list(pattern)
        out = out.where(reduce(lambda a, b: a | b, [c.rlike(glob_regex(p)) for p in pats]))
    if exclude:
        out = out.where(~c.isin(list(exclude)))
    return out.distinct()


def derive_resolution(df, stem="stem", table=None):
    """Resolution id from a batch stem: ``batch_tech_n`` by table, ``batch_n`` is n, anything else 0."""
    table = TECH_RESOLUTION if table is None else table
    parts = F.split(F.col(stem), "_")
    known = reduce(lambda acc, kv: acc.when(F.get(parts, F.lit(1)) == kv[0], kv[1]), table.items(), F.when(F.lit(False), 0))
    n = F.size(parts)
    res = F.when(n == 3, F.coalesce(known, F.lit(0))).when(n == 2, F.get(parts, F.lit(1)).cast("int")).otherwise(0)
    odd = F.when(n == 3, known.isNull()).otherwise(n != 2)
    return df.withColumns({"resolution": res, "defaulted": odd})


def rank_domains(names, name="domain", out="domain_id"):
    """Dense ids of the distinct names in sorted order."""
    d = global_index(names.select(name).where(F.col(name).isNotNull()).distinct(), [name], out)
    return d.withColumn(out, F.col(out).cast("int"))


def domain_join(df, domains, on="sample", domain="domain_id"):
    """Left join of the sample-to-domain table; unknown samples get -1."""
    return attach(df, domains.select(on, domain), on).withColumn(domain, F.coalesce(F.col(domain), F.lit(-1)))


def domain_offset(samples, base, name="sample", domain="domain_id"):
    """Ids for a second modality that continue after the largest id of ``base`` (-1 when empty)."""
    top = base.agg(F.coalesce(F.max(domain), F.lit(-1)).alias("_top"))
    return attach_row(rank_domains(samples, name, "_r"), top).select(name, (F.col("_top") + 1 + F.col("_r")).cast("int").alias(domain))


def infer_group(df, groups, name="sample", out="group"):
    """The one group whose text occurs in the name; NULL for none or several. ``n_hits`` tells which."""
    hits = F.filter(F.array(*[F.lit(g) for g in groups]), lambda g: F.col(name).contains(g))
    return df.withColumn("_h", hits).withColumns(
        {out: F.when(F.size("_h") == 1, F.get("_h", F.lit(0))), "n_hits": F.size("_h")}
    ).drop("_h")


def examples_profile(examples, tokens="tokens", labels="y", domain="domain_id", resolution="resolution"):
    """Rows, token count, feature width and class count per resolution, plus the number of domains overall."""
    per = examples.groupBy(resolution).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.size(tokens)).alias("t"),
        F.max(F.size(F.get(F.col(tokens), F.lit(0)))).alias("c"),
        F.max(F.size(labels)).alias("k"),
        F.max(F.when(F.col(domain) >= 0, F.col(domain))).alias("_d"),
    )
    # one row per resolution
    return per.withColumn(
        "n_domains", F.coalesce(F.max("_d").over(Window.partitionBy(F.lit(1))) + 1, F.lit(0)).cast("int")
    ).drop("_d")


def filter_resolution(examples, resolution, col="resolution"):
    return examples.where(F.col(col) == resolution)


def concat_samples(*frames, sample="sample", feature="feature"):
    """Stack long tables, keeping only features found in every one; ``None`` inputs are skipped."""
    frames = [f for f in frames if f is not None]
    if not frames:
        raise ValueError("no inputs")
    seen = reduce(
        lambda a, b: a.unionByName(b),
        [f.select(feature).distinct().withColumn("_src", F.lit(i)) for i, f in enumerate(frames)],
    )
    shared = seen.groupBy(feature).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(frames)).select(feature)
    return attach(stack(*frames), shared, feature, "left_semi")


def stack(*frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def batch_summary(examples, by=("sample", "domain_id"), **values):
    """Rows per batch plus any extra aggregate expressions given by name."""
    return examples.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[e.alias(k) for k, e in values.items()])


def run_incremental(todo, done, on="sample"):
    """Samples whose outputs do not exist yet."""
    return attach(todo, done.select(on).distinct(), on, "left_anti")


def validate_layout(files, samples, requirements, radius=None, spot_counts=None):
    """One row per problem: (sample, level, problem).

    ``files(sample, kind)``; ``requirements(kind, level)`` with level ``error`` or
    ``warning``; ``radius(sample, radius)`` must agree with the most common value
    (smallest on ties); ``spot_counts(sample, n_props, n_locs)`` must match.
    """
    rules = requirements.agg(F.collect_list(F.struct("kind", "level")).alias("_rules"))  # a handful of kinds
    need = attach_row(samples.select("sample").distinct(), rules).select("sample", F.inline("_rules"))
    have = files.select("sample", "kind").distinct()
    out = need.join(have, ["sample", "kind"], "left_anti").select(
        "sample", "level", F.concat(F.lit("missing "), "kind").alias("problem")
    )
    if radius is not None:
        common = (
            radius.groupBy("radius").agg(F.count(F.lit(1)).alias("n"))
            .agg(F.min_by("radius", F.struct(-F.col("n"), F.col("radius"))).alias("_want"))
        )
        bad = attach_row(radius, common).where(
            F.col("radius").isNull() | (F.col("radius") != F.col("_want"))
        )
        out = out.unionByName(bad.select("sample", F.lit("error").alias("level"), F.lit("radius mismatch").alias("problem")))
    if spot_counts is not None:
        bad = spot_counts.where(~F.col("n_props").eqNullSafe(F.col("n_locs")))
        out = out.unionByName(bad.select("sample", F.lit("error").alias("level"), F.lit("spot count mismatch").alias("problem")))
    return out


def sample_report(pred, p="p", z="z"):
    """Grid extent, tokens, classes and latent width per sample."""
    return pred.groupBy("sample").agg(
        (F.max("row") + 1).alias("height"),
        (F.max("col") + 1).alias("width"),
        F.count(F.lit(1)).alias("n_tokens"),
        F.max(F.size(p)).alias("k"),
        F.max(F.size(z)).alias("d"),
    )
