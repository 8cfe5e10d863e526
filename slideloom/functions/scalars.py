"""Scalar expressions shared by several operators."""

from __future__ import annotations

import fnmatch

from pyspark.sql import functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def glob_regex(pattern):
    """Anchored regular expression for a shell-style name pattern."""
    return "^" + fnmatch.translate(pattern).replace(r"\Z", "").replace(r"\z", "") + "$"


def adversarial_ramp(progress, lam_max=1.0):
    """lam_max * (2 / (1 + exp(-10 p)) - 1) for training progress p in [0, 1]."""
    return F.lit(float(lam_max)) * (F.lit(2.0) / (F.lit(1.0) + F.exp(_c(progress) * -10.0)) - 1.0)


def auto_batch_size(token_len, target_tokens=300_000, hard_cap=128):
    """Examples per batch for a token budget, at least one and at most ``hard_cap``."""
    t = F.greatest(_c(token_len).cast("long"), F.lit(1).cast("long"))
    return F.least(F.greatest(F.floor(F.lit(target_tokens) / t), F.lit(1)), F.lit(hard_cap)).cast("int")


def inverse_distance(dist, eps=1e-12):
    return F.lit(1.0) / (_c(dist) + eps)


def safe_label(name, colon=False):
    """Name usable as a file name: slashes and blanks replaced."""
    if colon:
        return F.translate(_c(name), "/ :", "___")
    return F.translate(_c(name), "/\\ ", "--_")


def micron_per_pixel(dpi, unit):
    """25400/dpi for inches, 10000/dpi for centimetres, else NULL."""
    d = F.nullif(_c(dpi).cast("double"), F.lit(0.0))
    return F.when(_c(unit) == "inch", F.lit(25400.0) / d).when(_c(unit) == "cm", F.lit(10000.0) / d)
