"""Sinks."""

from __future__ import annotations

from pyspark.sql import functions as F


def write_examples(df, path, mode="append", rows_per_file=100_000):
    """Training examples by technology and domain.

    A partition's rows are spread over several tasks by a salt, so one large domain
    does not become one writer.
    """
    salted = df.withColumn("_s", F.pmod(F.xxhash64("example_id"), F.lit(64)))
    salted.repartition("tech", "domain_id", "_s").drop("_s").write.mode(mode).option(
        "maxRecordsPerFile", rows_per_file
    ).partitionBy("tech", "domain_id").parquet(path)


def write_table(df, path, sep="\t", mode="overwrite"):
    """Delimited text with a header; arrays become comma lists."""
    flat = [
        F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c) if t.startswith("array") else F.col(c)
        for c, t in df.dtypes
    ]
    df.select(*flat).write.mode(mode).csv(path, sep=sep, header=True)


def write_summary(df, path, mode="overwrite"):
    """Batch summary as JSON lines."""
    df.write.mode(mode).json(path)
