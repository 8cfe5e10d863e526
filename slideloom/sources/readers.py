"""Readers for the tables and sidecar files of a sample folder.

Paths may be globs over many samples; ``with_sample`` then takes the sample from
the folder name, so a whole cohort is one scan.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..plans.scale import attach, settle

# fixed values: column names of the positions file without a header
POSITION_SCHEMA = "barcode string, in_tissue int, array_row int, array_col int, pxl_row int, pxl_col int"
HEADED = {"pxl_row_in_fullres": "pxl_row", "pxl_col_in_fullres": "pxl_col"}


def with_sample(df, depth=1, out="sample"):
    """Sample name from the file path, ``depth`` folders above the file."""
    return df.withColumn(out, F.element_at(F.split(F.input_file_name(), "/"), -1 - depth))


def read_positions(spark, path, has_header):
    """Spot positions in either layout."""
    if not has_header:
        return spark.read.csv(path, schema=POSITION_SCHEMA)
    named = POSITION_SCHEMA.replace("pxl_row", "pxl_row_in_fullres").replace("pxl_col", "pxl_col_in_fullres")
    # fullres columns may hold decimals in headed files
    named = named.replace("fullres int", "fullres double")
    df = spark.read.csv(path, schema=named, header=True).withColumnsRenamed(HEADED)
    return df.withColumns({"pxl_row": F.col("pxl_row").cast("int"), "pxl_col": F.col("pxl_col").cast("int")})


def read_scale_factors(spark, path):
    """Spot diameter per sample from the scale-factor JSON, one file a sample; folders named sample=… give a column sample."""
    return spark.read.schema("spot_diameter_fullres double").json(path, multiLine=True)


def numbered_lines(spark, path, sample=None, depth=None):
    """sample, line (from 1) and value of the text files of many samples, however they are split.

    A sample's files count on in the order of their names. Lines are counted by file split, splits carry offsets: no
    task sees a whole dictionary. See ``read_sparse_counts`` for ``sample`` and ``depth``.
    """
    t = settle(spark.read.text(path).select(
        "value", _sample_of(sample, depth).alias("sample"), F.col("_metadata.file_path").alias("_f"),
        F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_m"),
    ))
    # one row a split
    before = Window.partitionBy("sample").orderBy("_f", "_s").rowsBetween(Window.unboundedPreceding, -1)
    splits = t.groupBy("sample", "_f", "_s").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    line = (F.col("_before") + F.col("_m") - F.col("_first") + 1).alias("line")
    return attach(t, splits, ["sample", "_f", "_s"], "inner").select("sample", line, "value")


def _sample_of(sample, depth):
    """A constant, or the name of the folder ``depth`` levels above the file (what follows ``=`` in it)."""
    if depth is None:
        return F.lit(sample if sample is not None else "")
    return F.regexp_extract(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1 - depth), "([^=]*)$", 1)


def read_sparse_counts(spark, mtx, features, barcodes, feature_type="Gene Expression", size_line=True, sample=None, depth=None):
    """1-based triplets plus two dictionaries to long counts ([sample,] spot, gene, cnt).

    Reads all samples at once: with ``depth`` the paths (folders, lists or globs) hold files of many samples, each
    named by the folder ``depth`` levels above its files; else all files are of one sample, named by ``sample``. Matrices and
    dictionaries may be several files each, which count on in name order. Only ``feature_type`` rows stay; the id stands in for
    the symbol when every symbol of the sample is empty. ``size_line`` says whether each sample's triplets start with the matrix size.
    """
    def numbered(path, cols):
        v = F.split("value", "\t")
        return numbered_lines(spark, path, sample, depth).select("sample", F.col("line").alias("_i"), *[F.get(v, F.lit(i)).alias(c) for i, c in enumerate(cols)])

    feats = numbered(features, ["id", "symbol", "type"]).where(F.col("type").isNull() | (F.col("type") == feature_type))
    named = feats.groupBy("sample").agg(F.max(F.coalesce(F.length("symbol"), F.lit(0))).alias("_len"))
    gene = F.when(F.col("_len") > 0, F.col("symbol")).otherwise(F.col("id")).alias("gene")
    feats = attach(feats, named, "sample", "inner").select("sample", F.col("_i").alias("_g"), gene)
    bars = numbered(barcodes, ["spot"]).withColumnRenamed("_i", "_b")
    v = F.split(F.trim("value"), r"\s+")
    # the scan gives the same place to a line each time it is read
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("m"))
    trip = spark.read.text(mtx).select("value", _sample_of(sample, depth).alias("sample"), place.alias("_at")).where(~F.col("value").startswith("%")).select(
        "sample", F.get(v, F.lit(0)).cast("long").alias("_g"), F.get(v, F.lit(1)).cast("long").alias("_b"), F.get(v, F.lit(2)).cast("double").alias("cnt"), "_at",
    )
    if size_line:
        trip = attach(trip, trip.groupBy("sample").agg(F.min("_at").alias("_first")), "sample", "inner").where("_at != _first")
    out = attach(attach(trip, feats, ["sample", "_g"], "inner"), bars, ["sample", "_b"], "inner")
    return out.select(*(["sample"] if depth is not None or sample is not None else []), "spot", "gene", "cnt")


def read_cells(spark, path):
    """Cell centroids in microns; only the needed columns are scanned."""
    return spark.read.parquet(path).select("cell_id", F.col("x_centroid").alias("x"), F.col("y_centroid").alias("y"))


def read_annotation(spark, path, sep=","):
    """Cell annotations (cell_id, cell_state) with an explicit separator."""
    return spark.read.csv(path, sep=sep, header=True).select("cell_id", "cell_state")


def read_vocab(spark, path):
    """Class names in line order."""
    t = spark.read.text(path).select(F.rtrim("value").alias("ctype"), F.monotonically_increasing_id().alias("_m"))
    # one short file
    return t.select((F.row_number().over(Window.orderBy("_m")) - 1).cast("int").alias("class_idx"), "ctype")


def read_label_map(spark, path):
    """Flat JSON object of fine to coarse labels."""
    m = F.from_json("value", "map<string,string>")
    return spark.read.text(path, wholetext=True).select(F.explode(m).alias("fine", "coarse"))


def read_colour_map(spark, path):
    """Class colours from the ``type_to_color`` object of a colour-map JSON."""
    m = F.from_json(F.get_json_object("value", "$.type_to_color"), "map<string,string>")
    return spark.read.text(path, wholetext=True).select(F.explode(m).alias("ctype", "colour"))


def read_domain_map(spark, path):
    """Two-column tab file (sample, domain); blank and # lines are skipped."""
    return spark.read.csv(path, sep="\t", comment="#", schema="sample string, domain string").where(
        F.col("sample").isNotNull() & F.col("domain").isNotNull()
    )


def read_file_inventory(spark, path):
    """Paths and sizes of sample files; contents are never read."""
    return spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -2).alias("sample"), F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length"
    )


def read_examples(spark, path, tech=None, domains=None):
    """Training examples; ``tech`` and ``domains`` prune partitions."""
    df = spark.read.parquet(path)
    if tech is not None:
        df = df.where(F.col("tech") == tech)
    if domains is not None:
        df = df.where(F.col("domain_id").isin(list(domains)))
    return df
