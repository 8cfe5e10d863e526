"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: A word: a maximal run of characters other than space and TAB to CR.
WORD = r"[^\x20\x09-\x0D]+"


def text_of(column: str) -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def row_key(ident: str, text: str) -> dict[str, Column]:
    """Two join columns that tell rows apart by id and text and are never null.

    Rows alike in both are the same document twice and get the same treatment.
    """
    return {
        "_id": F.coalesce(F.col(ident).cast("long"), F.lit(-(2**63))),
        "_fp": F.xxhash64(F.col(ident).isNull(), F.col(text).isNull(), F.col(text)),
    }


def boxed(docs: DataFrame, **columns: Column) -> DataFrame:
    """All columns in one, _row, beside new ones: no name of theirs can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[c.alias(n) for n, c in columns.items()])


def unboxed(df: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` out of _row, some of them replaced."""
    return df.select(*[new.get(c, F.col("_row")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def spare(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as make it new."""
    while name in docs.columns:
        name = "_" + name
    return name


def number_within(df: DataFrame, group: str, order: list[str], name: str, rows_per_cell: int = 50_000) -> DataFrame:
    """Gapless 0-based number of each row in its group, for few groups of any size.

    Groups are cut into cells of about ``rows_per_cell`` rows by a hash of ``order``;
    rows are numbered inside cells and cells carry offsets, so no task holds a group.
    ``group`` must have a bounded number of values: its counts are broadcast. ``df``
    is read twice.
    """
    cells = df.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / rows_per_cell).alias("_cells"))
    cut = df.join(F.broadcast(cells), group).withColumn("_cell", F.pmod(F.xxhash64(*order), F.col("_cells"))).drop("_cells")
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    )
    inside = F.row_number().over(Window.partitionBy(group, "_cell").orderBy(*order)) - 1
    return (
        cut.withColumn("_in", inside).join(offsets, [group, "_cell"])
        .withColumn(name, F.col("_in").cast("long") + F.col("_before")).drop("_in", "_before", "_cell")
    )
