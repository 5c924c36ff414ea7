"""Column profiles and what other columns say about a tag.

Every operator turns the columns into rows first, so one grouped job serves all columns and
its groups are (column, value): counts are combined on the map side, and the second step sees
one row per distinct value only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitag.functions import text as tx
from lexitag.operators.lookup import lookup_join

# Percent of distinct values that make a column 'unique' / variable, distinct
# values a compare column must exceed, times a value must occur with its tag.
UNIQUE_PERCENT = 10.0
VARIABLE_PERCENT = 0.5
COMPARE_DISTINCT = 5
LEAST_COUNT = 2


def _long(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    texts = [F.col(f"`{c}`").cast("string").alias(c) for c in cols]
    return df.select(*ids, *texts).unpivot(list(ids), tx.cells(cols), "col", "val")


def column_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: rows, distinct values with and without null, uniqueness and variability in
    percent, whether it is a 'unique' or an 'other' column, and whether it is variable."""
    values = _long(df, cols).groupBy("col", "val").agg(F.count(F.lit(1)).alias("n"))
    counted = values.groupBy("col").agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("distinct_all"),
        F.count("val").alias("distinct_values"),
    )
    uniqueness = F.col("distinct_all") / F.col("rows") * 100
    variability = F.col("distinct_values") / F.col("rows") * 100
    return counted.select(
        "*",
        uniqueness.alias("uniqueness"),
        variability.alias("variability"),
        F.when(uniqueness > UNIQUE_PERCENT, "unique").otherwise("other").alias("kind"),
        (variability > VARIABLE_PERCENT).alias("is_variable"),
    )


def unique_and_other_columns(df: DataFrame, cols: Sequence[str]) -> tuple[list[str], list[str]]:
    """Column names by kind, in the order of ``cols`` (one row per column comes back)."""
    kinds = {r["col"]: r["kind"] for r in column_profile(df, cols).select("col", "kind").collect()}
    return (
        [c for c in cols if kinds.get(c) == "unique"],
        [c for c in cols if kinds.get(c) == "other"],
    )


def variable_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    found = column_profile(df, cols).where("is_variable").select("col").collect()
    return [c for c in cols if c in {r["col"] for r in found}]


def compare_profile(new: DataFrame, learn: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: distinct learn values, filled input cells, and whether it can be compared:
    more than five distinct learn values and some non-empty input cell (null counts as text)."""
    learned = column_profile(learn, cols).select("col", "distinct_values")
    empty = F.col("val") == ""
    filled = _long(new, cols).groupBy("col").agg(
        F.count(F.when(empty, None).otherwise(1)).alias("filled")
    )
    compare = (F.coalesce("filled", F.lit(0)) > 0) & (F.col("distinct_values") > COMPARE_DISTINCT)
    return learned.join(filled, "col", "left").select(
        "col",
        "distinct_values",
        F.coalesce("filled", F.lit(0)).alias("filled"),
        compare.alias("compare"),
    )


def compare_columns(
    new: DataFrame, learn: DataFrame, cols: Sequence[str]
) -> tuple[list[str], list[str]]:
    """(compare, fill) column names: a fill column takes its value from the matching learn row."""
    rows = compare_profile(new, learn, cols).where("compare").select("col").collect()
    compare = {r["col"] for r in rows}
    return [c for c in cols if c in compare], [c for c in cols if c not in compare]


def column_tags(df: DataFrame, tag: str, cols: Sequence[str]) -> DataFrame:
    """(col, val, Tag): values that occur at least twice with one tag and with no other tag so
    often. Text cells and tags lose runs of spaces first; blank ones are left out."""

    def clean(name: str) -> Column:
        cell = F.col(f"`{name}`")
        return tx.collapse_spaces(cell) if tx.is_text(df, name) else cell.cast("string")

    cells = df.select(clean(tag).alias("Tag"), *[clean(c).alias(c) for c in cols])
    counted = (
        cells.unpivot(["Tag"], tx.cells(cols), "col", "val")
        .where("Tag is not null and val is not null and val not in ('', ' ')")
        .groupBy("col", "val", "Tag")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= LEAST_COUNT)
    )
    return (
        counted.groupBy("col", "val")
        .agg(F.count(F.lit(1)).alias("tags"), F.min("Tag").alias("Tag"))
        .where("tags = 1")
        .select("col", "val", "Tag")
    )


def empty_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns in which every cell is null or '' (one row of maxima comes back)."""
    sizes = [F.max(F.length(F.col(f"`{c}`").cast("string"))) for c in cols]
    row = df.agg(*sizes).first() if cols else ()
    return [c for c, size in zip(cols, row) if not size]


def fill_values(learn: DataFrame, tag: str, cols: Sequence[str]) -> DataFrame:
    """(Col, Tag, Val): the most frequent value of each column per tag, the smallest on a tie.

    Counted per (tag, column, value) before the choice, so no group's values are gathered.
    """
    counted = (
        _long(learn.withColumn("_tag", F.col(tag).cast("string")), cols, ["_tag"])
        .where("_tag is not null and val is not null")
        .groupBy("_tag", "col", "val")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        counted.groupBy("_tag", "col")
        .agg(F.min(F.struct((-F.col("n")).alias("n"), "val")).alias("top"))
        .select(F.col("col").alias("Col"), F.col("_tag").alias("Tag"), F.col("top.val").alias("Val"))
        .where("Val <> ''")
    )


def distinct_tags(learn: DataFrame, tag: str = "Tag") -> DataFrame:
    return learn.select(F.col(tag).alias("Tag")).distinct()


def fill_columns(
    rows: DataFrame, fill: DataFrame, cols: Sequence[str], id_col: str, tag: str = "Tag"
) -> DataFrame:
    """Put the fill value of a row's tag into its empty cells; filled cells stay."""
    if not cols:
        return rows
    at = {c: f"in_{i}" for i, c in enumerate(rows.columns)}
    inside = tx.enclosed(rows).withColumn("tag", F.col(at[tag]))
    joined = joined_fill(inside, fill, cols, at[id_col])
    cells = {c: filled(F.col(at[c]), F.col(f"fill_{i}")) for i, c in enumerate(cols)}
    return joined.select([cells.get(c, F.col(at[c])).alias(c) for c in rows.columns])


def joined_fill(inside: DataFrame, fill: DataFrame, cols: Sequence[str], salt_by: str) -> DataFrame:
    """Enclosed rows with a column ``tag`` -> the same with fill_0, fill_1 ... of ``cols``."""
    values = [F.max(F.when(F.col("Col") == c, F.col("Val"))).alias(f"fill_{i}") for i, c in enumerate(cols)]
    wide = fill.groupBy(F.col("Tag").alias("tag")).agg(*values)
    return lookup_join(inside, wide, ["tag"], "left", [salt_by], measured=fill)


def filled(cell: Column, value: Column) -> Column:
    return F.coalesce(F.nullif(cell, F.lit("")), value, cell)
