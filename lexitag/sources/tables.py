"""Delimited text tables in, result tables out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from lexitag.functions import text as tx
from lexitag.operators import clean
from lexitag.operators.lasting import keep

# Separators, encodings and bookkeeping column names of the known files.
SEPARATOR = ";"
VALUE_LIST_SEPARATOR = " "
BOOKKEEPING = ("TB_edit", "TB_qual")


def _csv(
    spark: SparkSession, paths: str | Sequence[str], sep: str = SEPARATOR, multi_line: bool = False
) -> DataFrame:
    """Quotes in quoted cells are doubled and a backslash is a character like any other. Cells hold
    line breaks only with ``multi_line``, as a file then cannot be split."""
    reader = spark.read.options(sep=sep, header=True, quote='"', escape='"', multiLine=multi_line)
    return reader.csv(paths)


def _by_header(spark: SparkSession, path: str) -> list[list[str]]:
    """The files under a path or glob, those with the same first line together.

    Only the first line of each file is read, and only file names come to the driver.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(path)
    system = pattern.getFileSystem(conf)
    found = list(system.globStatus(pattern) or [])
    files = [f for x in found for f in (system.listStatus(x.getPath()) if x.isDirectory() else [x])]
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    groups: dict[str, list[str]] = {}
    for file in files:
        place = file.getPath()
        if file.isDirectory() or place.getName()[0] in "_.":
            continue
        codec, stream = codecs.getCodec(place), system.open(place)
        lines = jvm.java.io.BufferedReader(
            jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8")
        )
        groups.setdefault(lines.readLine(), []).append(place.toString())
        lines.close()
    return list(groups.values())


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_raw(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = False) -> DataFrame:
    """All files as text columns, united by column name: one read per path and header."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    parts = []
    for path in paths:
        groups = _by_header(spark, path)
        parts += [_csv(spark, g, multi_line=multi_line) for g in (groups if len(groups) > 1 else [path])]
    return _union(parts)


def read_table(
    spark: SparkSession,
    paths: str | Sequence[str],
    excludes: Mapping[str, Sequence[str]] | None = None,
    distinct: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """Files -> text table: excluded rows out, bookkeeping columns out, missing cells 'nan'."""
    df = read_raw(spark, paths, multi_line)
    if excludes:
        df = clean.exclude_patterns(df, excludes)
    if set(BOOKKEEPING) <= set(df.columns):
        df = df.drop(*BOOKKEEPING)
    if distinct:
        df = df.dropDuplicates()
    return tx.stringify(df)


def with_entry(df: DataFrame, id_col: str = "entry") -> DataFrame:
    """Give rows a key. It is written with the rows, as a generated key changes on recompute."""
    return keep(df.select(F.monotonically_increasing_id().alias(id_col), "*"))


def read_excludes(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Column -> upper-case patterns. A hand-written list: each pattern becomes part of a plan."""
    rows = _csv(spark, path)
    return {
        c: [r[0].upper() for r in rows.select(f"`{c}`").where(f"`{c}` <> ''").toLocalIterator()]
        for c in rows.columns
    }


def read_exclude_values(spark: SparkSession, path: str) -> DataFrame | None:
    """Table of values to leave out, space separated; None if there is no such file."""
    try:
        return _csv(spark, path, VALUE_LIST_SEPARATOR)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_decimal_table(
    spark: SparkSession,
    paths: str | Sequence[str],
    decimals: Sequence[str] = (),
    date: str = "Date",
    multi_line: bool = False,
) -> DataFrame:
    """Legacy input: decimal commas, dd.MM.yyyy dates, and an empty Tag column in front."""
    df = read_raw(spark, paths, multi_line)
    numbers = {c: F.replace(F.col(f"`{c}`"), F.lit(","), F.lit(".")).try_cast("double") for c in decimals}
    return df.withColumns({**numbers, date: tx.day(F.col(date))}).select(
        F.lit("").alias("Tag"), *[f"`{c}`" for c in df.columns]
    )


def as_learn_table(
    df: DataFrame, tag_col: str, text_col: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Legacy learn table: the named columns (all by default), Tag and Text named, missing text 'None'."""
    df = df.select([F.col(f"`{c}`") for c in columns or df.columns])
    cells = {
        c: F.coalesce(F.col(f"`{c}`"), F.lit("None")) for c in df.columns if tx.is_text(df, c)
    }
    return df.withColumns(cells).withColumnsRenamed({tag_col: "Tag", text_col: "Text"})


def write_table(df: DataFrame, path: str, header: bool = True) -> None:
    """Delimited text out (one file per partition)."""
    blanks = dict(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    options = dict(sep=SEPARATOR, header=header, quote='"', escape='"', **blanks)
    df.write.mode("overwrite").options(**options).csv(path)


def write_results(df: DataFrame, path: str, columns: Sequence[str], id_col: str | None = None) -> None:
    """Result rows with edit flag, quality and band, dates without time."""
    clean.result_columns(df, columns, id_col).write.mode("overwrite").parquet(path)
