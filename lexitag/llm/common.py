"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII characters (fixed value).
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_BATCH = 500


def text_batches(spark: SparkSession) -> None:
    """Hand whole texts to Python in small batches, so that a batch of long texts fits a worker.

    It lowers a session setting that only says how many rows travel at once.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= ROWS_PER_BATCH:
        spark.conf.set(setting, str(ROWS_PER_BATCH))


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def enclose(df: DataFrame) -> DataFrame:
    """``df`` with its columns called in_0, in_1 ..., so that no name can clash with a computed one."""
    return df.toDF(*(f"in_{i}" for i in range(len(df.columns))))


def inner(df: DataFrame, name: str) -> str:
    """The name that ``enclose(df)`` gives to column ``name``."""
    return f"in_{df.columns.index(name)}"


def reopen(enclosed: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` again, without what was computed beside them."""
    return enclosed.select([F.col(f"in_{i}").alias(c) for i, c in enumerate(like.columns)])


def group_key(column: Column) -> Column:
    """A never-null text key: null and the empty string stay apart."""
    return F.when(column.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), column.cast("string")))


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` does the same where all characters are ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(column) == F.char_length(column)
    return F.when(plain, F.lower(column)).otherwise(F.translate(column, upper, upper.lower()))


def crc_text(column: Column) -> Column:
    """crc32 of a value written as text; folds are taken from it. Null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))
