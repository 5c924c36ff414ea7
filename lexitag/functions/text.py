"""Column expressions for cells, row texts and words. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Word delimiters, number shape, the text a missing cell turns into.
ROW_DELIMITERS = "[ ,;:]+"
CELL_DELIMITERS = "[ ,;:.]+"
NUMBER = r"(?U)^-?[\d,.]+\z"
MISSING = "nan"
# Unicode white space plus the four separator controls, as Python's str.split() sees it.
WHITE_SPACE = r"(?U)[\s\x1c-\x1f]+"
# The same characters as a list, for trimming.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def cells(names: Sequence[str]) -> list[Column]:
    """Columns by name, whatever characters a name holds."""
    return [column(c) for c in names]


def enclosed(df: DataFrame) -> DataFrame:
    """``df`` with its columns called in_0, in_1 ..., so that no name can clash with a computed one."""
    return df.toDF(*(f"in_{i}" for i in range(len(df.columns))))


def stringify(df: DataFrame, missing: str | None = MISSING, keep: Sequence[str] = ()) -> DataFrame:
    """Cast every column to string; a missing cell becomes the word ``missing``.

    Columns in ``keep`` (row keys) are passed through untouched.
    """

    def as_text(name: str) -> Column:
        text = column(name).cast("string")
        return (text if missing is None else F.coalesce(text, F.lit(missing))).alias(name)

    return df.select([column(c) if c in keep else as_text(c) for c in df.columns])


def digest(cols: Sequence[str]) -> Column:
    """128 bits of the cells of the columns, each beside its length; a missing cell is like no other."""
    parts = [F.col(c).cast("string") for c in cols]
    told = (F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in parts)
    return F.unhex(F.md5(F.concat(*told).cast("binary")))


def row_text(cols: Sequence[str]) -> Column:
    """Text of a learn row: its data cells joined by one space."""
    return F.concat_ws(" ", *cells(cols))


def full_row_text(cols: Sequence[str]) -> Column:
    """Text of a new row: all cells joined by one space, empty leading cells leave no space."""
    return F.aggregate(
        F.array(*cells(cols)),
        F.lit(""),
        lambda text, cell: F.when(text == "", cell).otherwise(F.concat(text, F.lit(" "), cell)),
    )


def row_words(text: Column) -> Column:
    """Lower-case words of a row text; leading and trailing delimiters give empty words."""
    return F.split(F.lower(text), ROW_DELIMITERS)


def is_number(cell: Column) -> Column:
    return cell.rlike(NUMBER)


def cell_words(cell: Column) -> Column:
    """Lower-case words of one cell: a number is one word, else the dot is a delimiter too."""
    return F.when(is_number(cell), F.array(F.lower(cell))).otherwise(
        F.split(F.lower(cell), CELL_DELIMITERS)
    )


def space_words(text: Column) -> Column:
    """White-space separated words, case kept; no empty words and no 'None'."""
    return F.filter(F.split(text, WHITE_SPACE), lambda w: (w != "") & (w != "None"))


def strip(cell: Column) -> Column:
    return F.trim(cell, F.lit(SPACES))


def drop_spaces(cell: Column) -> Column:
    return F.regexp_replace(cell, " ", "")


def collapse_spaces(cell: Column) -> Column:
    """Delete runs of three, then of two spaces."""
    return F.regexp_replace(F.regexp_replace(cell, "   ", ""), "  ", "")


def none_to_empty(cell: Column) -> Column:
    return F.when(cell == "None", F.lit("")).otherwise(cell)


def amount(cell: Column) -> Column:
    """'1.234,56-' -> -1234.56 (dots group, comma is decimal, minus trails)."""
    plain = F.translate(strip(cell), ",.", ".")
    return F.when(plain.endswith("-"), F.concat(F.lit("-"), F.rtrim(plain, F.lit("-")))).otherwise(
        plain
    ).try_cast("double")


def day(cell: Column) -> Column:
    """'31.12.2020' -> date; null where there is no such day."""
    return F.to_date(F.try_to_timestamp(cell, F.lit("dd.MM.yyyy")))


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def timestamps_to_dates(df: DataFrame) -> DataFrame:
    stamps = (T.TimestampType, T.TimestampNTZType)
    return df.withColumns(
        {f.name: F.to_date(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, stamps)}
    )
