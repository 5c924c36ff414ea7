"""Row filters, relabelling and result columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitag.functions import text as tx
from lexitag.functions.quality import quality_band
from lexitag.operators.lookup import lookup_join


#: What a pattern means beyond its own place in a larger one: a group's number or name, an open quote.
_NUMBERED = re.compile(r"\\[0-9KQ]|\(\?<[A-Za-z]")


#: Patterns of plain characters, perhaps at the end of the cell only, which may share their starts.
_PLAIN = re.compile(r"[A-Z0-9 _]+\$?")
_NESTED = 16  # levels of groups at most


def _shared(tails: list[str], levels: int = _NESTED) -> str:
    """An expression found where one of the plain ``tails`` is; starts they share are written once.

    So a place in a cell is compared with a few characters a level, however many tails there are.
    """
    if "" in tails:  # found here, whatever follows
        return ""
    by_first: dict[str, list[str]] = {}
    for tail in tails:
        by_first.setdefault(tail[0], []).append(tail[1:])
    parts = []
    for char, rest in by_first.items():
        one = len(rest) == 1
        parts.append(char + (rest[0] if one else _shared(rest, levels - 1) if levels else f"(?:{'|'.join(rest)})"))
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def _alternations(patterns: Iterable[str]) -> list[str]:
    """The patterns as one alternation; those that may not stand beside others follow one by one."""
    wanted = list(dict.fromkeys(p.upper() for p in patterns if p))
    alone = [p for p in wanted if _NUMBERED.search(p)]
    free = [p for p in wanted if not _NUMBERED.search(p)]
    plain = [p for p in free if _PLAIN.fullmatch(p)]
    others = [f"(?:{p})" for p in free if not _PLAIN.fullmatch(p)]
    return (["|".join(([_shared(plain)] if plain else []) + others)] if free else []) + alone


def exclude_patterns(df: DataFrame, patterns: Mapping[str, Iterable[str]]) -> DataFrame:
    """Drop rows in which a pattern is found in the cell of its column.

    Patterns are upper-cased, cells are not. Empty patterns and unknown columns are passed
    over; a missing cell of a column that has patterns drops the row. The plan has one filter
    per column, however long the list.
    """
    for name, column_patterns in patterns.items():
        if name not in df.columns:
            continue
        cell = tx.column(name).cast("string")
        for pattern in _alternations(column_patterns):
            df = df.where(~cell.rlike(pattern))
    return df


def exclude_values(df: DataFrame, values: DataFrame, id_col: str) -> DataFrame:
    """Drop rows whose cell is one of the values listed in the column of the same name."""
    for name in values.columns:
        if name not in df.columns:
            continue
        listed = values.select(F.col(f"`{name}`").cast("string").alias("_cell"))
        listed = listed.where("_cell is not null").distinct()
        keyed = df.withColumn("_cell", F.col(f"`{name}`").cast("string"))
        df = lookup_join(keyed, listed, ["_cell"], "left_anti", [id_col]).drop("_cell")
    return df


def constant_lengths(learn: DataFrame) -> dict[str, int]:
    """Text columns whose cells all have one length, with that length; one pass, one row back."""
    names = [f.name for f in learn.schema.fields if tx.is_text(learn, f.name)]
    if not names:
        return {}
    sizes = [F.length(F.col(f"`{c}`")) for c in names]
    row = learn.agg(*[F.min(s) for s in sizes], *[F.max(s) for s in sizes]).first()
    lows, highs = row[: len(names)], row[len(names) :]
    return {n: lo for n, lo, hi in zip(names, lows, highs) if lo is not None and lo == hi}


def aligned_rows(df: DataFrame, learn: DataFrame) -> DataFrame:
    """Keep rows whose cells have exactly the word characters of a constant-length learn column."""
    for name, size in constant_lengths(learn).items():
        if name in df.columns:
            df = df.where(F.col(f"`{name}`").rlike(rf"(?U)^\w{{{size}}}\n?\z"))
    return df


def drop_sparse_rows(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """Drop rows with fewer than three filled cells (a null, '' or 'None' cell is empty)."""
    names = [c for c in df.columns if c != id_col]
    cells = [F.col(f"`{c}`").cast("string") for c in names]
    empty = sum((F.when(c.isNull() | c.isin("", "None"), 1).otherwise(0) for c in cells), F.lit(0))
    return df.where(empty <= len(names) - 3)


def none_cells_to_empty(df: DataFrame) -> DataFrame:
    names = [f.name for f in df.schema.fields if tx.is_text(df, f.name)]
    return df.withColumns({c: tx.none_to_empty(F.col(f"`{c}`")) for c in names})


def relabel_relevance(
    df: DataFrame, irrelevant: str, tag: str = "Tag", text: str = "Text"
) -> DataFrame:
    """Rows with text, tag reduced to not_relevant / relevant, text in upper case."""
    label = F.when(F.col(tag) == irrelevant, "not_relevant").otherwise("relevant")
    return df.where(F.col(text).isNotNull()).withColumns({tag: label, text: F.upper(text)})


def distinct_rows(df: DataFrame, id_col: str) -> DataFrame:
    """One row per set of equal cells, with its smallest row key."""
    names = [c for c in df.columns if c != id_col]
    first = df.groupBy(*tx.cells(names)).agg(F.min(id_col).alias(id_col))
    return first.select(tx.cells(df.columns))


def result_columns(df: DataFrame, columns: Sequence[str], id_col: str | None = None) -> DataFrame:
    """Result layout: the learn columns, TB_edit ('y' unless set), TB_qual and its band."""
    edit = F.col("TB_edit") if "TB_edit" in df.columns else F.lit("y")
    return tx.timestamps_to_dates(df).select(
        *([id_col] if id_col else []),
        *tx.cells(columns),
        edit.alias("TB_edit"),
        "TB_qual",
        quality_band(F.col("TB_qual")).alias("quality_band"),
    )
