"""Rows to words: the token tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitag.functions import text as tx


def learn_words(data_cols: Sequence[str], tokenizer: str = "row") -> Column:
    """Array of the words of a learn row: whole-row split, or number-aware split per cell."""
    if tokenizer == "row":
        return tx.row_words(tx.row_text(data_cols))
    if tokenizer == "cell":
        return F.flatten(F.array(*[tx.cell_words(F.col(f"`{c}`")) for c in data_cols]))
    raise ValueError(f"unknown tokenizer {tokenizer!r}")


def unpivot_tags(df: DataFrame, ids: Sequence[str], tag_cols: Sequence[str]) -> DataFrame:
    """One row per tag column: ``ids``, tag_col, tag."""
    return df.unpivot(tx.cells(ids), tx.cells(tag_cols), "tag_col", "tag")


def word_table(
    learn: DataFrame, id_col: str, tag_cols: Sequence[str], tokenizer: str = "row"
) -> DataFrame:
    """(entry, word, tag_col, tag): every word of every learn row beside each of its tags."""
    learn = tx.stringify(learn, keep=[id_col])
    data_cols = [c for c in learn.columns if c not in tag_cols and c != id_col]
    words = learn.select(
        F.col(id_col).alias("entry"),
        F.explode(learn_words(data_cols, tokenizer)).alias("word"),
        *tx.cells(tag_cols),
    )
    return unpivot_tags(words, ["entry", "word"], tag_cols)


def new_row_words(new: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """(entry, word): the distinct words of every new row over all its cells."""
    words = F.array_distinct(tx.row_words(tx.full_row_text(columns)))
    return new.select(F.col(id_col).alias("entry"), F.explode(words).alias("word"))


def text_words(df: DataFrame, id_col: str, text: str = "Text") -> DataFrame:
    """(entry, pos, Ngram): the white-space separated words of a text column, in order."""
    return df.where(F.col(text).isNotNull()).select(
        F.col(id_col).alias("entry"), F.posexplode(tx.space_words(F.col(text))).alias("pos", "Ngram")
    )


def tagged_words(df: DataFrame, tag: str = "Tag", text: str = "Text") -> DataFrame:
    """(ngramTag, Ngram): one row per word occurrence; rows without a tag give none."""
    return df.where(F.col(text).isNotNull() & F.col(tag).isNotNull() & (F.col(tag) != "None")).select(
        F.col(tag).alias("ngramTag"), F.explode(tx.space_words(F.col(text))).alias("Ngram")
    )
