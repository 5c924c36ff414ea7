"""Word/tag counts, probabilities and the two vocabularies.

Counts are aggregated before they are unpivoted, so the shuffle carries one row per
(word, tag combination) and task whatever the number of tag columns. The statistics of a word
are windows over its rows only while tags are too few to make a word hot; else aggregates with
map-side combine joined back: a word that occurs with nearly all tags does not end up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexitag.functions import text as tx
from lexitag.operators.lasting import keep
from lexitag.operators import lookup
from lexitag.operators.words import learn_words, unpivot_tags


def weights(
    learn: DataFrame,
    id_col: str,
    tag_cols: Sequence[str],
    tokenizer: str = "row",
    keep_empty: bool = True,
) -> DataFrame:
    """(tag, tag_col, word, count): occurrences of each word beside each tag."""
    missing = set(tag_cols) - set(learn.columns)
    if missing or not tag_cols:
        raise ValueError(f"tag columns missing from the learn table: {sorted(missing)}")
    learn = tx.stringify(learn, keep=[id_col])
    data_cols = [c for c in learn.columns if c not in tag_cols and c != id_col]
    tags = tx.cells(tag_cols)
    words = learn.select(F.explode(learn_words(data_cols, tokenizer)).alias("_word"), *tags)
    if not keep_empty:
        words = words.where("_word <> ''")
    counted = words.groupBy("_word", *tags).agg(F.count(F.lit(1)).alias("_count"))
    return (
        unpivot_tags(counted, ["_word", "_count"], tag_cols)
        .groupBy("tag", "tag_col", F.col("_word").alias("word"))
        .agg(F.sum("_count").alias("count"))
    )


def weights_of_words(words: DataFrame) -> DataFrame:
    """The same counts from a stored word table."""
    return words.groupBy("tag", "tag_col", "word").agg(F.count("entry").alias("count"))


def rate_words(weights: DataFrame, tag_cols: Sequence[str]) -> DataFrame:
    """Weights + probability 0..100 of the tag given the word, + ``tags`` and ``lowest``: number
    of tags and smallest tag of the word in that tag column, which tell the vocabularies apart.

    The rows of a word are taken in (tag, tag_col) order. The first keeps 100. With three or
    more rows, each later row gets its share of the later rows' counts; a tag that occurs in
    several tag columns among them is rated in the first of these columns only, the rest stay
    100.

    Words have a row per tag at most. Where there are fewer tags than make a hot key, all of it is
    windows over the rows of a word, in one shuffle and sort; else one aggregate per word and one
    join back, from which words with at most one tag per tag column and fewer than three rows, the
    great majority, stay out.
    """
    shared, tags = _tags_told(weights)
    in_col = {c: F.col("tag_col") == c for c in tag_cols}
    of_word = {
        "first": F.min(F.struct("tag", "tag_col", "count")),
        "total": F.sum("count"),
        "rows": F.count(F.lit(1)),
    }
    counts = {f"rows_{i}": F.count(F.when(here, 1)) for i, here in enumerate(in_col.values())}
    lows = {f"low_{i}": F.min(F.when(here, F.col("tag"))) for i, here in enumerate(in_col.values())}
    of_word |= counts | lows
    in_tag = Window.partitionBy("word", "tag").orderBy("tag_col")
    same_tag = F.col("tag") == F.col("first.tag")
    is_first = same_tag & (F.col("tag_col") == F.col("first.tag_col"))
    # the place of a row among the rows of its word and tag: at most one per tag column
    first_place = F.col("place") - same_tag.cast("int") == 1
    rated = (F.col("rows") >= 3) & ~is_first
    if tags < lookup.HOT_ROWS:
        in_word = Window.partitionBy("word")
        placed = weights.repartition("word").withColumn("place", F.row_number().over(in_tag))
        told = placed.withColumns({name: value.over(in_word) for name, value in of_word.items()})
        rated = rated & first_place
    else:
        if shared:
            weights = weights.withColumn("place", F.row_number().over(in_tag))
            rated = rated & first_place
        many = F.col("rows") >= 3
        for name in counts:
            many = many | (F.col(name) > 1)
        words = weights.groupBy("word").agg(*[value.alias(name) for name, value in of_word.items()])
        told = lookup.salted_join(weights, words.where(many), ["word"], "left", ["tag", "tag_col"])
    share = F.col("count").cast("double") / (F.col("total") - F.col("first.count")) * 100
    place_of_col = F.array_position(F.lit(list(tag_cols)), F.col("tag_col")).cast("int")
    return told.select(
        "tag",
        "tag_col",
        "word",
        "count",
        F.when(rated, F.rint(share).cast("int")).otherwise(100).alias("probability"),
        F.coalesce(F.get(F.array(*counts), place_of_col - 1), F.lit(1)).alias("tags"),
        F.coalesce(F.get(F.array(*lows), place_of_col - 1), "tag").alias("lowest"),
    )


VOCABULARY = ["tag", "tag_col", "word", "count", "probability"]


def probabilities(weights: DataFrame, tag_cols: Sequence[str]) -> DataFrame:
    return rate_words(weights, tag_cols).select(VOCABULARY)


def _tags_told(weights: DataFrame) -> tuple[bool, int]:
    """Does some tag name occur in more than one tag column? How many tags are there? (one row comes back)"""
    columns = weights.select("tag", "tag_col").distinct().groupBy("tag").agg(F.count(F.lit(1)).alias("columns"))
    told = columns.agg(F.max("columns").alias("most"), F.sum("columns").alias("tags")).first()
    return (told["most"] or 0) > 1, told["tags"] or 0


def ambiguous_words(probabilities: DataFrame) -> DataFrame:
    """Words with more than one probability row and the number of these rows."""
    counted = probabilities.groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    return counted.where(F.col("count") > 1)


def unique_words(rated: DataFrame) -> DataFrame:
    """Rows of words with exactly one tag in a tag column."""
    return rated.where("tags = 1").select(VOCABULARY)


def multi_words(rated: DataFrame) -> DataFrame:
    """All but the smallest tag of every (word, tag column)."""
    return rated.where("tag > lowest").select(VOCABULARY)


@dataclass
class TagModel:
    """What was learned: the tables, the learn columns in order and the tag columns."""

    columns: list[str]
    tag_cols: list[str]
    weights: DataFrame
    probabilities: DataFrame
    unique: DataFrame
    multi: DataFrame


def train(
    learn: DataFrame,
    id_col: str,
    tag_cols: Sequence[str],
    tokenizer: str = "row",
    keep_empty: bool = True,
) -> TagModel:
    """Learn from ``learn`` (cells are taken as text, a missing one as 'nan'; one row key).

    Two tables are kept: the counts, and the rated words that the vocabularies are filters of.
    """
    counted = keep(weights(learn, id_col, tag_cols, tokenizer, keep_empty))
    rated = keep(rate_words(counted, tag_cols))
    return TagModel(
        columns=[c for c in learn.columns if c != id_col],
        tag_cols=list(tag_cols),
        weights=counted,
        probabilities=rated.select(VOCABULARY),
        unique=unique_words(rated),
        multi=multi_words(rated),
    )


def vocabulary_summary(model: TagModel) -> DataFrame:
    """One row of counts: probability rows, ambiguous words, vocabulary sizes, certain words."""
    one = F.lit(1)
    per_word = model.probabilities.groupBy("word").agg(F.count(one).alias("rows"))
    sizes = per_word.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("probability_rows"),
        F.count(F.when(F.col("rows") > 1, one)).alias("ambiguous_words"),
    )
    unique = model.unique.agg(
        F.count(one).alias("unique_rows"), F.count(F.when(F.col("probability") > 99.9, one)).alias("certain_rows")
    )
    multi = model.multi.agg(F.count(one).alias("multi_rows"))
    return sizes.select(
        "probability_rows",
        "ambiguous_words",
        unique.select("unique_rows").scalar().alias("unique_rows"),
        unique.select("certain_rows").scalar().alias("certain_rows"),
        multi.scalar().alias("multi_rows"),
    )
