"""Stages of the legacy cascade on a table with Tag and Text columns.

Each stage takes the rows still open and returns them with Tag, Edit and Quality set where it
found something. ``split_tagged`` then parts the rows for the next stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitag.functions import text as tx
from lexitag.operators.lasting import keep
from lexitag.operators.lookup import lookup_join
from lexitag.operators.profile import filled, joined_fill
from lexitag.operators.similar import best_of_kind
from lexitag.operators.words import text_words

IRRELEVANT = "y"  # fixed value: tag of rows that are not relevant
SURE = 0.95  # fixed value: quality over which the long texts are compared as well


def _places(rows: DataFrame) -> dict[str, str]:
    """Where the columns of a table are once it is enclosed, so that no name clashes with a computed one."""
    return {c: f"in_{i}" for i, c in enumerate(rows.columns)}


def _with_hits(rows: DataFrame, ngrams: DataFrame, id_col: str, text: str) -> DataFrame:
    """Enclosed rows with said (tag of the last known word), clash (do tags differ) and known.

    Words are looked up once per distinct text, so null and repeated row keys are rows like others.
    """
    at = _places(rows)
    inside = tx.enclosed(rows).withColumn("key", F.unhex(F.md5(at[text])))
    texts = inside.where("key is not null").select("key", at[text]).dropDuplicates(["key"])
    words = text_words(texts, "key", at[text])
    vocabulary = ngrams.select("Ngram", "ngramTag")
    hits = lookup_join(words, vocabulary, ["Ngram"], "inner", ["entry", "pos"])
    said = hits.groupBy(F.col("entry").alias("key")).agg(
        F.max_by("ngramTag", "pos").alias("said"),
        (F.min("ngramTag") != F.max("ngramTag")).alias("clash"),
    )
    joined = lookup_join(inside, keep(said), ["key"], "left", [at[id_col]])
    return joined.withColumn("clash", F.coalesce("clash", F.lit(False)))


def _marked(
    inside: DataFrame,
    rows: DataFrame,
    tagged: Column,
    tag: Column | str,
    conflict: Column,
    cells: dict[str, Column] | None = None,
) -> DataFrame:
    """``rows`` again, Tag/Edit/Quality set: '' and 1 where ``tagged``, 'NEW' and 0 where ``conflict``."""
    at = _places(rows)
    quality = F.col(at["Quality"]) if "Quality" in at else F.lit(None).cast("double")
    edit = F.col(at["Edit"]) if "Edit" in at else F.lit("")
    tag = F.lit(tag) if isinstance(tag, str) else tag
    new = {
        "Tag": F.when(tagged, tag).otherwise(F.col(at["Tag"])),
        "Edit": F.when(conflict, "NEW").when(tagged, "").otherwise(edit),
        "Quality": F.when(conflict, 0.0).when(tagged, 1.0).otherwise(quality),
    }
    return _reopened(inside, rows, (cells or {}) | new)


def _reopened(inside: DataFrame, rows: DataFrame, new: dict[str, Column]) -> DataFrame:
    at = _places(rows)
    names = [*at, *(c for c in ("Edit", "Quality") if c not in at)]
    return inside.select([(new[c] if c in new else F.col(at[c])).alias(c) for c in names])


def split_tagged(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a tag, rows without one); a null tag is none."""
    tagged = F.coalesce(F.col("Tag"), F.lit("")) != ""
    return rows.where(tagged), rows.where(~tagged)


def tag_relevance(rows: DataFrame, ngrams: DataFrame, id_col: str, text: str = "Text") -> DataFrame:
    """Tag rows whose known words all say not_relevant; words of both kinds mark the row NEW."""
    inside = _with_hits(rows, ngrams, id_col, text)
    conflict = F.col("clash")
    irrelevant = F.coalesce(F.col("said") == "not_relevant", F.lit(False)) & ~conflict
    return _marked(inside, rows, irrelevant, IRRELEVANT, conflict)


def tag_by_ngram(
    rows: DataFrame,
    ngrams: DataFrame,
    id_col: str,
    fill: DataFrame | None = None,
    fill_cols: Sequence[str] = (),
    text: str = "Text",
) -> DataFrame:
    """Tag rows whose known words all name one tag and fill their empty companion cells."""
    at = _places(rows)
    inside = _with_hits(rows, ngrams, id_col, text)
    tagged = F.col("said").isNotNull() & ~F.col("clash")
    cells = {}
    if fill is not None and fill_cols:
        inside = joined_fill(inside.withColumn("tag", F.when(tagged, F.col("said"))), fill, fill_cols, at[id_col])
        cells = {c: filled(F.col(at[c]), F.col(f"fill_{i}")) for i, c in enumerate(fill_cols)}
    return _marked(inside, rows, tagged, F.col("said"), F.col("clash"), cells)


def tag_by_column(rows: DataFrame, column_tags: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    """Tag rows in which some cell is a value of a not_relevant column vocabulary."""
    at = _places(rows)
    inside = tx.enclosed(rows).withColumn("key", tx.digest([at[c] for c in cols]))
    cells = [F.struct(F.lit(c).alias("col"), F.col(at[c]).cast("string").alias("val")) for c in cols]
    long = inside.dropDuplicates(["key"]).select("key", F.explode(F.array(*cells)).alias("cell")).select("key", "cell.*")
    said = column_tags.where(F.col("Tag") == "not_relevant").select("col", "val")
    hits = lookup_join(long, said, ["col", "val"], "left_semi", ["key"])
    found = keep(hits.select("key").distinct().withColumn("hit", F.lit(True)))
    joined = lookup_join(inside, found, ["key"], "left", [at[id_col]])
    return _marked(joined, rows, F.coalesce("hit", F.lit(False)), IRRELEVANT, F.lit(False))


def _spaceless(cell: Column) -> Column:
    return tx.drop_spaces(F.coalesce(cell.cast("string"), F.lit("None")))


def _nearest(asked: DataFrame, learned: DataFrame, ratio: str, taken: str) -> DataFrame:
    """(kind, token), (kind, word, row, taken) -> (key, ratio, taken): the cells taken from the first learn
    row with the most similar text of the kind, by a digest of kind and text."""
    first = learned.groupBy("kind", "word").agg(F.min_by("taken", "row").alias(taken))
    near = keep(best_of_kind(asked, learned.select("kind", "word")))
    matched = lookup_join(near, first, ["kind", "word"], "inner", ["token"])
    key = tx.digest(["kind", "token"]).alias(f"{ratio}_key")
    return keep(matched.select(key, F.round("similarity", 2).alias(ratio), taken))


def tag_similar(
    rows: DataFrame,
    learn: DataFrame,
    id_col: str,
    fill_cols: Sequence[str] = (),
    variable: Sequence[str] = (),
    text: str = "Text",
) -> DataFrame:
    """Tag and Quality of the learn row with the most similar text, empty cells filled from it.

    Texts are compared without spaces. If that quality is over 0.95 and ``variable`` columns are
    given, the joined texts of these columns decide instead where they reach a better quality.
    Only the columns in which an input row has more than one character take part for that row,
    on both sides. Which these are is the kind of a joined text: the learn texts are built once per
    kind that occurs, and one join by kind serves all of them.
    """
    at, learn_at = _places(rows), _places(learn)
    take = ["Tag", *[c for c in fill_cols if c != "Tag"]]
    wide = [F.col(learn_at[c]) for c in variable]
    learned = tx.enclosed(learn).select(
        F.col(learn_at[id_col]).alias("row"),
        F.lit("").alias("kind"),
        _spaceless(F.col(learn_at[text])).alias("word"),
        F.struct(*[F.col(learn_at[c]).alias(f"t_{i}") for i, c in enumerate(take)]).alias("taken"),
        F.array(*[_spaceless(c) for c in wide]).cast("array<string>").alias("cells"),
    )
    inside = tx.enclosed(rows).withColumns({"kind": F.lit(""), "token": _spaceless(F.col(at[text]))})
    inside = inside.withColumn("short_key", tx.digest(["kind", "token"]))
    short = _nearest(inside.select("kind", "token"), learned, "short", "short_taken")
    joined = lookup_join(inside, short, ["short_key"], "left", [at[id_col]])
    ratio, taken = F.col("short"), F.col("short_taken")

    if variable:
        cells = [_spaceless(F.col(at[c])) for c in variable]
        used = [F.col(at[c]).isNotNull() & (F.length(cell) > 1) for c, cell in zip(variable, cells)]
        kind = F.concat(*[u.cast("int").cast("string") for u in used])
        whole = F.concat(*[F.when(u, cell).otherwise("") for u, cell in zip(used, cells)])
        sure = F.coalesce(F.col("short") > SURE, F.lit(False)) & kind.contains("1")
        joined = joined.withColumns({"kind": F.when(sure, kind), "token": F.when(sure, whole)})
        asked = keep(joined.where("kind is not null").select("kind", "token").distinct())
        kinds = asked.agg(F.collect_set("kind"))  # a matter of the columns, not of the rows
        flagged = lambda cell, i: F.when(F.substr("kind", i + 1, F.lit(1)) == "1", cell).otherwise("")
        long_learned = (
            learned.withColumn("kinds", kinds.scalar())
            .withColumn("kind", F.explode("kinds"))
            .withColumn("word", F.array_join(F.transform("cells", flagged), ""))
        )
        long = _nearest(asked, long_learned, "long", "long_taken")
        joined = joined.withColumn("long_key", F.when(F.col("kind").isNotNull(), tx.digest(["kind", "token"])))
        joined = lookup_join(joined, long, ["long_key"], "left", [at[id_col]])
        better = F.coalesce(F.col("long") > F.col("short"), F.lit(False))
        ratio = F.when(better, F.col("long")).otherwise(ratio)
        taken = F.when(better, F.col("long_taken")).otherwise(taken)

    new = {
        "Tag": F.coalesce(taken["t_0"], F.lit("")),
        "Quality": F.coalesce(ratio, F.lit(0.0)),
        **({} if "Edit" in at else {"Edit": F.lit("")}),
        **{c: filled(F.col(at[c]), taken[f"t_{i}"]) for i, c in enumerate(take) if c != "Tag"},
    }
    return _reopened(joined, rows, new)
