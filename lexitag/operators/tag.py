"""Tag new rows in three stages: unique words, ambiguous words, similar words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexitag.functions import text as tx
from lexitag.operators.lasting import keep
from lexitag.operators.lookup import lookup_join
from lexitag.operators.model import TagModel
from lexitag.operators.similar import similar_words


def _decided(hits: DataFrame, tag_cols: Sequence[str], quality: Column) -> DataFrame:
    """Tags count only if there are at least as many hit rows as tag columns; else quality 1."""
    enough = F.col("hits") >= len(tag_cols)
    return hits.select(
        "entry",
        F.when(enough, F.col("tags")).alias("tags"),
        F.when(enough, quality).otherwise(1).cast("int").alias("qual"),
    )


def _per_tag_col(tag_cols: Sequence[str], choose) -> Column:
    """Struct ``tags`` with one field per tag column: ``choose(condition on tag_col)``."""
    return F.struct(*[choose(F.col("tag_col") == c).alias(c) for c in tag_cols]).alias("tags")


def unique_stage(words: DataFrame, unique: DataFrame, tag_cols: Sequence[str]) -> DataFrame:
    """(entry, tags, qual) of the rows with a word that has one tag; the largest tag wins.

    The vocabulary is widened to one row per word first (a word has at most one row per tag
    column there), so a word occurrence meets one row.
    """
    wide = unique.groupBy("word").agg(
        F.count(F.lit(1)).alias("hits"),
        _per_tag_col(tag_cols, lambda here: F.max(F.when(here, F.col("tag")))),
    )
    hits = (
        lookup_join(words, wide, ["word"], "inner", ["entry"], measured=unique, sift=True)
        .groupBy("entry")
        .agg(
            F.sum("hits").alias("hits"),
            F.struct(*[F.max(f"tags.`{c}`").alias(c) for c in tag_cols]).alias("tags"),
        )
    )
    return _decided(hits, tag_cols, F.lit(100))


def multi_stage(words: DataFrame, multi: DataFrame, tag_cols: Sequence[str]) -> DataFrame:
    """(entry, tags, qual) from the ambiguous words of a row.

    A word brings a row per tag it occurs with, so the work is done once per set of ambiguous
    words: rows with the same set, as all copies of a row have, share one result. A set goes by a
    digest, and its hits by the smallest row key that has it, so no hit carries the words.
    """
    ambiguous = multi.select("word").distinct()
    known = lookup_join(words, ambiguous, ["word"], "left_semi", ["entry"], measured=multi, sift=True)
    sets = keep(
        known.groupBy("entry")
        .agg(F.array_sort(F.collect_list("word")).alias("words"))
        .withColumn("digest", F.sha2(F.array_join("words", " "), 256))
    )
    first = keep(
        sets.groupBy("digest").agg(F.min("entry").alias("entry"), F.min_by("words", "entry").alias("words"))
    )
    decided = _decided_sets(first.select("entry", "words"), multi, tag_cols)
    by_digest = keep(decided.join(first.select("entry", "digest"), "entry").drop("entry"))
    asked = sets.select("entry", "digest")
    return lookup_join(asked, by_digest, ["digest"], "inner", ["entry"]).select("entry", "tags", "qual")


def _decided_sets(sets: DataFrame, multi: DataFrame, tag_cols: Sequence[str]) -> DataFrame:
    """(entry, words) -> (entry, tags, qual).

    Hits are ranked by falling (probability, word); the later a tag first appears, the stronger
    it is, so per tag column the tag with the lowest best hit wins, the larger tag on a tie.
    The quality is the highest probability. All three aggregates share one shuffle.
    """
    looked_up = multi.select("word", "tag_col", "tag", "probability")
    words = sets.select("entry", F.explode("words").alias("word"))
    hits = lookup_join(words, looked_up, ["word"], "inner", ["entry"]).repartition("entry")
    best_of_tag = hits.groupBy("entry", "tag_col", "tag").agg(
        F.max(F.struct("probability", "word")).alias("best"), F.count(F.lit(1)).alias("hits")
    )
    of_best = best_of_tag.groupBy("entry", "tag_col", "best").agg(
        F.max("tag").alias("tag"), F.sum("hits").alias("hits")
    )
    per_set = of_best.groupBy("entry").agg(
        F.sum("hits").alias("hits"),
        F.max("best.probability").alias("probability"),
        _per_tag_col(tag_cols, lambda here: F.min_by("tag", F.when(here, F.col("best")))),
    )
    return _decided(per_set, tag_cols, F.col("probability"))


def similar_stage(rows: DataFrame, unique: DataFrame, tag_cols: Sequence[str]) -> DataFrame:
    """(entry, tags, qual) from the vocabulary words most similar to a row's words.

    ``rows`` is (entry, words). The best len(tag_cols) candidate rows of a row are ranked by
    falling (similarity, vocabulary word), then word position, tag and tag column. Per tag
    column the tag that first appears last wins; TB_qual is the best similarity in percent.
    """
    count = len(tag_cols)
    asked = rows.select("entry", F.posexplode("words").alias("pos", "token"))
    asked = asked.where(F.length("token") > 4)
    near = similar_words(asked.select("token"), unique.select("word"), count)
    per_token = Window.partitionBy("token").orderBy(
        F.desc("similarity"), F.desc("word"), "tag", "tag_col"
    )
    candidates = (
        lookup_join(near, unique.select("word", "tag", "tag_col"), ["word"], "inner", ["token"])
        .withColumn("place", F.row_number().over(per_token))
        .where(F.col("place") <= count)
        .drop("place")
    )
    per_row = Window.partitionBy("entry").orderBy(
        F.desc("similarity"), F.desc("word"), "pos", "tag", "tag_col"
    )
    top = (
        lookup_join(asked, keep(candidates), ["token"], "inner", ["entry", "pos"])
        .withColumn("place", F.row_number().over(per_row))
        .where(F.col("place") <= count)
    )
    first_seen = top.groupBy("entry", "tag_col", "tag").agg(
        F.min("place").alias("place"),
        F.max("similarity").alias("similarity"),
        F.count(F.lit(1)).alias("hits"),
    )
    hits = first_seen.groupBy("entry").agg(
        F.sum("hits").alias("hits"),
        F.max("similarity").alias("similarity"),
        _per_tag_col(tag_cols, lambda here: F.max_by("tag", F.when(here, F.col("place")))),
    )
    return _decided(hits, tag_cols, (F.col("similarity") * 100).cast("int"))


def tag_rows(
    new: DataFrame,
    model: TagModel,
    id_col: str,
    stages: Sequence[str] = ("unique", "multi", "similar"),
) -> DataFrame:
    """New rows, as text, with their tags and TB_qual in learn column order.

    A row is decided in the first stage that finds a hit for it. A row without any hit keeps
    null tags and TB_qual 0. Stages see distinct rows as a key and their words; the cells are
    joined to what was decided once, at the end. The key is a digest of row key and cells, so null
    and repeated row keys are served like others, and rows alike in all of them get the same tags.
    The words of all rows are neither written nor shuffled, unless rows repeat: the first stage
    takes them as they are read, and later ones get those of the rows still open.
    """
    names = list(new.columns)
    rows = tx.enclosed(tx.stringify(new, keep=[id_col]))
    inner = {c: f"in_{i}" for i, c in enumerate(names)}
    columns = [inner[c] for c in names if c != id_col]
    rows = rows.withColumn("entry", tx.digest([inner[id_col], *columns]))
    lookups = {
        "unique": (unique_stage, model.unique),
        "multi": (multi_stage, model.multi),
        "similar": (similar_stage, model.unique),
    }
    open_rows, parts = rows.select("entry", tx.row_words(tx.full_row_text(columns)).alias("words")), []
    entries = keep(rows.groupBy("entry").agg(F.count(F.lit(1)).alias("copies")))
    if not entries.where("copies > 1").isEmpty():
        open_rows = keep(open_rows.dropDuplicates(["entry"]))
    entries = entries.select("entry")
    for name in stages:
        asked = open_rows
        if name != "similar":
            asked = open_rows.select("entry", F.explode(F.array_distinct("words")).alias("word"))
        stage, vocabulary = lookups[name]
        part = stage(asked, vocabulary, model.tag_cols)
        if name != stages[-1]:
            part = keep(part)
            entries = keep(entries.join(part.select("entry"), "entry", "left_anti"))
            open_rows = keep(lookup_join(open_rows, entries, ["entry"], "left_semi", hot=[]))
        parts.append(part)
    decided = parts[0]
    for part in parts[1:]:
        decided = decided.unionByName(part)
    # rows of one entry are alike, so nothing could split them: no hot keys are looked for
    found = lookup_join(rows, keep(decided), ["entry"], "left", hot=[])
    return found.select(
        F.col(inner[id_col]).alias(id_col),
        *[
            (F.col("tags")[c] if c in model.tag_cols else F.col(inner[c])).alias(c)
            for c in model.columns
        ],
        F.coalesce("qual", F.lit(0)).alias("TB_qual"),
    )


def tag_summary(old: DataFrame, tagged: DataFrame) -> DataFrame:
    """One row of counts: input, known, new, tagged, unclear (quality 1) and untagged rows."""
    known = old.agg(F.count(F.lit(1)).alias("known"))
    quality = F.col("TB_qual")
    new = tagged.agg(
        F.count(F.lit(1)).alias("new"),
        F.count(F.when(quality > 1, 1)).alias("tagged"),
        F.count(F.when(quality == 1, 1)).alias("unclear"),
        F.count(F.when(quality == 0, 1)).alias("untagged"),
    )
    return new.withColumn("known", known.scalar()).select(
        (F.col("known") + F.col("new")).alias("input"), "known", "new", "tagged", "unclear", "untagged"
    )
