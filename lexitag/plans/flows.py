"""Whole runs: train from files, tag files, convert reports, the legacy cascade."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitag.operators import clean, legacy, ngrams, profile
from lexitag.operators import model as md
from lexitag.operators.existing import split_existing, split_existing_normalised
from lexitag.operators.lasting import keep
from lexitag.operators.tag import tag_rows
from lexitag.operators.words import word_table
from lexitag.sources import report, store, tables


def train_from_files(
    spark: SparkSession,
    paths: str | Sequence[str],
    folder: str,
    tag_cols: Sequence[str],
    excludes: Mapping[str, Sequence[str]] | None = None,
    rebuild: bool = False,
    with_words: bool = False,
    tokenizer: str = "row",
    keep_empty: bool = True,
    multi_line: bool = False,
) -> md.TagModel:
    """Build the tables of a model in ``folder``, each only where needed unless ``rebuild``.

    A table is needed anew if it is missing or half-written, or if the files or the settings that it
    was made of have changed since. Every table is computed from the stored one before it, so a run
    that was cut off goes on where it stopped. The word table is the largest and no later step needs
    it: it is stored on request.
    """
    files = store.files_mark(spark, paths)
    listed = {c: list(p) for c, p in (excludes or {}).items()}
    of_learn = store.fingerprint(files, listed, multi_line)
    of_words = store.fingerprint(of_learn, list(tag_cols), tokenizer, keep_empty)

    def stored(name: str, build) -> DataFrame:
        of = of_learn if name == store.LEARN else of_words
        return store.saved_or_built(spark, folder, name, build, rebuild, of)

    def learn_rows() -> DataFrame:
        rows = tables.read_table(spark, paths, listed, distinct=True, multi_line=multi_line)
        return rows.select(F.monotonically_increasing_id().alias("entry"), "*")

    learn = stored(store.LEARN, learn_rows)
    columns = [c for c in learn.columns if c != "entry"]
    missing = sorted(set(tag_cols) - set(columns))
    if missing:
        raise ValueError(f"tag columns missing from the learn table: {missing}")
    if with_words:
        stored(store.WORDS, lambda: word_table(learn, "entry", tag_cols, tokenizer))
    weights = stored(store.WEIGHTS, lambda: md.weights(learn, "entry", tag_cols, tokenizer, keep_empty))
    rated = stored(store.PROBABILITIES, lambda: md.rate_words(weights, tag_cols))
    model = md.TagModel(
        columns=columns,
        tag_cols=list(tag_cols),
        weights=weights,
        probabilities=rated.select(md.VOCABULARY),
        multi=stored(store.MULTI, lambda: md.multi_words(rated)),
        unique=stored(store.UNIQUE, lambda: md.unique_words(rated)),
    )
    stored(store.COLUMNS, lambda: store.column_names(spark, model))
    return model


def load_model(spark: SparkSession, folder: str) -> md.TagModel:
    names = store.load_table(spark, folder, store.COLUMNS).orderBy("position").collect()
    parts = (store.WEIGHTS, store.PROBABILITIES, store.UNIQUE, store.MULTI)
    weights, rated, unique, multi = (store.load_table(spark, folder, p) for p in parts)
    return md.TagModel(
        columns=[r["data_col_names"] for r in names],
        tag_cols=[r["data_col_names"] for r in names if r["is_tag"]],
        weights=weights,
        probabilities=rated.select(md.VOCABULARY),
        unique=unique,
        multi=multi,
    )


def tag_files(
    spark: SparkSession,
    paths: str | Sequence[str],
    folder: str,
    excludes: Mapping[str, Sequence[str]] | None = None,
    distinct: bool = False,
    multi_line: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(old, tagged) rows of new files against the model stored in ``folder``."""
    model = load_model(spark, folder)
    learn = store.load_table(spark, folder, store.LEARN)
    new = tables.read_table(spark, paths, excludes, distinct, multi_line)
    old, rest = split_existing(tables.with_entry(new), learn, "entry")
    return old, tag_rows(keep(rest), model, "entry")  # its stages read the new rows several times


def convert_report(
    spark: SparkSession,
    paths: str | Sequence[str],
    target: str | None = None,
    layout: str | Sequence[report.Kind] = "current",
    excludes: DataFrame | None = None,
    learn: DataFrame | None = None,
) -> DataFrame:
    """Report files -> typed rows, filtered by values and by the learn table's alignment."""
    rows = report.read_report(spark, paths, layout)
    if excludes is not None:
        keyed = rows.withColumn("_row", F.monotonically_increasing_id())  # spreads hot values
        rows = clean.exclude_values(keyed, excludes, "_row").drop("_row")
    if learn is not None:
        rows = clean.aligned_rows(rows, learn)
    if target:
        tables.write_table(rows, target)
    return rows


@dataclass
class Cascade:
    """Vocabularies of the legacy cascade."""

    relevance: DataFrame
    tags: DataFrame
    columns: DataFrame | None
    fill: DataFrame | None
    fill_cols: list[str]


def learn_cascade(
    learn: DataFrame, new: DataFrame, id_col: str, irrelevant: str = legacy.IRRELEVANT
) -> Cascade:
    """Learn from a table with Tag and Text: relevance words, tag words, column values, and
    fill values for the low-variety columns that are empty in the input."""
    relabelled = clean.relabel_relevance(learn, irrelevant)
    usable, unclear = ngrams.relevance_ngrams(relabelled)
    unique_cols, fill_cols = _unique_and_fill_columns(relabelled, new, id_col)
    fill = keep(profile.fill_values(learn, "Tag", fill_cols)) if fill_cols else None
    columns = profile.column_tags(relabelled, "Tag", unique_cols) if unique_cols else None
    return Cascade(
        relevance=keep(usable),
        tags=keep(ngrams.tag_ngrams(learn, unclear, irrelevant)),
        columns=keep(columns) if columns is not None else None,
        fill=fill,
        fill_cols=fill_cols,
    )


def _unique_and_fill_columns(relabelled: DataFrame, new: DataFrame, id_col: str) -> tuple[list[str], list[str]]:
    others = [c for c in relabelled.columns if c not in ("Tag", "Text", id_col)]
    unique_cols, other_cols = profile.unique_and_other_columns(relabelled, others)
    return unique_cols, profile.empty_columns(new, [c for c in other_cols if c in new.columns])


def save_cascade(vocabularies: Cascade, folder: str) -> None:
    names = store.LEGACY
    store.save_table(vocabularies.relevance, folder, names["relevance"])
    store.save_table(vocabularies.tags, folder, names["tags"])
    if vocabularies.columns is not None:
        store.save_column_tags(vocabularies.columns, folder)
    if vocabularies.fill is not None:
        store.save_table(vocabularies.fill, folder, names["fill"])


def load_cascade(spark: SparkSession, folder: str) -> Cascade:
    def optional(name: str) -> DataFrame | None:
        there = store.has_table(spark, folder, store.LEGACY[name])
        return store.load_table(spark, folder, store.LEGACY[name]) if there else None

    fill = optional("fill")
    return Cascade(
        relevance=store.load_table(spark, folder, store.LEGACY["relevance"]),
        tags=store.load_table(spark, folder, store.LEGACY["tags"]),
        columns=optional("columns"),
        fill=fill,
        fill_cols=store.fill_column_names(fill) if fill is not None else [],
    )


def run_cascade(
    learn: DataFrame, new: DataFrame, vocabularies: Cascade, id_col: str, by_column: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(old, tagged, conflicts): known rows, then not relevant rows, then rows with tag words,
    then rows with the most similar text. Each stage gets only what the one before left open."""
    columns = [c for c in learn.columns if c != id_col]
    old, rest, conflicts = _split_cascade(learn, new, vocabularies.fill_cols, id_col)

    rated = keep(legacy.tag_relevance(rest, vocabularies.relevance, id_col))
    tagged, left = legacy.split_tagged(rated)
    parts = [tagged]
    if by_column and vocabularies.columns is not None:
        named = [c for c in columns if c not in ("Tag", "Text") and c in new.columns]
        rated = keep(legacy.tag_by_column(left, vocabularies.columns, id_col, named))
        tagged, left = legacy.split_tagged(rated)
        parts.append(tagged)
    rated = keep(
        legacy.tag_by_ngram(
            left, vocabularies.tags, id_col, vocabularies.fill, vocabularies.fill_cols
        )
    )
    tagged, left = legacy.split_tagged(rated)
    parts.append(tagged)
    variable = profile.variable_columns(learn, [c for c in columns if c in new.columns])
    parts.append(legacy.tag_similar(left, learn, id_col, vocabularies.fill_cols, variable))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return old, result, conflicts


def old_of_cascade(learn: DataFrame, new: DataFrame, id_col: str, irrelevant: str = legacy.IRRELEVANT) -> DataFrame:
    """The known rows of ``run_cascade`` alone: no vocabulary is learned and no stage is run for them."""
    _, fill_cols = _unique_and_fill_columns(clean.relabel_relevance(learn, irrelevant), new, id_col)
    return _split_cascade(learn, new, fill_cols, id_col)[0]


def _split_cascade(
    learn: DataFrame, new: DataFrame, fill_cols: Sequence[str], id_col: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    compare, fill = profile.compare_columns(new, learn, [c for c in learn.columns if c != id_col])
    compare = [c for c in compare if c not in fill_cols]
    return split_existing_normalised(new, learn, id_col, compare, fill)
