"""Split input rows into rows the learn table already holds and new rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitag.functions import text as tx
from lexitag.operators.lasting import keep
from lexitag.operators.lookup import hot_keys, salted_join


def split_existing(new: DataFrame, learn: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(old, rest) of ``new``: old rows equal a learn row in all input columns, letter case aside.

    An old row is the first (smallest key) such learn row with its cells, TB_edit 'OLD' and
    TB_qual 100, under the input's row key. Cells are taken as text, so two missing ones are equal.
    The learn table is grouped once and the input read once: one join by a digest of the columns,
    whose result is kept and then split. Null and repeated row keys are rows like others.
    """
    unknown = set(new.columns) - {id_col} - set(learn.columns)
    if unknown:
        raise ValueError(f"input columns missing from the learn table: {sorted(unknown)}")
    names, learn_names = list(new.columns), list(learn.columns)
    new, learn = (tx.enclosed(tx.stringify(df, keep=[id_col])) for df in (new, learn))
    at = {c: f"in_{i}" for i, c in enumerate(names)}
    learn_at = {c: f"in_{i}" for i, c in enumerate(learn_names)}
    columns = [c for c in names if c != id_col]
    carried = [c for c in learn_names if c != id_col]
    keys = ["_digest0", "_digest1"]

    def digests(places: dict[str, str]) -> dict[str, Column]:
        upper = [F.upper(places[c]) for c in columns]
        return {k: F.xxhash64(F.lit(i), *upper) for i, k in enumerate(keys)}

    row = F.struct(*[F.col(learn_at[c]).alias(f"l_{i}") for i, c in enumerate(carried)])
    key = F.col(learn_at[id_col])
    first = learn.withColumns(digests(learn_at)).groupBy(*keys).agg(
        F.min_by(row, F.struct(key.isNull(), key)).alias("_row")
    )
    asked = new.withColumns(digests(at))
    joined = salted_join(asked, first, keys, "left", [at[id_col]], hot_keys(asked, keys))
    same = F.col("_row").isNotNull()  # digests only bring rows together
    for c in columns:
        same = same & (F.upper(at[c]) == F.upper(F.col("_row")[f"l_{carried.index(c)}"]))
    joined = keep(joined.withColumn("_known", F.coalesce(same, F.lit(False))).drop(*keys))
    own = F.col(at[id_col]).alias(id_col)
    old = joined.where("_known").select(
        own,
        *[F.col("_row")[f"l_{i}"].alias(c) for i, c in enumerate(carried)],
        F.lit("OLD").alias("TB_edit"),
        F.lit(100).alias("TB_qual"),
    )
    return old, joined.where("not _known").select([F.col(at[c]).alias(c) for c in names])


def split_existing_normalised(
    new: DataFrame,
    learn: DataFrame,
    id_col: str,
    compare: Sequence[str],
    fill: Sequence[str],
    tag: str = "Tag",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(old, rest, conflicts) by the compare columns without spaces and letter case.

    Old rows take the fill columns (spaces removed, 'None' emptied) of the first matching learn
    row, Edit 'OLD' and Quality 1; rest rows get Edit ''. Conflicts are the matching learn rows
    whose key carries other than exactly one tag.
    """
    compare = [c for c in compare if c != tag and c not in fill]

    def key(df: DataFrame, name: str) -> Column:
        cell = F.col(f"`{name}`")
        return F.upper(tx.drop_spaces(cell)) if tx.is_text(df, name) else cell

    names = [f"_key{i}" for i in range(len(compare))]
    new_keys = {n: key(new, c) for n, c in zip(names, compare)}
    learn_keys = {n: key(learn, c) for n, c in zip(names, compare)}

    def filled(name: str) -> Column:
        cell = F.col(f"`{name}`")
        return tx.none_to_empty(tx.drop_spaces(cell)) if tx.is_text(learn, name) else cell

    keyed = learn.withColumns(learn_keys)
    values = F.struct(*[filled(c).alias(c) for c in fill])
    first = keyed.groupBy(*names).agg(F.min_by(values, id_col).alias("_row"))
    asked = new.withColumns(new_keys)
    hot = hot_keys(asked, names)
    old = salted_join(asked, first, names, "inner", [id_col], hot).select(
        id_col,
        *[
            F.col(f"_row.`{c}`" if c in fill else f"`{c}`")
            for c in new.columns
            if c != id_col
        ],
        F.lit("OLD").alias("Edit"),
        F.lit(1.0).alias("Quality"),
    )
    known = keyed.select(*names).distinct()
    rest = salted_join(asked, known, names, "left_anti", [id_col], hot).select(
        *tx.cells(new.columns), F.lit("").alias("Edit")
    )
    tags = keyed.groupBy(*names).agg(F.min(tag).alias("_low"), F.max(tag).alias("_high"))
    unclear = tags.where("_low is null or _low <> _high").select(*names)
    met = unclear.join(asked.select(*names).distinct(), names, "left_semi")
    conflicts = salted_join(keyed, met, names, "left_semi", [id_col]).select(tx.cells(learn.columns))
    return old, rest, conflicts
