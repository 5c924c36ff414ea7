"""Mixing sources to target weights, exact to the word, without shuffling a text.

Every document gets a hash-random key. Within a source, documents in order of their keys fill the
source's budget: whole epochs first, then documents up to the cut, where one document is cut short.
The cut comes from distributed prefix sums over (source, key, size): keys are uniform, so equal
slices of their range are even buckets that sort a source by range; sums of buckets, of 1024 buckets
at a time, and of rows within a bucket are added up. So a source of any share of the rows is spread
over tasks. What comes out is one row per source (epochs, cut key, words of the cut document), and a
second pass over the documents only compares keys.

Targets: sources in code point order, null last, have the repeating weights and share a total of
words; no target exceeds ``max_epochs`` times its source's words, and what lies above is shared again
by weight. This is the level L with sum(min(limit, L * weight)) = total, found by sorting sources
by limit / weight.

Defined cases: a null text has no words; a null source is a source of its own, last in order; rows
that agree in identifier and text have the same key, and where the cut falls on them each is given an
equal part, rounded down; documents without words are taken or left by their key; a source without
words has target 0; no documents give no rows; other columns of the input, whatever their names, are
handed on by ``mixed_documents`` and else not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexitag.llm.common import WORD, enclose, inner, quoted, reopen
from lexitag.operators.lasting import keep
from lexitag.operators.lookup import lookup_join

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MAX_EPOCHS = 2
SEED = "mix"
BUCKET_ROWS = 1024


@dataclass
class Mix:
    """``rows``: id, source key, key, size of each document; ``sources``: one row per source."""

    rows: DataFrame
    sources: DataFrame
    seed: str


def _source(column: Column) -> Column:
    """Text that sorts like the source by code point, with null last."""
    return F.when(column.isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), column.cast("string")))


def _key(identifier: Column, text: Column, seed: str) -> Column:
    """60 random bits from seed, identifier and text."""
    whole = F.concat(
        F.lit(seed + ":"), F.coalesce(identifier.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))
    )
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prefix_sums(rows: DataFrame, group: str, key: str, value: str, buckets: str) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the group's rows of smaller ``key``.

    ``key`` is uniform in 60 bits and unique in its group; ``buckets`` says how many slices of its
    range the group gets. No task sees more than a bucket's rows or 1024 sums at a time, but for
    one row per 1024 buckets of a group.
    """
    rows = rows.withColumn("bucket", F.expr(f"shiftright(shiftright({key}, 28) * {buckets}, 32)"))
    sums = rows.groupBy(group, "bucket").agg(F.sum(value).alias("words")).withColumn("block", F.expr("bucket div 1024"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    blocks = (
        sums.groupBy(group, "block")
        .agg(F.sum("words").alias("words"))
        .withColumn("before_block", F.coalesce(F.sum("words").over(before(group).orderBy("block")), zero))
        .drop("words")
    )
    sums = sums.withColumn(
        "before_bucket", F.coalesce(F.sum("words").over(before(group, "block").orderBy("bucket")), zero)
    ).join(blocks, [group, "block"])
    base = sums.select(group, "bucket", (F.col("before_block") + F.col("before_bucket")).alias("base"))
    inside = F.coalesce(F.sum(value).over(before(group, "bucket").orderBy(key)), zero)
    return (
        rows.withColumn("inside", inside)
        .join(base, [group, "bucket"])
        .withColumn("before", F.col("base") + F.col("inside"))
        .drop("base", "inside", "bucket")
    )


def targets(sources: DataFrame, weights: Sequence[int], share_percent: int, max_epochs: int) -> DataFrame:
    """Adds ``target`` to (source, source_size): one row per source, so these windows are small."""
    listed = F.array(*(F.lit(float(w)) for w in weights))
    everything = Window.partitionBy(F.lit(0))
    ranked = sources.withColumn("rank", F.row_number().over(everything.orderBy("source")) - 1).withColumns(
        {
            "weight": F.get(listed, F.col("rank") % len(weights)),
            "limit": (F.col("source_size") * max_epochs).cast("double"),
            "budget": F.sum("source_size").over(everything) * F.lit(share_percent) / 100.0,
        }
    )
    order = everything.orderBy(F.col("limit") / F.col("weight"), "source")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    leveled = ranked.withColumn(
        "level",
        (F.col("budget") - F.coalesce(F.sum("limit").over(upto), F.lit(0.0)))
        / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
    )
    # The first source, by limit per weight, that the level of the rest does not fill sets the level.
    fits = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "level"))
    level = F.min(fits).over(everything)["level"]
    return leveled.withColumn("target", F.least(F.col("limit"), F.coalesce(level * F.col("weight"), F.col("limit")))).select(
        "source", "source_size", "docs", "target"
    )


def plan(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    source_col: str,
    weights: Sequence[int] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
) -> Mix:
    """Sizes, targets and cuts. Two narrow tables are kept; the texts are read once."""
    text = quoted(text_col)
    rows = keep(
        docs.select(
            quoted(id_col).alias("id"),
            _source(quoted(source_col)).alias("source"),
            _key(quoted(id_col), text, seed).alias("key"),
            size_in_words(text).alias("size"),
        )
    )
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    some = F.col("source_size") > 0
    words = F.round("target").cast("long")
    sources = keep(
        targets(sums, weights, share_percent, max_epochs).withColumns(
            {
                "epochs": F.when(some, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0)),
                "rest": F.when(some, words % F.col("source_size")).otherwise(F.lit(0)).cast("long"),
                "buckets": F.ceil(F.col("docs") / BUCKET_ROWS),
            }
        )
    )
    units = rows.groupBy("source", "key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("copies"))
    placed = lookup_join(units, sources.select("source", "rest", "buckets"), ["source"], "inner", ["key"], sources)
    placed = prefix_sums(placed, "source", "key", "size", "buckets")
    cuts = (
        placed.filter((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("size")))
        .withColumn("cut_words", F.expr("(rest - before) div copies"))
        .select("source", F.col("key").alias("cut_key"), "cut_words")
    )
    return Mix(rows, keep(sources.join(cuts, "source", "left")), seed)


def _joined(rows: DataFrame, mix: Mix, salt_by: Sequence[str]) -> DataFrame:
    return lookup_join(rows, mix.sources, ["source"], "inner", salt_by)


def taken(mix: Mix) -> DataFrame:
    """(id, size, source_size, target, taken): the words that the mix takes of each document."""
    part = (
        F.when(F.col("key") < F.col("cut_key"), F.col("size"))
        .when(F.col("key") == F.col("cut_key"), F.col("cut_words"))
        .otherwise(F.lit(0))
    )
    return _joined(mix.rows, mix, ["key"]).select(
        "id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken")
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word."""
    runs = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    return F.array_join(F.slice(runs, F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, mix: Mix, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The mix: every document as often as it is taken; the cut document's last copy is cut short."""
    identifier, text = F.col(inner(docs, id_col)), inner(docs, text_col)
    rows = enclose(docs).withColumns(
        {"source": _source(F.col(inner(docs, source_col))), "key": _key(identifier, F.col(text), mix.seed)}
    )
    cut = (F.col("key") == F.col("cut_key")) & (F.col("cut_words") > 0)
    last = F.coalesce((F.col("key") < F.col("cut_key")) | cut, F.lit(False)).cast("int")
    copies = _joined(rows, mix, ["key"]).withColumn("copies", F.col("epochs").cast("int") + last)
    one_each = copies.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    short = cut & (F.col("copy") == F.col("copies"))
    whole = one_each.withColumn(text, F.when(short, first_words(F.col(text), F.col("cut_words"))).otherwise(F.col(text)))
    return reopen(whole, docs)


#: The same in DuckDB SQL over ``documents``, for the constants above.
SQL = r"""
WITH rows_ AS (
  SELECT doc_id, coalesce('a' || source, 'n') AS source,
         ('0x' || md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, ''))[:15])::BIGINT AS key,
         coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
weighted AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS most,
         [3, 1, 2][(row_number() OVER (ORDER BY source) - 1) % 3 + 1]::DOUBLE AS weight
  FROM rows_ GROUP BY source),
levels AS (
  SELECT *, ((SELECT sum(source_size) * 1.5::DOUBLE FROM weighted) - coalesce(sum(most) OVER before, 0))
            / sum(weight) OVER rest AS level
  FROM weighted
  WINDOW before AS (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (ORDER BY most / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
targets AS (
  SELECT source, source_size, target,
         CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs,
         CASE WHEN source_size > 0 THEN round(target)::BIGINT % source_size ELSE 0 END AS rest
  FROM (SELECT source, source_size,
          least(most, weight * coalesce((SELECT arg_min(level, most / weight) FROM levels WHERE level * weight <= most), 1e300)) AS target
        FROM levels)),
units AS (SELECT source, key, sum(size)::BIGINT AS unit, count(*) AS copies FROM rows_ GROUP BY ALL),
placed AS (SELECT *, (sum(unit) OVER (PARTITION BY source ORDER BY key))::BIGINT - unit AS before FROM units)
SELECT r.doc_id, r.size, t.source_size, t.target,
  (t.epochs * r.size + CASE WHEN p.before + p.unit <= t.rest THEN r.size
                            WHEN p.before < t.rest THEN (t.rest - p.before) // p.copies
                            ELSE 0 END)::BIGINT AS taken
FROM rows_ r JOIN targets t USING (source) JOIN placed p USING (source, key)
"""
