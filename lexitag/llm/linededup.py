r"""Line dedup: lines that many documents share are dropped from all of them.

Texts are split at \n. A line's key is the line without blanks at its ends and with A-Z in lower
case. Each line becomes a row (document, position, 128-bit hash of the key); the distinct documents
of each hash are counted, and hashes of ``min_docs`` documents or more lose all their lines. The flag
of every line then goes back to its document in order of position, and the text is put together from
the lines that stay. The texts themselves are shuffled once, for that last join; a line that a third
of all documents hold is counted per (hash, document) first, and looked up in a broadcast or salted
join.

A document is a row of the input, so rows that agree in identifier and text count each. Defined
cases: a null or empty text is one empty line, which is too short to be dropped, and stays as it is;
a null identifier is a value like any other; no documents give no rows; other columns of the input,
whatever their names, are handed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitag.llm.common import BLANKS, ascii_lower, enclose, group_key, inner, quoted, reopen
from lexitag.operators.lasting import keep
from lexitag.operators.lookup import lookup_join

MIN_DOCS = 10
MIN_CHARS = 1


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _document(identifier: Column, text: Column) -> list[Column]:
    """A document's key: its identifier and a hash of its text."""
    return [group_key(identifier).alias("d_id"), F.xxhash64(text).alias("d_text")]


def line_table(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(row, d_id, d_text, pos, h1, h2) of every line; the hashes are null where the key is too short."""
    text = quoted(text_col)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *_document(quoted(id_col), text), text.alias("text"))
    rows = rows.select("row", "d_id", "d_text", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    key = F.btrim(F.col("line"), F.lit(BLANKS))
    rows = rows.withColumn("key", ascii_lower(key))
    long_enough = F.char_length("key") >= min_chars
    return rows.select(
        "row",
        "d_id",
        "d_text",
        "pos",
        F.when(long_enough, F.xxhash64("key")).alias("h1"),
        F.when(long_enough, F.xxhash64(F.lit(1), "key")).alias("h2"),
    )


def frequent_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2) of the keys that at least ``min_docs`` documents hold."""
    return (
        lines.filter(F.col("h1").isNotNull())
        .groupBy("h1", "h2")
        .agg(F.countDistinct("row").alias("docs"))
        .filter(F.col("docs") >= min_docs)
        .select("h1", "h2")
    )


def _flagged(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int) -> DataFrame:
    """The enclosed documents with ``flags``: for those that lose lines, per position, is it dropped?"""
    lines = keep(line_table(docs, id_col, text_col, min_chars))
    frequent = keep(frequent_lines(lines, min_docs)).withColumn("dropped", F.lit(True))
    lines = lines.drop("row")
    found = lookup_join(lines, frequent, ["h1", "h2"], "left", salt_by=["d_id", "d_text", "pos"])
    flag = F.struct("pos", F.coalesce("dropped", F.lit(False)).alias("dropped"))
    flags = (
        found.groupBy("d_id", "d_text")
        .agg(F.max("dropped").alias("any"), F.sort_array(F.collect_set(flag)).alias("flags"))
        .filter("any")
        .select("d_id", "d_text", F.transform("flags", lambda f: f["dropped"]).alias("flags"))
    )
    rows = enclose(docs)
    mine = _document(F.col(inner(docs, id_col)), F.col(inner(docs, text_col)))
    return rows.select("*", *mine).join(flags, ["d_id", "d_text"], "left")


def _kept_text(text: Column, flags: Column) -> Column:
    rest = F.filter(_lines(text), lambda x, i: ~F.get(flags, i))
    return F.when(flags.isNull(), text).otherwise(F.array_join(rest, "\n"))


def drop_lines(
    docs: DataFrame, id_col: str, text_col: str, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS
) -> DataFrame:
    """The input rows, their texts without the lines that ``min_docs`` documents share."""
    text = inner(docs, text_col)
    rows = _flagged(docs, id_col, text_col, min_docs, min_chars)
    return reopen(rows.withColumn(text, _kept_text(F.col(text), F.col("flags"))), docs)


def report(
    docs: DataFrame, id_col: str, text_col: str, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS
) -> DataFrame:
    """(id, n_lines, n_dropped, text) of every document, one row per input row."""
    text = F.col(inner(docs, text_col))
    dropped = F.size(F.filter(F.col("flags"), lambda f: f))
    return _flagged(docs, id_col, text_col, min_docs, min_chars).select(
        F.col(inner(docs, id_col)).alias("id"),
        F.size(_lines(text)).cast("long").alias("n_lines"),
        F.when(F.col("flags").isNull(), F.lit(0)).otherwise(dropped).cast("long").alias("n_dropped"),
        _kept_text(text, F.col("flags")).alias("text"),
    )


#: The same in DuckDB SQL over ``documents``.
SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM docs),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
kept AS (
  SELECT r, count(*) AS n_lines, count(f.key) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '') AS text
  FROM keyed k LEFT JOIN frequent f ON f.key = k.key GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM docs JOIN kept USING (r)
"""
