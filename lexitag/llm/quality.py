"""Quality rules with adaptive thresholds from mergeable sketches per language and source.

Every whole text gets a few counts. Three ratios of them (characters per word, symbols per 1000
words, repeated lines per 1000 lines) go into one sketch per language and source: a histogram over
whole numbers of which all but the leading nine binary digits are cleared, so a bucket is at most
1/256 of its value wide. Such sketches merge by adding counts, in any order, and always give the same
quartiles. A document is rejected where a ratio lies further outside its group's quartiles than
``REACH`` times their distance (and a least distance), more being allowed to short texts, whose
ratios vary more. Two base rules, on too few words and on repeated word sequences, are fixed.

Every group has thresholds of its own, of its sketch with that of its language merged in at the fixed
weight of ``PRIOR`` documents; into the language's sketch that of all documents is merged likewise. So
few documents lean on the others and many hardly do, by one rule at every size. Weights are whole
numbers of up to 38 digits, exact below 10^12 documents.

Defined cases: a null text has no words and fails the base rules; a null language or source is a
group of its own; repeated rows count and are decided each; no documents give no rows; other
columns of the input, whatever their names, are handed on by ``keep_documents`` and else not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexitag.llm.common import BLANKS, WORD, enclose, group_key, inner, quoted, reopen
from lexitag.operators.lasting import keep
from lexitag.operators.lookup import lookup_join

MIN_WORDS = 10
REPEAT_WINDOW = 5
REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
REACH = 6
PRIOR = 100
#: Least distance between quartiles that counts, and whether low values are rejected too.
RATIOS = {"word_length": (150, True), "symbol_rate": (25, False), "line_rate": (100, False)}


def _with_counts(rows: DataFrame, text: str) -> DataFrame:
    """Adds the base counts of column ``text`` except the repeated words, and the ratios."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    per_thousand = lambda n, of: F.floor(n * 1000 / F.greatest(of, F.lit(1))).cast("long")
    return (
        rows.withColumn("q_lines", lines)
        .withColumns(
            {
                "n_words": F.regexp_count(t, F.lit(WORD)).cast("long"),
                "word_chars": F.char_length(F.regexp_replace(t, f"[{BLANKS}]+", "")).cast("long"),
                "n_symbols": F.char_length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
                "q_n_lines": F.size("q_lines").cast("long"),
                "n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
            }
        )
        .drop("q_lines")
        .withColumns(
            {
                "word_length": per_thousand(F.col("word_chars"), F.col("n_words")),
                "symbol_rate": per_thousand(F.col("n_symbols"), F.col("n_words")),
                "line_rate": per_thousand(F.col("n_dup_lines"), F.col("q_n_lines")),
            }
        )
    )


def _with_repeats(rows: DataFrame, text: str) -> DataFrame:
    """Adds n_repeat_words: words in windows of five that the text holds twice or more.

    Windows are compared by a 64-bit hash of their five words, within one text. Only texts in
    which two windows agree go on to sorting their positions by window.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    n = REPEAT_WINDOW

    def windows(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - n)
        made = F.transform(at, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(n))))
        return F.when(F.size(h) > n, made).otherwise(F.array().cast("array<bigint>"))

    def repeated(marked: Column) -> Column:
        same = lambda s, o: F.coalesce(F.get(marked, o)["w"] == s["w"], F.lit(False))
        found = F.filter(marked, lambda s, i: same(s, i - 1) | same(s, i + 1))
        return F.sort_array(F.transform(found, lambda s: s["i"]))

    def covered(at: Column) -> Column:
        gaps = F.transform(
            F.sequence(F.lit(1), F.size(at) - 1),
            lambda k: F.least(F.lit(n), F.get(at, k) - F.get(at, k - 1)).cast("long"),
        )
        return F.aggregate(gaps, F.lit(n).cast("long"), lambda a, b: a + b)

    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    w, d = F.col("q_windows"), F.col("q_marked")
    marked = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
    none = F.lit(None)
    return (
        rows.withColumn("q_words", F.transform(words, lambda x: F.xxhash64(x)))
        .withColumn("q_windows", windows(F.col("q_words")))
        .withColumn("q_marked", F.when(F.size(F.array_distinct(w)) < F.size(w), marked).otherwise(none))
        .withColumn("q_at", F.when(d.isNotNull(), repeated(d)))
        .withColumn("n_repeat_words", F.when(d.isNotNull(), covered(F.col("q_at"))).otherwise(F.lit(0).cast("long")))
        .drop("q_words", "q_windows", "q_marked", "q_at")
    )


def _bucket(value: Column) -> Column:
    """The number with all but its leading nine binary digits cleared."""
    drop = F.greatest(F.length(F.bin(value)) - 9, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def _ratios(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, n_words, the ratios) of every document."""
    rows = docs.select(
        quoted(text_col).alias("text"),
        group_key(quoted(lang_col)).alias("lang"),
        group_key(quoted(source_col)).alias("source"),
    )
    return _with_counts(rows, "text").select("lang", "source", "n_words", *RATIOS)


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, count): one mergeable histogram per group and ratio.

    Documents that fail the base rule on words are left out, as their ratios say little.
    """
    values = F.array(*(F.struct(F.lit(r).alias("ratio"), _bucket(F.col(r)).alias("bucket")) for r in RATIOS))
    return (
        counted.filter(F.col("n_words") >= MIN_WORDS)
        .select("lang", "source", F.explode(values).alias("v"))
        .groupBy("lang", "source", "v.ratio", "v.bucket")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, and low and high of each ratio's quartiles), by the group's merged sketch.

    A sketch becomes one array: it has at most 256 buckets per binary digit of a value.
    """

    def arrays(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        buckets = F.collect_list(F.struct("bucket", F.col("count").alias("c"))).alias(name)
        return rows.groupBy(*keys, "ratio").agg(buckets, F.sum("count").cast("decimal(12,0)").alias(f"n_{name}"))

    by_lang = sketch.groupBy("lang", "ratio", "bucket").agg(F.sum("count").alias("count"))
    of_all = arrays(by_lang.groupBy("ratio", "bucket").agg(F.sum("count").alias("count")), [], "every")
    of_lang = keep(arrays(by_lang, ["lang"], "tongue"))
    groups = lookup_join(arrays(sketch, ["lang", "source"], "own"), of_lang, ["lang", "ratio"], salt_by=["source"])
    groups = groups.join(F.broadcast(of_all), "ratio")  # a row per ratio

    whole = lambda c: c.cast("decimal(12,0)")
    long = lambda c: c.cast("decimal(38,0)")
    prior, n_all, n_lang = F.lit(PRIOR), F.col("n_every"), whole(F.col("n_tongue") + PRIOR)

    def weighted(name: str, weight) -> Column:
        return F.transform(name, lambda x: F.struct(x["bucket"].alias("b"), long(weight(whole(x["c"]))).alias("w")))

    merged = F.array_sort(
        F.concat(
            weighted("own", lambda c: c * n_all * n_lang),
            weighted("tongue", lambda c: c * n_all * prior),
            weighted("every", lambda c: c * (prior * prior)),
        )
    )
    total = long(whole(F.col("n_own") + PRIOR) * n_all * n_lang)

    def step(so_far: Column, x: Column) -> Column:
        upto = long(so_far["upto"] + x["w"])
        reached = lambda q, name: F.coalesce(so_far[name], F.when(upto * 4 >= total * q, x["b"]))
        return F.struct(upto.alias("upto"), reached(1, "low").alias("low"), reached(3, "high").alias("high"))

    none = F.lit(None).cast("long")
    start = F.struct(long(F.lit(0)).alias("upto"), none.alias("low"), none.alias("high"))
    quartiles = groups.select("lang", "source", "ratio", F.aggregate(merged, start, step).alias("q"))
    return quartiles.groupBy("lang", "source").agg(
        *(
            F.max(F.when(F.col("ratio") == r, F.col("q")[name])).alias(f"{r}_{name}")
            for r in RATIOS
            for name in ("low", "high")
        )
    )


def _outside(ratio: str) -> Column:
    """Is the ratio too far from the quartiles? Whole numbers only: both sides are squared."""
    least, both = RATIOS[ratio]
    value, low, high = F.col(ratio), F.col(f"{ratio}_low"), F.col(f"{ratio}_high")
    over = value - high
    off = F.greatest(over, low - value) if both else over
    off = F.greatest(off, F.lit(0)).cast("decimal(14,0)")  # a text's length and three digits
    reach = (REACH * F.greatest(high - low, F.lit(least))).cast("decimal(14,0)")
    beyond = off * off * F.least(F.col("n_words"), F.lit(100)).cast("decimal(3,0)") > reach * reach * 100
    return F.coalesce(beyond, F.lit(False))


def _judged(counted: DataFrame, sketch: DataFrame, salt_by: list[str]) -> DataFrame:
    """Rows with lang, source, counts and ratios -> the same with base_failed and kept."""
    limits = keep(thresholds(keep(sketch)))
    joined = lookup_join(counted, limits, ["lang", "source"], "left", salt_by=salt_by)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rejected = failed
    for ratio in RATIOS:
        rejected = rejected | _outside(ratio)
    return joined.withColumns({"base_failed": failed, "kept": ~rejected})


def _counted(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """The enclosed documents with lang, source, all counts and the ratios."""
    rows = enclose(docs).withColumns(
        {
            "lang": group_key(F.col(inner(docs, lang_col))),
            "source": group_key(F.col(inner(docs, source_col))),
        }
    )
    text = inner(docs, text_col)
    return _with_repeats(_with_counts(rows, text), text)


def decide(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(id, counts, base_failed, kept) of every document, one row per input row; a kept narrow table.

    The texts are read once: counts and ratios go to a narrow table, and sketches and verdicts come from it.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    narrow = _counted(docs, text_col, lang_col, source_col).select(
        F.col(inner(docs, id_col)).alias("id"), "lang", "source", *counts, *RATIOS
    )
    narrow = keep(narrow)
    return keep(_judged(narrow, sketches(narrow), ["id", *counts]).select("id", *counts, "base_failed", "kept"))


def keep_documents(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """The input rows that the rules keep, with the columns they came with."""
    # The counts are worked out once a row: a filter on them is not pushed below the row number,
    # where it would repeat their expressions in place of every use.
    rows = _counted(docs, text_col, lang_col, source_col).withColumn("q_row", F.monotonically_increasing_id())
    judged = _judged(rows, sketches(_ratios(docs, text_col, lang_col, source_col)), [inner(docs, text_col)])
    return reopen(judged.filter("kept and q_row >= 0"), docs)


#: The same in DuckDB SQL over ``documents``, with the constants above.
SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS lang,
         CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS source
  FROM documents),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i
  FROM (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs)),
word_counts AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY r),
windows AS (
  SELECT r, i, struct_pack(a := word, b := lead(word, 1) OVER p, c := lead(word, 2) OVER p,
                           d := lead(word, 3) OVER p, e := lead(word, 4) OVER p) AS w
  FROM words WINDOW p AS (PARTITION BY r ORDER BY i)),
twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS c FROM windows WHERE w.e IS NOT NULL)
  WHERE c > 1),
repeats AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words
  FROM twice CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY r),
line_rows AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
line_counts AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM line_rows WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
counts AS (
  SELECT r, doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM docs LEFT JOIN word_counts USING (r) LEFT JOIN line_counts USING (r) LEFT JOIN repeats USING (r)),
ratios AS (
  SELECT *, word_chars * 1000 // greatest(n_words, 1) AS word_length,
         n_symbols * 1000 // greatest(n_words, 1) AS symbol_rate,
         n_dup_lines * 1000 // greatest(n_lines, 1) AS line_rate
  FROM counts),
valued AS (
  SELECT lang, source, unnest(['word_length', 'symbol_rate', 'line_rate']) AS ratio,
         unnest([word_length, symbol_rate, line_rate])::BIGINT AS v
  FROM ratios WHERE n_words >= 10),
bucketed AS (
  SELECT lang, source, ratio, ((v >> greatest(length(bin(v)) - 9, 0)) << greatest(length(bin(v)) - 9, 0)) AS bucket
  FROM valued),
own AS (SELECT lang, source, ratio, bucket, count(*)::HUGEINT AS c FROM bucketed GROUP BY ALL),
tongue AS (SELECT lang, ratio, bucket, sum(c) AS c FROM own GROUP BY ALL),
every AS (SELECT ratio, bucket, sum(c) AS c FROM own GROUP BY ALL),
sizes AS (
  SELECT lang, source, ratio, n, nl, na
  FROM (SELECT lang, source, ratio, sum(c) AS n FROM own GROUP BY ALL)
  JOIN (SELECT lang, ratio, sum(c) AS nl FROM tongue GROUP BY ALL) USING (lang, ratio)
  JOIN (SELECT ratio, sum(c) AS na FROM every GROUP BY ALL) USING (ratio)),
weighted AS (
  SELECT lang, source, ratio, bucket, c * na * (nl + 100) AS w FROM own JOIN sizes USING (lang, source, ratio)
  UNION ALL SELECT lang, source, ratio, bucket, c * na * 100 FROM tongue JOIN sizes USING (lang, ratio)
  UNION ALL SELECT lang, source, ratio, bucket, c * 10000 FROM every JOIN sizes USING (ratio)),
merged AS (SELECT lang, source, ratio, bucket, sum(w) AS w FROM weighted GROUP BY ALL),
cumulated AS (
  SELECT lang, source, ratio, bucket, (n + 100) * na * (nl + 100) AS total,
         sum(w) OVER (PARTITION BY lang, source, ratio ORDER BY bucket) AS upto
  FROM merged JOIN sizes USING (lang, source, ratio)),
quartiles AS (
  SELECT lang, source,
    min(bucket) FILTER (ratio = 'word_length' AND upto * 4 >= total) AS wl,
    min(bucket) FILTER (ratio = 'word_length' AND upto * 4 >= total * 3) AS wh,
    min(bucket) FILTER (ratio = 'symbol_rate' AND upto * 4 >= total) AS sl,
    min(bucket) FILTER (ratio = 'symbol_rate' AND upto * 4 >= total * 3) AS sh,
    min(bucket) FILTER (ratio = 'line_rate' AND upto * 4 >= total) AS ll,
    min(bucket) FILTER (ratio = 'line_rate' AND upto * 4 >= total * 3) AS lh
  FROM cumulated GROUP BY lang, source),
verdicts AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    greatest(word_length - wh, wl - word_length, 0)::HUGEINT AS off_words,
    greatest(symbol_rate - sh, 0)::HUGEINT AS off_symbols,
    greatest(line_rate - lh, 0)::HUGEINT AS off_lines,
    6 * greatest(wh - wl, 150)::HUGEINT AS reach_words,
    6 * greatest(sh - sl, 25)::HUGEINT AS reach_symbols,
    6 * greatest(lh - ll, 100)::HUGEINT AS reach_lines
  FROM ratios LEFT JOIN quartiles USING (lang, source))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed
    OR coalesce(off_words * off_words * least(n_words, 100) > reach_words * reach_words * 100, false)
    OR coalesce(off_symbols * off_symbols * least(n_words, 100) > reach_symbols * reach_symbols * 100, false)
    OR coalesce(off_lines * off_lines * least(n_words, 100) > reach_lines * reach_lines * 100, false)) AS kept
FROM verdicts
"""
