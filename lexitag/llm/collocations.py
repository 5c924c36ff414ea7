r"""Phrases whose words belong together, with exact counts of all n-grams that can matter.

Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and these into words.
Everything is counted per language. A phrase of 2 to ``LONGEST`` words found ``LEAST`` times or more
is a candidate; its score is 1000 * f(phrase) * n / (f(first words) * f(other words)), rounded down,
for the cut into two parts where this is least. Candidates inside a longer one that is as frequent
are dropped.

Words are counted first; those found ``LEAST`` times get numbers, and texts become runs of numbers,
cut where a rarer word or the end of a piece lies, as no candidate reaches across. Every task counts
n-grams of its runs in counting quotient filters (``quotient``): the packed numbers are permuted
invertibly into quotient and remainder, equal ones summed up. Filters are shuffled in slices of the
permuted range, which a frequent n-gram cannot make uneven, and merged. The counts are exact and the
n-grams come back out of their keys.

An n-gram is only counted if both (n-1)-grams in it may be candidates. Which ones may is told by
a bitmap of quotients, ``SLOT_BITS`` bits whatever the size of the data: a bit may be set for another
n-gram's sake, which costs work, never a candidate. Runs shrink from one length to the next.

Defined cases: a null text has no words; a null language is ``und``, together with texts that say
so; repeated rows count each; languages without candidates and empty tables give no rows; other
columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexitag.llm.common import quoted
from lexitag.llm.merkle import numbered
from lexitag.llm.quotient import Filter, permuted, restored, top
from lexitag.operators.lasting import keep
from lexitag.operators.lookup import fits_broadcast, lookup_join, salted_join

LEAST = 100
LONGEST = 5
FIRST = 2000
COVERED_PERCENT = 100
ENDS = ".,;:!?\n\x0b\x0c\r"
RUN_ROW = 16_384  # numbers in a row of runs
BATCH_ROWS = 16  # such rows, or filters, that travel at once
GRAMS = 1 << 19  # n-grams sorted at a time, and entries that a task holds before it hands them on
KEYS = 1 << 18  # n-grams whose keys are made at a time
SLOT_BITS = 27
BLOCK_BITS = 6, 16  # least and most; between them a slice for every million words
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    r"""All words in order, with \n where a piece ends."""
    plain = F.translate(text, _LETTERS + "\t" + ENDS, _LETTERS.lower() + " " + "\n" * len(ENDS))
    return F.array_remove(F.split(F.replace(plain, F.lit("\n"), F.lit(" \n ")), " ", -1), "")


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(quoted(lang_col).cast("string"), F.lit("und")).alias("lang"),
        words(quoted(text_col).cast("string")).alias("words"),
    )


@contextmanager
def _batches(spark: SparkSession, rows: int):
    """Hand so many rows at a time to Python within the block; narrow rows take many."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(rows))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def _rows_of(runs: np.ndarray, shortest: int, size: int) -> Iterator[np.ndarray]:
    """Runs, each behind a 0, in rows of some ``size`` numbers; runs below ``shortest`` are left out."""
    at = np.flatnonzero(runs == 0)
    sizes = np.diff(np.append(at, len(runs)))
    runs = runs[np.repeat(sizes > shortest, sizes)]
    at = np.flatnonzero(runs == 0)
    cuts = np.unique(at[np.searchsorted(at, np.arange(0, len(runs), size)).clip(max=len(at) - 1)]) if len(at) else at
    for a, b in zip(cuts, [*cuts[1:], len(runs)]):
        yield runs[a:b]


def _listed(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(rows).astype(np.int64)))


def _joined_runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Numbered words, in order, as rows of runs: words that follow each other in one piece."""
    held, last = [np.zeros(0, np.int64)], (None, None)

    def rows(runs: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = list(_rows_of(runs, 2, size))
        if found:
            yield pa.RecordBatch.from_arrays([_listed(found)], ["runs"])

    for batch in batches:
        if not batch.num_rows:
            continue
        row, pos, number = (batch.column(c).to_numpy() for c in ("row", "pos", "number"))
        fresh = np.empty(len(row), bool)
        fresh[0] = last != (row[0], pos[0] - 1)
        fresh[1:] = (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1)
        last = row[-1], pos[-1]
        starts = np.flatnonzero(fresh)
        runs = np.insert(number, starts, 0)
        if len(starts) and sum(map(len, held)) >= size:
            cut = int(starts[-1]) + len(starts) - 1  # the last run may go on in the next batch
            yield from rows(np.concatenate([*held, runs[:cut]]))
            held = [runs[cut:]]
        else:
            held.append(runs)
    yield from rows(np.concatenate(held))


def _windows(runs: np.ndarray, n: int) -> np.ndarray:
    """Where n numbers of one run start."""
    if len(runs) < n:
        return np.zeros(0, np.int64)
    real, count = runs != 0, len(runs) - n + 1
    return np.flatnonzero(reduce(np.logical_and, (real[j : j + count] for j in range(n))))


def _keys(runs: np.ndarray, at: np.ndarray, n: int, bits: int) -> list[np.ndarray]:
    return permuted([runs[at + j].astype(np.uint64) for j in range(n)], [bits] * n)


def _alive(runs: np.ndarray, n: int, bits: int, bitmap: np.ndarray, slot_bits: int) -> np.ndarray:
    """The parts of runs in which all n-grams may be candidates, and at least two follow each other."""
    at = _windows(runs, n)
    if len(at):
        slot = top(_keys(runs, at, n, bits), n * bits, slot_bits).astype(np.int64)
        at = at[(bitmap[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1]
    if not len(at):
        return np.zeros(0, np.int64)
    new = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))
    sizes = np.diff(np.append(new, len(at)))
    first, sizes = at[new][sizes > 1], sizes[sizes > 1] + n  # numbers of each run and its 0
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    found = runs[np.repeat(first, sizes) + np.maximum(inside - 1, 0)]
    found[inside == 0] = 0
    return found


def _counted(runs: DataFrame, n: int, bits: int, block_bits: int, bitmap: Broadcast | None) -> DataFrame:
    """Kept rows of two kinds: (block, filter) of n-grams, and (runs) that longer ones may lie in."""

    size, grams, slot_bits, step = RUN_ROW, GRAMS, min(SLOT_BITS, (n - 1) * bits), min(KEYS, GRAMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, filters = [], []

        def fold() -> None:
            if held:
                keys = [np.concatenate(k) for k in zip(*held)]
                held.clear()
                filters.append(Filter.of(keys, n * bits))

        def handed_on() -> Iterator[pa.RecordBatch]:
            whole = Filter.merged(filters)
            for block, part in whole.blocks(block_bits):
                columns = [pa.array([block], pa.int32()), pa.array([part.encode(block_bits)], pa.binary()), pa.nulls(1, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["block", "filter", "runs"])

        for batch in batches:
            found = batch.column("runs").flatten().to_numpy()
            if bitmap is not None:
                found = _alive(found, n - 1, bits, bitmap.value, slot_bits)
                rows = list(_rows_of(found, n + 1, size))
                for i in range(0, len(rows), BATCH_ROWS):
                    part = rows[i : i + BATCH_ROWS]
                    nothing = [pa.nulls(len(part), pa.int32()), pa.nulls(len(part), pa.binary())]
                    yield pa.RecordBatch.from_arrays([*nothing, _listed(part)], ["block", "filter", "runs"])
            at = _windows(found, n)
            for i in range(0, len(at), step):
                held.append(_keys(found, at[i : i + step], n, bits))
                if sum(len(k[0]) for k in held) >= grams:
                    fold()
                if sum(map(len, filters)) >= 2 * grams:
                    filters = [Filter.merged(filters)]
                    if len(filters[0]) >= grams:
                        yield from handed_on()
                        filters = []
        fold()
        if filters:
            yield from handed_on()

    with _batches(runs.sparkSession, BATCH_ROWS):  # rows are wide, and how many a task has grows with the data
        return keep(runs.select("runs").mapInArrow(run, "block int, filter binary, runs array<long>"))


def _merged(counted: DataFrame, n: int, bits: int, block_bits: int, least: int) -> DataFrame:
    """Kept rows of two kinds: (gram, f) of every candidate, and (block, slots): its part of the bitmap."""
    width, slot_bits, most = n * bits, min(SLOT_BITS, n * bits), 2 * GRAMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, filters = None, []

        def done() -> Iterator[pa.RecordBatch]:
            whole = Filter.merged(filters)
            often = whole.counts >= least
            if not often.any():
                return
            keys, f = [k[often] for k in whole.keys], whole.counts[often]
            slots = np.zeros(1 << (slot_bits - block_bits), bool)
            slots[top(keys, width, slot_bits).astype(np.int64) & (len(slots) - 1)] = True
            grams = np.stack(restored(keys, [bits] * n), axis=1).astype(np.int64)
            names = ["gram", "f", "block", "slots"]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(grams) + 1) * n, pa.int32()), pa.array(grams.reshape(-1)))
            yield pa.RecordBatch.from_arrays([lists, pa.array(f), pa.nulls(len(f), pa.int32()), pa.nulls(len(f), pa.binary())], names)
            one = [pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.int64()), pa.array([block], pa.int32())]
            yield pa.RecordBatch.from_arrays([*one, pa.array([np.packbits(slots).tobytes()], pa.binary())], names)

        for batch in batches:
            for b, blob in zip(batch.column("block").to_pylist(), batch.column("filter")):
                if b != block:
                    if filters:
                        yield from done()
                    block, filters = b, []
                filters.append(Filter.decode(blob.as_buffer().to_pybytes(), b, block_bits, width))
                if len(filters) > 1 and sum(map(len, filters)) >= max(most, 2 * len(filters[0])):
                    filters = [Filter.merged(filters)]
        if filters:
            yield from done()

    rows = counted.filter("filter is not null").select("block", "filter").repartition("block").sortWithinPartitions("block")
    with _batches(counted.sparkSession, BATCH_ROWS):
        return keep(rows.mapInArrow(run, "gram array<long>, f long, block int, slots binary"))


def _bitmap(merged: DataFrame, n: int, bits: int, block_bits: int) -> np.ndarray:
    """The quotients of all candidates of n words: 2 ** SLOT_BITS bits at most, whatever the data's size."""
    slot_bits = min(SLOT_BITS, n * bits)
    size = 1 << (slot_bits - block_bits)  # bits in a block's part
    whole = np.zeros(1 << slot_bits, bool) if size < 8 else np.zeros((1 << slot_bits) // 8, np.uint8)
    for r in merged.filter("slots is not null").select("block", "slots").collect():
        part = np.frombuffer(r["slots"], np.uint8)
        if size < 8:
            whole[r["block"] * size : (r["block"] + 1) * size] = np.unpackbits(part, count=size)
        else:
            whole[r["block"] * size // 8 : (r["block"] + 1) * size // 8] = part
    return np.packbits(whole) if size < 8 else whole


def word_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, word, f) of every word, kept."""
    rows = _texts(docs, text_col, lang_col).select("lang", F.explode("words").alias("word"))
    return keep(rows.filter("word != '\\n'").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("f")))


def _runs(docs: DataFrame, text_col: str, lang_col: str, vocabulary: DataFrame) -> DataFrame:
    """Rows of runs of word numbers, kept."""
    spark = docs.sparkSession
    placed = _texts(docs, text_col, lang_col).select("row", "lang", F.posexplode("words").alias("pos", "word"))
    known = vocabulary.select("lang", "word", "number")
    if fits_broadcast(known):  # rows stay in their order
        found = placed.join(F.broadcast(known), ["lang", "word"])
    else:
        found = salted_join(placed, known, ["lang", "word"], salt_by=["row", "pos"])
        found = found.repartition("row").sortWithinPartitions("row", "pos")
    size = RUN_ROW
    with _batches(spark, 50_000):
        narrow = found.select("row", "pos", "number")
        return keep(narrow.mapInArrow(lambda batches: _joined_runs(batches, size), "runs array<long>"))


def counts(docs: DataFrame, text_col: str, lang_col: str, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vocabulary (lang, word, number, f), totals (lang, n), and (gram, f) of all candidates, kept.

    Besides the bitmap, two numbers come back to the driver: of words, and of words with a number.
    """
    spark = docs.sparkSession
    every = word_counts(docs, text_col, lang_col)
    totals = keep(every.groupBy("lang").agg(F.sum("f").alias("n")))
    often = every.filter(F.col("f") >= least).select(F.lit("").alias("g"), "lang", "word", "f")
    vocabulary = keep(numbered(often, ["lang", "word"]).select("lang", "word", (F.col("pos") + 1).alias("number"), "f"))
    bits = max(1, vocabulary.count().bit_length())
    total = totals.agg(F.sum("n").alias("n")).first()["n"] or 0
    runs, bitmap, grams = _runs(docs, text_col, lang_col, vocabulary), None, []
    for n in range(2, longest + 1):
        block_bits = min(max(BLOCK_BITS[0], min(BLOCK_BITS[1], (total >> 20).bit_length())), n * bits, SLOT_BITS)
        shared = None if bitmap is None else spark.sparkContext.broadcast(bitmap)
        counted = _counted(runs, n, bits, block_bits, shared)
        merged = _merged(counted, n, bits, block_bits, least)
        grams.append(merged.filter("gram is not null").select("gram", "f"))
        if n < longest:
            bitmap = _bitmap(merged, n, bits, block_bits)
        if shared is not None:
            shared.unpersist()
            runs = counted.filter("runs is not null").select("runs")
    return vocabulary, totals, reduce(DataFrame.unionByName, grams)


def _uncovered(grams: DataFrame, percent: int) -> DataFrame:
    """Candidates that no longer one as frequent holds; a longer one by one word is the most frequent such."""
    inside = F.explode(F.array(F.expr("slice(gram, 1, size(gram) - 1)"), F.expr("slice(gram, 2, size(gram) - 1)")))
    longer = grams.filter("size(gram) > 2").select(inside.alias("gram"), "f").groupBy("gram").agg(F.max("f").alias("longer"))
    joined = grams.join(longer, "gram", "left")
    return joined.filter(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("f"))).drop("longer")


def scored(vocabulary: DataFrame, totals: DataFrame, grams: DataFrame, percent: int = COVERED_PERCENT) -> DataFrame:
    """(lang, gram, a, l, r, n, score) of all candidates that no longer one covers, kept."""
    parts = keep(grams.unionByName(vocabulary.select(F.array("number").alias("gram"), "f")))
    cut = F.explode(F.expr("sequence(1, size(gram) - 1)")).alias("k")
    cuts = _uncovered(grams, percent).select("gram", F.col("f").alias("a"), cut).withColumns(
        {"first": F.expr("slice(gram, 1, k)"), "rest": F.expr("slice(gram, k + 1, size(gram) - k)")}
    )
    of = lambda name, f: parts.select(F.col("gram").alias(name), F.col("f").alias(f))
    cuts = lookup_join(cuts, of("first", "l"), ["first"], salt_by=["gram"], measured=parts)
    cuts = lookup_join(cuts, of("rest", "r"), ["rest"], salt_by=["gram"], measured=parts)
    langs = vocabulary.select(F.col("number").alias("head"), "lang")
    cuts = lookup_join(cuts.withColumn("head", F.get("gram", F.lit(0))), langs, ["head"], salt_by=["gram"], measured=vocabulary)
    cuts = lookup_join(cuts, totals, ["lang"], salt_by=["gram"])
    # Decimals hold these products exactly up to some 10 ** 17 words.
    wide = lambda c: f"cast({c} as decimal(17,0))"
    score = F.expr(f"(cast(1000 as decimal(4,0)) * ({wide('a')} * {wide('n')})) div ({wide('l')} * {wide('r')})")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    best = cuts.groupBy("lang", "gram", "a", "n").agg(least)
    return keep(best.select("lang", "gram", "a", "best.l", "best.r", "n", "best.score"))


def phrases(
    docs: DataFrame,
    text_col: str,
    lang_col: str,
    least: int = LEAST,
    longest: int = LONGEST,
    first: int = FIRST,
    percent: int = COVERED_PERCENT,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score, a and phrase."""
    vocabulary, totals, grams = counts(docs, text_col, lang_col, least, longest)
    order = F.desc("score"), F.desc("a")
    by_lang = Window.partitionBy("lang")
    rows = scored(vocabulary, totals, grams, percent).withColumn("place", F.rank().over(by_lang.orderBy(*order)))
    rows = keep(rows.filter(F.col("place") <= first).drop("place"))  # ties of the last place are decided by the text
    placed = rows.select("gram", F.posexplode("gram").alias("pos", "number"))
    spelled = lookup_join(placed, vocabulary.select("number", "word"), ["number"], salt_by=["gram"], measured=vocabulary)
    texts = spelled.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("spelled"))
    phrase = F.array_join(F.transform("spelled", lambda s: s["word"]), " ").alias("phrase")
    named = rows.join(texts.select("gram", phrase), "gram")
    ranked = named.withColumn("rank", F.row_number().over(by_lang.orderBy(*order, "phrase")).cast("long"))
    return ranked.filter(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same in DuckDB SQL over ``documents``, with the constants above.
SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}\t{ENDS}', '{_LETTERS.lower()} {chr(10) * len(ENDS)}'), '[^ \\n]+|\\n') AS ws
  FROM documents),
tokens AS (SELECT d, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM docs),
placed AS (SELECT *, sum((w = chr(10))::INT) OVER (PARTITION BY d ORDER BY i) AS piece FROM tokens),
led AS (
  SELECT lang, w AS w1, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3, lead(w, 3) OVER p AS w4, lead(w, 4) OVER p AS w5
  FROM placed WHERE w <> chr(10) WINDOW p AS (PARTITION BY d, piece ORDER BY i)),
grams AS (
  SELECT lang, 1 AS k, w1 AS p FROM led
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM led WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM led WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM led WHERE w4 IS NOT NULL
  UNION ALL SELECT lang, 5, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 FROM led WHERE w5 IS NOT NULL),
f AS (SELECT lang, k, p, count(*) AS f FROM grams GROUP BY ALL HAVING k = 1 OR count(*) >= {LEAST}),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (
  SELECT * FROM f c WHERE k > 1 AND NOT EXISTS (
    SELECT 1 FROM f o WHERE o.lang = c.lang AND o.k = c.k + 1 AND 100 * o.f >= {COVERED_PERCENT} * c.f
      AND contains(' ' || o.p || ' ', ' ' || c.p || ' '))),
cuts AS (
  SELECT lang, p, f AS a, j, array_to_string(ws[:j], ' ') AS head, array_to_string(ws[j + 1:], ' ') AS rest
  FROM (SELECT *, string_split(p, ' ') AS ws, unnest(range(1, k)) AS j FROM candidates)),
scores AS (
  SELECT c.lang, c.p AS phrase, c.a, x.f AS l, y.f AS r, t.n, c.j,
    ((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN totals t USING (lang) JOIN f x ON x.lang = c.lang AND x.p = c.head JOIN f y ON y.lang = c.lang AND y.p = c.rest),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= {FIRST}
"""
