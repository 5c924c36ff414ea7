"""Queries on words, counts, probabilities and vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexitag.functions import text as tx
from lexitag.operators import clean, ngrams, words
from lexitag.operators import model as md
from lexitag.operators.lasting import keep
from lexitag.registry import inputs

PART_TAGS = ["p_type", "p_brand"]
DOCUMENT_TAGS = ["lang", "source"]
LABEL_TAGS = ["quality", "toxic"]


def tokens_row(spark, sf_dir):
    rows = inputs.part_rows(spark, sf_dir)
    text = tx.row_text(["p_name", "p_brand"])
    return rows.select("p_partkey", F.posexplode(tx.row_words(text)).alias("pos", "word"))


def tokens_cell(spark, sf_dir):
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string").alias("price")
    rows = inputs.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", price)
    cells = words.learn_words(["p_name", "p_brand", "price"], "cell")
    return rows.select("p_partkey", F.posexplode(cells).alias("pos", "word"))


def tokens_space(spark, sf_dir):
    found = words.text_words(inputs.document_rows(spark, sf_dir), "doc_id", "text")
    return found.select(F.col("entry").alias("doc_id"), "pos", "Ngram")


def unpivot_tags(spark, sf_dir):
    rows = inputs.part_rows(spark, sf_dir)
    return words.unpivot_tags(rows, ["p_partkey", "p_name"], PART_TAGS)


def word_table(spark, sf_dir):
    return words.word_table(inputs.part_rows(spark, sf_dir), "p_partkey", PART_TAGS)


def weights(spark, sf_dir):
    return md.weights(inputs.labelled_documents(spark, sf_dir), "doc_id", LABEL_TAGS)


def weights_filled(spark, sf_dir):
    rows = inputs.document_rows(spark, sf_dir)
    return md.weights(rows, "doc_id", DOCUMENT_TAGS, keep_empty=False)


def _rated_parts(spark, sf_dir):
    rows = inputs.part_rows(spark, sf_dir)
    return md.rate_words(keep(md.weights(rows, "p_partkey", PART_TAGS)), PART_TAGS)


def _rated_documents(spark, sf_dir):
    rows = inputs.document_rows(spark, sf_dir)
    return md.rate_words(keep(md.weights(rows, "doc_id", DOCUMENT_TAGS)), DOCUMENT_TAGS)


def probabilities(spark, sf_dir):
    return _rated_parts(spark, sf_dir).select(md.VOCABULARY)


def probabilities_documents(spark, sf_dir):
    return _rated_documents(spark, sf_dir).select(md.VOCABULARY)


def ambiguous_words(spark, sf_dir):
    return md.ambiguous_words(_rated_parts(spark, sf_dir))


def unique_words(spark, sf_dir):
    return md.unique_words(_rated_documents(spark, sf_dir))


def multi_words(spark, sf_dir):
    return md.multi_words(_rated_parts(spark, sf_dir))


def vocabulary_summary(spark, sf_dir):
    rows = inputs.document_rows(spark, sf_dir)
    return md.vocabulary_summary(md.train(rows, "doc_id", DOCUMENT_TAGS))


def relevance_ngrams(spark, sf_dir):
    relabelled = clean.relabel_relevance(inputs.legacy_documents(spark, sf_dir), "de")
    return ngrams.relevance_ngrams(relabelled)[0]


def tag_ngrams(spark, sf_dir):
    learn = inputs.legacy_documents(spark, sf_dir)
    unclear = ngrams.relevance_ngrams(clean.relabel_relevance(learn, "de"))[1]
    return ngrams.tag_ngrams(learn, unclear, "de")


def ngram_counts(spark, sf_dir):
    return ngrams.ngram_counts(inputs.legacy_documents(spark, sf_dir))


def clean_ngrams(spark, sf_dir):
    return ngrams.clean_ngrams(ngrams.ngram_counts(inputs.legacy_documents(spark, sf_dir)))


def verified_ngrams(spark, sf_dir):
    learn = inputs.legacy_documents(spark, sf_dir)
    kept = keep(ngrams.clean_ngrams(ngrams.ngram_counts(learn)))
    return ngrams.verified_ngrams(kept, learn, "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        tokens_row,
        tokens_cell,
        tokens_space,
        unpivot_tags,
        word_table,
        weights,
        weights_filled,
        probabilities,
        probabilities_documents,
        ambiguous_words,
        unique_words,
        multi_words,
        vocabulary_summary,
        relevance_ngrams,
        tag_ngrams,
        ngram_counts,
        clean_ngrams,
        verified_ngrams,
    )
}

# ---------------------------------------------------------------- oracle SQL

SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def weights_sql(source: str, key: str, text: str, tags: list[str], where: str = "true") -> str:
    """CTEs w0 (words beside all tags) and w (tag, tag_col, word, count)."""
    parts = " UNION ALL ".join(
        f"SELECT {t} AS tag, '{t}' AS tag_col, word FROM w0 WHERE {where}" for t in tags
    )
    return f"""
    w0 AS (SELECT {", ".join(tags)}, unnest(regexp_split_to_array(lower({text}), '[ ,;:]+')) AS word
           FROM {source}),
    w AS (SELECT tag, tag_col, word, count(*) AS count FROM ({parts}) GROUP BY 1, 2, 3)"""


PROBABILITIES_SQL = """
    pa AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY tag, tag_col) AS rn,
                  count(*) OVER (PARTITION BY word) AS n FROM w),
    pb AS (SELECT *, sum(CASE WHEN rn > 1 THEN count END) OVER (PARTITION BY word) AS sd,
                  row_number() OVER (PARTITION BY word, tag, rn > 1 ORDER BY tag_col) AS rt FROM pa),
    p AS (SELECT tag, tag_col, word, count,
                 CASE WHEN rn = 1 OR n < 3 OR rt > 1 THEN 100
                      ELSE cast(round_even(count::double / sd::double * 100, 0) AS int)
                 END AS probability FROM pb)"""

UNIQUE_SQL = """
    u AS (SELECT min(tag) AS tag, tag_col, word, min(count) AS count,
                 min(probability) AS probability
          FROM p GROUP BY word, tag_col HAVING count(*) = 1)"""

MULTI_SQL = """
    m AS (SELECT tag, tag_col, word, count, probability FROM
            (SELECT *, row_number() OVER (PARTITION BY word, tag_col ORDER BY tag) AS place FROM p)
          WHERE place > 1)"""

PART_W = weights_sql("part", "p_partkey", "p_name", PART_TAGS)
DOCUMENT_W = weights_sql("documents", "doc_id", "text", DOCUMENT_TAGS)
LABELLED = """(SELECT d.doc_id, d.text, l.quality::varchar AS quality, l.toxic::varchar AS toxic
               FROM documents d JOIN labels l USING (doc_id))"""
LABEL_W = weights_sql(LABELLED, "doc_id", "text", LABEL_TAGS)

# Java upper-cases the sharp s to SS, DuckDB to a capital sharp s
UPPER_TEXT = "upper(replace(text, 'ß', 'SS'))"


def ngram_words(text: str, tag: str, where: str = "true") -> str:
    return f"""(SELECT Ngram, {tag} AS ngramTag FROM
        (SELECT lang, unnest(regexp_split_to_array({text}, '{SPACE}')) AS Ngram
         FROM documents WHERE {where}) WHERE Ngram NOT IN ('', 'None'))"""


RELEVANCE_SQL = f"""
    rc AS (SELECT Ngram, ngramTag, count(*) AS size FROM
        {ngram_words(UPPER_TEXT, "CASE WHEN lang = 'de' THEN 'not_relevant' ELSE 'relevant' END")}
        GROUP BY 1, 2),
    rel AS (SELECT Ngram, min(ngramTag) AS ngramTag, min(size) AS size FROM rc
            GROUP BY 1 HAVING count(*) = 1),
    unclear AS (SELECT Ngram FROM rc GROUP BY 1 HAVING count(*) > 1)"""

TAG_NGRAMS_SQL = f"""
    gen AS (SELECT Ngram, min(ngramTag) AS ngramTag FROM
              {ngram_words(UPPER_TEXT, "lang", "lang <> 'de'")}
            GROUP BY 1 HAVING count(*) = 1 AND Ngram NOT IN (SELECT Ngram FROM unclear))"""

COUNTS_SQL = f"""
    nc AS (SELECT Ngram, ngramTag, count(*) AS size FROM {ngram_words("text", "lang")} GROUP BY 1, 2),
    cn AS (SELECT Ngram, min(ngramTag) AS ngramTag, min(size) AS size
           FROM nc WHERE length(Ngram) > 1 AND size >= 5 GROUP BY 1 HAVING count(*) = 1)"""


def _positions(select: str, array: str, source: str) -> str:
    return f"""SELECT {select}, unnest(range(len(a)))::int AS pos, unnest(a) AS word
               FROM (SELECT {select}, {array} AS a FROM {source})"""


def _cell(cell: str) -> str:
    return f"""CASE WHEN regexp_full_match({cell}, '-?[\\d,.]+') THEN [lower({cell})]
               ELSE regexp_split_to_array(lower({cell}), '[ ,;:.]+') END"""


ORACLES = {
    "tokens_row": _positions(
        "p_partkey", "regexp_split_to_array(lower(p_name || ' ' || p_brand), '[ ,;:]+')", "part"
    ),
    "tokens_cell": _positions(
        "p_partkey",
        f"list_concat(list_concat({_cell('p_name')}, {_cell('p_brand')}), {_cell('price')})",
        "(SELECT *, p_retailprice::decimal(12,2)::varchar AS price FROM part)",
    ),
    "tokens_space": f"""SELECT doc_id, unnest(range(len(a)))::int AS pos, unnest(a) AS Ngram FROM
        (SELECT doc_id, list_filter(regexp_split_to_array(text, '{SPACE}'),
                lambda w: w NOT IN ('', 'None')) AS a FROM documents)""",
    "unpivot_tags": """SELECT p_partkey, p_name, 'p_type' AS tag_col, p_type AS tag FROM part
        UNION ALL SELECT p_partkey, p_name, 'p_brand', p_brand FROM part""",
    "word_table": """WITH w0 AS (SELECT p_partkey AS entry, p_type, p_brand,
            unnest(regexp_split_to_array(lower(p_name), '[ ,;:]+')) AS word FROM part)
        SELECT entry, word, 'p_type' AS tag_col, p_type AS tag FROM w0
        UNION ALL SELECT entry, word, 'p_brand', p_brand FROM w0""",
    "weights": f"WITH {LABEL_W} SELECT tag, tag_col, word, count FROM w",
    "weights_filled": "WITH "
    + weights_sql("documents", "doc_id", "text", DOCUMENT_TAGS, "word <> ''")
    + " SELECT tag, tag_col, word, count FROM w",
    "probabilities": f"WITH {PART_W}, {PROBABILITIES_SQL} SELECT * FROM p",
    "probabilities_documents": f"WITH {DOCUMENT_W}, {PROBABILITIES_SQL} SELECT * FROM p",
    "ambiguous_words": f"""WITH {PART_W}
        SELECT word, count(*) AS count FROM w GROUP BY 1 HAVING count(*) > 1""",
    "unique_words": f"WITH {DOCUMENT_W}, {PROBABILITIES_SQL}, {UNIQUE_SQL} SELECT * FROM u",
    "multi_words": f"WITH {PART_W}, {PROBABILITIES_SQL}, {MULTI_SQL} SELECT * FROM m",
    "vocabulary_summary": f"""WITH {DOCUMENT_W}, {PROBABILITIES_SQL}, {UNIQUE_SQL}, {MULTI_SQL}
        SELECT (SELECT count(*) FROM p) AS probability_rows,
               (SELECT count(*) FROM (SELECT word FROM p GROUP BY 1 HAVING count(*) > 1))
                 AS ambiguous_words,
               (SELECT count(*) FROM u) AS unique_rows,
               (SELECT count(*) FROM u WHERE probability > 99.9) AS certain_rows,
               (SELECT count(*) FROM m) AS multi_rows""",
    "relevance_ngrams": f"WITH {RELEVANCE_SQL} SELECT * FROM rel",
    "tag_ngrams": f"WITH {RELEVANCE_SQL}, {TAG_NGRAMS_SQL} SELECT * FROM gen",
    "ngram_counts": f"WITH {COUNTS_SQL} SELECT * FROM nc",
    "clean_ngrams": f"WITH {COUNTS_SQL} SELECT * FROM cn",
    "verified_ngrams": f"""WITH {COUNTS_SQL},
        met AS (SELECT d.doc_id, c.Ngram, c.ngramTag, contains(d.lang, c.ngramTag) AS fits
                FROM documents d JOIN cn c ON contains(d.text, c.Ngram)),
        good AS (SELECT Ngram FROM met GROUP BY 1 HAVING bool_and(fits))
        SELECT doc_id, Ngram, ngramTag FROM met WHERE Ngram IN (SELECT Ngram FROM good)""",
}
