"""Queries that tag rows: the three stages, the similarity joins and the legacy cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexitag.functions import text as tx
from lexitag.operators import clean, edits, legacy, ngrams, profile, similar
from lexitag.operators import model as md
from lexitag.operators.lasting import keep
from lexitag.operators.existing import split_existing
from lexitag.operators.tag import tag_rows as tag
from lexitag.operators.tag import tag_summary as summary
from lexitag.plans import flows
from lexitag.registry import inputs
from lexitag.registry import learning as ln
from lexitag.registry.cleaning import _COLUMN_TAGS, _MATCH, _flagged_orders, _match_tables


def tag_unique(spark, sf_dir):
    """Language and source of conversation turns by words that only one of them uses."""
    model = md.train(inputs.document_rows(spark, sf_dir), "doc_id", ln.DOCUMENT_TAGS)
    return tag(inputs.conversation_rows(spark, sf_dir), model, "doc_id", ("unique",))


def _part_tagged(spark, sf_dir):
    learn = inputs.part_rows(spark, sf_dir)
    model = md.train(learn, "p_partkey", ln.PART_TAGS)
    new = learn.withColumns({"p_type": F.lit(""), "p_brand": F.lit("")})
    return tag(new, model, "p_partkey", ("unique", "multi")), model


def tag_multi(spark, sf_dir):
    """Type and brand of parts by name words that all types and brands share."""
    return _part_tagged(spark, sf_dir)[0]


def result_columns(spark, sf_dir):
    tagged, model = _part_tagged(spark, sf_dir)
    return clean.result_columns(tagged, model.columns, "p_partkey")


def tag_labels(spark, sf_dir):
    """Quality and toxicity of unlabelled documents from the labelled ones, first two stages."""
    model = md.train(inputs.labelled_documents(spark, sf_dir), "doc_id", ln.LABEL_TAGS)
    return tag(inputs.unlabelled_documents(spark, sf_dir), model, "doc_id", ("unique", "multi"))


def tag_summary(spark, sf_dir):
    """Row counts of a whole run: known part rows and newly tagged ones."""
    new, learn = _match_tables(spark, sf_dir)
    old, rest = split_existing(new, learn, "p_partkey")
    model = md.train(learn, "p_partkey", ln.PART_TAGS)
    return summary(old, tag(rest, model, "p_partkey", ("unique", "multi")))


def tag_rows(spark, sf_dir):
    """Quality and toxicity of unlabelled documents, all three stages."""
    model = md.train(inputs.labelled_documents(spark, sf_dir), "doc_id", ln.LABEL_TAGS)
    return tag(inputs.unlabelled_documents(spark, sf_dir), model, "doc_id")


def tag_customers(spark, sf_dir):
    """Nation of customers by the supplier name most like theirs: all rows reach stage three."""
    learn = inputs.table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("nation")
    )
    new = inputs.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("name"), F.lit("").alias("nation")
    )
    return tag(new, md.train(learn, "s_suppkey", ["nation"]), "s_suppkey")


def similar_words(spark, sf_dir):
    """Two best document words for every word of the conversations."""
    words = tx.row_words(F.col("text"))
    tokens = inputs.table(spark, sf_dir, "conversations").select(F.explode(words).alias("token"))
    vocabulary = inputs.table(spark, sf_dir, "documents").select(F.explode(words).alias("word"))
    return similar.similar_words(tokens, vocabulary, 2)


def similar_words_lev(spark, sf_dir):
    """Two best part descriptions by edit distance for every one with a typo."""
    parts = inputs.table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_brand", "p_size").alias("word"))
    typo = F.concat(F.substr("word", F.lit(1), F.lit(2)), F.lit("x"), F.substr("word", F.lit(4)))
    return edits.words_within_edits(parts.select(typo.alias("token")), parts, 2)


def _relevance(spark, sf_dir):
    relabelled = clean.relabel_relevance(inputs.legacy_documents(spark, sf_dir), "de")
    return ngrams.relevance_ngrams(relabelled)


def tag_relevance(spark, sf_dir):
    usable = keep(_relevance(spark, sf_dir)[0])
    return legacy.tag_relevance(inputs.legacy_turns(spark, sf_dir), usable, "doc_id")


def tag_by_ngram(spark, sf_dir):
    learn = inputs.legacy_documents(spark, sf_dir)
    words = keep(ngrams.tag_ngrams(learn, _relevance(spark, sf_dir)[1], "de"))
    fill = keep(profile.fill_values(learn, "Tag", ["source"]))
    turns = inputs.legacy_turns(spark, sf_dir)
    return legacy.tag_by_ngram(turns, words, "doc_id", fill, ["source"])


def tag_by_column(spark, sf_dir):
    """Orders all of whose line items seen twice or more were returned."""
    tags = keep(profile.column_tags(_flagged_orders(spark, sf_dir), "Tag", ["orderkey", "suppkey"]))
    orders = inputs.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.lit("").alias("Tag"),
        F.col("o_orderkey").cast("string").alias("orderkey"),
    )
    return legacy.tag_by_column(orders, tags, "id", ["orderkey"])


def best_text_match(spark, sf_dir):
    """Supplier name most like each customer name."""
    names = inputs.table(spark, sf_dir, "customer").select(F.col("c_name").alias("token"))
    known = inputs.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("word"))
    return similar.best_text(names, known)


def tag_similar(spark, sf_dir):
    learn = inputs.legacy_suppliers(spark, sf_dir)
    new = inputs.legacy_customers(spark, sf_dir)
    return legacy.tag_similar(new, learn, "id", ["region"], ["Text", "region"])


def cascade_old(spark, sf_dir):
    """Rows of the legacy input that the learn table knows."""
    learn = inputs.legacy_suppliers(spark, sf_dir)
    return flows.old_of_cascade(learn, inputs.legacy_customers(spark, sf_dir), "id")


def cascade_tagged(spark, sf_dir):
    learn = inputs.legacy_suppliers(spark, sf_dir)
    new = inputs.legacy_customers(spark, sf_dir)
    vocabularies = flows.learn_cascade(learn, new, "id")
    return flows.run_cascade(learn, new, vocabularies, "id", by_column=True)[1]


QUERIES = {
    f.__name__: f
    for f in (
        tag_unique,
        tag_multi,
        result_columns,
        tag_labels,
        tag_summary,
        tag_rows,
        tag_customers,
        similar_words,
        tag_relevance,
        tag_by_ngram,
        tag_by_column,
        best_text_match,
        tag_similar,
        similar_words_lev,
        cascade_old,
        cascade_tagged,
    )
}

# ---------------------------------------------------------------- oracle SQL


def _new_words(new: str) -> str:
    """CTE nw (id, word) from a query (id, text, ...): text plus the blanks of two empty cells."""
    return f"""
    new AS ({new}),
    nw AS (SELECT DISTINCT id, word FROM
             (SELECT id, unnest(regexp_split_to_array(
                lower(CASE WHEN text = '' THEN '' ELSE text || '  ' END), '[ ,;:]+')) AS word
              FROM new))"""


def _stage_one(tags: list[str]) -> str:
    chosen = ", ".join(f"max(CASE WHEN tag_col = '{t}' THEN tag END) AS {t}" for t in tags)
    return f"""
    s1 AS (SELECT id, count(*) AS hits, 100 AS qual, {chosen}
           FROM nw JOIN u USING (word) GROUP BY id)"""


def _stage_two(tags: list[str]) -> str:
    chosen = ", ".join(
        f"max_by(tag, place) FILTER (tag_col = '{t}') AS {t}" for t in tags
    )
    return f"""
    h2 AS (SELECT id, tag, tag_col, probability, row_number() OVER
             (PARTITION BY id ORDER BY probability DESC, word DESC, tag, tag_col) AS place
           FROM nw JOIN m USING (word) WHERE id NOT IN (SELECT id FROM s1)),
    t2 AS (SELECT id, tag, tag_col, min(place) AS place, count(*) AS n,
                  max(probability) AS qual FROM h2 GROUP BY 1, 2, 3),
    s2 AS (SELECT id, sum(n) AS hits, max(qual) AS qual, {chosen} FROM t2 GROUP BY id)"""


def _result(key: str, text: str, tags: list[str], stages: str) -> str:
    enough = f"hits >= {len(tags)}"
    chosen = ", ".join(f"CASE WHEN {enough} THEN s.{t} END AS {t}" for t in tags)
    return f"""SELECT n.id AS {key}, n.text AS {text}, {chosen},
            CASE WHEN hits IS NULL THEN 0 WHEN {enough} THEN qual ELSE 1 END::int AS TB_qual
        FROM new n LEFT JOIN ({stages}) s ON n.id = s.id"""


def _both(tags: list[str]) -> str:
    names = ", ".join(tags)
    return f"""SELECT id, hits, qual, {names} FROM s1
        UNION ALL SELECT id, hits, qual, {names} FROM s2"""


_TURNS = "SELECT conv_id || '-' || turn AS id, text FROM conversations"
_PARTS = "SELECT p_partkey AS id, p_name AS text FROM part"
_UNLABELLED = """SELECT doc_id AS id, text FROM documents
                 WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
_MODEL = f"{ln.PROBABILITIES_SQL}, {ln.UNIQUE_SQL}, {ln.MULTI_SQL}"

_TAG_MULTI = f"""WITH {ln.PART_W}, {_MODEL}, {_new_words(_PARTS)}, {_stage_one(ln.PART_TAGS)},
    {_stage_two(ln.PART_TAGS)} {_result("p_partkey", "p_name", ln.PART_TAGS, _both(ln.PART_TAGS))}"""

_NGRAM_HITS = f"""
    turns AS (SELECT conv_id || '-' || turn AS doc_id, {ln.UPPER_TEXT} AS Text FROM conversations),
    tw AS (SELECT doc_id, unnest(a) AS Ngram, unnest(range(len(a))) AS pos FROM
             (SELECT doc_id, list_filter(regexp_split_to_array(Text, '{ln.SPACE}'),
                     lambda w: w NOT IN ('', 'None')) AS a FROM turns))"""


def _hits(vocabulary: str) -> str:
    return f"""
    hits AS (SELECT doc_id, max_by(ngramTag, pos) AS result,
                    count(DISTINCT ngramTag) > 1 AS conflict
             FROM tw JOIN {vocabulary} USING (Ngram) GROUP BY 1)"""


def _longest(s: str, t: str) -> str:
    """l, the length of the longest text of ``s`` that ``t`` holds, and i, its first place in ``s``, negated."""
    length = f"list_max(list_filter(range(1, length({s}) - i + 2), lambda k: contains({t}, substr({s}, i, k))))"
    return f"list_max(list_transform(range(1, length({s}) + 1), lambda i: {{'l': coalesce({length}, 0), 'i': -i}}))"


def _ratios(words: str, tokens: str) -> str:
    """CTE ``ratios`` (word, token, similarity): matching blocks left and right of the longest one, and so on."""
    return f"""
    pairs AS (SELECT DISTINCT w.word, t.token FROM ({words}) w CROSS JOIN ({tokens}) t),
    blocks AS (
        SELECT word, token, word AS s, token AS t, {_longest("word", "token")} AS m FROM pairs
        UNION ALL
        SELECT word, token, s, t, {_longest("s", "t")} AS m FROM (
            SELECT word, token, p.s AS s, p.t AS t FROM (
                SELECT word, token, unnest([
                    {{'s': substr(s, 1, -m.i - 1), 't': substr(t, 1, j - 1)}},
                    {{'s': substr(s, m.l - m.i), 't': substr(t, j + m.l)}}]) AS p
                FROM (SELECT *, instr(t, substr(s, -m.i, m.l)) AS j FROM blocks WHERE m.l > 0)))
        WHERE s <> '' AND t <> ''),
    ratios AS (SELECT word, token, 2.0::double * sum(m.l) / (length(word) + length(token)) AS similarity
               FROM blocks GROUP BY word, token)"""


def _best(condition: str) -> str:
    return f"""best AS (SELECT token, word, similarity FROM ratios WHERE {condition}
        QUALIFY row_number() OVER (PARTITION BY token ORDER BY similarity DESC, word DESC) = 1)"""


_NAMES = "SELECT s_name AS word FROM supplier"
_ALIKE = f"""WITH RECURSIVE
    new AS (SELECT 'c' || c_custkey AS id, c_name AS Text FROM customer
            UNION ALL SELECT 's' || s_suppkey, upper(s_name) FROM supplier),
    {_ratios(_NAMES, "SELECT Text AS token FROM new")}, {_best("similarity >= 0.25")},
    learned AS (SELECT s_name AS word, CASE WHEN s_nationkey = 0 THEN 'y' ELSE s_nationkey::varchar END AS Tag,
                       'R' || n_regionkey AS region
                FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
                QUALIFY row_number() OVER (PARTITION BY s_name ORDER BY s_suppkey) = 1),
    alike AS (SELECT id, coalesce(Tag, '') AS Tag, Text, coalesce(region, '') AS region, '' AS Edit,
                     coalesce(round(similarity, 2), 0.0)::double AS Quality
              FROM new LEFT JOIN best ON token = Text LEFT JOIN learned USING (word))"""


ORACLES = {
    "best_text_match": f"""WITH RECURSIVE {_ratios(_NAMES, "SELECT c_name AS token FROM customer")},
        {_best("similarity >= 0.25")} SELECT token, word, similarity FROM best""",
    # no name is so much like a supplier's that the joined texts are compared as well
    "tag_similar": f"{_ALIKE} SELECT * FROM alike",
    "cascade_tagged": f"{_ALIKE} SELECT * FROM alike WHERE id LIKE 'c%'",
    "similar_words_lev": """WITH
        words AS (SELECT DISTINCT concat_ws(' ', p_name, p_brand, p_size) AS word FROM part),
        tokens AS (SELECT DISTINCT word[1:2] || 'x' || word[4:] AS token FROM words),
        rated AS (SELECT token, word, levenshtein(token, word) AS edits, greatest(length(token), length(word)) AS longest
                  FROM tokens CROSS JOIN words WHERE length(token) >= 5 AND length(word) >= 5)
        SELECT token, word, 1.0::double - edits / longest AS similarity FROM rated WHERE edits * 100 <= 20 * longest
        QUALIFY row_number() OVER (PARTITION BY token ORDER BY similarity DESC, word DESC) <= 2""",
    "tag_customers": f"""WITH RECURSIVE
        {_ratios("SELECT lower(s_name) AS word FROM supplier", "SELECT lower(c_name) AS token FROM customer")},
        {_best("similarity > 0.3 AND length(word) / length(token) BETWEEN 0.95 AND 1.05")}
        SELECT c_custkey AS s_suppkey, c_name AS name, nation, coalesce(trunc(similarity * 100), 0)::int AS TB_qual
        FROM customer LEFT JOIN best ON token = lower(c_name)
        LEFT JOIN (SELECT lower(s_name) AS word, s_nationkey::varchar AS nation FROM supplier) USING (word)""",
    "tag_unique": f"""WITH {ln.DOCUMENT_W}, {_MODEL}, {_new_words(_TURNS)},
        {_stage_one(ln.DOCUMENT_TAGS)}
        {_result("doc_id", "text", ln.DOCUMENT_TAGS, "SELECT * FROM s1")}""",
    "tag_multi": _TAG_MULTI,
    "result_columns": f"""SELECT p_partkey, p_name, p_type, p_brand, 'y' AS TB_edit, TB_qual,
            CASE WHEN q < 0.2 THEN 'red' WHEN q < 0.9 THEN 'yellow' END AS quality_band
        FROM (SELECT *, CASE WHEN TB_qual > 1 THEN TB_qual / 100 ELSE TB_qual END AS q
              FROM ({_TAG_MULTI}))""",
    "tag_labels": f"""WITH {ln.LABEL_W}, {_MODEL}, {_new_words(_UNLABELLED)},
        {_stage_one(ln.LABEL_TAGS)}, {_stage_two(ln.LABEL_TAGS)}
        {_result("doc_id", "text", ln.LABEL_TAGS, _both(ln.LABEL_TAGS))}""",
    # new rows here keep filled tag cells, and these count as words as well
    "tag_summary": f"""WITH {ln.PART_W}, {_MODEL}, {_MATCH.replace("new AS", "input AS")},
        {_new_words("""SELECT p_partkey AS id, p_name || ' ' || p_type || ' ' || p_brand AS text
                       FROM input WHERE k NOT IN (SELECT k FROM learn)""")},
        {_stage_one(ln.PART_TAGS)}, {_stage_two(ln.PART_TAGS)},
        r AS ({_result("id", "text", ln.PART_TAGS, _both(ln.PART_TAGS))})
        SELECT (SELECT count(*) FROM input) AS input,
               (SELECT count(*) FROM input WHERE k IN (SELECT k FROM learn)) AS known,
               count(*) AS new, count(*) FILTER (TB_qual > 1) AS tagged,
               count(*) FILTER (TB_qual = 1) AS unclear,
               count(*) FILTER (TB_qual = 0) AS untagged FROM r""",
    "tag_relevance": f"""WITH {ln.RELEVANCE_SQL}, {_NGRAM_HITS}, {_hits("rel")}
        SELECT doc_id, CASE WHEN result = 'not_relevant' AND NOT conflict THEN 'y' ELSE '' END AS Tag,
            Text, '' AS source, CASE WHEN conflict THEN 'NEW' ELSE '' END AS Edit,
            CASE WHEN conflict THEN 0.0::double
                 WHEN result = 'not_relevant' THEN 1.0::double END AS Quality
        FROM turns LEFT JOIN hits USING (doc_id)""",
    "tag_by_ngram": f"""WITH {ln.RELEVANCE_SQL}, {ln.TAG_NGRAMS_SQL}, {_NGRAM_HITS}, {_hits("gen")},
        fill AS (SELECT lang, source AS val FROM
                   (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2)
                 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) = 1)
        SELECT doc_id, CASE WHEN conflict = false THEN result ELSE '' END AS Tag, Text,
            CASE WHEN conflict = false THEN val ELSE '' END AS source,
            CASE WHEN conflict THEN 'NEW' ELSE '' END AS Edit,
            CASE WHEN conflict THEN 0.0::double WHEN NOT conflict THEN 1.0::double END AS Quality
        FROM turns LEFT JOIN hits USING (doc_id) LEFT JOIN fill ON fill.lang = result""",
    "cascade_old": """SELECT 's' || s_suppkey AS id,
            CASE WHEN s_nationkey = 0 THEN 'y' ELSE s_nationkey::varchar END AS Tag,
            upper(s_name) AS Text, 'R' || n_regionkey AS region, 'OLD' AS Edit, 1.0::double AS Quality
        FROM (SELECT *, row_number() OVER (PARTITION BY s_name ORDER BY s_suppkey) AS r FROM supplier)
        JOIN nation ON s_nationkey = n_nationkey WHERE r = 1""",
    "tag_by_column": f"""WITH {_COLUMN_TAGS},
        bad AS (SELECT val FROM ct WHERE col = 'orderkey' AND Tag = 'not_relevant')
        SELECT o_orderkey AS id, CASE WHEN val IS NULL THEN '' ELSE 'y' END AS Tag,
            o_orderkey::varchar AS orderkey, '' AS Edit,
            CASE WHEN val IS NULL THEN NULL ELSE 1.0::double END AS Quality
        FROM orders LEFT JOIN bad ON val = o_orderkey::varchar""",
}
