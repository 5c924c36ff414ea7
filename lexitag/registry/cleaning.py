"""Queries on filters, row matching, profiles, fill values and report parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexitag.functions import text as tx
from lexitag.operators import clean, profile
from lexitag.operators.existing import split_existing, split_existing_normalised
from lexitag.operators.lasting import keep
from lexitag.registry import inputs
from lexitag.sources import report

EXCLUDES = {"p_type": ["^eco", "MO$"], "p_name": ["anvil"], "p_brand": ["", "#1[0-4]$"]}
CUSTOMER_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def dedupe_rows(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return clean.distinct_rows(rows, "doc_id")


def exclude_regex(spark, sf_dir):
    return clean.exclude_patterns(inputs.part_rows(spark, sf_dir), EXCLUDES)


def exclude_values(spark, sf_dir):
    """Customers but those of the nations of region 0 and of the first market segment."""
    customers = inputs.table(spark, sf_dir, "customer")
    nations = inputs.table(spark, sf_dir, "nation").where("n_regionkey = 0")
    values = nations.select(F.col("n_nationkey").cast("string").alias("c_nationkey"))
    first = customers.agg(F.min("c_mktsegment").alias("c_mktsegment"))
    values = values.unionByName(first, allowMissingColumns=True)
    return clean.exclude_values(customers, values, "c_custkey")


def aligned_filter(spark, sf_dir):
    """Event types with as many word characters as the ship months of all line items have."""
    items = inputs.table(spark, sf_dir, "lineitem")
    learn = items.select(F.date_format("l_shipdate", "yyyyMM").alias("code"))
    events = inputs.table(spark, sf_dir, "events")
    new = events.select("event_id", "user_id", F.col("event_type").alias("code"))
    return clean.aligned_rows(new, learn)


def _label_cells(spark, sf_dir):
    documents = inputs.table(spark, sf_dir, "documents")
    return documents.join(inputs.table(spark, sf_dir, "labels"), "doc_id", "left").select(
        "doc_id",
        F.when(F.col("lang") == "de", "None").otherwise(F.col("lang")).alias("lang"),
        "source",
        F.col("quality").cast("string").alias("quality"),
        F.col("toxic").cast("string").alias("toxic"),
        F.when(F.col("n_chars") > 2000, "").otherwise(F.col("n_chars").cast("string")).alias("size"),
    )


def sparse_rows(spark, sf_dir):
    return clean.none_cells_to_empty(clean.drop_sparse_rows(_label_cells(spark, sf_dir), "doc_id"))


def relabel_relevance(spark, sf_dir):
    events = inputs.table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    return clean.relabel_relevance(events, "error", "event_type", "props")


def space_cleaning(spark, sf_dir):
    pages = inputs.table(spark, sf_dir, "pages")
    html = F.col("html")
    return pages.select(
        "page_id",
        tx.drop_spaces(html).alias("spaceless"),
        tx.collapse_spaces(html).alias("collapsed"),
    )


def _match_tables(spark, sf_dir):
    """Parts, and the same parts in other letter case with brands made from their sizes."""
    learn = inputs.part_rows(spark, sf_dir)
    size = F.col("p_size").cast("string")
    new = inputs.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.initcap("p_name").alias("p_name"),
        F.lower("p_type").alias("p_type"),
        F.concat(F.lit("BRAND#"), size).alias("p_brand"),
    )
    return new, learn


def existing_rows(spark, sf_dir):
    return split_existing(*_match_tables(spark, sf_dir), "p_partkey")[0]


def new_rows(spark, sf_dir):
    return split_existing(*_match_tables(spark, sf_dir), "p_partkey")[1]


def _legacy_match(spark, sf_dir):
    part = inputs.table(spark, sf_dir, "part")
    learn = part.select(
        "p_partkey",
        F.col("p_type").alias("Tag"),
        F.col("p_name").alias("Text"),
        "p_brand",
        F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("size"),
    )
    new = part.select(
        "p_partkey",
        F.lit("").alias("Tag"),
        F.upper(F.replace("p_name", F.lit(" "), F.lit("  "))).alias("Text"),
        F.concat(F.lit("brand#"), F.col("p_size").cast("string")).alias("p_brand"),
        F.lit("").alias("size"),
    )
    columns = ["Tag", "Text", "p_brand", "size"]
    compare, fill = profile.compare_columns(new, learn, columns)
    return split_existing_normalised(new, learn, "p_partkey", compare, fill)


def existing_normalised(spark, sf_dir):
    return _legacy_match(spark, sf_dir)[0]


def new_normalised(spark, sf_dir):
    return _legacy_match(spark, sf_dir)[1]


def conflicts(spark, sf_dir):
    return _legacy_match(spark, sf_dir)[2]


def column_profile(spark, sf_dir):
    return profile.column_profile(inputs.table(spark, sf_dir, "customer"), CUSTOMER_COLUMNS)


def compare_columns(spark, sf_dir):
    learn = inputs.part_rows(spark, sf_dir)
    new = learn.withColumn("p_type", F.lit(""))
    return profile.compare_profile(new, learn, ["p_name", "p_type", "p_brand"])


def _flagged_orders(spark, sf_dir):
    items = inputs.table(spark, sf_dir, "lineitem")
    flag = F.when(F.col("l_returnflag") == "R", "not_relevant").otherwise("relevant")
    return items.select(
        flag.alias("Tag"),
        F.col("l_orderkey").cast("string").alias("orderkey"),
        F.col("l_suppkey").cast("string").alias("suppkey"),
    )


def column_tags(spark, sf_dir):
    return profile.column_tags(_flagged_orders(spark, sf_dir), "Tag", ["orderkey", "suppkey"])


def _fill_learn(spark, sf_dir):
    return inputs.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_type").alias("Tag"),
        "p_name",
        "p_brand",
        F.col("p_size").cast("string").alias("p_size"),
    )


def fill_values(spark, sf_dir):
    learn = _fill_learn(spark, sf_dir)
    new = learn.withColumns({"p_brand": F.lit(""), "p_size": F.lit(None).cast("string")})
    empty = profile.empty_columns(new, ["p_name", "p_brand", "p_size"])
    return profile.fill_values(learn, "Tag", empty)


def fill_columns(spark, sf_dir):
    learn = _fill_learn(spark, sf_dir)
    fill = keep(profile.fill_values(learn, "Tag", ["p_brand", "p_size"]))
    large = F.col("p_size").cast("int") > 25
    rows = learn.withColumns(
        {
            "p_brand": F.when(large, "").otherwise(F.col("p_brand")),
            "p_size": F.when(large, None).otherwise(F.col("p_size")),
        }
    )
    return profile.fill_columns(rows, fill, ["p_brand", "p_size"], "p_partkey")


def distinct_tags(spark, sf_dir):
    return profile.distinct_tags(_fill_learn(spark, sf_dir))


def report_lines(spark, sf_dir):
    return report.parse_report(inputs.report_lines(spark, sf_dir))


def report_legacy(spark, sf_dir):
    """Cost, by-number and small-asset lines of the legacy layout."""
    return report.parse_report(inputs.legacy_report_lines(spark, sf_dir), "legacy")


def report_own_kinds(spark, sf_dir):
    """Asset lines by number and small ones only, by a list of kinds."""
    own = report.kinds()[2:]
    return report.parse_report(inputs.legacy_report_lines(spark, sf_dir), own)


def exclude_many(spark, sf_dir):
    """Customers but those whose name ends with one of 5,000 four-digit numbers, the even ones."""
    customers = inputs.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return clean.exclude_patterns(customers, {"c_name": [f"{i:04d}$" for i in range(0, 10_000, 2)]})


QUERIES = {
    f.__name__: f
    for f in (
        dedupe_rows,
        exclude_regex,
        exclude_values,
        aligned_filter,
        sparse_rows,
        relabel_relevance,
        space_cleaning,
        existing_rows,
        new_rows,
        existing_normalised,
        new_normalised,
        conflicts,
        column_profile,
        compare_columns,
        column_tags,
        fill_values,
        fill_columns,
        distinct_tags,
        report_lines,
        report_legacy,
        report_own_kinds,
        exclude_many,
    )
}

# ---------------------------------------------------------------- oracle SQL

_MATCH = """
    learn AS (SELECT p_partkey, p_name, p_type, p_brand,
                     upper(p_name) || '|' || upper(p_type) || '|' || upper(p_brand) AS k FROM part),
    new AS (SELECT p_partkey, upper(p_name[1]) || p_name[2:position(' ' IN p_name)]
                     || upper(p_name[position(' ' IN p_name) + 1])
                     || p_name[position(' ' IN p_name) + 2:] AS p_name,
                   lower(p_type) AS p_type, 'BRAND#' || p_size AS p_brand,
                   upper(p_name) || '|' || upper(p_type) || '|BRAND#' || p_size AS k FROM part)"""

_LEGACY_MATCH = """
    learn AS (SELECT *, upper(replace(p_name, ' ', '')) || '|' || upper(p_brand) AS k FROM part),
    new AS (SELECT *, upper(replace(p_name, ' ', '')) || '|BRAND#' || p_size AS k FROM part)"""

_PROFILE = " UNION ALL ".join(
    f"""SELECT '{c}' AS col, count(*) AS rows,
           count(DISTINCT {c}) + (CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END) AS distinct_all,
           count(DISTINCT {c}) AS distinct_values FROM customer"""
    for c in CUSTOMER_COLUMNS
)

_COLUMN_TAGS = """
    flagged AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'not_relevant' ELSE 'relevant' END AS Tag,
                       l_orderkey::varchar AS orderkey, l_suppkey::varchar AS suppkey FROM lineitem),
    ctc AS (SELECT col, val, Tag, count(*) AS n FROM
              (SELECT 'orderkey' AS col, orderkey AS val, Tag FROM flagged
               UNION ALL SELECT 'suppkey', suppkey, Tag FROM flagged)
            GROUP BY 1, 2, 3 HAVING count(*) >= 2),
    ct AS (SELECT col, val, min(Tag) AS Tag FROM ctc GROUP BY 1, 2 HAVING count(*) = 1)"""

_FILL = """
    fc AS (SELECT Col, Tag, Val, count(*) AS n FROM
             (SELECT 'p_brand' AS Col, p_type AS Tag, p_brand AS Val FROM part
              UNION ALL SELECT 'p_size', p_type, p_size::varchar FROM part) GROUP BY 1, 2, 3),
    fill AS (SELECT Col, Tag, Val FROM
               (SELECT *, row_number() OVER (PARTITION BY Col, Tag ORDER BY n DESC, Val) AS r FROM fc)
             WHERE r = 1)"""

ORACLES = {
    "dedupe_rows": "SELECT min(doc_id) AS doc_id, text, lang FROM documents GROUP BY text, lang",
    "exclude_regex": """SELECT p_partkey, p_name, p_type, p_brand FROM part
        WHERE NOT regexp_matches(p_type, '^ECO') AND NOT regexp_matches(p_type, 'MO$')
          AND NOT regexp_matches(p_name, 'ANVIL') AND NOT regexp_matches(p_brand, '#1[0-4]$')""",
    "exclude_values": """SELECT * FROM customer
        WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)
          AND c_mktsegment <> (SELECT min(c_mktsegment) FROM customer)""",
    "aligned_filter": """SELECT event_id, user_id, event_type AS code FROM events
        WHERE regexp_full_match(event_type, '\\w{6}')
          AND (SELECT min(length(strftime(l_shipdate, '%Y%m'))) = 6
                  AND max(length(strftime(l_shipdate, '%Y%m'))) = 6 FROM lineitem)""",
    "sparse_rows": """SELECT doc_id, replace(lang, 'None', '') AS lang, source, quality, toxic, size
        FROM (SELECT doc_id, CASE WHEN lang = 'de' THEN 'None' ELSE lang END AS lang, source,
                     quality::varchar AS quality, toxic::varchar AS toxic,
                     CASE WHEN n_chars > 2000 THEN '' ELSE n_chars::varchar END AS size
              FROM documents LEFT JOIN labels USING (doc_id))
        WHERE (lang = 'None')::int + (source = '')::int + (quality IS NULL)::int
              + (toxic IS NULL)::int + (size = '')::int <= 2""",
    "relabel_relevance": """SELECT event_id, CASE WHEN event_type = 'error' THEN 'not_relevant'
            ELSE 'relevant' END AS event_type, upper(props) AS props
        FROM events WHERE props IS NOT NULL""",
    "space_cleaning": """SELECT page_id, replace(html, ' ', '') AS spaceless,
        replace(replace(html, '   ', ''), '  ', '') AS collapsed FROM pages""",
    "existing_rows": f"""WITH {_MATCH} SELECT n.p_partkey, f.p_name, f.p_type, f.p_brand,
            'OLD' AS TB_edit, 100 AS TB_qual
        FROM new n JOIN (SELECT * FROM learn QUALIFY row_number()
                         OVER (PARTITION BY k ORDER BY p_partkey) = 1) f ON n.k = f.k""",
    "new_rows": f"""WITH {_MATCH} SELECT p_partkey, p_name, p_type, p_brand
        FROM new WHERE k NOT IN (SELECT k FROM learn)""",
    "existing_normalised": f"""WITH {_LEGACY_MATCH}
        SELECT n.p_partkey, f.p_type AS Tag, upper(replace(n.p_name, ' ', '  ')) AS Text,
            'brand#' || n.p_size AS p_brand, 'size' || f.p_size AS size,
            'OLD' AS Edit, 1.0::double AS Quality
        FROM new n JOIN (SELECT * FROM learn QUALIFY row_number()
                         OVER (PARTITION BY k ORDER BY p_partkey) = 1) f ON n.k = f.k""",
    "new_normalised": f"""WITH {_LEGACY_MATCH}
        SELECT p_partkey, '' AS Tag, upper(replace(p_name, ' ', '  ')) AS Text,
            'brand#' || p_size AS p_brand, '' AS size, '' AS Edit
        FROM new WHERE k NOT IN (SELECT k FROM learn)""",
    "conflicts": f"""WITH {_LEGACY_MATCH}
        SELECT p_partkey, p_type AS Tag, p_name AS Text, p_brand, 'size ' || p_size AS size
        FROM learn WHERE k IN (SELECT k FROM new)
          AND k IN (SELECT k FROM learn GROUP BY k HAVING count(DISTINCT p_type) > 1)""",
    "column_profile": f"""SELECT *, distinct_all / rows * 100 AS uniqueness,
            distinct_values / rows * 100 AS variability,
            CASE WHEN distinct_all / rows * 100 > 10 THEN 'unique' ELSE 'other' END AS kind,
            distinct_values / rows * 100 > 0.5 AS is_variable
        FROM ({_PROFILE})""",
    "compare_columns": """SELECT *, filled > 0 AND distinct_values > 5 AS compare FROM (
            SELECT 'p_name' AS col, count(DISTINCT p_name) AS distinct_values,
                   count(*) FILTER (length(p_name) > 0) AS filled FROM part
            UNION ALL SELECT 'p_type', count(DISTINCT p_type), 0 FROM part
            UNION ALL SELECT 'p_brand', count(DISTINCT p_brand),
                   count(*) FILTER (length(p_brand) > 0) FROM part)""",
    "column_tags": f"WITH {_COLUMN_TAGS} SELECT * FROM ct",
    "fill_values": f"WITH {_FILL} SELECT * FROM fill",
    "fill_columns": f"""WITH {_FILL}
        SELECT p_partkey, p_type AS Tag, p_name,
            CASE WHEN p_size > 25 THEN b.Val ELSE p_brand END AS p_brand,
            CASE WHEN p_size > 25 THEN s.Val ELSE p_size::varchar END AS p_size
        FROM part
        LEFT JOIN (SELECT * FROM fill WHERE Col = 'p_brand') b ON b.Tag = p_type
        LEFT JOIN (SELECT * FROM fill WHERE Col = 'p_size') s ON s.Tag = p_type""",
    "distinct_tags": "SELECT DISTINCT p_type AS Tag FROM part",
    "report_lines": """SELECT
            CASE WHEN l_returnflag = 'A' THEN 'Anlagen' ELSE 'Kosten' END AS Art,
            l_suppkey::varchar AS Kostenstelle,
            CASE WHEN l_returnflag = 'A' THEN upper(s_name)
                 ELSE upper(s_name) || ' ORDER ' || l_orderkey END AS Text,
            CASE WHEN l_returnflag = 'A' THEN '' ELSE l_partkey::varchar END AS Kostenart,
            CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS Betrag,
            l_shipdate::date AS Datum, strftime(l_shipdate, '%Y') AS Jahr,
            CASE WHEN l_returnflag = 'A' THEN lpad(l_orderkey::varchar, 7, '0')
                 ELSE l_orderkey::varchar END AS Referenz
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "report_legacy": """SELECT
            CASE WHEN l_returnflag IN ('A', 'R') THEN 'Anlagen' ELSE 'Kosten' END AS Art,
            CASE WHEN l_returnflag = 'A' THEN lpad(l_suppkey::varchar, 7, '0') ELSE l_suppkey::varchar END AS Kostenstelle,
            '' AS Tag,
            CASE WHEN l_returnflag IN ('A', 'R') THEN 'PART ' || l_partkey
                 ELSE 'PART ' || l_partkey || ' ORDER ' || l_orderkey END AS Text,
            CASE WHEN l_returnflag IN ('A', 'R') THEN '' ELSE l_partkey::varchar END AS Kostenart,
            CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS Betrag,
            l_shipdate::date AS Datum, strftime(l_shipdate, '%Y') AS Jahr, 'b' AS Beschaffungsklasse, '' AS CKA,
            CASE WHEN l_returnflag = 'A' THEN lpad(l_orderkey::varchar, 7, '0')
                 ELSE l_orderkey::varchar END AS Referenz
        FROM lineitem""",
    "report_own_kinds": """SELECT 'Anlagen' AS Art,
            CASE WHEN l_returnflag = 'A' THEN lpad(l_suppkey::varchar, 7, '0') ELSE l_suppkey::varchar END AS Kostenstelle,
            'PART ' || l_partkey AS Text, '' AS Kostenart,
            CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS Betrag,
            l_shipdate::date AS Datum, strftime(l_shipdate, '%Y') AS Jahr,
            CASE WHEN l_returnflag = 'A' THEN lpad(l_orderkey::varchar, 7, '0')
                 ELSE l_orderkey::varchar END AS Referenz
        FROM lineitem WHERE l_returnflag IN ('A', 'R')""",
    "exclude_many": "SELECT c_custkey, c_name FROM customer WHERE CAST(right(c_name, 4) AS INT) % 2 = 1",
}
