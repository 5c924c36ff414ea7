"""Learn and input tables of the registered queries, all whole tables of the test data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


SPREAD = "spark.lexitag.spread"
TEXT_TABLES = {
    "documents": ["doc_id"],
    "conversations": ["conv_id", "turn"],
    "lineitem": ["l_orderkey", "l_linenumber"],
    "pages": ["page_id"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as it lies. A session whose files are single pieces that cannot be split, as those
    of the bench, may ask for text tables to be dealt out first by setting SPREAD."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key, pieces = TEXT_TABLES.get(name), spark.conf.get(SPREAD, None)
    return df.repartition(int(pieces), *key) if key and pieces else df


def part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key, part name, two tag columns; every name word is ambiguous in both."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels: two tag columns as text."""
    return _labels(spark, sf_dir, "inner")


def unlabelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without labels, tag cells empty."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    rest = documents.join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")
    return rest.withColumns({"quality": F.lit(""), "toxic": F.lit("")})


def _labels(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    return documents.join(labels, "doc_id", how).select(
        "doc_id",
        "text",
        F.col("quality").cast("string").alias("quality"),
        F.col("toxic").cast("string").alias("toxic"),
    )


def conversation_key() -> Column:
    return F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))


def conversation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as new rows for the document model, tag cells empty."""
    return table(spark, sf_dir, "conversations").select(
        conversation_key().alias("doc_id"),
        "text",
        F.lit("").alias("lang"),
        F.lit("").alias("source"),
    )


def legacy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a legacy learn table: Tag is the language."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("Tag"), F.col("text").alias("Text"), "source"
    )


def legacy_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as legacy input: text in upper case, no tag, no source."""
    return table(spark, sf_dir, "conversations").select(
        conversation_key().alias("doc_id"),
        F.lit("").alias("Tag"),
        F.upper("text").alias("Text"),
        F.lit("").alias("source"),
    )


def legacy_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a legacy learn table with one-word texts; nations are tags, nation 0 is 'y'."""
    nation = F.col("s_nationkey").cast("string")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    suppliers = table(spark, sf_dir, "supplier")
    return suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("s_suppkey").alias("id"),
        F.when(nation == "0", "y").otherwise(nation).alias("Tag"),
        F.col("s_name").alias("Text"),
        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("region"),
    )


def legacy_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer and supplier names as legacy input, tag and region empty."""
    customers = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"),
        F.col("c_name").alias("Text"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"),
        F.upper("s_name").alias("Text"),
    )
    names = customers.unionByName(suppliers)
    return names.select("id", F.lit("").alias("Tag"), "Text", F.lit("").alias("region"))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as report text: shipped-back items as asset lines, all others as cost lines."""
    items = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"),
        F.col("l_suppkey") == F.col("s_suppkey"),
    )
    day = F.date_format("l_shipdate", "dd.MM.yyyy")
    year = F.date_format("l_shipdate", "yyyy")
    value = F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    sign = F.when(F.col("l_returnflag") == "R", "-").otherwise(" ")
    cost = F.concat_ws(
        "|",
        F.lit(""),
        F.concat(F.lit("  "), year),
        F.concat("l_suppkey", F.lit(" ")),
        F.concat("l_partkey", F.lit("  ")),
        F.lit("Material "),
        F.concat(day, F.lit(" ")),
        F.concat(F.lit("   "), value, sign),
        F.concat("s_name", F.lit("  ")),
        F.concat(F.lit("order "), "l_orderkey", F.lit(" ")),
        F.lit("Partner "),
        F.lit("  "),
        F.concat("l_orderkey", F.lit(" ")),
        F.concat("l_linenumber", F.lit(" ")),
        F.lit("RB \n"),
    )
    asset = F.concat_ws(
        "|",
        F.lit(""),
        F.concat("l_suppkey", F.lit(" ")),
        F.lit("678 "),
        F.lit("0 "),
        day,
        F.concat("s_name", F.lit(" ")),
        F.concat(F.lit(" "), value, F.lit(" ")),
        F.lit("EUR "),
        F.lit("long "),
        F.concat(F.lpad(F.col("l_orderkey").cast("string"), 7, "0"), F.lit(" ")),
        F.lit("900 "),
        F.lit("\n"),
    )
    return items.select(F.when(F.col("l_returnflag") == "A", asset).otherwise(cost).alias("line"))


def legacy_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as text of the legacy report: open items as cost lines, shipped-back ones as assets by
    number, returned ones as small assets."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_returnflag",
        F.col("l_suppkey").cast("string").alias("supp"),
        F.col("l_partkey").cast("string").alias("part"),
        F.col("l_orderkey").cast("string").alias("order"),
        F.date_format("l_shipdate", "dd.MM.yyyy").alias("day"),
        F.date_format("l_shipdate", "yyyy").alias("year"),
        F.translate(F.format_number("l_extendedprice", 2), ",.", ".,").alias("value"),
    )
    number = lambda c: F.lpad(F.col(c), 7, "0")

    def line(*fields) -> Column:
        return F.concat(*(x for f in fields for x in (F.lit("|"), f if isinstance(f, Column) else F.lit(f))))

    def after(c, end: str) -> Column:
        return F.concat(F.col(c) if isinstance(c, str) else c, F.lit(end))

    cost = line(
        after("year", "  "), after("supp", " "), after("part", " "), "Text ", after("day", " "), after("value", " "),
        F.concat(F.lit("part "), "part", F.lit(" ")), F.concat(F.lit("order "), "order"), "Partner ", " ",
        after("order", " "), "7 ", "RB 1 \n",
    )
    by_number = line(
        after(number("order"), " "), "0 ", after(number("supp"), " "), "678 ", F.col("day"), F.concat(F.lit("Part "), "part"),
        F.concat(F.lit(" "), "value", F.lit(" ")), "EUR ", "long ", "900 ", "\n",
    )
    small = line(
        "KST ", after("supp", " "), "Fonds ", "555 ", "V 9 ", F.col("day"), F.concat(F.lit("  "), "value", F.lit("-")),
        "Kreditor ", F.concat(F.lit("Part "), "part"), "short ", "name ", after("order", " "), " 1", "54 ", "Ist ",
        "Fipos ", "RW1 \n",
    )
    flag = F.col("l_returnflag")
    return items.select(F.when(flag == "A", by_number).when(flag == "R", small).otherwise(cost).alias("line"))
