"""Queries on readers and writers: given tables written to the checkpoint folder and read back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from lexitag.operators import clean
from lexitag.operators.lasting import checkpoint_folder
from lexitag.plans import flows
from lexitag.registry import inputs
from lexitag.registry import learning as ln
from lexitag.sources import store, tables


def _folder(spark):
    return f"{checkpoint_folder(spark)}/files-{uuid4().hex}"


def csv_round_trip(spark, sf_dir):
    """Whole documents through delimited text, with their quotes, backslashes and line breaks."""
    folder = _folder(spark)
    tables.write_table(inputs.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), folder)
    return tables.read_raw(spark, folder, multi_line=True)


def csv_mixed_headers(spark, sf_dir):
    """Customers of odd and even nations in files under one glob, with their columns in another order."""
    folder = _folder(spark)
    customers = inputs.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    odd = F.col("c_nationkey") % 2 == 1
    tables.write_table(customers.where(odd), f"{folder}/a")
    tables.write_table(customers.where(~odd).select("c_nationkey", "c_custkey", "c_name"), f"{folder}/b")
    return tables.read_raw(spark, f"{folder}/*")


def _part_files(spark, sf_dir):
    folder = _folder(spark)
    rows = inputs.part_rows(spark, sf_dir).withColumns({"TB_edit": F.lit(""), "TB_qual": F.lit(0)})
    tables.write_table(rows, f"{folder}/learn")
    return folder


def table_without_bookkeeping(spark, sf_dir):
    """Parts written with bookkeeping columns and read as a learn table without them."""
    return tables.read_table(spark, f"{_part_files(spark, sf_dir)}/learn")


def stored_model(spark, sf_dir):
    """The model of the part table, trained from files, stored and loaded again: its weights."""
    folder = _part_files(spark, sf_dir)
    for _ in range(2):  # the second run finds every table and builds none
        flows.train_from_files(spark, f"{folder}/learn", f"{folder}/model", ["p_type", "p_brand"])
    return flows.load_model(spark, f"{folder}/model").weights


def stored_column_names(spark, sf_dir):
    """The learn columns that a stored model names, in order."""
    folder = _part_files(spark, sf_dir)
    flows.train_from_files(spark, f"{folder}/learn", f"{folder}/model", ["p_type", "p_brand"])
    return store.load_table(spark, f"{folder}/model", store.COLUMNS).select("position", "data_col_names", "is_tag")


def decimal_table(spark, sf_dir):
    """Orders written with decimal commas and day-first dates, read as legacy input."""
    folder = _folder(spark)
    orders = inputs.table(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "dd.MM.yyyy").alias("Date"),
        F.col("o_orderkey").cast("string").alias("Text"),
        F.translate(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), ".", ",").alias("Amount"),
    )
    tables.write_table(orders, folder)
    return tables.read_decimal_table(spark, folder, ["Amount"])


def exclude_listed(spark, sf_dir):
    """Suppliers but those whose names a stored list of patterns holds."""
    folder = _folder(spark)
    suppliers = inputs.table(spark, sf_dir, "supplier").select("s_suppkey", F.upper("s_name").alias("s_name"), "s_nationkey")
    tables.write_table(suppliers.where("s_nationkey = 3").select("s_name"), folder)
    return clean.exclude_patterns(suppliers, tables.read_excludes(spark, folder))


def exclude_listed_values(spark, sf_dir):
    """Suppliers but those of the nations that a stored list of values holds."""
    folder = _folder(spark)
    nations = inputs.table(spark, sf_dir, "nation").where("n_regionkey = 1")
    values = nations.select(F.col("n_nationkey").alias("s_nationkey"))
    values.write.csv(folder, sep=tables.VALUE_LIST_SEPARATOR, header=True)
    suppliers = inputs.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return clean.exclude_values(suppliers, tables.read_exclude_values(spark, folder), "s_suppkey")


def multi_line_model(spark, sf_dir):
    """Word counts of documents trained from files whose cells hold line breaks, split cell by cell, no empty words."""
    folder = _folder(spark)
    rows = inputs.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    tables.write_table(rows.where("text is not null and lang is not null"), f"{folder}/learn")
    model = flows.train_from_files(
        spark, f"{folder}/learn", f"{folder}/model", ["lang"], tokenizer="cell", keep_empty=False, multi_line=True
    )
    return model.weights.groupBy("tag").agg(F.count("word").alias("words"), F.sum("count").alias("count"))


QUERIES = {
    f.__name__: f
    for f in (
        csv_round_trip,
        csv_mixed_headers,
        table_without_bookkeeping,
        stored_model,
        stored_column_names,
        decimal_table,
        exclude_listed,
        exclude_listed_values,
        multi_line_model,
    )
}
ORACLES = {
    "csv_round_trip": "SELECT doc_id::VARCHAR AS doc_id, text, lang, source FROM documents",
    "csv_mixed_headers": """SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey
        FROM customer""",
    "table_without_bookkeeping": "SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_type, p_brand FROM part",
    "stored_column_names": """SELECT * FROM (VALUES (0, 'p_partkey', false), (1, 'p_name', false),
        (2, 'p_type', true), (3, 'p_brand', true)) AS t(position, data_col_names, is_tag)
        WHERE (SELECT count(*) FROM part) > 0""",
    "decimal_table": """SELECT '' AS "Tag", o_orderdate::DATE AS "Date", o_orderkey::VARCHAR AS "Text",
        round(o_totalprice, 2)::DOUBLE AS "Amount" FROM orders""",
    "stored_model": f"""WITH {ln.weights_sql("(SELECT p_partkey || ' ' || p_name AS t, p_type, p_brand FROM part)",
                                             "p_partkey", "t", ln.PART_TAGS)} SELECT tag, tag_col, word, count FROM w""",
    "exclude_listed": "SELECT s_suppkey, upper(s_name) AS s_name, s_nationkey FROM supplier WHERE s_nationkey <> 3",
    "exclude_listed_values": """SELECT s_suppkey, s_name, s_nationkey FROM supplier
        WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""",
}
