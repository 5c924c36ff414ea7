"""What the plans must look like for large inputs."""

import re

import pytest
from pyspark.sql import functions as F

from lexitag.operators import model as md
from lexitag.operators import tag, words
from lexitag.operators.existing import split_existing
from lexitag.operators.profile import fill_values


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_counts_read_only_their_columns(documents):
    plan = plan_of(md.weights(documents.select("doc_id", "text", "lang"), "doc_id", ["lang"]))
    assert re.search(r"ReadSchema: struct<text:string,lang:string>", plan)


def test_counts_combine_before_they_shuffle(documents):
    plan = plan_of(md.weights(documents.select("doc_id", "text", "lang", "source"), "doc_id", ["lang", "source"]))
    # tags are unpivoted above the first aggregate, not below it
    assert plan.index("Expand") < plan.index("Generate explode")
    assert plan.count("Exchange") == 2 and plan.count("partial_") == 2


def test_no_window_over_a_word(documents):
    learn = documents.select("doc_id", "text", "lang", "source")
    rated = md.rate_words(md.weights(learn, "doc_id", ["lang", "source"]), ["lang", "source"])
    assert "Window" not in plan_of(rated)


def test_small_vocabularies_are_broadcast(spark, documents):
    model = md.train(documents.select("doc_id", "text", "lang"), "doc_id", ["lang"])
    asked = words.new_row_words(documents.select("doc_id", "text"), "doc_id", ["text"])
    plan = plan_of(tag.unique_stage(asked, model.unique, ["lang"]))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_no_cross_joins(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name", "p_type")
    old, rest = split_existing(part, part, "p_partkey")
    for df in (old, rest, fill_values(part, "p_type", ["p_name"])):
        plan = plan_of(df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_new_rows_do_not_carry_tags_through_stages(spark, documents):
    model = md.train(documents.select("doc_id", "text", "lang"), "doc_id", ["lang"])
    new = documents.select("doc_id", "text", F.lit("").alias("lang"))
    result = tag.tag_rows(new, model, "doc_id", ("unique",))
    assert result.columns == ["doc_id", "text", "lang", "TB_qual"]
    assert result.count() == documents.count()
